"""Lossless lexers for the five languages.

``lex`` cuts a text into tokens that join to the text again, whatever it holds:
what is not understood is a one-character token.  Offsets are code points.
Kinds: w blank, n newline, c comment, s string, i identifier or keyword,
d number, l lifetime, x regular expression, p anything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    text: str


#: Makes a token from a tuple; ``Token()`` itself takes twice as long.
_token = tuple.__new__


# Words that are never identifiers.
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota _",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while _ "
    "bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package "
    "private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "js": "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while "
    "with yield true false null undefined",
}
KEYWORDS = {lang: frozenset(words.split()) for lang, words in KEYWORDS.items()}

_BLANKS = r"(?P<n>\r?\n)|(?P<w>[^\S\n]+?(?=\r?\n)|[^\S\n]+)"
_C_COMMENT = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))"
_NUMBER = r"(?P<d>\d(?:[\w.]|(?<=[eE])[+-])*)"

_RULES = {
    "go": rf"""{_BLANKS}|{_C_COMMENT}|(?P<s>`[^`]*(?:`|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<i>[^\W\d]\w*)|{_NUMBER}|(?P<p>.)""",
    "java": rf'''{_BLANKS}|{_C_COMMENT}|(?P<s>"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<i>(?:[^\W\d]|\$)[\w$]*)|{_NUMBER}|(?P<p>.)''',
    "rust": rf"""{_BLANKS}|(?P<c>//[^\n]*)|(?P<b>/\*)|(?P<s>(?:b|c|br|cr|r)?(?P<hash>\#+)"(?:.*?)(?:"(?P=hash)|\Z)|(?:br|cr|r)"[^"]*(?:"|\Z)|(?:b|c)?"(?:\\.|[^"\\])*(?:"|\Z)|b?'(?:\\(?:u\{{[^}}]*\}}|x[0-9a-fA-F]{{2}}|.)|[^'\\\n])')|(?P<l>'[^\W\d]\w*)|(?P<i>r\#[^\W\d]\w*|[^\W\d]\w*)|{_NUMBER}|(?P<p>.)""",
    "python": rf"""{_BLANKS}|(?P<c>\#[^\n]*)|(?P<s>(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF]|[tT][rR]?|[rR][tT])?(?:'''(?:\\.|.)*?(?:'''|\Z)|\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?))|(?P<i>[^\W\d]\w*)|{_NUMBER}|(?P<p>.)""",
    "js": rf"""{_BLANKS}|{_C_COMMENT}|(?P<s>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<t>`)|(?P<i>(?:[^\W\d]|\$)[\w$]*)|(?P<h>\#[^\W\d][\w$]*)|{_NUMBER}|(?P<p>.)""",
}
_MASTER = {lang: re.compile(rule, re.S) for lang, rule in _RULES.items()}
_JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_NEST = re.compile(r"/\*|\*/")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def _nested_comment(text: str, at: int) -> int:
    depth = 0
    for m in _NEST.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template(text: str, at: int) -> Iterator[Token]:
    """Tokens of a JavaScript template literal that begins at ``at``: its text as strings, its holes as code."""
    start, i = at, at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            yield Token("s", start, i + 1, text[start : i + 1])
            return
        elif text.startswith("${", i):
            yield Token("s", start, i + 2, text[start : i + 2])
            depth, i = 1, i + 2
            for t in _lex_js(text, i):
                if t.kind == "p" and t.text in "{}":
                    depth += 1 if t.text == "{" else -1
                    if not depth:
                        start = i = t.start
                        i += 1
                        break
                yield t
                i = t.end
            else:
                return
        else:
            i += 1
    if start < len(text):
        yield Token("s", start, len(text), text[start:])


def _lex_js(text: str, at: int) -> Iterator[Token]:
    last: Token | None = None
    rule = _MASTER["js"]
    while at < len(text):
        if text[at] == "/" and not text.startswith(("//", "/*"), at):
            value = last is not None and (last.kind in "sdxh" or last.kind == "i" and last.text not in _BEFORE_REGEX or last.kind == "p" and last.text in ")]}")
            if not value and (m := _JS_REGEX.match(text, at)):
                last = Token("x", at, m.end(), m.group())
                yield last
                at = m.end()
                continue
        m = rule.match(text, at)
        if m.lastgroup == "t":
            for last in _template(text, at):
                yield last
                at = last.end
            continue
        kind = "p" if m.lastgroup == "h" else m.lastgroup
        t = Token(kind, at, m.end(), m.group())
        yield t
        if kind not in "wnc":
            last = t
        at = m.end()


def lex(lang: str, text: str, without: str = "") -> Iterator[Token]:
    """The tokens of ``text``; joined, they are ``text``. Kinds in ``without`` are left out."""
    if lang == "js":
        yield from (t for t in _lex_js(text, 0) if t.kind not in without)
        return
    if lang != "rust":  # every character is matched, so the matches follow each other
        for m in _MASTER[lang].finditer(text):
            kind = m.lastgroup
            if kind not in without:
                yield _token(Token, (kind, m.start(), m.end(), m.group()))
        return
    rule, at = _MASTER[lang], 0
    while at < len(text):
        m = rule.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "hash":
            kind = "s"
        if kind == "b":
            kind, end = "c", _nested_comment(text, at)
        if kind not in without:
            yield _token(Token, (kind, at, end, text[at:end]))
        at = end


def code(lang: str, text: str) -> list[Token]:
    """The tokens without blanks, newlines and comments."""
    return list(lex(lang, text, "wnc"))


_FSTRING = re.compile(r"(?i)^(?:f|fr|rf|t|tr|rt)('''|\"\"\"|'|\")")


def holes(token: Token) -> Iterator[tuple[int, int]]:
    """(start, end) of the code in a Python f-string's braces; nothing for other strings."""
    m = _FSTRING.match(token.text)
    if not m:
        return
    raw = token.text
    i, end = m.end(), len(raw) - (len(m[1]) if raw.endswith(m[1]) and len(raw) >= m.end() + len(m[1]) else 0)
    while i < end:
        if raw.startswith(("{{", "}}"), i):
            i += 2
        elif raw[i] == "{":
            depth, j = 1, i + 1
            while j < end and depth:
                depth += {"{": 1, "[": 1, "(": 1, "}": -1, "]": -1, ")": -1}.get(raw[j], 0)
                j += 1
            stop = j - (depth == 0)
            # a conversion or format at the end is no code, but holes within the format are
            yield token.start + i + 1, token.start + stop
            i = j
        else:
            i += 1


# The same tokens as one pattern for Java's regular expressions, for column expressions. Loops are possessive: no stack grows with a text.
def _nest(depth: int) -> str:
    inner = r"[^*/]++|\*(?!/)|/(?!\*)"
    return rf"/\*(?:{inner}|{_nest(depth - 1)})*+(?:\*/|\z)" if depth else rf"/\*(?:{inner})*+(?:\*/|\z)"


#: Rust's comments are nested; Java's regular expressions can't count, so theirs end after so many levels.
NESTED = 32
_LETTER, _DIGIT = r"[\p{L}\p{Nl}\p{No}_]", r"\p{Nd}(?:[\p{L}\p{N}_.]|(?<=[eE])[+-])*+"
_REST = r"[\p{L}\p{N}_]*+"
_C_STYLE = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_QUOTED = r'''"(?:[^"\\\n]|\\(?s:.))*+"?+|'(?:[^'\\\n]|\\(?s:.))*+'?+'''
_BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]++"
_ELSE = rf"{_BLANK}|(?s:.)"


JAVA_PATTERNS = {
    "go": rf"""{_C_STYLE}|`[^`]*+(?:`|\z)|{_QUOTED}|(?:package(?:{_BLANK}|{_C_STYLE})++)++{_LETTER}{_REST}|{_LETTER}{_REST}|{_DIGIT}|{_ELSE}""",
    "java": rf'''{_C_STYLE}|"""(?s:\\.|(?!""").)*+(?:"""|\z)|{_QUOTED}|{_LETTER.replace("_]", "_$]")}{_REST.replace("_]", "_$]")}|{_DIGIT}|{_ELSE}''',
    "rust": rf"""//[^\n]*+|{_nest(NESTED)}|(?:br|cr|b|c|r)?(#++)"(?s:.*?)(?:"\1|\z)|(?:br|cr|r)"[^"]*+(?:"|\z)|[bc]?+"(?s:[^"\\]|\\.)*+(?:"|\z)|b?+'(?:\\(?:u\{{[^}}]*+\}}|x[0-9a-fA-F]{{2}}|(?s:.))|[^'\\\n])'|'{_LETTER}{_REST}|r#{_LETTER}{_REST}|{_LETTER}{_REST}|{_DIGIT}|{_ELSE}""",
}
