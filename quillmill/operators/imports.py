"""``import``, ``use`` and ``package``: statements that bring names in.

Each language has one function that finds its statements as
:class:`Statement` rows; replace, delete and ensure are the same for all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

from ..functions.lexers import Token, code, lex
from .edits import after_line, apply_edits, drop_lines


class Statement(NamedTuple):
    start: int  # of what delete takes away
    end: int
    name: str  # what the target is compared with
    at: int  # where the name stands
    stop: int


_OPEN, _SHUT = "([{", ")]}"


def go_imports(text: str) -> Iterator[Statement]:
    """Import specs; the name is the path in double quotes."""
    tokens, depth, i = code("go", text), 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "p" and t.text in _OPEN:
            depth += 1
        elif t.kind == "p" and t.text in _SHUT:
            depth -= 1
        elif not depth and t.kind == "i" and t.text == "import" and i + 1 < len(tokens):
            block = tokens[i + 1].text == "("
            i += 2 if block else 1
            first: Token | None = None
            while i < len(tokens) and tokens[i].text != ")":
                s = tokens[i]
                first = first or s
                if s.kind == "s":
                    yield Statement(first.start, s.end, s.text.strip('"'), s.start, s.end)
                    first = None
                    if not block:
                        break
                elif s.text == ";":
                    first = None
                elif not block and s.kind not in "ip":
                    break
                i += 1
        i += 1


def rust_uses(text: str) -> Iterator[Statement]:
    """``use`` declarations at any depth; the name is all that stands before the semicolon."""
    tokens = code("rust", text)
    for i, t in enumerate(tokens):
        if t.kind != "i" or t.text != "use" or i + 1 >= len(tokens):
            continue
        k = i
        if k and tokens[k - 1].text == ")":  # pub(crate)
            j = k - 1
            while j and tokens[j].text != "(":
                j -= 1
            if j and tokens[j - 1].text == "pub":
                k = j - 1
        elif k and tokens[k - 1].text in ("pub", "crate"):
            k -= 1
        if k and not (tokens[k - 1].kind == "p" and tokens[k - 1].text in ";{}]"):
            continue
        j = i + 1
        while j < len(tokens) and tokens[j].text != ";":
            j += 1
        last = tokens[min(j, len(tokens) - 1)]
        name = text[tokens[i + 1].start : tokens[j - 1].end]
        yield Statement(tokens[k].start, last.end, name, tokens[i + 1].start, tokens[j - 1].end)


def _java(text: str, word: str) -> Iterator[Statement]:
    """Statements that begin with ``word``; the text is read no further than the caller goes on."""
    if word not in text:
        return
    rest = lex("java", text, "wnc")
    tokens: list[Token] = []

    def has(i: int) -> bool:
        if i == len(tokens):
            tokens.extend(islice(rest, 1))
        return i < len(tokens)

    depth, i = 0, 0
    while has(i):
        t = tokens[i]
        if t.kind == "p" and t.text in _OPEN:
            depth += 1
        elif t.kind == "p" and t.text in _SHUT:
            depth -= 1
        elif not depth and t.kind == "i" and t.text == word and (not i or tokens[i - 1].text in ("", ";", "}", ")") or word == "package"):
            j = i + 1
            if has(j) and tokens[j].text == "static":
                j += 1
            first = j
            while has(j) and tokens[j].text != ";":
                j += 1
            last = j - 1
            if last - first >= 2 and tokens[last].text == "*":
                last -= 2
            if first <= last:
                end = tokens[min(j, len(tokens) - 1)].end
                name = "".join(x.text for x in tokens[first : last + 1])
                yield Statement(t.start, end, name, tokens[first].start, tokens[last].end)
        i += 1


def java_imports(text: str) -> Iterator[Statement]:
    """Imports, static ones too; the name of ``a.b.*`` is ``a.b``."""
    return _java(text, "import")


def java_packages(text: str) -> Iterator[Statement]:
    """The package declaration: the first one alone counts."""
    yield from islice(_java(text, "package"), 1)


def _statements(text: str) -> Iterator[list[Token]]:
    """Python's simple statements, each as its tokens; blocks' headers end at the colon."""
    depth, line = 0, []
    for t in lex("python", text, "wc"):
        if t.kind == "p" and t.text in _OPEN:
            depth += 1
        elif t.kind == "p" and t.text in _SHUT:
            depth = max(0, depth - 1)
        if t.kind == "n":
            if depth or line and line[-1].text == "\\":
                continue
            if line:
                yield line
            line = []
        elif not depth and t.kind == "p" and t.text in ";:" and not (t.text == ":" and line and line[0].text == "lambda"):
            if line:
                yield line
            line = []
        else:
            line.append(t)
    if line:
        yield line


def python_imports(text: str) -> Iterator[Statement]:
    """``import`` names and ``from`` modules, dots joined; relative and ``__future__`` imports are left out."""
    for s in _statements(text):
        s = [t for t in s if t.text != "\\"]
        if len(s) < 2 or s[0].kind != "i" or s[0].text not in ("import", "from"):
            continue
        names: list[list[Token]] = [[]]
        for t in s[1:]:
            if t.kind == "i" and t.text == ("as" if s[0].text == "import" else "import"):
                if s[0].text == "from":
                    break
                names[-1].append(t)
            elif s[0].text == "import" and t.text == ",":
                names.append([])
            else:
                names[-1].append(t)
        for n in names:
            cut = next((k for k, t in enumerate(n) if t.text == "as"), len(n))
            n = n[:cut]
            if n and n[0].kind == "i" and n[0].text != "__future__":
                yield Statement(s[0].start, s[-1].end, "".join(t.text for t in n), n[0].start, n[-1].end)


def js_imports(text: str) -> Iterator[Statement]:
    """``import`` and ``export … from`` statements; the name is what stands between the quotes."""
    tokens, depth, i = code("js", text), 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "p" and t.text in _OPEN:
            depth += 1
        elif t.kind == "p" and t.text in _SHUT:
            depth -= 1
        elif not depth and t.kind == "i" and t.text in ("import", "export") and i + 1 < len(tokens) and not (i and tokens[i - 1].text == "."):
            j, nest, source = i + 1, 0, None
            if t.text == "import" and tokens[j].kind == "s":
                source = tokens[j]
            elif t.text == "import" and tokens[j].text in "(." or t.text == "export" and tokens[j].text not in ("*", "{", "type"):
                i += 1
                continue
            else:
                while j < len(tokens) and tokens[j].text != ";":
                    x = tokens[j]
                    nest += (x.kind == "p" and x.text in _OPEN) - (x.kind == "p" and x.text in _SHUT)
                    if not nest and x.kind == "i" and x.text == "from" and j + 1 < len(tokens) and tokens[j + 1].kind == "s":
                        source = tokens[j + 1]
                        j += 1
                        break
                    if not nest and x.kind == "p" and x.text not in "{}*,":
                        break
                    j += 1
            if source is not None:
                end = source.end
                if j + 2 < len(tokens) and tokens[j + 1].text in ("with", "assert") and tokens[j + 2].text == "{":
                    while j < len(tokens) and tokens[j].text != "}":
                        j += 1
                    end = tokens[min(j, len(tokens) - 1)].end
                if j + 1 < len(tokens) and tokens[j + 1].text == ";":
                    j += 1
                    end = tokens[j].end
                yield Statement(t.start, end, source.text[1:-1], source.start + 1, source.end - 1)
                i = j
        i += 1


FIND: dict[str, Callable[[str], Iterator[Statement]]] = {"go": go_imports, "rust": rust_uses, "java": java_imports, "python": python_imports, "js": js_imports}
#: What may follow the target in a longer name; languages that aren't here compare whole names.
BOUNDARY = {"rust": ("::", " ", "\t", "\n", ";"), "python": (".",)}


def covers(lang: str, target: str, name: str) -> bool:
    """Whether the target is the name, or a prefix of it in whole segments."""
    return name == target or name.startswith(target) and name[len(target) :].startswith(BOUNDARY.get(lang, ())) if lang in BOUNDARY else name == target


def replace(lang: str, text: str, old: str, new: str) -> str:
    """Every matching name with the target in it replaced; Go's paths get double quotes."""
    edits = []
    for s in FIND[lang](text):
        if covers(lang, old, s.name):
            if lang == "go":
                edits.append((s.at, s.stop, f'"{new}"'))
            elif lang in BOUNDARY and text.startswith(old, s.at):
                edits.append((s.at, s.at + len(old), new))
            elif lang in BOUNDARY:  # blanks or line breaks within the name
                edits.append((s.at, s.stop, new + s.name[len(old) :]))
            else:
                edits.append((s.at, s.stop, new))
    return apply_edits(text, edits)


def delete(lang: str, text: str, target: str) -> str:
    """The text without the lines of matching statements."""
    return drop_lines(text, [(s.start, s.end) for s in FIND[lang](text) if covers(lang, target, s.name)])


def _go_place(text: str) -> int:
    tokens = lex("go", text, "wnc")
    for t in tokens:
        if t.text == "package":
            return next((after_line(text, name.end) for name in tokens), 0)
    return 0


def _java_place(text: str) -> int:
    return next((after_line(text, s.end) for s in java_packages(text)), 0)


def _rust_place(text: str) -> int:
    """After leading comments and inner attributes."""
    place, tokens, i = 0, [t for t in lex("rust", text) if t.kind not in "wn"], 0
    while i < len(tokens):
        if tokens[i].kind == "c":
            # a comment counts only if an inner attribute or an inner doc comment stands here
            inner = tokens[i].text.startswith(("//!", "/*!"))
            if inner:
                place = after_line(text, tokens[i].end)
        elif tokens[i].text == "#" and i + 2 < len(tokens) and tokens[i + 1].text == "!" and tokens[i + 2].text == "[":
            depth = 0
            while i < len(tokens):
                depth += (tokens[i].text == "[") - (tokens[i].text == "]")
                i += 1
                if not depth and tokens[i - 1].text == "]":
                    break
            i -= 1
            place = after_line(text, tokens[i].end)
        else:
            break
        i += 1
    return place


#: Blanks and comments, and after them neither a string nor ``from``.
_OTHER_FIRST = re.compile(r"""(?:\s|#[^\n]*+|[;:])*+(?!["'fFrRbBuUtT])""")


def _python_place(text: str) -> int:
    """After a shebang, an encoding line, leading strings and ``__future__`` imports; what follows these is not read."""
    place = 0
    for line in text.split("\n", 2)[:2]:
        if line.startswith("#!") and place == 0 or line.startswith("#") and "coding" in line:
            place += len(line) + 1
        else:
            break
    place = min(place, len(text))
    if _OTHER_FIRST.match(text):
        return place
    depth, count, future = 0, 0, False  # of the statement so far
    last: Token | None = None
    for t in lex("python", text, "wc"):
        if t.kind == "p" and t.text in _OPEN:
            depth += 1
        elif t.kind == "p" and t.text in _SHUT:
            depth = max(0, depth - 1)
        if t.kind == "n" and (depth or last is not None and last.text == "\\"):
            continue
        if t.kind == "n" or not depth and t.kind == "p" and t.text in ";:":
            if future and count == 1:
                return place
            if last is not None:
                place = after_line(text, last.end)
            count, future, last = 0, False, None
            continue
        if not count:
            future = t.text == "from"
        if t.kind != "s" and not future or count == 1 and future and t.text != "__future__":
            return place
        count, last = count + 1, t
    return place if last is None or future and count == 1 else after_line(text, last.end)


#: How comments begin in the languages whose names may be broken by blanks and comments.
_COMMENT = {"python": "#", "java": "/"}


@lru_cache(256)
def _odd(target: str) -> bool:
    return re.search(r"[\s\\#/]", target) is not None


def _may_name(lang: str, text: str, target: str) -> bool:
    """A quick test that fails only for texts in which no statement's name begins with the target."""
    if target in text or lang not in _COMMENT:
        return target in text
    if _odd(target):
        return True
    dense, mark = "".join(text.split()).replace("\\", ""), _COMMENT[lang]
    return target in dense or mark in dense and any(target[:k] + mark in dense for k in range(1, len(target)))


def ensure(lang: str, text: str, target: str) -> str:
    """The text with a statement for the target put near its top, unless one covers it."""
    if _may_name(lang, text, target) and any(covers(lang, target, s.name) for s in FIND[lang](text)):
        return text
    if lang == "go":
        at, line = _go_place(text), f'\nimport "{target}"\n'
    elif lang == "java":
        at, line = _java_place(text), f"\nimport {target};\n"
    elif lang == "rust":
        at, line = _rust_place(text), f"use {target};\n"
    else:
        at, line = _python_place(text), f"import {target}\n"
    if at and text[at - 1] != "\n" and lang in ("rust", "python"):
        line = "\n" + line
    return text[:at] + line + text[at:]


def replace_package(text: str, old: str, new: str) -> str:
    """Java's package declaration with another name, if it has the old one."""
    return apply_edits(text, [(s.at, s.stop, new) for s in java_packages(text) if s.name == old])
