"""``symbol``: renames identifiers in code, and leaves strings and comments alone.

For Go, Rust and Java the whole operator is a column expression: the text is
cut into a token array by one regular expression, the array is mapped, and
joined.  Renames that follow each other in a script go through one map.
Python's f-strings and JavaScript's template literals and regular expressions
need a lexer with state; they are rewritten in Arrow batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexers import JAVA_PATTERNS, KEYWORDS, Token, holes, lex
from .edits import Edit, apply_edits

_WORD = re.compile(r"(?:[^\W\d]|\$)[\w$]*")


def is_word(s: str) -> bool:
    return _WORD.fullmatch(s) is not None


def composed(renames: list[tuple[str, str]]) -> dict[str, str]:
    """One map that does the renames in order: ``a -> b, b -> c`` takes a to c."""
    out: dict[str, str] = {}
    for old, new in renames:
        for k, v in out.items():
            if v == old:
                out[k] = new
        out.setdefault(old, new)
    return {k: v for k, v in out.items() if k != v}


def renamed(lang: str, text: Column, renames: list[tuple[str, str]]) -> Column:
    """``text`` with the renames of a language whose tokens :data:`JAVA_PATTERNS` has, in order.

    The name in Go's package clause is no identifier: both are one token. Texts
    without any of the names are passed through unread.
    """
    table = composed([(a, b) for a, b in renames if a not in KEYWORDS[lang]])
    if not table:
        return text
    tokens = F.regexp_extract_all(text, F.lit(JAVA_PATTERNS[lang]), F.lit(0))
    swap = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))

    mapped = F.array_join(F.transform(tokens, lambda token: F.coalesce(F.element_at(swap, token), token)), "")
    hit = F.lit(False)
    for name in table:
        hit = hit | F.contains(text, F.lit(name))
    return F.when(hit, mapped).otherwise(text)


def _edits(lang: str, text: str, old: str, new: str, offset: int) -> list[Edit]:
    out: list[Edit] = []
    before: Token | None = None
    for t in lex(lang, text):
        if t.kind == "i" and t.text == old and not (lang == "go" and before is not None and before.text == "package"):
            out.append((offset + t.start, offset + t.end, new))
        elif lang == "python" and t.kind == "s":
            for a, b in holes(t):
                out += _edits(lang, text[a:b], old, new, offset + a)
        if t.kind not in "wnc":
            before = t
    return out


def rename(lang: str, text: str, old: str, new: str) -> str:
    """The same for one text, for all five languages."""
    if old in KEYWORDS[lang] or old not in text:
        return text
    return apply_edits(text, _edits(lang, text, old, new, 0))
