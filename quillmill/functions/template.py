"""Call templates: ``$1``, ``$args``, ``$func`` and ``$$``.

A template is cut once into segments; the same segments render in Python and
as a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOLE = re.compile(r"\$(?:(\$)|(args)|(func)|([0-9]+))")


def segments(template: str) -> list[tuple[str, str | int]]:
    """("text", s), ("args", ""), ("func", "") or ("arg", n), left to right; a ``$`` before anything else is text."""
    out: list[tuple[str, str | int]] = []
    at = 0
    for m in _HOLE.finditer(template):
        out.append(("text", template[at : m.start()]))
        at = m.end()
        out.append(("text", "$") if m[1] else ("args", "") if m[2] else ("func", "") if m[3] else ("arg", int(m[4])))
    out.append(("text", template[at:]))
    return [s for s in out if s != ("text", "")]


def render(template: str, name: str, args: Sequence[str]) -> str:
    """Arguments count from 1; one that is out of range is empty."""
    parts = []
    for kind, value in segments(template):
        if kind == "arg":
            parts.append(args[value - 1] if 1 <= value <= len(args) else "")
        else:
            parts.append(", ".join(args) if kind == "args" else name if kind == "func" else value)
    return "".join(parts)


def render_column(template: str, name: Column, args: Column) -> Column:
    """The same over a string column and an array column."""
    parts = []
    for kind, value in segments(template):
        if kind == "arg":
            parts.append(F.coalesce(F.get(args, F.lit(value - 1)), F.lit("")) if value else F.lit(""))
        else:
            parts.append(F.array_join(args, ", ") if kind == "args" else name if kind == "func" else F.lit(value))
    return F.concat(*parts) if parts else F.lit("")
