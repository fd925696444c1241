"""Edits of a text: (start, end, replacement), all in offsets of the original."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

Edit = tuple[int, int, str]


def apply_edits(text: str, edits: Iterable[Edit]) -> str:
    """``text`` with the edits made; equal edits count once, and one that overlaps an earlier one is left out."""
    out, at = [], 0
    for start, end, new in sorted(set(edits)):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]]) if out else text


def whole_lines(text: str, start: int, end: int) -> tuple[int, int]:
    """From the start of the line of ``start`` past the newline after ``end``, or to the end of the text."""
    stop = text.find("\n", end)
    return text.rfind("\n", 0, start) + 1, len(text) if stop < 0 else stop + 1


def drop_lines(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """``text`` without the lines of the spans."""
    merged: list[list[int]] = []
    for a, b in sorted({whole_lines(text, *s) for s in spans}):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return apply_edits(text, [(a, b, "") for a, b in merged])


def after_line(text: str, at: int) -> int:
    """The place after the first newline from ``at`` on; ``at`` where none follows."""
    stop = text.find("\n", at)
    return at if stop < 0 else stop + 1


def unified_diff(path: str, before: str, after: str, context: int = 3) -> str:
    """A unified diff with ``a/`` and ``b/`` headers; empty for equal texts."""
    a, b = (x.splitlines(keepends=True) if "\r" not in x and "\x0b" not in x else [y + "\n" for y in x.split("\n")[:-1]] + ([x.rsplit("\n", 1)[-1]] if x and not x.endswith("\n") else []) for x in (before, after))
    out = []
    for line in difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", n=context):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)
