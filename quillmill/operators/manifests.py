"""``struct_tag`` of Go and ``crate`` of Cargo manifests."""

from __future__ import annotations

import re
import tomllib

from ..functions.lexers import code
from .edits import apply_edits

_OPEN, _SHUT = "([{", ")]}"

#: Tables whose keys are dependencies.
DEPENDENCY_TABLES = ("dependencies", "dev-dependencies", "build-dependencies")


def rename_tag(text: str, old: str, new: str) -> str:
    """``key:value`` pairs in the tags of struct fields; a pair without a colon leaves the text as it is."""
    if ":" not in old or ":" not in new:
        return text
    needle, repl = ('{}:"{}"'.format(*x.split(":", 1)) for x in (old, new))
    if needle not in text and needle.replace('"', '\\"') not in text:
        return text
    edits, stack, tokens = [], [], code("go", text)
    for i, t in enumerate(tokens):
        if t.kind == "p" and t.text in _OPEN:
            stack.append(t.text == "{" and i > 0 and tokens[i - 1].text == "struct")
        elif t.kind == "p" and t.text in _SHUT and stack:
            stack.pop()
        elif t.kind == "s" and stack and stack[-1]:
            inner, at = t.text[1:-1], 0
            while (k := inner.find(needle, at)) >= 0:
                if k == 0 or inner[k - 1] == " ":
                    edits.append((t.start + 1 + k, t.start + 1 + k + len(needle), repl))
                at = k + len(needle)
    return apply_edits(text, edits)


_HEADER = re.compile(r"[ \t]*(\[\[?)([^\[\]]*)\]\]?[ \t]*(?:#[^\n]*)?\r?\n?\Z")


def _valid(text: str, key: str) -> bool:
    """Whether the text is TOML and a dependency table has the key."""
    try:
        doc = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError, RecursionError):
        return False
    return any(isinstance(doc.get(t), dict) and key in doc[t] for t in DEPENDENCY_TABLES)


def _lines(text: str):
    """(line, section that it stands in, name if it is a header) of a manifest."""
    section = None
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        m = _HEADER.match(line)
        if m:
            section = m[2].strip() if m[1] == "[" else None
            yield line, section, m[2].strip() if m[1] == "[" else ""
        else:
            yield line, section, None


def _declares(line: str, key: str) -> bool:
    return re.match(rf"\s*{re.escape(key)}[= \t]", line) is not None


def rename_crate(text: str, old: str, new: str) -> str:
    """A dependency's key renamed, inline and in headers like ``[dependencies.key]``; other bytes stay."""
    if not _valid(text, old):
        return text
    out = []
    for line, section, header in _lines(text):
        if header is not None:
            parent, _, leaf = header.rpartition(".")
            if parent in DEPENDENCY_TABLES and leaf == old:
                i = line.rindex(old, 0, line.index("]"))
                line = line[:i] + new + line[i + len(old) :]
        elif section in DEPENDENCY_TABLES and _declares(line, old):
            i = line.index(old)
            line = line[:i] + new + line[i + len(old) :]
        out.append(line)
    return "".join(out)


def delete_crate(text: str, target: str) -> str:
    """The manifest without the dependency: its line, or its table up to the next header."""
    if not _valid(text, target):
        return text
    out, dropping = [], False
    for line, section, header in _lines(text):
        if header is not None:
            parent, _, leaf = header.rpartition(".")
            dropping = parent in DEPENDENCY_TABLES and leaf == target
        if dropping or header is None and section in DEPENDENCY_TABLES and _declares(line, target):
            continue
        out.append(line)
    return "".join(out)
