"""Functions for editors and agents: lint, preview, apply and completion."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..errors import EngineError
from ..sources import files
from . import run
from .compiler import changes, compile_script
from .registry import Registry, default_registry


def checked(script: str, registry: Registry | None = None) -> dict:
    """Name and number of rules of a good script; of a bad one what is wrong, and the exit code that running it would end with."""
    try:
        plan = compile_script(script, registry)
    except EngineError as e:
        return {"ok": False, "error": str(e), "exit_code": e.exit_code}
    return {"ok": True, "name": plan.name, "rule_count": len(plan.rules)}


def lint_script(script: str, registry: Registry | None = None) -> list[dict]:
    """Nothing for a good script; else one finding with the exit code that running it would end with."""
    try:
        compile_script(script, registry)
    except EngineError as e:
        return [{"line": 0, "column": 0, "severity": "error", "code": e.exit_code, "message": str(e)}]
    return []


def preview(spark: SparkSession, script: str, path: str | list[str], registry: Registry | None = None) -> list[dict]:
    """An object for each processed file; changed ones have a diff. Includes are refused, as the script has no path."""
    plan = compile_script(script, registry)
    from pyspark.sql import functions as F

    return list(reports(changes(files.tree(spark, path, relevant=plan.relevant(F.col("path"))), plan)))


def reports(ch) -> Iterator[dict]:
    """An object for each processed file, in order, as they come; changed ones have a diff."""
    from pyspark.sql import functions as F

    rows = ch.select("root_idx", "path", "changed", F.octet_length("before").alias("b"), F.octet_length("after").alias("a"), F.when(F.col("changed"), run.diff_column()).alias("diff"))
    for r in run.in_order(rows).toLocalIterator():
        yield {"path": r["path"], "changed": r["changed"], "bytes_before": r["b"], "bytes_after": r["a"]} | ({"diff": r["diff"]} if r["changed"] else {})


def apply(spark: SparkSession, script: str, path: str | list[str], registry: Registry | None = None) -> dict:
    """Writes the changes in place and returns the summary."""
    from pyspark.sql import functions as F

    plan = compile_script(script, registry)
    return run.apply(files.tree(spark, path, relevant=plan.relevant(F.col("path"))), plan, "write")[1]


def line_prefix(text: str, line: int, column: int) -> str:
    """A line's text up to the cursor; both count from 0."""
    lines = text.split("\n")
    return lines[line][:column] if line < len(lines) else ""


# Item kinds of the language server protocol.
_MODULE, _KEYWORD = 9, 14


def _item(label: str, kind: int, detail: str, snippet: str | None = None, plain: str | None = None) -> dict:
    """An item in the protocol's own terms; text to insert is a snippet (2) or plain (1)."""
    out = {"label": label, "kind": kind, "detail": detail}
    if snippet is not None:
        return out | {"insertText": snippet, "insertTextFormat": 2}
    return out | ({"insertText": plain, "insertTextFormat": 1} if plain is not None else {})


_WITH_TEXT = {"replace": 'replace "$1"', "replace_call": 'replace_call "$1"'}


def complete(before: str, registry: Registry | None = None) -> list[dict]:
    """What can stand next, after all of the script up to the cursor."""
    r = registry or default_registry()
    code = re.sub(r'"[^"]*"|//[^\n]*', lambda m: '""' if m[0][0] == '"' else "", before)
    if m := re.search(r'match\s+(\w+)::(\w+)\s+""\s*\{\s*\w*$', code):
        if m[1] not in r.languages():
            return []
        return [_item(a.name, _KEYWORD, a.description, _WITH_TEXT.get(a.name, a.name)) for x in r.get(m[1]).modules if x.name == m[2] for a in x.actions]
    if m := re.search(r"match\s+(\w+)::\w*$", code):
        return [_item(x.name, _MODULE, x.description) for x in r.get(m[1]).modules] if m[1] in r.languages() else []
    if re.search(r"match\s+\w*$", code):
        return [_item(x, _MODULE, r.get(x).description, plain=f"{x}::") for x in r.languages()]
    if re.search(r'refactor\s+""\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*$', code):
        return [_item("match", _KEYWORD, "A rule", 'match $1::$2 "$3" { $0 }'), _item("include", _KEYWORD, "The rules of another script", 'include "$1"')]
    return [_item("refactor", _KEYWORD, "A script", 'refactor "$1" {\n    $0\n}')] if not code.strip() or re.fullmatch(r"\s*\w*", code) else []
