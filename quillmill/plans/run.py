"""What is done with changes: events, summaries, diffs, checks, verified and bisected runs."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.edits import unified_diff
from ..sources import sinks
from ..sources.tables import kept
from .compiler import Plan, changes, rewritten

FORMATS = ("human", "json", "ndjson", "diff")
MODES = ("write", "dry-run", "check")


def _root(df: DataFrame) -> list[str]:
    """What orders files besides their paths, if the source told."""
    return [c for c in ("root_idx",) if c in df.columns]


def file_events(ch: DataFrame) -> DataFrame:
    """One JSON object a processed file, unchanged ones too; sizes are UTF-8 bytes."""
    event = F.struct(
        F.lit("file").alias("type"), "path", "changed", F.octet_length("before").cast("long").alias("bytes_before"), F.octet_length("after").cast("long").alias("bytes_after")
    )
    return ch.select(*_root(ch), "path", F.to_json(event).alias("event"))


def summary(ch: DataFrame, *by: str) -> DataFrame:
    """Files seen and changed and their bytes, overall or by columns: one partial row a task is all that is shuffled."""
    counts = (
        F.count("*").alias("files_seen"),
        F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).alias("files_changed"),
        F.coalesce(F.sum(F.octet_length("before").cast("long")), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.octet_length("after").cast("long")), F.lit(0)).alias("bytes_after"),
    )
    return ch.groupBy(*by).agg(*counts)


def language() -> Column:
    """Name of the language of ``path``, or null."""
    from .registry import SUFFIXES

    out = F.when((F.col("path") == "Cargo.toml") | F.col("path").endswith("/Cargo.toml"), "rust")
    for lang, exts in SUFFIXES.items():
        out = out.when(F.col("path").rlike(rf"[^/]\.(?:{'|'.join(exts)})$"), lang)
    return out


def human_lines(ch: DataFrame, mode: str = "dry-run") -> DataFrame:
    """A line for each changed file."""
    verb = "Wrote" if mode == "write" else "Would change"
    return ch.filter("changed").select(*_root(ch), "path", F.concat(F.lit(f"{verb} "), F.col("path")).alias("line"))


def summary_line(row, elapsed_ms: int = 0) -> str:
    return f"Done: {row['files_seen']} file(s) seen, {row['files_changed']} changed, {row['bytes_before']} → {row['bytes_after']} bytes in {elapsed_ms} ms"


@F.arrow_udf(StringType())
def _diff(path: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    return pa.array([unified_diff(*x) for x in zip(path.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True)], pa.string())


def diff_column() -> Column:
    """The unified diff of ``before`` and ``after``."""
    return _diff("path", "before", "after")


def diffs(ch: DataFrame) -> DataFrame:
    """(path, diff) of changed files, with their root if it is known."""
    return ch.filter("changed").select(*_root(ch), "path", _diff("path", "before", "after").alias("diff"))


def in_order(df: DataFrame) -> DataFrame:
    """By root as given, then by path, segment by segment: the one sort that a run can have."""
    return df.orderBy(*_root(df), F.split("path", "/"))


def resolve_mode(fmt: str = "human", write: bool = False, dry_run: bool = False, check: bool = False, terminal: bool = False) -> str:
    """check, write and dry-run as asked for, in this order; else human output on a terminal writes."""
    if check:
        return "check"
    if write:
        return "write"
    if dry_run:
        return "dry-run"
    return "write" if fmt == "human" and terminal else "dry-run"


def hits(files: DataFrame, plan: Plan, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(rule_idx, rule, files_seen, files_changed) of each rule on its own, in one job."""
    out = None
    for i, r in enumerate(plan.rules):
        one = summary(changes(files, plan.single(i), path_col, text_col)).select(F.lit(i).alias("rule_idx"), F.lit(r.label).alias("rule"), "files_seen", "files_changed")
        out = one if out is None else out.unionByName(one)
    return out


def prefixes(files: DataFrame, plan: Plan) -> DataFrame:
    """(path, texts): the text before any rule and after each one, worked out once for all prefixes of the plan."""
    out = files.filter(plan.relevant(F.col("path"))).select(*_root(files), "path", F.col("text").alias("t0"))
    for i in range(len(plan.rules)):
        out = rewritten(out, plan.single(i), "path", f"t{i}", f"t{i + 1}")
    return out.select(*_root(files), "path", F.array(*(f"t{i}" for i in range(len(plan.rules) + 1))).alias("texts"))


@dataclass(frozen=True)
class Outcome:
    ok: bool
    culprit: int | None = None
    label: str | None = None
    files_changed: int = 0


def bisect(texts: DataFrame, plan: Plan, verify: Callable[[DataFrame], bool]) -> Outcome:
    """The first rule whose prefix fails ``verify``, which gets (path, before, after, changed) of a prefix.

    Assumes, as any bisection, that once a prefix fails all longer ones do.
    """

    def of(n: int) -> DataFrame:
        return texts.select("path", F.col("texts")[0].alias("before"), F.col("texts")[n].alias("after")).withColumn("changed", F.col("before") != F.col("after"))

    if verify(of(len(plan.rules))):
        return Outcome(True, files_changed=of(len(plan.rules)).filter("changed").count())
    low, high = 0, len(plan.rules)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if verify(of(mid)) else (low, mid)
    return Outcome(False, high - 1, plan.rules[high - 1].label)


def stepwise(load: Callable[[], DataFrame], plan: Plan, verify: Callable[[], bool] | None = None, commit: Callable[[str], None] | None = None, backup: str | None = None) -> Outcome:
    """Each rule alone, written before the next is read. A rule after which ``verify`` fails is taken back, and the run ends."""
    total = 0
    for i in range(len(plan.rules)):
        one = plan.single(i)
        ch = kept(changes(load(), one).filter("changed"))
        n = ch.count()
        if backup and n:
            sinks.backup(ch, backup)
        sinks.write_files(ch)
        if verify is not None and not verify():
            sinks.write_files(ch, "before")
            return Outcome(False, i, plan.rules[i].label, total)
        total += n
        if commit is not None and n:
            commit(plan.rules[i].label)
    return Outcome(True, files_changed=total)


def shell(command: str, cwd: str | None = None) -> Callable[[], bool]:
    """``sh -c`` as a check: true for exit code 0."""
    return lambda: subprocess.run(["sh", "-c", command], cwd=cwd, check=False).returncode == 0


def git_commit(cwd: str) -> Callable[[str], None]:
    def commit(label: str) -> None:
        subprocess.run(["git", "add", "-u"], cwd=cwd, check=True)
        subprocess.run(["git", "commit", "-qm", f"codemod: {label}"], cwd=cwd, check=True)

    return commit


def apply(files: DataFrame, plan: Plan, mode: str = "dry-run", backup: str | None = None) -> tuple[DataFrame, dict]:
    """(changes, summary). All changes are worked out and kept in a table before the first file is written."""
    began = time.monotonic()
    ch = kept(changes(files, plan)) if mode == "write" else changes(files, plan).cache()
    s = summary(ch).collect()[0].asDict()
    if mode == "write":
        if backup:
            sinks.backup(ch, backup)
        sinks.write_files(ch)
    return ch, s | {"elapsed_ms": int(1000 * (time.monotonic() - began))}
