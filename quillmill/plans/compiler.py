"""Scripts to plans: a chain of projections over ``files(path, text)``, without a shuffle.

Each rule is gated by its own test of the path.  Renames that are column
expressions and follow each other in one language share one pass over the
tokens; rules that need a lexer and follow each other share one Arrow pass.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.lexers import JAVA_PATTERNS
from ..operators import symbols
from .dsl import expand, parse, read_script
from .registry import Registry, Rule, default_registry, relevant

#: Files to an Arrow batch: whole texts are large rows.
BATCH = 256


@dataclass(frozen=True)
class Plan:
    name: str
    rules: tuple[Rule, ...]

    def __str__(self) -> str:
        return f"Refactoring '{self.name}': [{', '.join(r.label for r in self.rules)}]"

    def relevant(self, path: Column) -> Column:
        """Paths that a rule is for."""
        return relevant(self.rules, path)

    def single(self, i: int) -> Plan:
        return Plan(self.name, (self.rules[i],))

    def apply(self, path: str, text: str) -> str:
        """The plan on one text, on the driver."""
        for r in self.rules:
            if r.takes(path):
                text = r.apply(text)
        return text


def compile_script(text: str, registry: Registry | None = None, base: str | None = None) -> Plan:
    """A script's plan. Includes need ``base``, the folder that their paths are relative to."""
    registry, command = registry or default_registry(), parse(text)
    return Plan(command.name, tuple(registry.rule(m) for m in expand(command, base)))


def compile_at_path(path: str, registry: Registry | None = None) -> Plan:
    """The plan of a script file; its own path counts for circular includes."""
    registry, command = registry or default_registry(), parse(read_script(path))
    real = os.path.realpath(path)
    return Plan(command.name, tuple(registry.rule(m) for m in expand(command, os.path.dirname(real), (real,))))


def _column_form(r: Rule) -> bool:
    return r.rename is not None and r.match.lang in JAVA_PATTERNS and (symbols.is_word(r.rename[1]))


def _steps(rules: tuple[Rule, ...]) -> Iterator[tuple[str | None, list[Rule]]]:
    """(language of a column step, or None for an Arrow step) and its rules."""
    for lang, group in groupby(rules, key=lambda r: r.match.lang if _column_form(r) else None):
        yield lang, list(group)


def _by_ending(rules: list[Rule]) -> Callable[[str], list[Rule]]:
    """The rules that may take a path, by what follows its last dot."""
    endings = [[None if s.startswith("/") and "." not in s else s.rpartition(".")[2] for s in r.suffixes] for r in rules]
    other = [r for r, known in zip(rules, endings, strict=True) if None in known]
    table = {e: [r for r, known in zip(rules, endings, strict=True) if e in known or None in known] for known in endings for e in known if e is not None}
    return lambda path: table.get(path[path.rfind(".") + 1 :], other)


def _arrow_step(rules: list[Rule]):
    """A function of Arrow columns that does the rules in order; texts that none of them is for never get here."""

    @F.arrow_udf(StringType())
    def run(path: pa.Array, text: pa.Array) -> pa.Array:
        # whole columns as objects: to_pylist makes a scalar of each value first
        out, some = text.to_numpy(zero_copy_only=False).tolist(), _by_ending(rules)
        for i, p in enumerate(path.to_numpy(zero_copy_only=False).tolist()):
            if p is not None and out[i] is not None:
                for r in some(p):
                    if r.takes(p):
                        out[i] = r.apply(out[i])
        return pa.array(out, pa.string())

    return run


def _gate(rules: list[Rule], path: Column, text: Column) -> Column:
    """Whether a rule may change the text: its path fits, and the text holds what it looks for."""
    tests = [r.relevant(path) & (F.contains(text, F.lit(r.needle)) if r.needle is not None else F.lit(True)) for r in rules]
    return reduce(lambda a, b: a | b, tests)


def rewritten(files: DataFrame, plan: Plan, path_col: str = "path", text_col: str = "text", out_col: str = "after") -> DataFrame:
    """``files`` with ``out_col``: the text after all rules. Null texts and paths stay as they are."""
    path, now = F.col(f"`{path_col}`"), F.col(f"`{text_col}`")
    out = files.withColumn(out_col, now)
    for lang, rules in _steps(plan.rules):
        now = F.col(out_col)
        if lang:
            new = F.when(rules[0].relevant(path), symbols.renamed(lang, now, [r.rename for r in rules])).otherwise(now)
        else:
            new = F.coalesce(_arrow_step(rules)(path, F.when(_any_step(rules, path, now), now)), now)
        out = out.withColumn(out_col, new)
    return out


def _any_step(rules: list[Rule], path: Column, text: Column) -> Column:
    # a rule may bring in what a later one looks for, so only the first rule's needle can be asked for alone
    if len(rules) == 1:
        return _gate(rules, path, text)
    return relevant(rules, path)


def changes(files: DataFrame, plan: Plan, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, before, after, changed) of every file that a rule is for; extra columns of ``files`` are left out.

    Only ``root_idx``, the number of a file's root, is kept if there is one, and
    stands first. A file whose text is null is left out.
    """
    root = ["root_idx"] if "root_idx" in files.columns and "root_idx" not in (path_col, text_col) else []
    picked = files.select(*root, F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("before"))
    picked = picked.filter(plan.relevant(F.col("path")) & F.col("before").isNotNull())
    out = rewritten(picked, plan, "path", "before", "after")
    return out.select(*root, "path", "before", "after", (F.col("before") != F.col("after")).alias("changed"))
