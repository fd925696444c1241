"""A thin command line over the API: ``python -m quillmill.cli refactor --script s.codemod PATH``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import WOULD_CHANGE, ConfigError, EngineError
from .plans import api, dsl, registry, run
from .plans.compiler import Plan, compile_at_path, compile_script
from .sources import files, sinks
from .sources.tables import kept


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("refactor", help="run a script over trees of files")
    r.add_argument("--script", required=True)
    r.add_argument("-C", "--change-dir", default=".")
    r.add_argument("--format", choices=run.FORMATS, default="human")
    mode = r.add_mutually_exclusive_group()
    mode.add_argument("--write", action="store_true")
    mode.add_argument("--dry-run", action="store_true")
    mode.add_argument("--check", action="store_true")
    r.add_argument("--stdin", action="store_true")
    r.add_argument("--path", dest="hint")
    r.add_argument("--include", action="append", default=[])
    r.add_argument("--exclude", action="append", default=[])
    r.add_argument("--no-ignore", action="store_true")
    r.add_argument("--changed-since")
    r.add_argument("--staged", action="store_true")
    r.add_argument("--jobs", type=int, default=int(os.environ.get("QUILLMILL_JOBS") or 0) or None)
    r.add_argument("--summary-only", action="store_true")
    r.add_argument("--verify")
    r.add_argument("--commit-per-rule", action="store_true")
    r.add_argument("--bisect")
    r.add_argument("--backup")
    r.add_argument("paths", nargs="*", default=["."])
    sub.add_parser("schema")
    sub.add_parser("list-languages")
    sub.add_parser("list-rules").add_argument("lang")
    sub.add_parser("explain").add_argument("script")
    sub.add_parser("lint").add_argument("script")
    sub.add_parser("pack").add_argument("what", choices=["list"])
    sub.add_parser("serve", help="JSON-RPC over standard input and output").add_argument("kind", choices=["tools", "language"])
    sub.add_parser("undo").add_argument("--from", dest="table", required=True)
    return p


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _refactor(a: argparse.Namespace) -> int:
    os.chdir(a.change_dir)
    if a.stdin:
        if not a.hint:
            raise ConfigError("--stdin needs --path")
        plan = compile_script(dsl.read_script(a.script))
        before = sys.stdin.read()
        after = plan.apply(a.hint, before)
        if a.format == "human":
            sys.stdout.write(after)
        elif a.format == "diff":
            from .operators.edits import unified_diff

            sys.stdout.write(unified_diff(a.hint, before, after))
        else:
            print(json.dumps({"type": "file", "path": a.hint, "changed": before != after, "bytes_before": len(before.encode()), "bytes_after": len(after.encode())}))
        return WOULD_CHANGE if a.check and before != after else 0
    plan = compile_at_path(a.script)
    spark = _session()
    options = files.WalkOptions(a.include, a.exclude, not a.no_ignore, False, a.jobs)

    def load(p: Plan = plan):
        return files.select(spark, a.paths, options, a.changed_since, a.staged, ".", p.relevant(F.col("path")))

    if a.bisect:
        check = run.shell(a.bisect)

        def verify(ch) -> bool:
            sinks.write_files(ch)
            ok = check()
            sinks.write_files(ch, "before")
            return ok

        texts = kept(run.prefixes(load(), plan))
        got = run.bisect(texts, plan, verify)
        if got.ok:
            run.apply(load(), plan, "write", a.backup)
            return 0
        print(f"first failing rule: {got.label}", file=sys.stderr)
        return 1
    if a.verify or a.commit_per_rule:
        got = run.stepwise(load, plan, run.shell(a.verify) if a.verify else None, run.git_commit(".") if a.commit_per_rule else None, a.backup)
        if not got.ok:
            print(f"verification failed after {got.label}", file=sys.stderr)
        return 0 if got.ok else 1
    mode = run.resolve_mode(a.format, a.write, a.dry_run, a.check, sys.stdout.isatty())
    ch, total = run.apply(load(), plan, mode, a.backup)
    if a.format == "diff":
        for r in run.in_order(run.diffs(ch)).toLocalIterator():
            sys.stdout.write(r["diff"])
    elif a.format == "human":
        if not a.summary_only:
            for r in run.in_order(run.human_lines(ch, mode)).toLocalIterator():
                print(r["line"])
        print(run.summary_line(total, total["elapsed_ms"]))
    else:
        if not a.summary_only:
            for r in run.in_order(run.file_events(ch)).toLocalIterator():
                print(r["event"])
        print(json.dumps({"type": "summary", **total}))
    return WOULD_CHANGE if mode == "check" and total["files_changed"] else 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "refactor":
            return _refactor(a)
        if a.command == "undo":
            print(f"{sinks.undo(_session(), a.table)} file(s) restored")
            return 0
        if a.command == "serve":
            from .server import main as serve

            return serve(a.kind)
        if a.command == "lint":
            found = api.lint_script(dsl.read_script(a.script))
            print(json.dumps(found, indent=2))
            return found[0]["code"] if found else 0
        out = {
            "schema": lambda: registry.schema(),
            "list-languages": lambda: registry.list_languages(),
            "list-rules": lambda: registry.list_rules(a.lang),
            "explain": lambda: dsl.explain(dsl.parse(dsl.read_script(a.script))),
            "pack": lambda: {"packs": [dict(zip(("name", "path", "source"), x, strict=True)) for x in files.packs()]},
        }[a.command]()
        print(json.dumps(out, indent=2))
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
