"""Plans, sources and sinks on Spark, and every query against its SQL."""

import json
import os
import random
import subprocess
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill import cli
from quillmill.errors import ConfigError
from quillmill.operators import symbols
from quillmill.plans import api, catalog, registry, run
from quillmill.plans.compiler import Plan, changes, compile_script, rewritten
from quillmill.sources import files, globs, sinks
from quillmill.streaming import stream


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{f}'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_against_sql(name, spark, tables, duck):
    got = catalog.QUERIES[name](spark, tables)
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert rows
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        at = [want.columns.index(c) for c in sorted(got.columns)]
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def plan(*rules):
    return compile_script(catalog.script("t", *rules))


RENAME = 'match go::symbol "old" { replace "new" }'


def test_odd_rows(spark):
    rows = [("a.go", None, 1), (None, "old", 2), ("b.go", "", 3), ("c.go", "var old, 🙂old = 1\r\n", 4), ("c.go", "var old, 🙂old = 1\r\n", 4)]
    df = spark.createDataFrame(rows, "path string, text string, after int")
    got = sorted((r.path, r.after) for r in changes(df, plan(RENAME, 'match go::import "x" { delete }')).collect())
    assert got == [("b.go", ""), ("c.go", "var new, 🙂new = 1\r\n"), ("c.go", "var new, 🙂new = 1\r\n")]
    assert changes(df.limit(0), plan(RENAME)).count() == 0
    assert run.summary(changes(df.limit(0), plan(RENAME))).collect()[0].asDict() == {"files_seen": 0, "files_changed": 0, "bytes_before": 0, "bytes_after": 0}
    assert changes(df, plan()).count() == 0


def test_a_very_long_text_does_not_overflow_the_stack(spark):
    text = 'package p\nvar old = "' + "\\n" * 300_000 + '"\n/*' + "*" * 300_000 + "*/\n"
    df = spark.createDataFrame([("a.go", text), ("a.rs", text), ("A.java", text)], "path string, text string")
    p = plan(RENAME, 'match rust::symbol "old" { replace "new" }', 'match java::symbol "old" { replace "new" }')
    assert {r.after for r in changes(df, p).collect()} == {text.replace("old", "new")}


def test_renames_share_a_pass_and_nothing_is_shuffled(spark):
    df = spark.createDataFrame([("a.go", "old")], "path string, text string")
    ch = changes(df, plan(RENAME, 'match go::symbol "new" { replace "newer" }'))
    said = ch._jdf.queryExecution().executedPlan().toString()
    assert said.count("regexp_extract_all") <= 2 and "Exchange" not in said and "Python" not in said
    assert ch.first().after == "newer"


PIECES = ["old", "package", "new", " ", "\n", "/*", "*/", "//", '"', "'", "`", "\\", "r", "#", "b", "1", "e", "+", ".", "é", "$", "_", "(", '"""', "a1", "²", "\t"]


@pytest.mark.parametrize("lang", ["go", "rust", "java"])
def test_both_forms_of_a_rename_agree(spark, lang):
    r = random.Random(lang)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    texts += ["package /* c */ old\nvar old", "package // c\n old; old", "package package old old", "x := `old", '"old', "/* old", "/* /* old */ old */ old", "packageold old", "1e+old old"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {x.i: x.r for x in df.select("i", symbols.renamed(lang, F.col("text"), [("old", "fresh")]).alias("r")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, symbols.rename(lang, t, "old", "fresh")) for t in texts]


def test_a_rename_takes_time_in_proportion(spark):
    text = "package p\n" + "x := Old + 1\n" * 20_000
    df = spark.createDataFrame([(text,)], "text string")
    began = time.monotonic()
    got = df.select(symbols.renamed("go", F.col("text"), [("Old", "New")]).alias("r")).first().r
    assert got == text.replace("Old", "New") and time.monotonic() - began < 30


@pytest.fixture
def work(tmp_path):
    for name, text in {"a.go": "var old = 1\n", "sub/__init__.py": "old = 1\n", "sub/b.go": "none\n", ".hidden/c.go": "old", "skip/d.go": "old", "skip/keep.go": "old", "é x.go": "old"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("skip/*\n!skip/keep.go\n")
    return tmp_path


def names(df, root):
    return [os.path.relpath(r.path, root) for r in run.in_order(df).collect()]


def test_tree(spark, work):
    top = str(work)
    assert names(files.tree(spark, top), top) == ["a.go", "skip/keep.go", "sub/__init__.py", "sub/b.go", "é x.go"]
    assert names(files.tree(spark, top, files.WalkOptions(include=["*.go"], exclude=["sub/"])), top) == ["a.go", "skip/keep.go", "é x.go"]
    assert len(names(files.tree(spark, top, files.WalkOptions(respect_ignore=False)), top)) == 8
    assert names(files.tree(spark, [str(work / "skip/d.go"), top], relevant=F.col("path").endswith("d.go")), top) == ["skip/d.go"]
    (work / "bad.go").write_bytes(b"\xff")
    assert "bad.go" not in names(files.tree(spark, top, on_error="skip"), top)
    with pytest.raises(Exception, match="bad.go"):
        files.tree(spark, top).count()
    with pytest.raises(ConfigError):
        files.tree(spark, top + "/missing")
    with pytest.raises(ConfigError):
        globs.glob_regex("a[")


def test_write_backup_undo(spark, work, tmp_path_factory):
    table = f"{tmp_path_factory.mktemp('b')}/images"
    p = plan(RENAME)
    load = lambda: files.tree(spark, str(work), relevant=p.relevant(F.col("path")))
    ch, total = run.apply(load(), p, "write", table)
    assert total["files_seen"] == 4 and total["files_changed"] == 3
    assert (work / "a.go").read_text() == "var new = 1\n"
    again = plan('match go::symbol "new" { replace "newer" }')
    run.apply(files.tree(spark, str(work), relevant=again.relevant(F.col("path"))), again, "write", table)
    assert sinks.undo(spark, table) == 3
    assert (work / "a.go").read_text() == "var old = 1\n"


def test_undo_from_another_folder(spark, work, tmp_path_factory, monkeypatch):
    table, p = f"{tmp_path_factory.mktemp('b')}/images", plan(RENAME)
    monkeypatch.chdir(work)
    run.apply(files.tree(spark, ["./a.go"]), p, "write", table)
    assert (work / "a.go").read_text() == "var new = 1\n"
    assert [r.path for r in spark.read.parquet(table).collect()] == [str(work / "a.go")]
    monkeypatch.chdir(tmp_path_factory.mktemp("elsewhere"))
    assert sinks.undo(spark, table) == 1
    assert (work / "a.go").read_text() == "var old = 1\n"


def test_changes_outlive_what_they_were_made_from(spark, work):
    p = plan('match go::symbol "old" { replace "old2" }', 'match go::call "f" { replace_call "wrap($args)" }')
    (work / "a.go").write_text("var old = f(1)\n")
    ch, total = run.apply(files.tree(spark, str(work / "a.go")), p, "write")
    assert total["files_changed"] == 1
    # as after the loss of everything that was cached
    spark.catalog.clearCache()
    assert [(r.before, r.after) for r in ch.collect()] == [("var old = f(1)\n", "var old2 = wrap(1)\n")]
    sinks.write_files(ch)
    assert (work / "a.go").read_text() == "var old2 = wrap(1)\n"


def test_a_large_tree_is_listed_by_the_executors(spark, work, monkeypatch):
    top = str(work)
    for i in range(12):
        (work / f"pkg{i}" / "deep" / "er").mkdir(parents=True)
        for at in ("", "deep/", "deep/er/"):
            (work / f"pkg{i}" / f"{at}f.go").write_text("old")
    (work / "pkg3" / ".gitignore").write_text("er/\n")
    for options in (files.WalkOptions(), files.WalkOptions(include=["*.go"], exclude=["pkg1/"]), files.WalkOptions(respect_ignore=False)):
        want = names(files.tree(spark, top, options), top)
        monkeypatch.setattr(files, "SPREAD", 3)
        assert names(files.tree(spark, top, options), top) == want
        monkeypatch.setattr(files, "SPREAD", 256)
    assert len(want) > 40


def test_files_come_root_by_root(spark, work):
    top = work / "roots"
    for name in ("zz", "aa"):
        (top / name).mkdir(parents=True)
        (top / name / "f.go").write_text("var old = 1\n")
    ch = changes(files.tree(spark, [str(top / "zz"), str(top / "aa")]), plan(RENAME))
    for df in (ch, run.diffs(ch), run.file_events(ch), run.human_lines(ch)):
        assert names(df, top) == ["zz/f.go", "aa/f.go"]


def test_stepwise_stops_at_the_rule_that_fails(spark, work):
    p = plan(RENAME, 'match go::symbol "new" { replace "bad" }')
    load = lambda: files.tree(spark, str(work / "a.go"))
    got = run.stepwise(load, p, lambda: "bad" not in (work / "a.go").read_text())
    assert (got.ok, got.culprit) == (False, 1)
    assert (work / "a.go").read_text() == "var new = 1\n"


def test_git_scopes(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.go").write_text("old\n")
    (tmp_path / "b.go").write_text("old\n")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "a.go").write_text("old 2\n")
    (tmp_path / "c.go").write_text("old\n")
    git("add", "c.go")
    assert names(files.git_changed(spark, str(tmp_path), since="HEAD"), tmp_path) == ["a.go", "c.go"]
    assert names(files.git_changed(spark, str(tmp_path), staged=True), tmp_path) == ["c.go"]


def test_preview_and_command_line(spark, work, capsys, monkeypatch):
    s = work / "s.codemod"
    s.write_text(catalog.script("s", RENAME))
    got = api.preview(spark, s.read_text(), str(work))
    assert [r["changed"] for r in got] == [True, True, False, True] and "+var new = 1" in got[0]["diff"]
    args = ["refactor", "--script", str(s), "-C", str(work), "--format", "json"]
    monkeypatch.chdir(work)
    assert cli.main([*args, "--check"]) == 10
    events = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert events[-1]["type"] == "summary" and events[-1]["files_changed"] == 3
    assert [e["path"] for e in events[:-1]] == sorted(e["path"] for e in events[:-1])
    assert cli.main(["explain", str(s)]) == 0
    assert cli.main(["list-rules", "cobol"]) == 3
    assert cli.main([*args, "missing"]) == 1
    assert run.resolve_mode("human", terminal=True) == "write" and run.resolve_mode("json", terminal=True) == "dry-run"


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a.go", "old"), ("b.go", "x"), ("c.txt", "old")], "path string, text string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("path string, text string").parquet(f"{tmp_path}/in")
    q = stream.to_tables(source, plan(RENAME), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(60)
    assert [r.after for r in spark.read.parquet(f"{tmp_path}/out/changes").collect()] == ["new"]
    assert spark.read.parquet(f"{tmp_path}/out/summary").agg(F.sum("files_seen")).first()[0] == 2


def test_paths_are_asked_about_once_a_step(spark, tables):
    ch = changes(catalog._mixed_files(spark, tables).limit(1), catalog._mixed_plan())
    said = ch._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert 0 < said.count("RLIKE(") <= 3


def test_rules_by_the_ending_of_a_path(spark):
    suffixes = [("go",), ("d.ts", "ts"), ("/Cargo.toml",), ("/Makefile", "mk"), ("py",)]
    rules = [registry.Rule(None, s, lambda t, i=i: f"{t}{i}") for i, s in enumerate(suffixes)]
    want = {"a.go": "0", "x/.go": "", ".go": "", "go": "", "a.d.ts": "1", "x/.d.ts": "1", "x/.ts": "", "Cargo.toml": "2", "a/Cargo.toml": "2", "a/MyCargo.toml": "", "Makefile": "3", "a.b/Makefile": "3", "é.mk": "3", "a.py": "4", "a.py\n": "", "": ""}
    df = spark.createDataFrame(list(want.items()), "path string, want string")
    got = rewritten(df.withColumn("text", F.lit("")), Plan("t", tuple(rules))).collect()
    assert {r.path: r.after for r in got} == want == {p: "".join(str(i) for i, r in enumerate(rules) if r.takes(p)) for p in want}
