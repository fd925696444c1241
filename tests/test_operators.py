"""Operators on single texts: golden cases, identity, idempotency and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.errors import ConfigError, ParseError, UnsupportedOperation
from quillmill.functions.lexers import lex
from quillmill.functions.template import render
from quillmill.operators import imports
from quillmill.operators.edits import apply_edits, drop_lines, unified_diff
from quillmill.plans import api, dsl, registry
from quillmill.plans.catalog import CASES, script
from quillmill.plans.compiler import compile_at_path, compile_script


def rewrite(rule, text, path="a/f.go"):
    return compile_script(script("t", rule)).apply(path, text)


@pytest.mark.parametrize("case", CASES, ids=lambda c: c.name)
def test_cases_on_the_driver(case):
    for before, after in case.variants:
        got = rewrite(case.rules, before.replace("{n}", "7"), case.path.replace("{n}", "7"))
        assert got == after.replace("{n}", "7")


@pytest.mark.parametrize("case", [c for c in CASES if "call" not in c.name], ids=lambda c: c.name)
def test_second_pass_changes_nothing(case):
    for _, after in case.variants:
        text, path = after.replace("{n}", "7"), case.path.replace("{n}", "7")
        assert rewrite(case.rules, text, path) == text


@pytest.mark.parametrize("case", CASES, ids=lambda c: c.name)
def test_files_of_other_kinds_are_left_alone(case):
    before = case.variants[0][0]
    assert rewrite(case.rules, before, "a/f.txt") == before
    assert rewrite(case.rules, before, "a/.go") == before


@pytest.mark.parametrize(
    ("rule", "path", "before", "after"),
    [
        ('match go::import "a" { delete }', "f.go", 'package p\nimport (\n\t"a"; "b"\n\t"c"\n)\n', 'package p\nimport (\n\t"c"\n)\n'),
        ('match go::import "a" { replace "b" }', "f.go", "package p\nimport `a`\n", "package p\nimport `a`\n"),
        ('match go::import "a" { ensure }', "f.go", "", '\nimport "a"\n'),
        ('match go::struct_tag "json:x" { replace "json:y" }', "f.go", 'type T struct {\n A struct {\n  B int `myjson:"x" json:"x"`\n }\n}\n', 'type T struct {\n A struct {\n  B int `myjson:"x" json:"y"`\n }\n}\n'),
        ('match go::struct_tag "json" { replace "json:y" }', "f.go", 'type T struct {\n A int `json:"x"`\n}\n', 'type T struct {\n A int `json:"x"`\n}\n'),
        ('match go::call "f" { replace_call "g($args)" }', "f.go", "package p\nfunc (t T) f(a int) {}\ntype I interface { f(x int) }\nvar x = f(func() { f(1) }, m[f(2)])\n", "package p\nfunc (t T) f(a int) {}\ntype I interface { f(x int) }\nvar x = g(func() { g(1) }, m[g(2)])\n"),
        ('match rust::use "a" { delete }', "f.rs", "pub(crate) use a::{\n    b,\n    c,\n};\nmod m { use a; }\nfn f() {}\n", "fn f() {}\n"),
        ('match rust::use "a" { replace "z" }', "f.rs", "use a as b;\nuse ab::c;\nuse {a};\nfn u() { use a::c; }\n", "use z as b;\nuse ab::c;\nuse {a};\nfn u() { use z::c; }\n"),
        ('match rust::use "a::b" { ensure }', "f.rs", "//! Doc.\n#![no_std]\n\nfn f() {}\n", "//! Doc.\n#![no_std]\nuse a::b;\n\nfn f() {}\n"),
        ('match rust::call "f" { replace_call "g($1)" }', "f.rs", "fn f() { a::f(1); f(2); x.f(3); vec![f(4)] }\n", "fn f() { a::f(1); g(2); x.f(3); vec![f(4)] }\n"),
        ('match rust::crate "a" { replace "b" }', "Cargo.toml", "[dependencies]\na.workspace = true\na2 = '1'\n", "[dependencies]\na.workspace = true\na2 = '1'\n"),
        ('match rust::crate "a" { delete }', "x/Cargo.toml", '[dependencies.a]\nversion = "1"\n# note\n[build-dependencies]\na\t= "1"\nb = "1"', '[build-dependencies]\nb = "1"'),
        ('match java::import "a.b" { delete }', "f.java", "import a.b;\nimport static a.b.c;\nimport a.b.*;\n", "import static a.b.c;\n"),
        ('match python::import "a" { delete }', "f.py", "if x: import a\nimport b; import a.c\nimport d\n", "import d\n"),
        ('match python::import "a" { replace "z" }', "f.py", "from a . b import c\nimport ab, a\nfrom .a import d\nfrom a import a\n", "from z . b import c\nimport ab, z\nfrom .a import d\nfrom z import a\n"),
        ('match python::import "a" { ensure }', "f.py", '#!/bin/sh\n# coding: utf-8\n"""D."""\nfrom __future__ import x\nb = 1', '#!/bin/sh\n# coding: utf-8\n"""D."""\nfrom __future__ import x\nimport a\nb = 1'),
        ('match python::symbol "a" { replace "b" }', "f.py", "a = f'{a:{a}}' + rf\"{{a}}\" + 'a' # a\n", "b = f'{b:{b}}' + rf\"{{a}}\" + 'a' # a\n"),
        ('match js::import "m" { delete }', "f.js", "import {\n  a,\n} from 'm';\nexport * from \"m\" with { type: 'json' };\nimport('m');\nlet from = 'm';\n", "import('m');\nlet from = 'm';\n"),
        ('match js::symbol "a" { replace "b" }', "f.ts", "const x = 1 / a / 2, r = /a/g, t = `a ${a + `${a}`} a`;\n", "const x = 1 / b / 2, r = /a/g, t = `a ${b + `${b}`} a`;\n"),
        ('match rust::symbol "a" { replace "b" }', "f.rs", "fn a<'a>(x: &'a str) { let c = 'a'; r#\"a\"#; /* /* a */ a */ a(a) }", "fn b<'a>(x: &'a str) { let c = 'a'; r#\"a\"#; /* /* a */ a */ b(b) }"),
        ('match go::symbol "if" { replace "b" }', "f.go", "package p\nif x {}\n", "package p\nif x {}\n"),
    ],
)
def test_more_cases(rule, path, before, after):
    assert rewrite(rule, before, path) == after


@pytest.mark.parametrize("lang", ["go", "rust", "java", "python", "js"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab'\"`\\/*#{}()$ré\n \t_0.r!", max_size=60))
def test_lexers_lose_nothing(lang, text):
    assert "".join(t.text for t in lex(lang, text)) == text


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=30), cuts=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5), st.text(max_size=3)), max_size=4))
def test_edits_keep_what_lies_between(text, cuts):
    edits = [(min(a, len(text)), min(a + n, len(text)), new) for a, n, new in cuts]
    assert apply_edits(text, []) == text
    assert apply_edits(text, edits) == apply_edits(text, [*edits, *edits])


def test_lines_are_dropped_once():
    assert drop_lines("a\nb\nc", [(2, 3), (2, 3)]) == "a\nc"
    assert drop_lines("a\nb", [(2, 3)]) == "a\n"


@pytest.mark.parametrize(
    ("template", "want"),
    [("$func($1, $3)", "f(a, )"), ("$$args", "$args"), ("$argsX $function", "a, bX ftion"), ("$12$0$", "$"), ("$x $", "$x $"), ("", "")],
)
def test_templates(template, want):
    assert render(template, "f", ["a", "b"]) == want


def test_diff_marks_a_missing_newline():
    assert unified_diff("p", "a\nb", "a\nc\n").splitlines() == ["--- a/p", "+++ b/p", "@@ -1,2 +1,2 @@", " a", "-b", "\\ No newline at end of file", "+c"]
    assert unified_diff("p", "a", "a") == ""


def test_scripts():
    tree = dsl.parse('refactor "x" { // note\n match go::import "a" { replace "b" } include "c" match js::symbol "d" { replace "e" } }')
    assert [type(i).__name__ for i in tree.items] == ["Match", "Include", "Match"]
    assert dsl.parse('refactor "" {}').items == ()
    for bad in ("", "refactor x {}", 'refactor "a" { match go::import "b" { rename "c" } }', 'refactor "a" {} refactor "b" {}', 'refactor "a" { match go::import "b" { delete } ', 'refactor "a" { ? }'):
        with pytest.raises(ParseError):
            dsl.parse(bad)
    for unknown in ('match c::import "a" { delete }', 'match go::use "a" { delete }', 'match rust::crate "a" { ensure }'):
        with pytest.raises(UnsupportedOperation):
            compile_script(script("s", unknown))
    with pytest.raises(ConfigError):
        compile_script('refactor "x" { include "y" }')
    plan = compile_script(script("s", 'match go::import "a" { delete }', 'match go::call "f" { replace_call "g" }'))
    assert str(plan) == "Refactoring 's': [go::import \"a\" -> delete, go::call \"f\" -> replace_call \"g\"]"


def test_includes(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/leaf").write_text(script("leaf", 'match go::symbol "a" { replace "b" }'))
    (tmp_path / "sub/mid").write_text('refactor "mid" { include "leaf" }')
    (tmp_path / "top").write_text('refactor "top" { include "sub/mid" match go::symbol "b" { replace "c" } include "sub/leaf" }')
    assert [r.match.target for r in compile_at_path(str(tmp_path / "top")).rules] == ["a", "b", "a"]
    (tmp_path / "loop").write_text('refactor "l" { include "loop" }')
    with pytest.raises(ConfigError, match="circular"):
        compile_at_path(str(tmp_path / "loop"))


def test_discovery_and_completion():
    assert registry.list_languages()["languages"][0]["name"] == "go"
    assert len(registry.default_registry().capabilities()) == 25
    with pytest.raises(UnsupportedOperation):
        registry.list_rules("cobol")
    assert api.lint_script(script("s", 'match go::import "a" { delete }')) == []
    assert api.lint_script("nonsense")[0]["code"] == 2
    labels = lambda before: [x["label"] for x in api.complete(before)]
    assert labels("") == ["refactor"] and "$0" in api.complete("")[0]["insertText"]
    assert labels('refactor "x" { ') == ["match", "include"]
    languages = api.complete('refactor "x" { match ')
    assert [x["insertText"] for x in languages][:2] == ["go::", "rust::"] and languages[0]["insertTextFormat"] == 1
    assert labels('refactor "x" { match rust::') == ["use", "symbol", "crate", "call"]
    actions = api.complete('refactor "x" { match rust::crate "a" { ')
    assert [x["insertText"] for x in actions] == ['replace "$1"', "delete"] and all(x["kind"] == 14 and x["insertTextFormat"] == 2 and x["detail"] for x in actions)
    assert api.line_prefix("ab\ncd", 1, 1) == "c"


def test_the_first_backend_of_a_name_stays():
    own = registry.Backend("go", "mine", ())
    r = registry.default_registry()
    r.register(own)
    assert r.get("go").description != "mine"


@pytest.mark.parametrize(
    "rule, path, head, after",
    [
        ('match python::import "sys" { ensure }', "a.py", '"""Doc."""\nfrom __future__ import (a,\n b)\nx = 1\n', '"""Doc."""\nfrom __future__ import (a,\n b)\nimport sys\nx = 1\n'),
        ('match python::import "sys" { ensure }', "a.py", "x = 1\n", "import sys\nx = 1\n"),
        ('match java::package "a.b" { replace "c" }', "A.java", "// a.b\npackage a.b;\n", "// a.b\npackage c;\n"),
        ('match java::import "q.Q" { ensure }', "A.java", "package a;\n", "package a;\n\nimport q.Q;\n"),
        ('match go::import "log" { ensure }', "a.go", "package a\n", 'package a\n\nimport "log"\n'),
    ],
)
def test_a_text_is_read_no_further_than_its_head(monkeypatch, rule, path, head, after):
    read = [0]

    def counted(f):
        def g(*args):
            for t in f(*args):
                read[0] += 1
                yield t

        return g

    monkeypatch.setattr(imports, "lex", counted(imports.lex))
    monkeypatch.setattr(imports, "code", lambda *args, f=imports.code: list(counted(f)(*args)))
    rest = "f(x) = { y }\n" * 2000
    assert rewrite(rule, head + rest, path) == after + rest
    assert read[0] < 30


@pytest.mark.parametrize(
    "path, rule, text",
    [
        ("a.py", 'match python::import "old.mod" { ensure }', "import old \\\n  . mod.sub\n"),
        ("a.py", 'match python::import "old.mod" { ensure }', "import a, old.  mod\n"),
        ("a.py", 'match python::import "old.mod" { ensure }', "if x:\n    import old . mod as m # c\n"),
        ("a.py", 'match python::import "a.b" { ensure }', "import (x, a # c\n # d\n .b.c)\n"),
        ("A.java", 'match java::import "a.b" { ensure }', "import a /* c */ . // d\n b ;\n"),
        ("A.java", 'match java::import "a.b" { ensure }', "import static a .\n b.*;\n"),
    ],
)
def test_names_broken_by_blanks_and_comments_are_found(path, rule, text):
    assert rewrite(rule, text, path) == text
