"""Queries over files that are made from the driver's tables, and SQL that constructs what must come out.

A case gives the text of a file and the text that a script must make of it, as
templates over a row's key.  The query makes the files and runs the script; the
SQL makes the expected texts and never looks at the rules.
"""

from __future__ import annotations

import os
import re
import tempfile
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.template import render_column
from ..sources.globs import selected
from . import run
from .compiler import changes, compile_at_path, compile_script
from .dsl import explain, parse
from .registry import capabilities, list_languages, list_rules


class Case(NamedTuple):
    name: str
    table: str
    key: str
    path: str
    rules: str
    variants: tuple[tuple[str, str], ...]  # (before, after) by key modulo their number; {n} is the key


def _parts(template: str) -> list[str]:
    return re.split(r"(\{n\})", template)


def _column(template: str, key: Column) -> Column:
    return F.concat(*(key.cast("string") if p == "{n}" else F.lit(p) for p in _parts(template)), F.lit(""))


def _sql(template: str, key: str) -> str:
    return "concat(" + ", ".join([f"CAST({key} AS VARCHAR)" if p == "{n}" else "'" + p.replace("'", "''") + "'" for p in _parts(template)] + ["''"]) + ")"


GO = '// Old in a comment\npackage shop{n}\n\nimport (\n\t"fmt"\n\tx "old/pkg"\n\t"old/pkg/sub"\n)\n\n'
GO_BODY = 'type Old struct {\n\tName string `json:"old" xml:"old"`\n\tOldest int\n}\n\nfunc (o Old) Get() string {\n\ts := "Old \\" Old"\n\tr := `Old{n}`\n\treturn oldCall(s, fn(r, 1)) + o.Old.Name\n}\n'
RUST = "#![allow(dead_code)]\n// old::path\nuse old::path::Thing;\nuse old::pathology;\npub use old::path;\n"
RUST_BODY = "fn main<'old>() {{n}\n    let old = r#\"old \"old\" \"#;\n    /* old /* old */ old */\n    call_me(old, &[1, {n}]);\n    x.call_me(1);\n    let c = 'o';\n}\n"
CARGO = '[package]\nname = "serde"\nversion = "0.{n}.0"\n\n[dependencies] # keep\nserde = "1"\nserde_json = { version = "1" }\n\n[dev-dependencies.serde]\nversion = "1"\nfeatures = ["derive"]\n\n[[bin]]\nname = "serde"\n'
JAVA = "// old.pkg\npackage old.pkg;\n\nimport static old.pkg.Util.max;\nimport old.pkg.Util;\nimport old.pkg.*;\n\n"
JAVA_BODY = 'class Util{n} {\n    String s = "Util \\" Util";\n    Util make() { return new Util(); } // Util\n}\n'
PY = '"""Doc old."""\nfrom __future__ import annotations\n\nimport os, old.mod as m\nfrom old.mod import (\n    a,\n    old,\n)\nfrom .old import b\n\n'
PY_BODY = 'def f{n}(old):\n    s = "old" + f"{old!r:>{old}} old"\n    return old + 1  # old\n'
JS = "import a, { b as c } from 'old-lib';\nimport \"old-lib/sub\";\nexport { d } from \"old-lib\";\nconst old-lib-x = 1;\n".replace("const old-lib-x = 1;\n", "")
JS_BODY = "const re = /old'old/g;\nlet t = `old ${old + {n}} old`;\nobj.old = { old }; // old\nlet s = 'old';\n"


def _swap(text: str, *pairs: tuple[str, str]) -> str:
    """``text`` with each piece, which must be there, replaced once."""
    for old, new in pairs:
        assert old in text, old
        text = text.replace(old, new, 1)
    return text


_P, _S, _N, _C, _O = ("part", "p_partkey", "go"), ("supplier", "s_suppkey", "rs"), ("nation", "n_nationkey", ""), ("customer", "c_custkey", "java"), ("orders", "o_orderkey", "py")
_NOTHING = ("", "")


def _case(name: str, where: tuple[str, str, str], rules: str, *variants: tuple[str, str], path: str | None = None) -> Case:
    table, key, ext = where
    return Case(name, table, key, path or f"src/d/f{{n}}.{ext}", rules, variants)


CASES = (
    _case("go_import_replace", _P, 'match go::import "old/pkg" { replace "new/pkg" }', (GO + GO_BODY, _swap(GO, ('x "old/pkg"', 'x "new/pkg"')) + GO_BODY), _NOTHING, (GO_BODY, GO_BODY)),
    _case("go_import_delete", _P, 'match go::import "old/pkg" { delete }', (GO + GO_BODY, _swap(GO, ('\tx "old/pkg"\n', "")) + GO_BODY), ('package a\nimport "old/pkg"\n', "package a\n")),
    _case("go_import_ensure", _P, 'match go::import "log" { ensure }', (GO + GO_BODY, _swap(GO, ("package shop{n}\n", 'package shop{n}\n\nimport "log"\n')) + GO_BODY), ('package a\nimport "log"\n', 'package a\nimport "log"\n')),
    _case(
        "go_symbol_replace",
        _P,
        'match go::symbol "Old" { replace "Fresh" }',
        (GO + GO_BODY, GO + _swap(GO_BODY, ("type Old", "type Fresh"), ("(o Old)", "(o Fresh)"), ("o.Old.", "o.Fresh."))),
        ("package Old\n\nvar Old, Öld = 1, 2\n", "package Old\n\nvar Fresh, Öld = 1, 2\n"),
    ),
    _case("go_struct_tag_replace", _P, 'match go::struct_tag "json:old" { replace "json:new" }', (GO + GO_BODY + 'var s = `json:"old"`\n', GO + _swap(GO_BODY, ('json:"old"', 'json:"new"')) + 'var s = `json:"old"`\n')),
    _case(
        "go_call_replace_call",
        _P,
        'match go::call "oldCall" { replace_call "pkg.Call($2, $1, $args, $$$func, $3)" }',
        (GO + GO_BODY, GO + _swap(GO_BODY, ("oldCall(s, fn(r, 1))", "pkg.Call(fn(r, 1), s, s, fn(r, 1), $oldCall, )"))),
        ("package a\nfunc oldCall(a int) {\n\ta.oldCall(1)\n\toldCall(oldCall(x))\n}\n", "package a\nfunc oldCall(a int) {\n\ta.oldCall(1)\n\tpkg.Call(, pkg.Call(, x, x, $oldCall, ), pkg.Call(, x, x, $oldCall, ), $oldCall, )\n}\n"),
    ),
    _case("rust_use_replace", _S, 'match rust::use "old::path" { replace "new" }', (RUST + RUST_BODY, _swap(RUST, ("use old::path::Thing", "use new::Thing"), ("pub use old::path;", "pub use new;")) + RUST_BODY), _NOTHING),
    _case("rust_use_delete", _S, 'match rust::use "old::path" { delete }', (RUST + RUST_BODY, _swap(RUST, ("use old::path::Thing;\n", ""), ("pub use old::path;\n", "")) + RUST_BODY)),
    _case("rust_use_ensure", _S, 'match rust::use "std::fmt" { ensure }', (RUST + RUST_BODY, _swap(RUST, ("#![allow(dead_code)]\n", "#![allow(dead_code)]\nuse std::fmt;\n")) + RUST_BODY), ("use std::fmt::Display;\n", "use std::fmt::Display;\n"), ("", "use std::fmt;\n")),
    _case("rust_symbol_replace", _S, 'match rust::symbol "old" { replace "fresh" }', (RUST_BODY, _swap(RUST_BODY, ("let old", "let fresh"), ("call_me(old", "call_me(fresh"))), ("struct S { old: u8 }\n", "struct S { fresh: u8 }\n")),
    _case("rust_crate_replace", _N, 'match rust::crate "serde" { replace "serde2" }', (CARGO, _swap(CARGO, ('\nserde = "1"', '\nserde2 = "1"'), ("dependencies.serde]", "dependencies.serde2]"))), ("[dependencies]\nserde = = 1\n", "[dependencies]\nserde = = 1\n"), path="c{n}/Cargo.toml"),
    _case("rust_crate_delete", _N, 'match rust::crate "serde" { delete }', (CARGO, _swap(CARGO, ('serde = "1"\n', ""), ('[dev-dependencies.serde]\nversion = "1"\nfeatures = ["derive"]\n\n', ""))), path="c{n}/Cargo.toml"),
    _case("rust_call_replace_call", _S, 'match rust::call "call_me" { replace_call "other::call($2, $1)" }', (RUST_BODY, _swap(RUST_BODY, ("call_me(old, &[1, {n}])", "other::call(&[1, {n}], old)"))), ("fn call_me(a: u8) { m!(call_me(1)); call_me(|a, b| a, f::<A, B>()) }\n", "fn call_me(a: u8) { m!(call_me(1)); other::call(f::<A, B>(), |a, b| a) }\n")),
    _case("java_import_replace", _C, 'match java::import "old.pkg.Util" { replace "new.pkg.Util" }', (JAVA + JAVA_BODY, _swap(JAVA, ("import old.pkg.Util;", "import new.pkg.Util;")) + JAVA_BODY), ("import static old.pkg.Util;\n", "import static new.pkg.Util;\n")),
    _case("java_import_delete", _C, 'match java::import "old.pkg" { delete }', (JAVA + JAVA_BODY, _swap(JAVA, ("import old.pkg.*;\n", "")) + JAVA_BODY)),
    _case("java_import_ensure", _C, 'match java::import "java.util.List" { ensure }', (JAVA + JAVA_BODY, _swap(JAVA, ("package old.pkg;\n", "package old.pkg;\n\nimport java.util.List;\n")) + JAVA_BODY), ("class A {}\n", "\nimport java.util.List;\nclass A {}\n"), ("import java.util.List;\n", "import java.util.List;\n")),
    _case("java_package_replace", _C, 'match java::package "old.pkg" { replace "new.home" }', (JAVA + JAVA_BODY, _swap(JAVA, ("package old.pkg;", "package new.home;")) + JAVA_BODY), ("package old.pkg.sub;\n", "package old.pkg.sub;\n")),
    _case("java_symbol_replace", _C, 'match java::symbol "Util" { replace "Tool" }', (JAVA + JAVA_BODY, _swap(JAVA, ("Util.max", "Tool.max"), ("pkg.Util;", "pkg.Tool;")) + _swap(JAVA_BODY, ("Util make", "Tool make"), ("new Util", "new Tool")))),
    _case("python_import_replace", _O, 'match python::import "old.mod" { replace "new" }', (PY + PY_BODY, _swap(PY, ("old.mod as m", "new as m"), ("from old.mod", "from new")) + PY_BODY), ("import old.module\n", "import old.module\n")),
    _case("python_import_delete", _O, 'match python::import "old" { delete }', (PY + PY_BODY, _swap(PY, ("import os, old.mod as m\n", ""), ("from old.mod import (\n    a,\n    old,\n)\n", "")) + PY_BODY)),
    _case("python_import_ensure", _O, 'match python::import "sys" { ensure }', (PY + PY_BODY, _swap(PY, ("annotations\n", "annotations\nimport sys\n")) + PY_BODY), ("#!/bin/py\nx = 1\n", "#!/bin/py\nimport sys\nx = 1\n"), ("import sys.x\n", "import sys.x\n")),
    _case("python_symbol_replace", _O, 'match python::symbol "old" { replace "fresh" }', (PY_BODY, _swap(PY_BODY, ("(old)", "(fresh)"), ("{old!r:>{old}}", "{fresh!r:>{fresh}}"), ("return old", "return fresh"))), path="src/d/__init{n}__.py"),
    _case("js_import_replace", ("nation", "n_nationkey", "ts"), 'match js::import "old-lib" { replace "new-lib" }', (JS + JS_BODY, _swap(JS, ("'old-lib'", "'new-lib'"), ('"old-lib";', '"new-lib";')) + JS_BODY)),
    _case("js_import_delete", ("nation", "n_nationkey", "mjs"), 'match js::import "old-lib" { delete }', (JS + JS_BODY, 'import "old-lib/sub";\n' + JS_BODY)),
    _case("js_symbol_replace", ("nation", "n_nationkey", "tsx"), 'match js::symbol "old" { replace "fresh" }', (JS_BODY, _swap(JS_BODY, ("${old +", "${fresh +"), ("obj.old = { old }", "obj.fresh = { fresh }")))),
)

#: Further texts of the cases above: what stands alone comes out as it is.
_MORE: dict[str, tuple] = {
    "go_import_replace": (
        ('package a\nimport "old/pkg"\n', 'package a\nimport "new/pkg"\n'),
        ('package a\nimport . "old/pkg"\n', 'package a\nimport . "new/pkg"\n'),
        ('package a\nimport _ "old/pkg" // why\n', 'package a\nimport _ "new/pkg" // why\n'),
        ('package a\nimport ("a"; "old/pkg")\n', 'package a\nimport ("a"; "new/pkg")\n'),
        ('package a\n// import "old/pkg"\nvar s = "old/pkg"\n',),
        ('package a\nimport "old/pkg/sub"\nimport "older/pkg"\n',),
        ('package a\r\nimport "old/pkg"\r\n', 'package a\r\nimport "new/pkg"\r\n'),
    ),
    "go_import_delete": (
        ('package a\nimport (\n\t"a"\n\t"old/pkg"\n\t"b"\n)\n', 'package a\nimport (\n\t"a"\n\t"b"\n)\n'),
        ('package a\nimport "old/pkg/sub"\n',),
        ('package a\nvar s = "old/pkg"\n',),
        ('package a\nimport _ "old/pkg"\nvar x{n} = 1\n', 'package a\nvar x{n} = 1\n'),
        ('package a\n/* import "old/pkg" */\n',),
        ('package a\nimport "a"\nimport y "old/pkg"\nimport "b"\n', 'package a\nimport "a"\nimport "b"\n'),
    ),
    "go_import_ensure": (
        ('package a\nimport (\n\t"fmt"\n\t"log"\n)\n',),
        ('package a\nimport l "log"\n',),
        ('package a\n// import "log"\n', 'package a\n\nimport "log"\n// import "log"\n'),
        ('package a{n}\n', 'package a{n}\n\nimport "log"\n'),
    ),
    "go_symbol_replace": (
        ('package a\nvar Old = Old.Old[Old]\n', 'package a\nvar Fresh = Fresh.Fresh[Fresh]\n'),
        ('package a\n// Old\nvar s, r = "Old", \'O\'\n',),
        ('package a\nvar Older, old, MyOld = 1, 2, 3\n',),
        ('package /* c */ Old\nvar Old{n} = Old\n', 'package /* c */ Old\nvar Old{n} = Fresh\n'),
        ('package a\n/* Old\nOld */ var x Old\n', 'package a\n/* Old\nOld */ var x Fresh\n'),
        ('package a\nvar s = `\nOld` + Old\n', 'package a\nvar s = `\nOld` + Fresh\n'),
        ('package a\r\nfunc Old() {}\r\n', 'package a\r\nfunc Fresh() {}\r\n'),
        ('',),
    ),
    "go_struct_tag_replace": (
        ('type T struct {\n\tA int `xml:"a" json:"old"`\n}\n', 'type T struct {\n\tA int `xml:"a" json:"new"`\n}\n'),
        ('type T struct {\n\tA int `json:"older"`\n\tB int `json:"old,omitempty"`\n}\n',),
        ('func f() {\n\ts := `json:"old"`\n}\n',),
        ('type T struct {\n\tA struct {\n\t\tB int `json:"old"`\n\t}\n\tC{n} int `json:"c"`\n}\n', 'type T struct {\n\tA struct {\n\t\tB int `json:"new"`\n\t}\n\tC{n} int `json:"c"`\n}\n'),
        ('// `json:"old"`\ntype T struct{}\n',),
    ),
    "rust_use_replace": (
        ('use old::path as p;\n', 'use new as p;\n'),
        ('use old::path::{a, b};\n', 'use new::{a, b};\n'),
        ('use old::paths;\nuse older::path;\n',),
        ('// use old::path;\nlet s = "use old::path;";\n',),
        ('pub(crate) use old::path::x{n};\n', 'pub(crate) use new::x{n};\n'),
        ('mod m { use old::path; }\n', 'mod m { use new; }\n'),
        ('use old::path::*;\n', 'use new::*;\n'),
    ),
    "rust_use_delete": (
        ('use a::b;\nuse old::path;\nuse c::d;\n', 'use a::b;\nuse c::d;\n'),
        ('use old::paths;\n',),
        ('// use old::path;\n',),
        ('use old::path::{\n    a,\n    b,\n};\nfn f{n}() {}\n', 'fn f{n}() {}\n'),
    ),
    "rust_use_ensure": (
        ('fn f() {}\n', 'use std::fmt;\nfn f() {}\n'),
        ('use std::fmt;\n',),
        ('use std::io;\nfn f() {}\n', 'use std::fmt;\nuse std::io;\nfn f() {}\n'),
        ('//! Doc {n}.\n\nfn f() {}\n', '//! Doc {n}.\nuse std::fmt;\n\nfn f() {}\n'),
    ),
    "rust_symbol_replace": (
        ('fn old(old: Old) -> old::T { old.old() }\n', 'fn fresh(fresh: Old) -> fresh::T { fresh.fresh() }\n'),
        ('// old\nlet s = "old"; let c = b"old";\n',),
        ('let r = r"old"; let q = r##"old"#old"##;\n',),
        ("fn f<'old>(x: &'old u8) {}\n",),
        ('let older = my_old + old_{n};\n',),
        ('/* /* old */ old */ old!();\n', '/* /* old */ old */ fresh!();\n'),
    ),
    "rust_crate_replace": (
        ('[dependencies]\nserde = "1"\n', '[dependencies]\nserde2 = "1"\n'),
        ('[dependencies]\nserde = { version = "1", features = ["derive"] }\n', '[dependencies]\nserde2 = { version = "1", features = ["derive"] }\n'),
        ('[build-dependencies]\nserde = "{n}"\n', '[build-dependencies]\nserde2 = "{n}"\n'),
        ('[package]\nserde = "1"\n',),
        ('[dependencies]\nserde_json = "1"\n# serde = "1"\n',),
    ),
    "rust_crate_delete": (
        ('[dependencies]\na = "1"\nserde = "1"\nb = "{n}"\n', '[dependencies]\na = "1"\nb = "{n}"\n'),
        ('[package]\nname = "serde"\n',),
        ('[dependencies]\nserde_json = "1"\n',),
    ),
    "java_import_replace": (
        ('import old.pkg.Util;\n', 'import new.pkg.Util;\n'),
        ('// import old.pkg.Util;\nclass A{n} {}\n',),
        ('import old.pkg.Utils;\nimport old.pkg.util;\n',),
        ('class A { String s = "import old.pkg.Util;"; }\n',),
    ),
    "java_import_delete": (
        ('import old.pkg;\nclass A{n} {}\n', 'class A{n} {}\n'),
        ('import old.pkgs.*;\n',),
        ('// import old.pkg.*;\n',),
    ),
    "java_import_ensure": (
        ('import java.util.List;\nclass A{n} {}\n',),
        ('package p;\nclass A{n} {}\n', 'package p;\n\nimport java.util.List;\nclass A{n} {}\n'),
    ),
    "java_package_replace": (
        ('package old.pkg;\nclass A{n} {}\n', 'package new.home;\nclass A{n} {}\n'),
        ('// package old.pkg;\nclass A {}\n',),
        ('package old;\n',),
        ('/* c */ package old.pkg; // d\n', '/* c */ package new.home; // d\n'),
    ),
    "java_symbol_replace": (
        ('Util u = new Util<Util>();\n', 'Tool u = new Tool<Tool>();\n'),
        ('// Util\nString s = "Util"; char c = \'U\';\n',),
        ('Utility x = MyUtil.util{n}(Util_);\n',),
        ('String t = """\n Util "Util" """ + Util;\n', 'String t = """\n Util "Util" """ + Tool;\n'),
    ),
    "python_import_replace": (
        ('import old.mod\n', 'import new\n'),
        ('import old.mod.sub as s\n', 'import new.sub as s\n'),
        ('from old.mod import (a,\n    b)\n', 'from new import (a,\n    b)\n'),
        ('from .old.mod import a\n',),
        ('x = "import old.mod"\n# import old.mod\n',),
        ('def f{n}():\n    from old.mod import a\n', 'def f{n}():\n    from new import a\n'),
    ),
    "python_import_delete": (
        ('import a\nimport old\nimport b\n', 'import a\nimport b\n'),
        ('from older import x\n',),
        ('x = "import old"\n',),
        ('from old.x import (\n    a,\n)\ny = {n}\n', 'y = {n}\n'),
    ),
    "python_import_ensure": (
        ('import sys\n',),
        ('"""Doc {n}."""\nx = 1\n', '"""Doc {n}."""\nimport sys\nx = 1\n'),
        ('x = {n}\n', 'import sys\nx = {n}\n'),
    ),
    "python_symbol_replace": (
        ('old = old.old(old=old)[old]\n', 'fresh = fresh.fresh(fresh=fresh)[fresh]\n'),
        ('# old\ns = "old" + \'old\' + """old"""\n',),
        ('older = my_old + old_{n}\n',),
        ('s = f"{old} old {old + {n}}"\n', 's = f"{fresh} old {fresh + {n}}"\n'),
        ('s = rb"old"; t = r\'old\'\n',),
    ),
    "js_import_replace": (
        ("import 'old-lib';\n", "import 'new-lib';\n"),
        ("export * from 'old-lib';\n", "export * from 'new-lib';\n"),
        ("// import 'old-lib';\nlet s = 'old-lib';\n",),
        ("import a from 'old-libs';\n",),
    ),
    "js_import_delete": (
        ("import a{n} from 'old-lib';\nlet x = 1;\n", 'let x = 1;\n'),
        ("let s = 'old-lib';\n",),
    ),
    "js_symbol_replace": (
        ('let old = old.old(old);\n', 'let fresh = fresh.fresh(fresh);\n'),
        ('// old\nlet s = "old", r = /old/;\n',),
        ('let older = old{n} + $old;\n',),
        ('let t = `${old}${`${old} old`}`;\n', 'let t = `${fresh}${`${fresh} old`}`;\n'),
    ),
}
CASES = tuple(c._replace(variants=(*c.variants, *((v[0], v[-1]) for v in _MORE.get(c.name, ())))) for c in CASES)


def script(name: str, *rules: str) -> str:
    return f'refactor "{name}" {{ {" ".join(rules)} }}'


def _files(spark: SparkSession, sf_dir: str, c: Case, which: int = 0) -> DataFrame:
    """path and text of a case's files; ``which`` = 1 takes the expected texts."""
    key = F.col(c.key)
    text = F.lit(None).cast("string")
    for i, v in enumerate(c.variants):
        text = F.when(key % len(c.variants) == i, _column(v[which], key)).otherwise(text)
    rows = spark.read.parquet(f"{sf_dir}/{c.table}.parquet").select(c.key)
    return rows.select(_column(c.path, key).alias("path"), text.alias("text"))


def _result(ch: DataFrame) -> DataFrame:
    return ch.select("path", "changed", F.octet_length("before").cast("long").alias("bytes_before"), F.octet_length("after").cast("long").alias("bytes_after"), "after")


def _pick(c: Case, which: int) -> str:
    n = len(c.variants)
    return "CASE " + " ".join(f"WHEN {c.key} % {n} = {i} THEN {_sql(v[which], c.key)}" for i, v in enumerate(c.variants)) + " END"


def _texts(c: Case) -> str:
    return f"SELECT {_sql(c.path, c.key)} AS path, {_pick(c, 0)} AS b, {_pick(c, 1)} AS a FROM {c.table}"


def _expected(inner: str) -> str:
    return f'SELECT path, b <> a AS changed, CAST(strlen(b) AS BIGINT) AS bytes_before, CAST(strlen(a) AS BIGINT) AS bytes_after, a AS "after" FROM ({inner}) t'


def _one(c: Case):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _result(changes(_files(spark, sf_dir, c), compile_script(script(c.name, c.rules))))

    return q


BY = {c.name: c for c in CASES}
#: One of each language, for scripts that mix them.
MIXED = [BY[x] for x in ("go_symbol_replace", "rust_use_replace", "rust_crate_replace", "java_package_replace", "python_import_ensure", "js_import_replace")]


def _mixed_plan():
    return compile_script(script("mixed", *(c.rules for c in MIXED)))


def _mixed_files(spark: SparkSession, sf_dir: str, which: int = 0) -> DataFrame:
    out = None
    for c in MIXED:
        one = _files(spark, sf_dir, c, which)
        out = one if out is None else out.unionByName(one)
    return out


def _mixed_sql() -> str:
    return " UNION ALL ".join(_texts(c) for c in MIXED)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with rules for five languages over the files of all of them."""
    return _result(changes(_mixed_files(spark, sf_dir), _mixed_plan()))


# a -> b -> c, then something that looks for c
_CHAIN = Case(
    "chain", "part", "p_partkey", "a/f{n}.go",
    'match go::symbol "a" { replace "b" } match go::symbol "b" { replace "c" } match go::call "c" { replace_call "d($1)" } match go::import "old" { replace "mid" } match go::import "mid" { replace "new" }',
    (("package a\nimport \"old\"\nvar x{n} = a(b(1)) + b\n", 'package a\nimport "new"\nvar x{n} = d(d(1)) + c\n'), ("package b\n", "package b\n")),
)


def multi_rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(changes(_files(spark, sf_dir, _CHAIN), compile_script(script("chain", _CHAIN.rules))))


def idempotent_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(changes(_mixed_files(spark, sf_dir, 1), _mixed_plan()))


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run.file_events(changes(_mixed_files(spark, sf_dir), _mixed_plan()))
    return out.select("path", *(F.get_json_object("event", f"$.{k}").alias(k) for k in ("type", "changed", "bytes_before", "bytes_after")))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.summary(changes(_mixed_files(spark, sf_dir), _mixed_plan()))


def summary_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.summary(changes(_mixed_files(spark, sf_dir), _mixed_plan()).withColumn("lang", run.language()), "lang")


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.hits(_files(spark, sf_dir, _CHAIN), compile_script(script("chain", _CHAIN.rules))).select("rule_idx", "files_seen", "files_changed")


_SUMS = 'CAST(count(*) AS BIGINT) AS files_seen, CAST(coalesce(sum(CASE WHEN b <> a THEN 1 ELSE 0 END), 0) AS BIGINT) AS files_changed, CAST(coalesce(sum(strlen(b)), 0) AS BIGINT) AS bytes_before, CAST(coalesce(sum(strlen(a)), 0) AS BIGINT) AS bytes_after'

_PATHS = "src/f{n}.go vendor/f{n}.go src/.go src/f{n}.go.txt Cargo.toml crates/c{n}/Cargo.toml a/MyCargo.toml web/f{n}.tsx web/f{n}.TSX".split()


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    return rows.select(F.explode(F.array(*(_column(p, F.col("n_nationkey")) for p in _PATHS))).alias("path"))


_PATHS_SQL = "SELECT unnest([" + ", ".join(_sql(p, "n_nationkey") for p in _PATHS) + "]) AS path FROM nation"


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = compile_script(script("r", BY["go_symbol_replace"].rules, BY["rust_crate_replace"].rules, BY["js_symbol_replace"].rules)).rules
    return _paths(spark, sf_dir).select("path", *(r.relevant(F.col("path")).alias(n) for n, r in zip(("go", "cargo", "js"), rules, strict=True)))


def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).filter(selected(F.col("path"), ["*.go", "/crates/**"], ["vendor/"]))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    args = F.array("p_brand", "p_type")
    return rows.select("p_partkey", render_column("$func<$2|$1|$3|$args|$$|$x|$argsX>", F.col("p_name"), args).alias("rendered"))


def capability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capabilities(spark).select("lang", "module", "action")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    tree = explain(parse(script("mixed", *(c.rules for c in MIXED), 'include "more"')))
    return spark.createDataFrame([(tree["name"], i, x["kind"], json.dumps(x, sort_keys=True)) for i, x in enumerate(tree["items"])], "name string, idx int, kind string, item string")


_BISECT = 'match go::symbol "a" { replace "b" } match go::symbol "b" { replace "bad" } match go::symbol "x" { replace "y" }'


def bisect_culprit(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compile_script(script("b", _BISECT))
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").select(_column("f{n}.go", F.col("n_nationkey")).alias("path"), _column("package p\nvar a{n}, a, x = 1, 2, 3\n", F.col("n_nationkey")).alias("text"))
    got = run.bisect(run.prefixes(files, plan).cache(), plan, lambda ch: ch.filter(F.contains("after", F.lit("bad"))).isEmpty())
    return spark.createDataFrame([(got.ok, got.culprit, got.label)], "ok boolean, culprit int, label string")


def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.diffs(changes(_files(spark, sf_dir, _CHAIN), compile_script(script("chain", _CHAIN.rules))))


_DIFF_SQL = f"""SELECT path, concat('--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -1,3 +1,3 @@', chr(10), ' package a', chr(10), '-import "old"', chr(10),
    '-var x', CAST(p_partkey AS VARCHAR), ' = a(b(1)) + b', chr(10), '+import "new"', chr(10), '+var x', CAST(p_partkey AS VARCHAR), ' = d(d(1)) + c', chr(10)) AS diff
    FROM (SELECT p_partkey, {_sql(_CHAIN.path, "p_partkey")} AS path FROM part WHERE p_partkey % 2 = 0) t"""

def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.human_lines(changes(_mixed_files(spark, sf_dir), _mixed_plan()))


def total_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = run.summary(changes(_mixed_files(spark, sf_dir), _mixed_plan())).collect()[0]
    return spark.createDataFrame([(run.summary_line(row),)], "line string")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, x["name"]) for i, x in enumerate(list_languages()["languages"])], "idx int, name string")


def rules_of_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(lang, m["name"], ",".join(a["name"] for a in m["actions"])) for lang in ("go", "rust", "java", "python", "js") for m in list_rules(lang)["modules"]]
    return spark.createDataFrame(rows, "lang string, module string, actions string")


_FLAGS = ((False, True),) * 4


def exec_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f, *flags, run.resolve_mode(f, *flags)) for f in run.FORMATS for flags in product(*_FLAGS)]
    return spark.createDataFrame(rows, "format string, write boolean, dry_run boolean, check boolean, terminal boolean, mode string")


def include_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a script that includes others, which lie in a folder of the driver."""
    with tempfile.TemporaryDirectory() as top:
        os.mkdir(f"{top}/sub")
        for name, text in (
            ("top", 'refactor "top" { // first\n include "sub/mid" match go::symbol "x" { replace "y" } include "sub/leaf" }'),
            ("sub/mid", 'refactor "mid" { match rust::crate "a" { delete } include "leaf" }'),
            ("sub/leaf", 'refactor "leaf" {\n  match python::import "z" { ensure } // last\n}'),
        ):
            with open(f"{top}/{name}", "w") as f:
                f.write(text)
        plan = compile_at_path(f"{top}/top")
    return spark.createDataFrame([(plan.name, str(plan), i, r.label) for i, r in enumerate(plan.rules)], "name string, shown string, idx int, rule string")


_MODES = " ".join(
    f"WHEN {cond} THEN '{mode}'"
    for cond, mode in (('"check"', "check"), ('"write"', "write"), ("dry_run", "dry-run"), ("format = 'human' AND terminal", "write"))
)
_BOOLS = "(VALUES (false), (true))"
# What each language's modules can do.
_ABILITIES = """
go import replace delete ensure
go symbol replace
go struct_tag replace
go call replace_call
rust use replace delete ensure
rust symbol replace
rust crate replace delete
rust call replace_call
java import replace delete ensure
java package replace
java symbol replace
python import replace delete ensure
python symbol replace
js import replace delete
js symbol replace
"""
_ABILITIES = [x.split() for x in _ABILITIES.strip().splitlines()]

QUERIES = {f"q_{c.name}": _one(c) for c in CASES} | {
    "q_mixed_language_script": flagship,
    "q_multi_rule_chain": multi_rule_chain,
    "q_idempotent_second_pass": idempotent_second_pass,
    "q_events_json": events_json,
    "q_summary": summary,
    "q_summary_by_language": summary_by_language,
    "q_rule_hits": rule_hits,
    "q_relevance": relevance,
    "q_globs": globs,
    "q_template_render": template_render,
    "q_capabilities": capability_table,
    "q_explain": explained,
    "q_bisect_culprit": bisect_culprit,
    "q_unified_diff": unified_diffs,
    "q_human_lines": human,
    "q_summary_line": total_line,
    "q_list_languages": languages,
    "q_list_rules": rules_of_languages,
    "q_exec_modes": exec_modes,
    "q_include_expansion": include_expansion,
}

ORACLES = {f"q_{c.name}": _expected(_texts(c)) for c in CASES} | {
    "q_mixed_language_script": _expected(_mixed_sql()),
    "q_multi_rule_chain": _expected(_texts(_CHAIN)),
    "q_idempotent_second_pass": _expected(f"SELECT path, a AS b, a FROM ({_mixed_sql()}) s"),
    "q_events_json": f"SELECT path, 'file' AS type, CASE WHEN b <> a THEN 'true' ELSE 'false' END AS changed, CAST(strlen(b) AS VARCHAR) AS bytes_before, CAST(strlen(a) AS VARCHAR) AS bytes_after FROM ({_mixed_sql()}) s",
    "q_summary": f"SELECT {_SUMS} FROM ({_mixed_sql()}) s",
    "q_summary_by_language": "SELECT lang, " + _SUMS + " FROM (" + " UNION ALL ".join(f"SELECT '{c.name.split('_')[0]}' AS lang, path, b, a FROM ({_texts(c)}) s" for c in MIXED) + ") u GROUP BY lang",
    "q_rule_hits": "SELECT CAST(i AS INTEGER) AS rule_idx, (SELECT count(*) FROM part) AS files_seen, CASE WHEN i IN (0, 1, 3) THEN (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) ELSE 0 END AS files_changed FROM range(5) r(i)",
    "q_relevance": f"SELECT path, regexp_matches(path, '[^/][.]go$') AS go, path = 'Cargo.toml' OR ends_with(path, '/Cargo.toml') AS cargo, regexp_matches(path, '[^/][.](js|mjs|cjs|jsx|ts|tsx)$') AS js FROM ({_PATHS_SQL}) p",
    "q_globs": f"SELECT path FROM ({_PATHS_SQL}) p WHERE (ends_with(path, '.go') OR starts_with(path, 'crates/')) AND NOT starts_with(path, 'vendor/')",
    "q_template_render": "SELECT p_partkey, concat(p_name, '<', p_type, '|', p_brand, '||', p_brand, ', ', p_type, '|$|$x|', p_brand, ', ', p_type, 'X>') AS rendered FROM part",
    "q_capabilities": "SELECT * FROM (VALUES " + ", ".join(f"('{lang}', '{module}', '{a}')" for lang, module, *actions in _ABILITIES for a in actions) + ") v(lang, module, action)",
    "q_explain": """SELECT 'mixed' AS name, CAST(idx AS INTEGER) AS idx, kind, item FROM (VALUES
        (0, 'match', '{"action": {"replace": "Fresh"}, "kind": "match", "match": "Old", "namespace": "go::symbol"}'),
        (1, 'match', '{"action": {"replace": "new"}, "kind": "match", "match": "old::path", "namespace": "rust::use"}'),
        (2, 'match', '{"action": {"replace": "serde2"}, "kind": "match", "match": "serde", "namespace": "rust::crate"}'),
        (3, 'match', '{"action": {"replace": "new.home"}, "kind": "match", "match": "old.pkg", "namespace": "java::package"}'),
        (4, 'match', '{"action": "ensure", "kind": "match", "match": "sys", "namespace": "python::import"}'),
        (5, 'match', '{"action": {"replace": "new-lib"}, "kind": "match", "match": "old-lib", "namespace": "js::import"}'),
        (6, 'include', '{"kind": "include", "path": "more"}')) v(idx, kind, item)""",
    "q_human_lines": f"SELECT path, concat('Would change ', path) AS line FROM ({_mixed_sql()}) s WHERE b <> a",
    "q_summary_line": f"SELECT concat('Done: ', count(*), ' file(s) seen, ', sum(CASE WHEN b <> a THEN 1 ELSE 0 END), ' changed, ', sum(strlen(b)), ' → ', sum(strlen(a)), ' bytes in 0 ms') AS line FROM ({_mixed_sql()}) s",
    "q_list_languages": "SELECT CAST(idx AS INTEGER) AS idx, name FROM (VALUES (0, 'go'), (1, 'rust'), (2, 'java'), (3, 'python'), (4, 'js')) v(idx, name)",
    "q_list_rules": "SELECT * FROM (VALUES " + ", ".join(f"('{lang}', '{module}', '{','.join(actions)}')" for lang, module, *actions in _ABILITIES) + ") v(lang, module, actions)",
    "q_exec_modes": f"""SELECT *, CASE {_MODES} ELSE 'dry-run' END AS mode FROM (VALUES ('human'), ('json'), ('ndjson'), ('diff')) f(format),
        {_BOOLS} w("write"), {_BOOLS} d(dry_run), {_BOOLS} c("check"), {_BOOLS} t(terminal)""",
    "q_include_expansion": """SELECT 'top' AS name,
        'Refactoring ''top'': [rust::crate "a" -> delete, python::import "z" -> ensure, go::symbol "x" -> "y", python::import "z" -> ensure]' AS shown, CAST(idx AS INTEGER) AS idx, rule
        FROM (VALUES (0, 'rust::crate "a" -> delete'), (1, 'python::import "z" -> ensure'), (2, 'go::symbol "x" -> "y"'), (3, 'python::import "z" -> ensure')) v(idx, rule)""",
    "q_bisect_culprit": """SELECT false AS ok, CAST(1 AS INTEGER) AS culprit, 'go::symbol "b" -> "bad"' AS label""",
    "q_unified_diff": _DIFF_SQL,
}
