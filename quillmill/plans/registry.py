"""Languages and their rules: what can be matched, and what rewrites it.

A rule is either a column expression (``columns``) or a function of one text
(``function``) that runs in Arrow batches.  New languages register a
:class:`Backend`; the first one registered for a name stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedOperation
from ..operators import calls, imports, manifests, symbols
from .dsl import Match


@dataclass(frozen=True)
class Action:
    name: str
    description: str


@dataclass(frozen=True)
class Module:
    name: str
    description: str
    actions: tuple[Action, ...]


@dataclass(frozen=True)
class Rule:
    """One rule, ready to run: which paths it is for, and what it does to their texts."""

    match: Match
    suffixes: tuple[str, ...]  # file extensions, or whole names that begin with a slash
    function: Callable[[str], str] | None = None
    rename: tuple[str, str] | None = None  # for the column form
    needle: str | None = None  # texts without it stay as they are

    @property
    def label(self) -> str:
        m = self.match
        tail = {"replace": f'-> "{m.argument}"', "replace_call": f'-> replace_call "{m.argument}"'}.get(m.action, f"-> {m.action}")
        return f'{m.lang}::{m.module} "{m.target}" {tail}'

    def relevant(self, path: Column) -> Column:
        """By the path alone, so that other files are never read."""
        return relevant((self,), path)

    def takes(self, path: str) -> bool:
        for s in self.suffixes:
            if s.startswith("/"):
                if path.endswith(s) or path == s[1:]:
                    return True
            elif path.endswith(f".{s}") and path[-len(s) - 2 : -len(s) - 1] not in ("", "/"):
                return True
        return False

    def apply(self, text: str) -> str:
        """The rule on one text, whichever form it has."""
        if self.rename:
            return symbols.rename(self.match.lang, text, *self.rename)
        if self.needle is not None and self.needle not in text:
            return text
        return self.function(text)


def relevant(rules: Iterable[Rule], path: Column) -> Column:
    """Whether one of the rules is for the path: all extensions are one regular expression."""
    suffixes = dict.fromkeys(s for r in rules for s in r.suffixes)
    tests = [(path == s[1:]) | path.endswith(s) for s in suffixes if s.startswith("/")]
    if endings := [s for s in suffixes if not s.startswith("/")]:
        tests.insert(0, path.rlike(rf"[^/]\.(?:{'|'.join(endings)})$"))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass
class Backend:
    """A language: its modules, and a builder for each (module, action)."""

    lang: str
    description: str
    modules: tuple[Module, ...]
    build: dict[tuple[str, str], Callable[[Match], Rule]] = field(default_factory=dict)

    def rule(self, m: Match) -> Rule:
        made = self.build.get((m.module, m.action))
        if made is None:
            raise UnsupportedOperation(f"{m.lang}::{m.module} has no action {m.action}")
        return made(m)


class Registry:
    def __init__(self, backends: tuple[Backend, ...] = ()):
        self._by: dict[str, Backend] = {}
        for b in backends:
            self.register(b)

    def register(self, backend: Backend) -> None:
        self._by.setdefault(backend.lang, backend)

    def languages(self) -> list[str]:
        return list(self._by)

    def get(self, lang: str) -> Backend:
        if lang not in self._by:
            raise UnsupportedOperation(f"unknown language {lang}")
        return self._by[lang]

    def rule(self, m: Match) -> Rule:
        return self.get(m.lang).rule(m)

    def capabilities(self) -> list[tuple[str, str, str, str, str, str]]:
        """(lang, its description, module, its description, action, its description), in order."""
        return [(b.lang, b.description, m.name, m.description, a.name, a.description) for b in self._by.values() for m in b.modules for a in m.actions]


# The extensions of each language's files.
SUFFIXES = {"go": ("go",), "rust": ("rs",), "java": ("java",), "python": ("py",), "js": ("js", "mjs", "cjs", "jsx", "ts", "tsx")}


def _imports(lang: str, module: str, actions: tuple[str, ...]) -> dict:
    ext = SUFFIXES[lang]
    made = {
        "replace": lambda m: Rule(m, ext, lambda t: imports.replace(lang, t, m.target, m.argument), needle=_needle(lang, m.target)),
        "delete": lambda m: Rule(m, ext, lambda t: imports.delete(lang, t, m.target), needle=_needle(lang, m.target)),
        "ensure": lambda m: Rule(m, ext, lambda t: imports.ensure(lang, t, m.target)),
    }
    return {(module, a): made[a] for a in actions}


def _needle(lang: str, target: str) -> str:
    """What a text must hold for the target to be in it: dotted names may be broken by blanks."""
    return target.split(".")[0] if lang in ("python", "java") else target


def _symbol(lang: str) -> dict:
    return {("symbol", "replace"): lambda m: Rule(m, SUFFIXES[lang], rename=(m.target, m.argument), needle=m.target)}


def _call(lang: str) -> dict:
    return {("call", "replace_call"): lambda m: Rule(m, SUFFIXES[lang], lambda t: calls.rewrite(lang, t, m.target, m.argument), needle=m.target)}


def _module(name: str, description: str, **actions: str) -> Module:
    return Module(name, description, tuple(Action(a, d) for a, d in actions.items()))


_TEMPLATE = "Put the rendered template in place of the whole call."
_RENAME = "Rename every identifier that is spelled like the target, in code only."


def _symbols(what: str) -> Module:
    return _module("symbol", f"Identifiers: {what}. Scope is not looked at, so read the diff before writing.", replace=_RENAME)


def default_registry() -> Registry:
    """The five languages."""
    go = Backend(
        "go",
        "Go source files (.go)",
        (
            _module("import", "Import paths, compared whole.", replace="Put another path in place of the target.", delete="Take the import's lines away.", ensure="Add the import unless it is there."),
            _symbols("functions, types, fields and variables"),
            _module("struct_tag", "key:value pairs in the tags of struct fields.", replace="Put another pair in place of the target."),
            _module("call", "Calls whose function is written like the target.", replace_call=_TEMPLATE),
        ),
        _imports("go", "import", ("replace", "delete", "ensure"))
        | _symbol("go")
        | _call("go")
        | {("struct_tag", "replace"): lambda m: Rule(m, ("go",), lambda t: manifests.rename_tag(t, m.target, m.argument), needle=m.target.split(":")[0])},
    )
    rust = Backend(
        "rust",
        "Rust source files (.rs) and Cargo.toml",
        (
            _module("use", "Paths of use declarations, compared by leading segments.", replace="Put another prefix in place of the target.", delete="Take matching declarations away.", ensure="Add a use declaration unless one covers it."),
            _symbols("functions, types, fields and shorthand fields"),
            _module("crate", "Dependencies in Cargo.toml.", replace="Rename the dependency's key.", delete="Take the dependency away."),
            _module("call", "Calls whose function is written like the target; methods are not.", replace_call=_TEMPLATE),
        ),
        _imports("rust", "use", ("replace", "delete", "ensure"))
        | _symbol("rust")
        | _call("rust")
        | {
            ("crate", "replace"): lambda m: Rule(m, ("/Cargo.toml",), lambda t: manifests.rename_crate(t, m.target, m.argument), needle=m.target),
            ("crate", "delete"): lambda m: Rule(m, ("/Cargo.toml",), lambda t: manifests.delete_crate(t, m.target), needle=m.target),
        },
    )
    java = Backend(
        "java",
        "Java source files (.java)",
        (
            _module("import", "Imports, compared whole; static ones count.", replace="Put another name in place of the target.", delete="Take the import's lines away.", ensure="Add the import unless it is there."),
            _module("package", "The package declaration.", replace="Put another package in place of the target."),
            _symbols("classes, methods, fields and variables"),
        ),
        _imports("java", "import", ("replace", "delete", "ensure"))
        | _symbol("java")
        | {("package", "replace"): lambda m: Rule(m, ("java",), lambda t: imports.replace_package(t, m.target, m.argument), needle=_needle("java", m.target))},
    )
    python = Backend(
        "python",
        "Python source files (.py)",
        (
            _module("import", "Imported modules, compared by leading segments.", replace="Put another prefix in place of the target.", delete="Take matching statements away.", ensure="Add the import unless one covers it."),
            _symbols("functions, classes and variables"),
        ),
        _imports("python", "import", ("replace", "delete", "ensure")) | _symbol("python"),
    )
    js = Backend(
        "js",
        "JavaScript and TypeScript source files (.js .mjs .cjs .jsx .ts .tsx)",
        (
            _module("import", "Module specifiers of import and export statements.", replace="Put another specifier in place of the target.", delete="Take matching statements away."),
            _symbols("functions, variables and properties"),
        ),
        _imports("js", "import", ("replace", "delete")) | _symbol("js"),
    )
    return Registry((go, rust, java, python, js))


def capabilities(spark, registry: Registry | None = None):
    """The capabilities as a table."""
    return spark.createDataFrame((registry or default_registry()).capabilities(), "lang string, lang_description string, module string, module_description string, action string, action_description string")


def schema(registry: Registry | None = None) -> dict:
    """Languages, modules and actions as plain values for JSON."""
    r = registry or default_registry()
    return {"languages": [list_rules(lang, r) for lang in r.languages()]}


def list_languages(registry: Registry | None = None) -> dict:
    r = registry or default_registry()
    return {"languages": [{"name": b.lang, "description": b.description} for b in map(r.get, r.languages())]}


def list_rules(lang: str, registry: Registry | None = None) -> dict:
    b = (registry or default_registry()).get(lang)
    return {
        "name": b.lang,
        "description": b.description,
        "modules": [{"name": m.name, "description": m.description, "actions": [{"name": a.name, "description": a.description} for a in m.actions]} for m in b.modules],
    }


