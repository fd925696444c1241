"""The rule language: ``refactor "name" { match lang::module "target" { action } include "path" }``.

Everything here runs on the driver and starts no job.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from ..errors import ConfigError, ParseError, SourceError


@dataclass(frozen=True)
class Match:
    lang: str
    module: str
    target: str
    action: str  # replace, delete, ensure, replace_call
    argument: str | None = None


@dataclass(frozen=True)
class Include:
    path: str


@dataclass(frozen=True)
class Command:
    name: str
    items: tuple[Match | Include, ...]


_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*)|(?P<word>[a-zA-Z_][a-zA-Z0-9_]*)|(?P<string>"[^"]*")|(?P<mark>::|[{}])')
KEYWORDS = ("refactor", "match", "include", "replace", "delete", "ensure", "replace_call")


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {_where(text, at)}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return out


def _where(text: str, at: int) -> str:
    return f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}"


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, _tokens(text), 0

    def next(self, kind: str, value: str | None = None) -> str:
        want = value or {"word": "a name", "string": "a string"}.get(kind, kind)
        if self.i >= len(self.tokens):
            raise ParseError(f"expected {want}, but the script ends")
        k, v, at = self.tokens[self.i]
        if k != kind or value is not None and v != value:
            raise ParseError(f"expected {want}, not {v}, at {_where(self.text, at)}")
        self.i += 1
        return v

    def string(self) -> str:
        return self.next("string")[1:-1]

    def peek(self) -> str | None:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else None

    def program(self) -> Command:
        self.next("word", "refactor")
        name, items = self.string(), []
        self.next("mark", "{")
        while self.peek() != "}":
            if self.peek() == "include":
                self.i += 1
                items.append(Include(self.string()))
            else:
                items.append(self.match())
        self.next("mark", "}")
        if self.i < len(self.tokens):
            raise ParseError(f"one refactor block a script; more begins at {_where(self.text, self.tokens[self.i][2])}")
        return Command(name, tuple(items))

    def match(self) -> Match:
        self.next("word", "match")
        lang = self._name()
        self.next("mark", "::")
        module = self._name()
        target = self.string()
        self.next("mark", "{")
        action = self.next("word")
        if action not in ("replace", "delete", "ensure", "replace_call"):
            raise ParseError(f"unknown action {action}")
        argument = self.string() if action in ("replace", "replace_call") else None
        self.next("mark", "}")
        return Match(lang, module, target, action, argument)

    def _name(self) -> str:
        word = self.next("word")
        if word in KEYWORDS:
            raise ParseError(f"{word} is reserved")
        return word


def parse(text: str) -> Command:
    """A script as its tree; includes stay as they are. Raises :class:`ParseError`."""
    return _Parser(text).program()


def read_script(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise SourceError(f"{path}: {e}") from e


def expand(command: Command, base: str | None, stack: tuple[str, ...] = ()) -> list[Match]:
    """The rules in order, those of included scripts in their place.

    A script may be included twice, but not from within itself.
    """
    out: list[Match] = []
    for item in command.items:
        if isinstance(item, Match):
            out.append(item)
            continue
        if base is None:
            raise ConfigError(f'include "{item.path}": a script without a path can\'t include others')
        path = os.path.realpath(os.path.join(base, item.path))
        if path in stack:
            raise ConfigError(f"circular include of {path}")
        out += expand(parse(read_script(path)), os.path.dirname(path), (*stack, path))
    return out


def explain(command: Command) -> dict:
    """The tree as plain values for JSON."""
    items = []
    for x in command.items:
        if isinstance(x, Include):
            items.append({"kind": "include", "path": x.path})
        else:
            items.append({"kind": "match", "namespace": f"{x.lang}::{x.module}", "match": x.target, "action": x.action if x.argument is None else {x.action: x.argument}})
    return {"name": command.name, "items": items}
