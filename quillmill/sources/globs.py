"""Globs in ignore-file syntax, as regular expressions over paths relative to a folder."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError


def glob_regex(pattern: str) -> str:
    """The pattern of one glob, for a whole relative path; a match of a folder takes what is below it.

    ``*`` and ``?`` stay within a segment, ``**`` spans segments, ``{a,b}`` and
    ``[a-z]`` choose. A pattern with a slash that isn't its last character is
    anchored; any other one matches at every depth.
    """
    only_dirs = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        raise ConfigError(f"empty glob {pattern!r}")
    out, i, depth = [], 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if body.startswith("**", i) and i + 2 == len(body) and (i == 0 or body[i - 1] == "/"):
            out.append(".+")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = body.find("]", i + 2)
            if j < 0:
                raise ConfigError(f"unclosed [ in glob {pattern!r}")
            inner = body[i + 1 : j]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ConfigError(f"unclosed {{ in glob {pattern!r}")
    head = "" if anchored else "(?:.*/)?"
    regex = rf"{head}{''.join(out)}" + ("/.*" if only_dirs else "(?:/.*)?")
    try:
        re.compile(regex)
    except re.error as e:
        raise ConfigError(f"glob {pattern!r}: {e}") from e
    return regex


def selected(rel: Column, include: list[str], exclude: list[str]) -> Column:
    """Paths that an include glob takes (all, if there is none) and no exclude glob does."""
    test = lambda g: rel.rlike(rf"\A(?:{glob_regex(g)})\z")
    out = reduce(lambda a, b: a | b, map(test, include)) if include else F.lit(True)
    return out & ~reduce(lambda a, b: a | b, map(test, exclude)) if exclude else out


def takes(rel: str, include: list[str], exclude: list[str]) -> bool:
    """The same for one path."""
    hit = lambda gs: any(re.fullmatch(glob_regex(g), rel) for g in gs)
    return (not include or hit(include)) and not hit(exclude)


class Ignore:
    """Rules of ignore files. The last rule that matches counts, and deeper files come later."""

    def __init__(self, rules: list[tuple[str, re.Pattern, bool, bool]] | None = None):
        self.rules = rules or []

    def plus(self, folder: str, name: str) -> Ignore:
        """With the rules of the file ``name`` in ``folder``, if it is there."""
        return self.file(folder, os.path.join(folder, name))

    def file(self, folder: str, path: str) -> Ignore:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
        except OSError:
            return self
        more = []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            body = line[1:] if back else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
            try:
                regex = glob_regex(body.rstrip("/") if body.rstrip("/") else body)
            except ConfigError:
                continue
            regex = regex.removesuffix("(?:/.*)?")
            more.append((folder, re.compile(regex), back, body.endswith("/")))
        return Ignore([*self.rules, *more])

    def has(self, path: str, is_dir: bool) -> bool:
        for folder, regex, back, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and path.startswith(folder + os.sep) and regex.fullmatch(os.path.relpath(path, folder).replace(os.sep, "/")):
                return not back
        return False
