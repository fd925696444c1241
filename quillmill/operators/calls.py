"""``call``: rewrites calls of a function by a template, in Go and Rust."""

from __future__ import annotations

from ..functions.lexers import Token, code
from ..functions.template import render

_OPEN, _SHUT = "([{", ")]}"


def _close(tokens: list[Token], i: int) -> int:
    """The token that closes the bracket at ``i``, or -1."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].kind == "p":
            depth += (tokens[j].text in _OPEN) - (tokens[j].text in _SHUT)
            if not depth:
                return j
    return -1


def _arguments(lang: str, tokens: list[Token], i: int, j: int) -> list[tuple[int, int]]:
    """(start, end) of the arguments between the brackets at ``i`` and ``j``, cut at outermost commas."""
    out, depth, angle, start, pipe = [], 0, 0, None, False
    for k in range(i + 1, j):
        t = tokens[k]
        if t.kind == "p":
            if lang == "rust" and t.text == "|" and not depth and (pipe or start is None or tokens[k - 1].text == "move"):
                pipe = not pipe  # a closure's parameters
            elif lang == "rust" and t.text == "<" and k >= 2 and tokens[k - 1].text == tokens[k - 2].text == ":":
                angle += 1
            elif lang == "rust" and angle and t.text in "<>":
                angle += 1 if t.text == "<" else -(tokens[k - 1].text not in "-=")
            depth += (t.text in _OPEN) - (t.text in _SHUT)
            if t.text == "," and not depth and not angle and not pipe:
                if start is not None:
                    out.append((start, tokens[k - 1].end))
                start = None
                continue
        if start is None:
            start = t.start
    if start is not None:
        out.append((start, tokens[j - 1].end))
    return out


def _skips(lang: str, tokens: list[Token]) -> list[bool]:
    """Which tokens stand where no call can: attributes and macro arguments in Rust, method lists of Go's interfaces."""
    out, i = [False] * len(tokens), 0
    while i < len(tokens):
        t, nxt = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
        begin = -1
        if lang == "rust" and t.text == "#" and nxt is not None:
            begin = i + 1 if nxt.text == "[" else i + 2 if nxt.text == "!" and i + 2 < len(tokens) and tokens[i + 2].text == "[" else -1
        elif lang == "rust" and t.text == "!" and i and tokens[i - 1].kind == "i" and nxt is not None and nxt.kind == "p" and nxt.text in _OPEN:
            begin = i + 1
        elif lang == "go" and t.text == "interface" and nxt is not None and nxt.text == "{":
            begin = i + 1
        if begin > 0 and (end := _close(tokens, begin)) > 0:
            out[begin : end + 1] = [True] * (end + 1 - begin)
            i = end
        i += 1
    return out


def rewrite(lang: str, text: str, target: str, template: str) -> str:
    """Calls whose function is written exactly as ``target``, each replaced by the rendered template.

    Arguments are their source text; calls within them are rewritten first.
    """
    if not target or target not in text:
        return text
    tokens = code(lang, text)
    skip = _skips(lang, tokens)
    starts = {t.start: k for k, t in enumerate(tokens)}
    ends = {t.end: k for k, t in enumerate(tokens)}
    out, at, pos = [], 0, text.find(target)
    while pos >= 0:
        i, last = starts.get(pos), ends.get(pos + len(target))
        nxt = pos + 1
        if i is not None and last is not None and last + 1 < len(tokens) and tokens[last + 1].text == "(" and not skip[i] and tokens[i].kind != "s" and _begins(lang, tokens, i):
            j = _close(tokens, last + 1)
            if j > 0:
                args = [rewrite(lang, text[a:b], target, template) for a, b in _arguments(lang, tokens, last + 1, j)]
                out += [text[at:pos], render(template, target, args)]
                at = nxt = tokens[j].end
        pos = text.find(target, nxt)
    return "".join([*out, text[at:]]) if out else text


def _begins(lang: str, tokens: list[Token], i: int) -> bool:
    """Whether a callee can begin at ``i``: no path or selector goes before it, and it isn't being declared."""
    if not i:
        return True
    before = tokens[i - 1]
    if before.text == "." and not (lang == "rust" and i > 1 and tokens[i - 2].text == "."):
        return False
    if lang == "rust":
        return before.text not in ("fn", "struct", "enum", "macro") and not (before.text == ":" and i > 1 and tokens[i - 2].text == ":")
    if before.text in ("func", "type"):
        return False
    if before.text == ")":  # func (r T) name(
        depth, k = 0, i - 1
        while k >= 0:
            depth += (tokens[k].text == ")") - (tokens[k].text == "(")
            if not depth:
                break
            k -= 1
        return not (k > 0 and tokens[k - 1].text == "func")
    return True
