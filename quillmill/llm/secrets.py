"""Secret scan: three fixed patterns, and a guess-cost estimate of values in credential contexts.

The base patterns are plain regular expressions.  The method goes on from there:
it takes values that stand after a credential word (``pwd: ...``, ``bearer ...``),
those of the base spans too, and finds, by dynamic programming, the cheapest way
to guess each one as a sequence of words, dates, repeats, keyboard walks and
brute-force characters. Base spans are given with their cost; other values that
cost many guesses are reported as spans of kind ``guess``, cheap ones are not.

One pass over the rows, no shuffle; texts without a keyword are never decoded.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_texts

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
_HEX_BYTES = re.compile(rb"[0-9a-f]{24}")

#: A word that announces a credential, what may stand between, and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|code|phrase|key)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|client|signing|encryption)[\x20_-]?(?:key|secret|token)|login)["']?(?:\x20*(?:[:=]|:=|=>|->)\x20*|\x20+is\x20+|(?<=[Bb]earer)\x20+)["'`]?([^\s"'`,;<>(){}\[\]]{6,})""",
    re.I | re.A,
)
_GATE = (b"pass", b"pwd", b"pin", b"secret", b"token", b"credential", b"auth", b"bearer", b"key", b"login")

# Frequent passwords and placeholder words, most frequent first.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football "
    "shadow michael superman batman trustno1 hello freedom whatever secret hunter killer pepper jordan harley ranger "
    "buster soccer hockey george charlie andrew thomas summer winter spring autumn flower cheese computer internet "
    "example changeme default test guest root user demo sample placeholder token apikey none null true false your "
    "here this that with from have will the and for not are but all any can had her was one our out day get has him "
    "his how man new now old see two way who boy did its let put say she too use work licence license value string"
).split()


def ranked_words(path: str) -> tuple[str, ...]:
    """Lower-case words of three letters or more from a vocabulary file of a BPE tokenizer with word ends, as its ids rank them; read by the driver alone."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t.removesuffix("</w>") for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    return tuple(w for w in words if len(w) >= 3 and w.isalpha() and w.islower())


class Words:
    """Words by rank: :data:`COMMON` first, then others as they are given. Bounded by the vocabulary."""

    def __init__(self, more: Sequence[str] = ()):
        self.rank = {w: i + 1 for i, w in reversed([*enumerate(dict.fromkeys((*COMMON, *more)))])}
        self.longest = max(map(len, self.rank))
        self.costs: dict[str, float] = {}


_PLAIN = Words()
_LEET = str.maketrans("4@310$5!7", "aaeiossit")
# Rows of a keyboard.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (y, x + (0, 0.5, 0.75, 1.25)[y]) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATES = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
_REPEAT = re.compile(r"(.{1,16}?)\1+", re.S)

#: log10 of the guesses that one more segment costs, for not knowing where it begins.
SEGMENT = math.log10(2)


def _single(c: str) -> float:
    """log10 of the guesses for one character on its own."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _matches(value: str, words: Words = _PLAIN) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every word, date, repeat, walk and run in ``value``."""
    low, out, n = value.lower(), [], len(value)
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + words.longest) + 1):
            rank = words.rank.get(low[i:j])
            extra = 0.0
            if rank is None and (rank := words.rank.get(plain[i:j])) is not None:
                extra = math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
            if rank is not None:
                upper = sum(map(str.isupper, value[i:j]))
                extra += 0.0 if not upper else 0.3 if upper == j - i or value[i].isupper() and upper == 1 else math.log10(math.comb(j - i, upper) + 1)
                out.append((i, j, math.log10(rank + 1) + extra))
    out += [(m.start(), m.end(), math.log10(120 * (365 if m.end() - m.start() > 4 else 1))) for m in _DATES.finditer(value)]
    for m in _REPEAT.finditer(value):
        unit = m[1]
        if len(m[0]) >= 3:
            once = sum(map(_single, unit)) if len(unit) == 1 or len(unit) == n else log10_guesses(unit, words)
            out.append((m.start(), m.end(), once + math.log10(len(m[0]) / len(unit))))
    i = 0
    while i < n - 2:  # keyboard walks
        j, turns, last = i + 1, 1, None
        while j < n and _near(low[j - 1], low[j]):
            p, q = _PLACE[low[j - 1]], _PLACE[low[j]]
            way = (q[0] - p[0], q[1] > p[1])
            turns += last is not None and way != last
            last = way
            j += 1
        if j - i >= 3:
            out.append((i, j, math.log10(47) + turns * math.log10(4.6) + math.log10(j - i)))
        i = max(i + 1, j - 1)
    i = 0
    while i < n - 2:  # abc, 987
        step, j = ord(value[i + 1]) - ord(value[i]), i + 1
        while abs(step) == 1 and j < n and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
        if j - i >= 3:
            out.append((i, j, math.log10(26) + math.log10(j - i)))
        i = max(i + 1, j - 1)
    return out


def log10_guesses(value: str, words: Words = _PLAIN) -> float:
    """log10 of the guesses for the whole ``value`` by its cheapest segmentation; 0 for no text."""
    if (known := words.costs.get(value)) is not None:
        return known
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _matches(value, words):
        ending.setdefault(j, []).append((i, cost))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = best[j - 1] + _single(value[j - 1])
        for i, cost in ending.get(j, ()):
            best[j] = min(best[j], best[i] + cost + SEGMENT)
    if len(words.costs) >= 4096:
        words.costs.clear()
    if len(value) <= 64:
        words.costs[value] = best[-1]
    return best[-1]


def find(text: str, least: float = 10.0, words: Words = _PLAIN) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses) of the secrets in ``text`` by start, then kind.

    Offsets are code points, ends exclusive.  A context value becomes a ``guess``
    span when it takes 10**least guesses or more and no base span overlaps it.
    Base spans stay whatever they cost; that of ``assign`` is its value's.
    """
    out = [("assign", *m.span(), log10_guesses(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), log10_guesses(m[0], words)) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), log10_guesses(m[0], words)) for m in HEX.finditer(text)]
    # the base spans as disjoint intervals
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(x[1:3] for x in out):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in CONTEXT.finditer(text):
        i = m.start(1)
        j = i + len(m[1].rstrip(".:!?"))
        at = bisect_left(starts, j)
        if j - i >= 6 and (not at or ends[at - 1] <= i):
            cost = log10_guesses(text[i:j], words)
            if cost >= least:
                out.append(("guess", i, j, cost))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))


def _scan(texts: pa.Array, least: float, words: Words) -> list:
    found = []
    for raw in texts.cast(pa.binary()).to_pylist():
        hit = False
        if raw:
            low = raw.lower()
            hit = any(k in low for k in _GATE) or b"AKIA" in raw or _HEX_BYTES.search(raw) is not None
        found.append([dict(zip(("kind", "start", "end", "log10_guesses"), x, strict=True)) for x in find(raw.decode(errors="replace"), least, words)] if hit else [])
    return [found]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 10.0, words: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``, the secrets of its whole text with the log10 of their guesses.

    ``words`` are ranked words besides :data:`COMMON`, say of :func:`ranked_words`.

    Null and empty texts have an empty list.  Repeated rows and null ids are
    kept as they are; other columns are not read; an empty table gives none.
    """
    fields = "spans array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(Words(words))  # as large as the vocabulary that was given
    return map_texts(docs, {id_col: id_col}, text_col, lambda texts: _scan(texts, least, shared.value), fields, [pa.field("spans", _SPANS)])
