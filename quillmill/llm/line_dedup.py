"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words.  Words are ordered by rarity over the whole
corpus; the prefix filter takes each line's rarest words, the length filter
compares sizes, the positional filter bounds what can follow a common word, and
what is left is verified by Jaccard similarity on whole sets.  A line goes when
an earlier line (by document, then line number) is similar to it.

1. ``lines``: the texts are read once. Sets are kept packed, and words counted.
2. ``met``: of equal sets each task gives out the first place only.  Prefix
   entries meet in blocks by word; what comes out are the entries that another
   one may be similar to by size, position and a parity sketch, this being the
   first word that they have in common, and the copies.
3. ``links``: these entries come together once more, now with whole sets.  A
   pair is counted in the first word that both sets' order has in common, so
   nowhere twice, and only sums by class leave the task: no pair is ever stored.
   A word of very many classes is dealt into tiles, pairs of parts of them.
   Both steps go in parts by word, one after the other, so that only a part
   of what is shuffled is on disk at a time.
4. Lines of over ``SHORT`` words have too many entries for that: theirs meet
   without sets, and the pairs that size and a 512-bit sketch leave are verified
   on sets that are fetched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .frames import drop_folder, finished, in_parts, lean, shared_folder, stored
from .setjoin import DEN, NUM, Rarity, Sets
from .tokens import Texts, chunks, column, lower, mix, word_hashes, words

#: Words are told apart by so many bits of their hashes.
_BITS = 48

#: Bytes of text whose lines are packed into a row, and of the stored sets that a task reads at a time, about: the JVM keeps large arrays badly.
_ROW, _ROW_GROUP = 1 << 18, 4 << 20


class Sizes(NamedTuple):
    """What is worked on at a time, and how. None of these changes a result."""

    held: int = 400_000  # elements
    pairs: int = 100_000
    few: int = 50_000  # entries with their sets that are given out
    small: int = 8192  # classes of a word: up to here each pair is tested in the first round
    tile: int = 8192  # classes of a word that meet in one task; more are dealt into tiles
    short: int = 256  # words of a line whose set goes along with each of its entries, a fifth of so many
    parts: int = 2  # of the first round
    share: float = 0.25  # of the texts' bytes: what goes along with entries is dealt in parts of so many bytes, about
    least: int = 32 << 20  # bytes, but no less than these


#: Words at most that are dealt into tiles; where there would be more, tiles are larger.
MOST_TILED = 100_000


def line_sets(part: Texts, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, bounds, elements) of the lines with ``least`` distinct words or more; lines count from 0."""
    data = lower(part.data)
    w = words(Texts(data, part.offsets, 0))
    tokens = word_hashes(data, w) >> np.uint64(64 - _BITS)
    # lines of all texts are numbered through; a new text begins a new line
    begin = np.union1d(np.flatnonzero(data == 0x0A) + 1, part.offsets[:-1])
    size = np.diff(np.append(np.searchsorted(w.starts, begin), len(tokens)))
    line = np.repeat(np.arange(len(begin), dtype=np.uint64), size)
    if len(begin) < 1 << (64 - _BITS):
        key = np.sort(line << np.uint64(_BITS) | tokens)
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        own, elements = (key >> np.uint64(_BITS)).astype(np.int64), key << np.uint64(64 - _BITS)
    else:
        order = np.lexsort((tokens, line))
        own, elements = line[order].astype(np.int64), tokens[order] << np.uint64(64 - _BITS)
        fresh = np.append(True, (own[1:] != own[:-1]) | (elements[1:] != elements[:-1]))[: len(own)]
        own, elements = own[fresh], elements[fresh]
    size = np.bincount(own, minlength=len(begin))
    some = size >= max(1, least)
    elements = elements[np.repeat(some, size)]
    text = np.searchsorted(part.offsets[:-1], begin, "right") - 1
    # texts of no bytes begin where the next one does: its first line is that of the last of them
    first = np.searchsorted(begin, part.offsets[:-1])
    return text[some], (np.arange(len(begin)) - first[text])[some], np.concatenate([[0], np.cumsum(size[some])]), elements


def _slim(elements: np.ndarray) -> bytes:
    """The 48 bits of each element."""
    return elements.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unslim(raw) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, 2:] = x
    return out.view(np.uint64).reshape(-1)


def _picked(s: Sets, at: np.ndarray) -> Sets:
    """The sets at these places."""
    size = np.diff(s.bounds)[at]
    bounds = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(bounds[-1]) + np.repeat(s.bounds[at] - bounds[:-1], size)
    return Sets(s.doc[at], s.line[at], bounds, s.elements[index], s.sketch[at])


_LINES = f"doc binary, line binary, size binary, sets binary, {setjoin.Counts.fields}"


def packed_lines(docs: DataFrame, least: int) -> DataFrame:
    """Rows of some lines each: documents, line numbers, sizes and sets as bytes; and, at a task's end, rows of its counts of words.

    ``docs`` has the columns id and text, without nulls.
    """

    def rows(**given):
        n = len(next(iter(given.values())))
        kinds = {"block": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(given.get(c) or [None] * n, kinds.get(c, pa.binary())) for c in ("doc", "line", "size", "sets", "block", "place", "n")], names=["doc", "line", "size", "sets", "block", "place", "n"])

    def run(batches):
        met = setjoin.Counts()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in chunks(*column(batch, "text"), _ROW):
                of, line, bounds, elements = line_sets(part, least)
                if len(of):
                    met.add(elements)
                    yield rows(
                        doc=[np.ascontiguousarray(ids[part.first + of]).tobytes()],
                        line=[line.astype(np.int32).tobytes()],
                        size=[np.diff(bounds).astype(np.uint32).tobytes()],
                        sets=[_slim(elements)],
                    )
        blocks, places, n = met.rows()
        yield from in_parts(rows(block=blocks, place=places, n=n))

    return docs.mapInArrow(lean(run), _LINES)


def _read(batches, most: int) -> Iterator[Sets]:
    """The sets of packed rows, about ``most`` elements at a time."""

    def joined(parts):
        doc, line, size, elements = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Sets(doc, line, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), elements, np.zeros((len(doc), 2), np.uint64))

    parts, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            doc, line, size, sets = (batch.column(c)[i].as_buffer() for c in ("doc", "line", "size", "sets"))
            parts.append((np.frombuffer(doc, np.int64), np.frombuffer(line, np.int32), np.frombuffer(size, np.uint32), _unslim(sets)))
            held += len(parts[-1][-1])
            if held >= most:
                yield joined(parts)
                parts, held = [], 0
    if parts:
        yield joined(parts)


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


#: Pairs that are tested at a time.
_TESTED = 1 << 18


def _windows(column: np.ndarray, n: np.ndarray, pos: np.ndarray, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries of a column whose first common word it may be, by size and position, i of ``some``.

    Entries stand by column (numbers below 2**31) and size. What lies behind the
    column in both sets, and it, bound the overlap, as nothing before is in both.
    """
    column, n = column.astype(np.int64) << 32, n.astype(np.int64)
    left = n - pos  # positions that were cut off only leave more
    # the largest set that an entry's own position allows; never over DEN / NUM of its size
    most = (NUM + DEN) * left // NUM - n
    begin = np.arange(1, len(n) + 1)
    end = np.searchsorted(column | n, column | np.clip(most, 0, (1 << 32) - 1), "right")
    some = some[end[some] > begin[some]]
    count = end[some] - begin[some]
    total = np.cumsum(count)
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _TESTED, "right")))
        of, j = _ranges(begin[some[at:to]], count[at:to])
        i = some[at:to][of]
        ok = (NUM + DEN) * left[j] >= NUM * (n[i] + n[j])
        yield i[ok], j[ok]
        at = to


def _paired(sizes: np.ndarray, n: np.ndarray, pos: np.ndarray, apart, small: int) -> np.ndarray:
    """Which entries may be similar to another whose first common word is their column, as far as size, position and sketch tell.

    ``sizes`` are those of the columns, whose entries stand together by size.
    Similar sets pass in their first common column, where they are counted.
    Columns of over ``small`` entries are kept whole.
    """
    has = np.repeat(sizes, sizes) > small
    n = n.astype(np.int64)
    for i, j in _windows(np.repeat(np.arange(len(sizes)), sizes), n, pos.astype(np.int64), np.flatnonzero(~has)):
        ok = (NUM + DEN) * apart(i, j) <= (DEN - NUM) * (n[i] + n[j])
        has[i[ok]] = True
        has[j[ok]] = True
    return has


_ENTRY = (("rem", np.uint32), ("cls", np.uint64), ("doc", np.int64), ("line", np.int32), ("n", np.uint32), ("pos", np.uint16), ("sketch", np.uint64), ("sketch2", np.uint64))

#: Sets of more words have 128 parities in the first round, others 64.
LONG = 96

#: With a class's size: its task has copies of it.
_COPIED = np.uint32(1 << 31)

#: Kinds of rows that :func:`meetings` gives: an entry that may have partners, a class with copies, a copy, and a word of many classes.
ENTRY, HEAD, COPY, TILED = range(4)


def meetings(lines: DataFrame, rare: Rarity, bits: int, sizes: Sizes, part: int = 0, parts: int = 1) -> DataFrame:
    """Rows (kind, elem, cls, doc, line, n) from packed lines; see the kinds. Of every ``parts`` words it takes one."""
    shift = 64 - bits - 32
    shared = lines.sparkSession.sparkContext.broadcast(rare)  # 16 MB
    names = ["block", *(x for x, _ in _ENTRY)]

    def blocks(number, cols):
        """Rows of packed columns by block; ``cols`` are sorted by ``number``."""
        at = np.flatnonzero(_fresh(number))
        ends = np.append(at, len(number))
        arrays = [pa.array([setjoin.planes(np.ascontiguousarray(c[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)] if c is not None else [b""] * len(at), pa.binary()) for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(number[at].astype(np.int32)), *arrays], names=names)

    def deal(batches):
        for s in _read(batches, sizes.held):
            cls = setjoin.class_ids(s)
            order = np.lexsort((s.line, s.doc, cls))
            first = _fresh(cls[order])
            size = np.diff(np.append(np.flatnonzero(first), len(order)))
            own, copies = order[first], order[~first]
            # copies go on as they are, to any block
            salt = -1 - (mix(cls[copies] + mix(s.doc[copies].astype(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)
            copies, salt = copies[salt % parts == part], salt[salt % parts == part]
            if len(copies):
                by = np.argsort(salt, kind="stable")
                yield from in_parts(blocks(salt[by], [None, *(np.ascontiguousarray(x[copies][by]) for x in (cls, s.doc, s.line)), None, None, None, None]))
            cls, mark = cls[own], np.where(size > 1, _COPIED, np.uint32(0))
            s = _picked(s, own)
            sketch = setjoin.parities(s.elements, s.bounds)
            fold = sketch[:, 0] ^ sketch[:, 1]  # the same elements' 64 parities
            more = np.where(np.diff(s.bounds) > LONG, sketch[:, 1], np.uint64(0))
            of, pos, at = setjoin.prefixes(s, shared.value)
            # nobody is met in a word that was met once
            k = s.elements[at] >> np.uint64(shift)
            often = (shared.value.of(s.elements[at]) > 0) & (k % np.uint64(parts) == np.uint64(part))
            of, pos, k = of[often], pos[often], k[often]
            order = setjoin.sorted_order(k, bits + 32)
            k, of, pos = k[order], of[order], pos[order]
            n = np.diff(s.bounds).astype(np.uint32) | mark
            yield from in_parts(blocks(k >> np.uint64(32), [k.astype(np.uint32), cls[of], s.doc[of], s.line[of], n[of], np.minimum(pos, 65535).astype(np.uint16), fold[of], more[of]]))

    def found(kind, elem, cls, doc, line, n):
        size = len(cls)
        column = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), size).astype(t))
        return pa.RecordBatch.from_arrays([column(kind, np.int8), *(column(x, np.int64) for x in (elem, cls, doc)), column(line, np.int32), column(n, np.int64)], names=["kind", "elem", "cls", "doc", "line", "n"])

    def meet(batches):
        for block, parts in setjoin._groups(batches, len(_ENTRY)):
            rem, cls, doc, line, n, pos, sketch, sketch2 = (np.concatenate([setjoin.unplaned(x, kind) for x in xs]) for xs, (_, kind) in zip(parts, _ENTRY, strict=True))
            if block < 0:
                yield found(COPY, 0, cls.view(np.int64), doc, line, 0)
                continue
            order = setjoin.sorted_order(rem.astype(np.uint64), 32)
            # of the columns with a single entry only those that tell of copies matter
            alone = _fresh(rem[order])
            alone &= np.append(alone[1:], True)
            heads = order[alone][(pos[order[alone]] == 0) & (n[order[alone]] >= _COPIED)]
            if len(heads):
                yield found(HEAD, 0, cls[heads].view(np.int64), doc[heads], line[heads], 0)
            order = order[~alone]
            order = order[np.lexsort((line[order], doc[order], cls[order], rem[order]))]
            first = _fresh(rem[order], cls[order])
            size = np.diff(np.append(np.flatnonzero(first), len(order)))
            begins = pos[order] == 0  # all or none of a class's entries in a column
            copies = order[begins & ~first]
            # a task's mark counts, whichever of the class's entries has it
            marked = np.maximum.reduceat(n[order], np.flatnonzero(first)) >= _COPIED if len(order) else np.zeros(0, bool)
            order = order[first]
            heads = order[(pos[order] == 0) & (marked | (size > 1))]
            for kind, at in ((HEAD, heads), (COPY, copies)):
                if len(at):
                    yield found(kind, 0, cls[at].view(np.int64), doc[at], line[at], 0)
            n = n & ~_COPIED
            number = _fresh(rem[order])
            size = np.diff(np.append(np.flatnonzero(number), len(order)))
            order = order[np.repeat(size > 1, size)]
            if not len(order):
                continue
            order = order[np.lexsort((n[order], rem[order]))]
            own, fold, more = n[order], sketch[order], sketch2[order]

            def apart(i, j, own=own, fold=fold, more=more):
                x, y = fold[i] ^ fold[j], more[i] ^ more[j]
                out = np.bitwise_count(x).astype(np.int64)
                both = (own[i] > LONG) & (own[j] > LONG)
                return np.where(both, np.bitwise_count(x ^ y).astype(np.int64) + np.bitwise_count(y), out)

            order = order[_paired(size[size > 1], own, pos[order], apart, sizes.small)]
            elem = (np.uint64(block) << np.uint64(32) | rem[order].astype(np.uint64)).view(np.int64)
            for i in range(0, len(order), 65536):
                o = order[i : i + 65536]
                yield found(ENTRY, elem[i : i + 65536], cls[o].view(np.int64), doc[o], line[o], n[o])
            begin = np.flatnonzero(_fresh(elem))
            size = np.diff(np.append(begin, len(elem)))
            if (size > sizes.tile).any():
                yield found(TILED, elem[begin[size > sizes.tile]], np.zeros(int((size > sizes.tile).sum()), np.int64), 0, 0, size[size > sizes.tile])

    dealt = lines.filter("doc IS NOT NULL").select("doc", "line", "size", "sets").mapInArrow(lean(deal), "block int, rem binary, cls binary, doc binary, line binary, n binary, pos binary, sketch binary, sketch2 binary")
    return setjoin._by_block(dealt).mapInArrow(lean(meet), "kind byte, elem long, cls long, doc long, line int, n long")


class Tiles(NamedTuple):
    """Words whose classes are dealt into parts, and the number of parts of each; a task gets two parts of a word, or one."""

    elems: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, met: DataFrame, least: int) -> Tiles:
        many = met.filter(F.col("kind") == TILED)
        while many.filter(F.col("n") > least).count() > MOST_TILED:
            least *= 2
        rows = sorted((r["elem"], -(-r["n"] // least)) for r in many.filter(F.col("n") > least).select("elem", "n").collect())
        return cls(np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64))

    def dealt(self, k: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, key, side): where each entry goes. Pairs are those of side 0, and of side 1 with side 2."""
        at = np.minimum(np.searchsorted(self.elems, k), max(0, len(self.elems) - 1))
        many = self.elems[at] == k if len(self.elems) else np.zeros(len(k), bool)
        entry, key, side = [np.flatnonzero(~many)], [mix(k[~many])], [np.zeros(int((~many).sum()), np.uint8)]
        for i in np.flatnonzero(many).tolist():
            n = int(self.parts[at[i]])
            own = int(mix(cls[i : i + 1] ^ np.uint64(0x9E3779B97F4A7C15))[0] % np.uint64(n))
            other = np.arange(n)
            tile = np.minimum(own, other) * n + np.maximum(own, other) + 1
            entry.append(np.full(n, i))
            with np.errstate(over="ignore"):
                key.append(mix(mix(k[i : i + 1]) + tile.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            side.append(np.where(other == own, 0, np.where(own < other, 1, 2)).astype(np.uint8))
        return np.concatenate(entry), np.concatenate(key), np.concatenate(side)


def _entry_keys(elem: np.ndarray, cls: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(elem.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + cls.astype(np.uint64))


_WHOLE = (("key", np.uint64), ("cls", np.uint64), ("doc", np.int64), ("line", np.int32), ("n", np.uint32), ("pos", np.uint32), ("side", np.uint8))


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, index) of all indices of the ranges."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def _common(elements: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """How many elements each pair of ranges (begin, size) has in common."""
    out = np.zeros(len(a[0]), np.int64)
    total = np.cumsum(a[1] + b[1])
    i = 0
    while i < len(out):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + most, "right")))
        j = min(j, i + (1 << (64 - _BITS)))  # the pair's number has the bits that an element leaves
        (x, p), (y, q) = _ranges(a[0][i:j], a[1][i:j]), _ranges(b[0][i:j], b[1][i:j])
        key = np.sort(np.concatenate([x, y]).astype(np.uint64) << np.uint64(_BITS) | elements[np.concatenate([p, q])] >> np.uint64(64 - _BITS))
        twice = key[1:][key[1:] == key[:-1]]
        out[i:j] = np.bincount((twice >> np.uint64(_BITS)).astype(np.int64), minlength=j - i)
        i = j
    return out


def _candidates(column: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, sketch: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of the same column that size, position and sketch allow, ``most`` or so at a time."""
    out, held = [], 0
    for i, j in _windows(column, n, pos, np.arange(len(n))):
        ok = (side[i] == 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        ok = (NUM + DEN) * apart <= (DEN - NUM) * (n[i] + n[j])
        out.append((i[ok], j[ok]))
        held += len(out[-1][0])
        if held >= most:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
            out, held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def needed_lines(lines: DataFrame, met: DataFrame, sizes: Sizes) -> DataFrame:
    """Packed rows of the lines that are the first place of a class with an entry; a filter of bounded size may let others through."""
    entries = met.filter(F.col("kind") == ENTRY).select("cls", "doc", "line")
    shared = lines.sparkSession.sparkContext.broadcast(setjoin.bloom(entries, entries.count()))  # 32 MB at most

    def run(batches):
        for s in _read(batches, sizes.held):
            some = np.flatnonzero(shared.value.has(setjoin.place_keys(setjoin.class_ids(s), s.doc, s.line)))
            if len(some):
                s = _picked(s, some)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (s.doc.tobytes(), s.line.tobytes(), np.diff(s.bounds).astype(np.uint32).tobytes(), _slim(s.elements))], names=["doc", "line", "size", "sets"])

    return lines.select("doc", "line", "size", "sets").filter("doc IS NOT NULL").mapInArrow(lean(run), "doc binary, line binary, size binary, sets binary")


def needed_entries(met: DataFrame, rare: Rarity, sizes: Sizes) -> Broadcast:
    """The order of words, a filter of the entries and the tiles, for all tasks: 16 MB, 32 MB at most, and 16 bytes for each of MOST_TILED."""
    entries = met.filter(F.col("kind") == ENTRY).select("elem", "cls")
    return met.sparkSession.sparkContext.broadcast((rare, setjoin.bloom(entries, entries.count(), _entry_keys), Tiles.of(met, sizes.tile)))


def link_parts(met: DataFrame, texts: int, sizes: Sizes) -> int:
    """How many parts :func:`counted_links` goes in: what entries, those of tiles too, take there with their sets, by a share of the texts' bytes."""
    entries = met.filter((F.col("kind") == ENTRY) & (F.col("n") <= sizes.short)).agg(F.count("*"), F.sum(6 * F.col("n") + 45)).collect()[0]
    tiled = met.filter((F.col("kind") == TILED) & (F.col("n") > sizes.tile)).agg(F.sum(F.col("n") * (F.ceil(F.col("n") / sizes.tile) - 1))).collect()[0][0] or 0
    whole = (entries[1] or 0) * (1 + tiled / max(1, entries[0]))
    return max(1, math.ceil(whole / max(1, sizes.least, sizes.share * texts)))


def counted_links(lines: DataFrame, met: DataFrame, shared: Broadcast, bits: int, sizes: Sizes, part: int = 0, parts: int = 1) -> DataFrame:
    """(cls, doc, line, n_links, e_doc, e_line, common, together): parts of each linked class's number of links, and its earliest partner in that part.

    ``lines`` are those of :func:`needed_lines`, ``shared`` has what :func:`needed_entries`
    gives. Pairs of lines of ``sizes.short`` words at most; of every ``parts``
    places that words are dealt to, one.
    """
    shift = 64 - bits - 32
    names = ["block", *(x for x, _ in _WHOLE), "sets"]

    def deal(batches):
        rare, needed, tiles = shared.value
        for s in _read(batches, sizes.held):
            s = _picked(s, np.flatnonzero(np.diff(s.bounds) <= sizes.short))
            cls, size = setjoin.class_ids(s), np.diff(s.bounds)
            s = s._replace(elements=s.elements[setjoin.ranked(s, rare)])
            of, pos = _ranges(np.zeros(len(size), np.int64), setjoin.prefix_length(size))
            k = s.elements[s.bounds[of] + pos] >> np.uint64(shift)
            hit = needed.has(_entry_keys(k, cls[of]))
            of, pos, k = of[hit], pos[hit], k[hit]
            entry, key, side = tiles.dealt(k, cls[of])
            own = key % np.uint64(parts) == np.uint64(part)
            entry, key, side = entry[own], key[own], side[own]
            for i in range(0, len(entry), sizes.few):
                few = slice(i, i + sizes.few)
                e, x, y = entry[few], key[few], side[few]
                block = (x >> np.uint64(64 - bits)).astype(np.int64)
                by = np.argsort(block, kind="stable")
                e, x, y, block = e[by], x[by], y[by], block[by]
                o = of[e]
                cols = [x, cls[o], s.doc[o], s.line[o], size[o].astype(np.uint32), pos[e].astype(np.uint32), y]
                begin = np.flatnonzero(_fresh(block))
                ends = np.append(begin, len(block))
                arrays = [pa.array([setjoin.planes(np.ascontiguousarray(c[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for c in cols]
                sets = [_slim(s.elements[_ranges(s.bounds[o[a:b]], size[o[a:b]])[1]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield from in_parts(pa.RecordBatch.from_arrays([pa.array(block[begin].astype(np.int32)), *arrays, pa.array(sets, pa.binary())], names=names))

    def meet(batches):
        for _, (*parts, raw) in setjoin._groups(batches, len(_WHOLE) + 1):
            key, cls, doc, line, n, pos, side = (np.concatenate([setjoin.unplaned(x, kind) for x in xs]) for xs, (_, kind) in zip(parts, _WHOLE, strict=True))
            elements = np.concatenate([_unslim(x) for x in raw])
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            sketch = setjoin.parities(elements, bounds)
            order = np.lexsort((line, doc, cls, side, key))
            # a filter may have let a copy through
            order = order[_fresh(key[order], cls[order])]
            order = order[np.lexsort((n[order], key[order]))]
            column = np.cumsum(_fresh(key[order]))
            for i, j in _candidates(column, n[order], pos[order], side[order], sketch[order], sizes.pairs):
                i, j = order[i], order[j]
                before = np.flatnonzero((pos[i] > 0) & (pos[j] > 0))
                seen = _common(elements, (bounds[i[before]], pos[i[before]]), (bounds[j[before]], pos[j[before]]), 2 * sizes.held) > 0
                fresh = np.ones(len(i), bool)
                fresh[before[seen]] = False
                i, j = i[fresh], j[fresh]
                common = _common(elements, (bounds[i], n[i]), (bounds[j], n[j]), 2 * sizes.held)
                ok = DEN * common >= NUM * (n[i] + n[j] - common)
                i, j, common = i[ok], j[ok], common[ok]
                if not len(i):
                    continue
                x, y, common = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([common, common])
                by = np.lexsort((line[y], doc[y], cls[x]))
                x, y, common = x[by], y[by], common[by]
                first = np.flatnonzero(_fresh(cls[x]))
                links = np.diff(np.append(first, len(x)))
                x, y, common = x[first], y[first], common[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (cls[x].view(np.int64), doc[x], line[x], links, doc[y], line[y], common, n[x] + n[y] - common)],
                    names=["cls", "doc", "line", "n_links", "e_doc", "e_line", "common", "together"],
                )

    dealt = lines.mapInArrow(lean(deal), ", ".join(["block int", *(f"{x} binary" for x, _ in _WHOLE), "sets binary"]))
    return setjoin._by_block(dealt).mapInArrow(lean(meet), "cls long, doc long, line int, n_links long, e_doc long, e_line int, common long, together long")


def long_links(lines: DataFrame, met: DataFrame, folder: str, sizes: Sizes) -> DataFrame:
    """The same of pairs with a longer line, in rows of one partner each."""
    least = setjoin.NUM * sizes.short // DEN  # the other line of such a pair has more words

    def run(batches):
        for s in _read(batches, sizes.held):
            s = _picked(s, np.flatnonzero(np.diff(s.bounds) >= least))
            own = [s.elements[a:b] for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
            for i in range(0, len(own), 256):
                part = slice(i, i + 256)
                arrays = [pa.array(x[part]) for x in (setjoin.class_ids(s).view(np.int64), s.doc, s.line, np.diff(s.bounds))]
                sets, wide = [setjoin.planes(x) for x in own[part]], [setjoin.wide_sketch(x) for x in own[part]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(sets, pa.binary()), pa.array(wide, pa.list_(pa.int64()))], names=["cls", "doc", "line", "n", "set", "wide"])

    table = stored(lines.mapInArrow(lean(run), "cls long, doc long, line int, n long, set binary, wide array<long>"), folder, "long", _ROW_GROUP)
    entries = met.filter((F.col("kind") == ENTRY) & (F.col("n") >= least)).select("elem", "cls", "n", "doc", "line")
    entries = entries.join(table.select("cls", "wide").dropDuplicates(["cls"]), "cls").withColumns({c: F.lit(0).cast("long") for c in ("pos", "sketch", "sketch2")})
    entries = stored(entries, folder, "long_entries")
    on = (F.struct("y.doc", "y.line") < F.struct("x.doc", "x.line")) & (F.greatest("x.n", "y.n") > sizes.short) & setjoin.within_wide("x", "y")
    pairs = stored(setjoin.verified(setjoin.full_pairs(entries, entries, on), table, folder, "long"), folder, "long_links")
    sides = [pairs.select(*(F.col(f"{x}{c}").alias(k) for c, k in (("", "cls"), ("_doc", "doc"), ("_line", "line"))), F.lit(1).cast("long").alias("n_links"), F.col(f"{y}_doc").alias("e_doc"), F.col(f"{y}_line").alias("e_line"), "common", "together") for x, y in ("ab", "ba")]
    return sides[0].unionByName(sides[1])


def later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, sizes: Sizes = Sizes()) -> DataFrame:
    """Every line that goes, with the earliest line that it is similar to, its class, and the number of classes that are linked to it.

    Columns: id, ``line``, earlier id, ``earlier_line``, ``similarity``, class
    id, ``class_line`` and ``n_links``; prefixes ``earlier_`` and ``class_`` go
    before the name of the id. Similar: the sets of words (A-Z in lower case)
    have a Jaccard similarity of 0.8 or more. Lines of equal sets are a class,
    known by its first line; ``n_links`` counts the other classes that it is
    similar to, earlier and later ones. The earlier line may itself go. Lines
    count from 0, are cut at ``\\n`` and need ``least`` distinct words. Rows
    without id or text have no lines here; rows that repeat an id count as one
    document whose lines are numbered alike; an empty table gives no rows.
    """
    folder = shared_folder(docs.sparkSession)
    ids = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    p = setjoin.plan(ids, None, folder)
    lines = stored(packed_lines(p.docs, least), folder, "lines", _ROW_GROUP)
    rare = setjoin.rarity(lines.filter("block IS NOT NULL").select("block", "place", "n"))
    made = [stored(meetings(lines, rare, p.block_bits, sizes, i, sizes.parts), folder, f"met{i}") for i in range(sizes.parts)]
    met = reduce(DataFrame.unionByName, made)
    needed = stored(needed_lines(lines, met, sizes), folder, "needed", _ROW_GROUP)
    drop_folder(docs.sparkSession, f"{folder}/lines")  # as large as the texts
    parts, entries = link_parts(met, p.bytes, sizes), needed_entries(met, rare, sizes)
    made = [stored(counted_links(needed, met, entries, p.block_bits, sizes, i, parts), folder, f"links{i}") for i in range(parts)]
    links = reduce(DataFrame.unionByName, [*made, long_links(needed, met, folder, sizes)])

    place, partner = F.struct("doc", "line"), F.struct(F.col("e_doc").alias("doc"), F.col("e_line").alias("line"))
    linked = links.groupBy("cls", "doc", "line").agg(F.sum("n_links").alias("n_links"), F.min(F.struct(partner.alias("e"), (F.col("common") / F.col("together")).alias("similarity"))).alias("m"))
    heads = met.filter(F.col("kind") == HEAD).select("cls", place.alias("at"))
    copies = met.filter(F.col("kind") == COPY).select("cls", "doc", "line")
    known = copies.join(heads, "cls").join(linked.select("cls", "n_links", "m"), "cls", "left").dropDuplicates(["cls", "doc", "line"])
    by_link = F.coalesce(F.col("m.e") < F.col("at"), F.lit(False))
    of_copies = known.select(
        "doc", "line", F.when(by_link, F.col("m.e")).otherwise(F.col("at")).alias("e"), F.when(by_link, F.col("m.similarity")).otherwise(1.0).alias("similarity"), "at", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    of_firsts = linked.select("doc", "line", F.col("m.e").alias("e"), F.col("m.similarity").alias("similarity"), place.alias("at"), "n_links")
    out = of_copies.unionByName(of_firsts).filter(F.col("e") < place)
    names = [F.col("doc").alias(id_col), "line", F.col("e.doc").alias(f"earlier_{id_col}"), F.col("e.line").alias("earlier_line"), "similarity", F.col("at.doc").alias(f"class_{id_col}"), F.col("at.line").alias("class_line"), "n_links"]
    return finished(out.select(*names), folder)


def without_later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", least: int = 1) -> DataFrame:
    """``docs`` with the lines of :func:`later_lines` cut from the texts; columns, types and rows as they were.

    ``length_col``, if there is such a column, gets the new length in characters
    of the texts that changed. A text that loses all lines becomes empty.
    Columns are carried by position, so their names can't clash with ours.
    """
    gone = later_lines(docs, id_col, text_col, least).groupBy(F.col(id_col).alias("id")).agg(F.collect_set("line").alias("gone"))
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    lines = F.split(text.cast("string"), "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("gone"), s["i"]))
    cut = F.array_join(F.transform(left, lambda s: s["x"]), "\n")
    joined = rows.join(gone, key.cast("long") == F.col("id"), "left").withColumn("cut", F.when(F.col("gone").isNotNull(), cut))
    made = []
    for i, f in enumerate(docs.schema.fields):
        own = F.col(f"c{i}")
        if f.name == text_col:
            own = F.when(F.col("gone").isNull(), own).otherwise(F.col("cut"))
        elif length_col and f.name == length_col:
            own = F.when(F.col("gone").isNull(), own).otherwise(F.char_length("cut").cast(f.dataType))
        made.append(own.alias(f.name))
    return joined.select(*made)
