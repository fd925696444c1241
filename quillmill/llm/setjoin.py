"""Exact joins of sets by Jaccard similarity, as a blocked product of sparse incidence matrices.

A text (or line) is a row, a shingle (or token) a column, both as 64-bit hashes.
Rows with equal sets are one class.  Two rows can only reach the similarity if
they meet in the rarest ``n - ceil(t n) + 1`` columns of each (the prefix), so
only these entries are multiplied:

1. ``rarity``: each task adds up how often columns are met, by their leading
   bits; a table of bounded size, from the sums over all tasks, gives the column
   order, rare ones first.  The order only steers the work; any is exact.
2. ``columns``: the prefix entries, dealt into blocks likewise.  A block sorts
   its entries and gives out those of classes that another class of the column
   may be similar to, by size, position and a 128-bit parity sketch.
3. First candidates: each class with the earliest class that it may be similar
   to in most of its columns.  That is one pair a class, however large a group.
4. What these pairs leave open (the caller says which) is multiplied in full:
   overlap counts of all pairs in the open columns, dropped when count and
   sizes show that the similarity is out of reach.
5. A candidate's two sketches, of about a bit for each element, rule out most
   that only share columns by chance. Sets of the classes that are left are
   fetched through a Bloom filter of bounded size, and every candidate that is
   left is verified on whole sets.

Blocks grow in number with the input, not in size; nothing that grows with it
is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import in_parts, lean, stored
from .tokens import mix

#: Leading bits of a hash that columns are counted by: the order takes one byte for each value, 16 MB.
SCALE_BITS = 24

#: Blocks that the counts are added up in, as a power of two.
COUNT_BITS = 8

#: Bytes of text a block, about.
BLOCK_BYTES = 64 << 20

#: Similarity as a fraction: 4/5.
NUM, DEN = 4, 5


class Sets(NamedTuple):
    """Consecutive sets: document, line, bounds in ``elements``, and the sorted distinct elements.

    ``sketch`` has two numbers for each set: parities (see :func:`parities`), or zeros.
    """

    doc: np.ndarray
    line: np.ndarray
    bounds: np.ndarray
    elements: np.ndarray
    sketch: np.ndarray


#: What turns a batch of (id, text) into sets, some at a time.
Extract = Callable[[pa.RecordBatch], Iterator[Sets]]


def planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, all first bytes first: equal leading bytes compress to nothing in a shuffle."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(raw, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def class_ids(s: Sets) -> np.ndarray:
    """A hash of each set as a whole; 0 for an empty one."""
    sizes = np.diff(s.bounds)
    with np.errstate(over="ignore"):
        total = np.zeros(len(s.elements) + 1, np.uint64)
        np.cumsum(mix(s.elements ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
        out = mix(total[s.bounds[1:]] - total[s.bounds[:-1]] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[out == 0] = 1
    out[sizes == 0] = 0
    return out


def parities(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two numbers: each element flips one. Two sets' bits differ in no more places than the sets have elements apart."""
    h = mix(elements) >> np.uint64(57)
    bit = np.uint64(1) << (h & np.uint64(63))
    out = np.empty((len(bounds) - 1, 2), np.uint64)
    for k in range(2):
        total = np.zeros(len(elements) + 1, np.uint64)
        np.bitwise_xor.accumulate(np.where(h >> np.uint64(6) == k, bit, np.uint64(0)), out=total[1:])
        out[:, k] = total[bounds[1:]] ^ total[bounds[:-1]]
    return out


def prefix_length(n):
    return np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)


def least_overlap(n: Column, m: Column) -> Column:
    return F.floor((NUM * (n + m) + NUM + DEN - 1) / (NUM + DEN))


def within_sketch(x: str, y: str) -> Column:
    """Whether the sketches of two aliases allow a link."""
    apart = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("sketch", "sketch2"))
    return (NUM + DEN) * apart <= (DEN - NUM) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def within_size(n: Column, m: Column) -> Column:
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n)


class Plan(NamedTuple):
    docs: DataFrame  # (id bigint, text string)
    extract: Extract | None
    folder: str
    block_bits: int
    bytes: int  # of the texts

    @property
    def n_blocks(self) -> int:
        return 1 << self.block_bits


def plan(docs: DataFrame, extract: Extract | None, folder: str) -> Plan:
    """``docs`` has the columns id and text; rows without either are left out."""
    docs = docs.filter("id IS NOT NULL AND text IS NOT NULL")
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return Plan(docs, extract, folder, max(8, int(np.ceil(np.log2(max(1, total / BLOCK_BYTES))))), total)


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of a block come to one task, in any order."""
    return rows.repartition("block")


def _groups(batches, fields: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(block, parts of each field): a task's blocks are gathered as the bytes that they came as, and given out one by one.

    They were not sorted before: that would keep large pages in the JVM for a few rows.
    """
    blocks: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = blocks.setdefault(x[0], [[] for _ in range(fields)])
            for p, v in zip(parts, x[1:], strict=True):
                p.append(v)
    while blocks:
        yield blocks.popitem()


class Rarity(NamedTuple):
    """The order of columns: one byte for each value of the hashes' leading bits, from the number of times that they were met.

    Of bounded size. Where many columns share their leading bits it says less,
    and the order is worse, but an order still.
    """

    scale: np.ndarray

    def of(self, elements: np.ndarray) -> np.ndarray:
        return self.scale[(elements >> np.uint64(64 - SCALE_BITS)).astype(np.int64)]


def step(n):
    """Place of a count on the scale: 8 steps an octave, from 0 for one."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(1, n)))).astype(np.uint8)


class Counts:
    """What a task has met, by leading bits: 64 MB, whatever it reads."""

    fields = "block int, place binary, n binary"

    def __init__(self):
        self.n = np.zeros(1 << SCALE_BITS, np.uint32)

    def add(self, elements: np.ndarray) -> None:
        np.add.at(self.n, (elements >> np.uint64(64 - SCALE_BITS)).astype(np.int64), np.uint32(1))

    def rows(self) -> tuple[list[int], list[bytes], list[bytes]]:
        """Blocks that aren't empty, with the places and counts in them."""
        out: tuple[list[int], list[bytes], list[bytes]] = ([], [], [])
        for block, part in enumerate(self.n.reshape(1 << COUNT_BITS, -1)):
            at = np.flatnonzero(part)
            if len(at):
                for x, y in zip(out, (block, planes(at.astype(np.uint16)), planes(part[at])), strict=True):
                    x.append(y)
        return out


def rarity(counted: DataFrame) -> Rarity:
    """The order from all tasks' rows (block, place, n) of :class:`Counts`."""
    width = 1 << (SCALE_BITS - COUNT_BITS)

    def total(batches):
        for block, (places, counts) in _groups(batches, 2):
            n = np.zeros(width, np.int64)
            for at, x in zip(places, counts, strict=True):
                n[unplaned(at, np.uint16)] += unplaned(x, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([step(n).tobytes()], pa.binary())], names=["block", "scale"])

    scale = np.zeros(1 << SCALE_BITS, np.uint8)
    for block, raw in _by_block(counted).mapInArrow(lean(total), "block int, scale binary").collect():  # 16 MB at most
        scale[block * width : (block + 1) * width] = np.frombuffer(raw, np.uint8)
    return Rarity(scale)


def counted(p: Plan) -> DataFrame:
    """Rows of :class:`Counts`, a task's each, of all columns of all rows."""
    extract = p.extract

    def count(batches):
        met = Counts()
        for batch in batches:
            for s in extract(batch):
                met.add(s.elements)
        blocks, places, n = met.rows()
        yield from in_parts(pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(places, pa.binary()), pa.array(n, pa.binary())], names=["block", "place", "n"]))

    return p.docs.mapInArrow(lean(count), Counts.fields)


def sorted_order(k: np.ndarray, bits: int) -> np.ndarray:
    """What sorts numbers of so many bits: by one plain sort, if their indices fit beside them."""
    own = len(k).bit_length()
    if bits + own > 64:
        return np.argsort(k, kind="stable")
    return (np.sort(k << np.uint64(own) | np.arange(len(k), dtype=np.uint64)) & np.uint64((1 << own) - 1)).astype(np.int64)


def ranked(s: Sets, rare: Rarity) -> np.ndarray:
    """What brings each set's elements into order: rare ones first, ties by hash."""
    sizes = np.diff(s.bounds)
    of = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    rank = rare.of(s.elements).astype(np.uint64)
    if len(sizes) < 1 << 24 and len(of) < 1 << 32:
        # one number holds set, rank and index: a plain sort does
        return (np.sort(of << np.uint64(40) | rank << np.uint64(32) | np.arange(len(of), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.lexsort((rank, of))


def prefixes(s: Sets, rare: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, position, index of the element) of the prefix entries: the rarest columns of each set."""
    sizes = np.diff(s.bounds)
    length = prefix_length(sizes)
    of = np.repeat(np.arange(len(sizes)), length)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    return of, pos, ranked(s, rare)[s.bounds[of] + pos]


_ENTRY = (("rem", np.uint32), ("cls", np.uint64), ("doc", np.int64), ("line", np.int32), ("n", np.uint32), ("pos", np.uint16), ("sketch", np.uint64), ("sketch2", np.uint64))

#: Entries that a task holds before it gives them out in blocks (about 50 bytes each).
FLUSH = 200_000

#: In a column of so many classes or fewer each pair is tested by size and sketch at once; the rest of the columns is kept whole.
SMALL = 512


def partners(sizes: np.ndarray, n: np.ndarray, pos: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have another in their column that size, position and sketch allow, and the first of these before each (or itself).

    ``sizes`` are those of the columns, whose entries stand together in order of
    place. What lies before the column in both sets, it, and what lies behind it
    in both bound the overlap. ``apart`` gives the least number of elements that
    two sets of entries differ in, as far as sketches tell. Sets that are similar
    pass in all their columns.
    """
    size, begin = np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    has, first = size > small, np.arange(len(n))
    first[has] = begin[has]
    rest = np.flatnonzero(~has)
    last = begin + size - 1
    for d in range(1, small):
        rest = rest[rest + d <= last[rest]]
        if not len(rest):
            break
        j = rest + d
        a, b = n[rest].astype(np.int64), n[j].astype(np.int64)
        p, q = pos[rest].astype(np.int64), pos[j].astype(np.int64)
        # positions are cut off at 65535, where nothing follows from them
        reach = np.where((p < 65535) & (q < 65535), np.minimum(p, q) + 1 + np.minimum(a - 1 - p, b - 1 - q), a + b)
        ok = (DEN * a >= NUM * b) & (DEN * b >= NUM * a) & ((NUM + DEN) * reach >= NUM * (a + b))
        ok[ok] = (NUM + DEN) * apart(rest[ok], j[ok]) <= (DEN - NUM) * (a + b)[ok]
        has[rest[ok]] = True
        has[j[ok]] = True
        first[j[ok]] = rest[ok]
    return has, first


def columns(p: Plan, rare: Rarity, small: int = SMALL, flush: int = FLUSH) -> DataFrame:
    """Columns that hold two classes or more, a row for each class that may be similar to another there.

    (elem, cls, n, pos, sketch, sketch2, doc, line) with the first place of the class, and
    the column's earliest class that may be similar to it likewise as pivot,
    pivot_n, pivot_doc, pivot_line (the class itself, if none is earlier). All
    texts of a class have the same prefix, so its first place is the first in
    the corpus. Two similar classes are in each of their common columns.
    """
    extract, bits, shift = p.extract, p.block_bits, 64 - p.block_bits - 32
    shared = p.docs.sparkSession.sparkContext.broadcast(rare)  # 16 MB

    def packed(found):
        k, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        order = sorted_order(k, bits + 32)
        k = k[order]
        at = np.searchsorted(k, np.arange(0, (1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        full = np.flatnonzero(np.diff(at))
        cols = [k.astype(np.uint32), *(x[order] for x in rest)]
        arrays = [pa.array([planes(np.ascontiguousarray(c[at[b] : at[b + 1]])) for b in full], pa.binary()) for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *arrays], names=["block", *(x for x, _ in _ENTRY)])

    def deal(batches):
        found: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            for s in extract(batch):
                of, pos, at = prefixes(s, shared.value)
                sizes = np.diff(s.bounds)
                found.append([s.elements[at] >> np.uint64(shift), class_ids(s)[of], s.doc[of], s.line[of], sizes[of].astype(np.uint32), np.minimum(pos, 65535).astype(np.uint16), s.sketch[of, 0], s.sketch[of, 1]])
                held += len(at)
                if held >= flush:
                    yield from in_parts(packed(found))
                    found, held = [], 0
        if held:
            yield from in_parts(packed(found))

    def meet(batches):
        for block, parts in _groups(batches, len(_ENTRY)):
            rem, cls, doc, line, n, pos, sketch, sketch2 = (np.concatenate([unplaned(x, kind) for x in xs]) for xs, (_, kind) in zip(parts, _ENTRY, strict=True))
            key = np.sort((rem.astype(np.uint64) << np.uint64(32)) | np.arange(len(rem), dtype=np.uint64))
            order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            r = (key >> np.uint64(32)).astype(np.uint32)
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            size = np.diff(np.append(first, len(r)))
            order = order[np.repeat(size > 1, size)]
            if not len(order):
                continue
            order = order[np.lexsort((line[order], doc[order], cls[order], rem[order]))]
            r, c = rem[order], cls[order]
            order = order[np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))]  # the first of each class
            order = order[np.lexsort((line[order], doc[order], rem[order]))]
            r = rem[order]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            size = np.diff(np.append(first, len(r)))
            order = order[np.repeat(size > 1, size)]
            parity = np.stack([sketch[order], sketch2[order]], axis=1)
            has, earliest = partners(size[size > 1], n[order], pos[order], lambda i, j, s=parity: np.bitwise_count(s[i] ^ s[j]).sum(axis=1, dtype=np.int64), small)
            pivot = order[earliest][has]
            order = order[has]
            for i in range(0, len(order), 65536):
                o, q = order[i : i + 65536], pivot[i : i + 65536]
                elem = np.uint64(block) << np.uint64(32) | rem[o].astype(np.uint64)
                arrays = [elem.astype(np.int64), cls[o].astype(np.int64), n[o].astype(np.int64), pos[o].astype(np.int32), sketch[o].astype(np.int64), sketch2[o].astype(np.int64), doc[o], line[o], cls[q].astype(np.int64), n[q].astype(np.int64), doc[q], line[q]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["elem", "cls", "n", "pos", "sketch", "sketch2", "doc", "line", "pivot", "pivot_n", "pivot_doc", "pivot_line"])

    dealt = p.docs.mapInArrow(lean(deal), "block int, rem binary, cls binary, doc binary, line binary, n binary, pos binary, sketch binary, sketch2 binary")
    rows = _by_block(dealt).mapInArrow(lean(meet), "elem long, cls long, n long, pos int, sketch long, sketch2 long, doc long, line int, pivot long, pivot_n long, pivot_doc long, pivot_line int")
    return stored(rows, p.folder, "columns")


class Bloom(NamedTuple):
    """A set of numbers that may hold a few more than were put in."""

    words: np.ndarray

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for k in range(3):
            h = self.hash(ids, k, len(self.words) * 64)
            out &= (self.words[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @staticmethod
    def hash(ids: np.ndarray, k: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)) & np.uint64(bits - 1)


def place_keys(cls: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One number for a class and its place."""
    with np.errstate(over="ignore"):
        return mix(cls.astype(np.uint64)) ^ mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def bloom(rows: DataFrame, expected: int, key: Callable[..., np.ndarray] = place_keys) -> Bloom:
    """A filter of the ``key`` of the rows' columns, 32 MB at most; built in parts by the tasks and merged by slices.

    With over 2**24 rows it lets more through, and at last everything: those
    who use it must be right, if slower, with all rows.
    """
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, 16 * expected))), 16, 28))
    slices = 1 << int(np.clip(np.log2(bits) - 16, 0, 8))
    width = bits // 64 // slices

    def part(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            x = np.unique(key(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)))
            for k in range(3):
                h = Bloom.hash(x, k, bits)
                np.bitwise_or.at(words, h >> np.uint64(6), np.uint64(1) << (h & np.uint64(63)))
        full = [i for i in range(slices) if words[i * width : (i + 1) * width].any()]
        yield from in_parts(pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([words[i * width : (i + 1) * width].tobytes() for i in full], pa.binary())], names=["slice", "bits"]))

    def merge(batches):
        # the rows of a slice stand together
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint64)
                own[i] = own[i] | x if i in own else x
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["slice", "bits"])

    parts = rows.mapInArrow(lean(part), "slice int, bits binary").repartition("slice").mapInArrow(lean(merge), "slice int, bits binary").collect()
    words = np.zeros(bits // 64, np.uint64)
    for i, raw in parts:
        words[i * width : (i + 1) * width] = np.frombuffer(raw, np.uint64)
    return Bloom(words)


#: Longs of the wide sketch: 512 parities.
WIDE = 8


def members(p: Plan, cols: DataFrame) -> DataFrame:
    """(doc, line, cls, n, wide, broad) of every row that has a set; its sketches are there at the first place of a class that may meet another.

    A few other rows have them too, as Bloom filters let some through.
    """
    extract, expected = p.extract, cols.agg(F.approx_count_distinct("cls")).collect()[0][0]
    shared = p.docs.sparkSession.sparkContext.broadcast(bloom(cols.select("cls", "doc", "line"), expected))

    def run(batches):
        for batch in batches:
            for s in extract(batch):
                ids, sizes = class_ids(s), np.diff(s.bounds)
                hit = shared.value.has(place_keys(ids, s.doc, s.line))
                some = np.flatnonzero(sizes > 0)
                own = [s.elements[s.bounds[i] : s.bounds[i + 1]] if hit[i] else None for i in some.tolist()]
                wide, broad = ([None if x is None else f(x) for x in own] for f in (wide_sketch, broad_sketch))
                yield pa.RecordBatch.from_arrays([pa.array(s.doc[some]), pa.array(s.line[some], pa.int32()), pa.array(ids[some].astype(np.int64)), pa.array(sizes[some]), pa.array(wide, pa.list_(pa.int64())), pa.array(broad, pa.binary())], names=["doc", "line", "cls", "n", "wide", "broad"])

    return stored(p.docs.mapInArrow(lean(run), "doc long, line int, cls long, n long, wide array<long>, broad binary"), p.folder, "members")


def fetched(p: Plan, keys: DataFrame) -> DataFrame:
    """(cls, doc, line, set) of the rows of these (cls, doc, line), by one more reading of the texts; a filter of bounded size may let others through."""
    extract, expected = p.extract, keys.count()
    shared = p.docs.sparkSession.sparkContext.broadcast(bloom(keys.select("cls", "doc", "line"), expected))

    def run(batches):
        for batch in batches:
            for s in extract(batch):
                ids = class_ids(s)
                some = np.flatnonzero(shared.value.has(place_keys(ids, s.doc, s.line)) & (np.diff(s.bounds) > 0))
                if len(some):
                    sets = [planes(s.elements[s.bounds[i] : s.bounds[i + 1]]) for i in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some].astype(np.int64)), pa.array(s.doc[some]), pa.array(s.line[some], pa.int32()), pa.array(sets, pa.binary())], names=["cls", "doc", "line", "set"])

    return (p.docs if expected else p.docs.limit(0)).mapInArrow(lean(run), "cls long, doc long, line int, set binary")


#: A pair: two classes, each with its first place, at which its set is found.
PAIR = ("a", "a_doc", "a_line", "b", "b_doc", "b_line")

_PAIR_FIELDS = "a long, a_doc long, a_line int, b long, b_doc long, b_line int"


#: Bytes of fetched sets that a task reads at a time, about.
SETS_GROUP = 4 << 20

#: Keys of sets at most that are sent to all tasks (20 MB).
MOST_KEYS = 1_000_000


def _keys(pairs: DataFrame, folder: str, name: str) -> DataFrame:
    """The (cls, doc, line) of the pairs' ends."""
    key = lambda x: pairs.select(F.col(x).alias("cls"), F.col(f"{x}_doc").alias("doc"), F.col(f"{x}_line").alias("line"))
    return stored(key("a").unionByName(key("b")).distinct(), folder, name)


def _beside(pairs: DataFrame, some: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs with both ends' ``value`` from ``table`` as sa and sb; ``some`` are their keys."""
    # only what is in a pair goes on: keys of 20 bytes are sent to all tasks up to a bound, and joined by a shuffle beyond it
    few = F.broadcast(some) if some.count() <= MOST_KEYS else some
    # rows that repeat a place have the same set there
    own = table.filter(F.col(value).isNotNull()).select("cls", "doc", "line", value).join(few, ["cls", "doc", "line"], "left_semi").dropDuplicates(["cls", "doc", "line"])
    side = lambda x: own.select(F.col("cls").alias(x), F.col("doc").alias(f"{x}_doc"), F.col("line").alias(f"{x}_line"), F.col(value).alias(f"s{x}"))
    return pairs.join(side("a"), ["a", "a_doc", "a_line"]).join(side("b"), ["b", "b_doc", "b_line"]).select(*PAIR, "sa", "sb")


def likely(pairs: DataFrame, table: DataFrame, folder: str, name: str) -> DataFrame:
    """The pairs that broad sketches allow; all that reach the similarity are among them."""

    def run(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)) if within_broad(x.as_buffer(), y.as_buffer())]
            yield batch.select(PAIR).take(pa.array(keep, pa.int64()))

    pairs = stored(pairs, folder, f"{name}_likely")
    return _beside(pairs, _keys(pairs, folder, f"{name}_sketched"), table, "broad").mapInArrow(lean(run), _PAIR_FIELDS)


def verified(pairs: DataFrame, table: DataFrame, folder: str, name: str, of: Plan | None = None) -> DataFrame:
    """The pairs whose sets reach the similarity, with the sizes of intersection and union as ``common`` and ``together``.

    ``table`` has the sets, or it is that of :func:`members` of the plan ``of``:
    then its broad sketches rule pairs out first, and only the sets of those
    that are left are fetched. Intermediate tables are stored below ``folder``.
    A class in very many pairs is a hot key of the second join, which adaptive
    execution splits.
    """

    def run(batches):
        for batch in batches:
            keep, common, together = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                u, v = unplaned(x.as_buffer(), np.uint64), unplaned(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([u, v]))
                k = int((both[1:] == both[:-1]).sum())
                if DEN * k >= NUM * (len(both) - k):
                    keep.append(i)
                    common.append(k)
                    together.append(len(both) - k)
            kept = batch.select(PAIR).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(common, pa.int64()), pa.array(together, pa.int64())], names=[*PAIR, "common", "together"])

    pairs = stored(likely(pairs, table, folder, name) if of else pairs, folder, f"{name}_pairs")
    some = _keys(pairs, folder, f"{name}_needed")
    if of:
        table = stored(fetched(of, some), folder, f"{name}_sets", SETS_GROUP)
    return _beside(pairs, some, table, "set").mapInArrow(lean(run), f"{_PAIR_FIELDS}, common long, together long")


def first_pairs(cols: DataFrame) -> DataFrame:
    """Each class with the pivot that it meets most often, if the sizes allow a link."""
    met = cols.filter((F.col("cls") != F.col("pivot")) & within_size(F.col("n"), F.col("pivot_n")))
    met = met.groupBy("cls", "doc", "line", "pivot", "pivot_doc", "pivot_line").agg(F.count("*").alias("c"))
    best = met.groupBy(F.col("cls").alias("a"), F.col("doc").alias("a_doc"), F.col("line").alias("a_line")).agg(F.max(F.struct("c", "pivot", "pivot_doc", "pivot_line")).alias("m"))
    return best.select("a", "a_doc", "a_line", F.col("m.pivot").alias("b"), F.col("m.pivot_doc").alias("b_doc"), F.col("m.pivot_line").alias("b_line"))


def wide_sketch(elements: np.ndarray) -> np.ndarray:
    """Parities as in :func:`parities`, but ``WIDE`` longs of them."""
    h = mix(elements ^ np.uint64(0x2545F4914F6CDD1D))
    odd = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def broad_sketch(elements: np.ndarray) -> bytes:
    """The number of elements, and parities as in :func:`parities`: a power of two of them, as many as elements or more, so that large sets are told apart too."""
    width = max(64 * WIDE, 1 << (len(elements) - 1).bit_length())
    odd = np.bincount((mix(elements ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.int64(len(elements)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def within_broad(x, y) -> bool:
    """Whether two broad sketches allow a link; the wider one is folded, as its parities' numbers only have more leading bits."""
    n = int(np.frombuffer(x, np.int64, 1)[0]) + int(np.frombuffer(y, np.int64, 1)[0])
    u, v = sorted((np.frombuffer(z, np.uint64, offset=8) for z in (x, y)), key=len)
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return (NUM + DEN) * int(np.bitwise_count(u ^ v).sum()) <= (DEN - NUM) * n


def within_wide(x: str, y: str) -> Column:
    """Whether the wide sketches of two aliases allow a link."""
    apart = F.lit(0)
    for i in range(WIDE):
        apart = apart + F.bit_count(F.get(F.col(f"{x}.wide"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{y}.wide"), F.lit(i))))
    return (NUM + DEN) * apart <= (DEN - NUM) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


#: How far a class looks along its column, and how many likely partners it takes from there and in all.
REACH, TAKEN, BEST = 32, 2, 8


def ring_pairs(rows: DataFrame) -> DataFrame:
    """Likely pairs of different roots, ``BEST`` a class at most: neighbours in columns that are shuffled, each in its own way.

    ``rows`` has elem, cls, n, doc, line, root and wide. Dealt by ranges of
    (column, hash), so that a large column is no single task's; what stands on
    two tasks' border is left to :func:`full_pairs`.
    """

    def run(batches):
        tail: dict[str, np.ndarray] | None = None
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("elem", "cls", "n", "doc", "line", "root")}
            x["wide"] = np.array(batch.column("wide").to_pylist(), np.int64).reshape(-1, WIDE)
            if tail is not None:
                x = {c: np.concatenate([tail[c], x[c]]) for c in x}
            m, left, out = len(x["elem"]), np.full(len(x["elem"]), TAKEN), []
            for d in range(1, min(REACH, m - 1) + 1):
                i = np.flatnonzero((left[:-d] > 0) & (x["elem"][:-d] == x["elem"][d:]) & (x["root"][:-d] != x["root"][d:]))
                j = i + d
                total = x["n"][i] + x["n"][j]
                ok = (DEN * np.minimum(x["n"][i], x["n"][j]) >= NUM * np.maximum(x["n"][i], x["n"][j])) & (
                    (NUM + DEN) * np.bitwise_count(x["wide"][i] ^ x["wide"][j]).sum(axis=1, dtype=np.int64) <= (DEN - NUM) * total
                )
                left[i[ok]] -= 1
                out.append((i[ok], j[ok]))
            if out:
                i, j = (np.concatenate(z) for z in zip(*out, strict=True))
                later = (x["doc"][i] > x["doc"][j]) | ((x["doc"][i] == x["doc"][j]) & (x["line"][i] >= x["line"][j]))
                a, b = np.where(later, i, j), np.where(later, j, i)
                yield pa.RecordBatch.from_arrays([pa.array(x[c][k]) for k in (a, b) for c in ("cls", "doc", "line")], names=list(PAIR))
            tail = {c: v[-REACH:] for c, v in x.items()}

    key = F.xxhash64("cls", "elem")
    order = rows.select("elem", "cls", "n", "doc", "line", "root", "wide", key.alias("h")).repartitionByRange("elem", "h").sortWithinPartitions("elem", "h")
    found = order.mapInArrow(lean(run), "a long, a_doc long, a_line int, b long, b_doc long, b_line int").groupBy(*PAIR).agg(F.count("*").alias("c"))
    # the most frequent of each of BEST parts of its partners
    per = found.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(BEST)))
    best = per.groupBy("a", "a_doc", "a_line", "part").agg(F.max(F.struct("c", "b", "b_doc", "b_line")).alias("m"))
    return best.select("a", "a_doc", "a_line", F.col("m.b").alias("b"), F.col("m.b_doc").alias("b_doc"), F.col("m.b_line").alias("b_line"))


def full_pairs(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Pairs of ``left`` and ``right`` (both elem, cls, n, pos, sketch, sketch2, doc, line and what ``on`` needs) that the bounds leave.

    ``on`` says which pairs count, in terms of the aliases x and y. Every common
    prefix column of a pair must be in both tables. What of the pair isn't
    counted lies after its last common column in both sets, so count plus the
    shorter remainder bounds the overlap.
    """
    x, y = left.alias("x"), right.alias("y")
    met = x.join(y, (F.col("x.elem") == F.col("y.elem")) & (F.col("x.cls") != F.col("y.cls")) & within_size(F.col("x.n"), F.col("y.n")) & within_sketch("x", "y") & on)
    ends = [F.col(f"{t}.{c}").alias(name) for t, names in (("x", PAIR[:3]), ("y", PAIR[3:])) for c, name in zip(("cls", "doc", "line"), names, strict=True)]
    pairs = met.groupBy(*ends).agg(F.count("*").alias("c"), F.first("x.n").alias("n"), F.first("y.n").alias("m"), F.max("x.pos").alias("i"), F.max("y.pos").alias("j"))
    reach = F.col("c") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))
    return pairs.filter(reach >= least_overlap(F.col("n"), F.col("m"))).select(*PAIR)
