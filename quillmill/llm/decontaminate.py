"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming search.

A benchmark item of L words is compared with every window of L words of a
document.  Both are weighted sets of 5-word shingles (a shingle weighs as often
as it occurs; fewer than five words are one shingle) with a 64-bit SimHash.
Fingerprints are cut into ``BLOCKS`` blocks of bits: two that differ in
``RADIUS`` bits or fewer differ in ``RADIUS // BLOCKS`` or fewer in one of the
blocks, so the items whose value of a block is that near are all that have to
be looked at, in each block.  Candidates are then verified by exact weighted
Jaccard similarity.

Windows of which fewer places than a similar one needs hold shingles of the
items of their size can't reach the similarity, and are never fingerprinted;
nearly all windows are of that kind.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, drop_folder, lean, shared_folder, stored
from .tokens import Texts, chunks, column, lower, mix, runs, whole, windows, word_hashes, words

WIDTH = 5
SIMILARITY = (4, 5)

#: Bits that may differ. At a similarity of 0.8 fingerprints differ in 9.7 of 64 bits on average, with a deviation of 2.9.
RADIUS = 18

#: Blocks of 16 bits.
BLOCKS = 4

#: Bytes of item texts that go to the workers at a time; a larger benchmark is taken in blocks of items.
BLOCK_BYTES = 16 << 20

_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64))


def shingles(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(hashes of the shingles in order, number of words) of one text; fewer than five words make one shingle."""
    low = lower(data)
    w = words(Texts(low, np.array([0, len(low)]), 0))
    h = word_hashes(low, w)
    if len(h) >= WIDTH:
        return windows(h, WIDTH), len(h)
    return (np.array([whole(h)], np.uint64) if len(h) else np.zeros(0, np.uint64)), len(h)


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 times +1 or -1 for each shingle."""
    return np.where(mix(hashes)[:, None] & _BITS, np.int32(1), np.int32(-1))


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of 64 sums."""
    return np.where(sums > 0, _BITS, np.uint64(0)).sum(axis=1, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


class BlockIndex:
    """Fingerprints by the values of their blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.near_by = prints, radius, radius // blocks
        edges = np.linspace(0, 64, blocks + 1).astype(int)
        self.cuts = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables = []
        for shift, mask in self.cuts:
            part = prints >> shift & mask
            order = np.argsort(part, kind="stable")
            values, first, many = np.unique(part[order], return_index=True, return_counts=True)
            self.tables.append((values, first, many, order))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs within the radius, each once."""
        found = [np.zeros(0, np.int64)]
        for (shift, mask), (values, first, many, order) in zip(self.cuts, self.tables, strict=True):
            step = max(1, (1 << 20) // max(1, len(values)))
            for i in range(0, len(queries), step):
                part = queries[i : i + step] >> shift & mask
                q, v = np.nonzero(np.bitwise_count(part[:, None] ^ values) <= self.near_by)
                n = many[v]
                at = np.arange(n.sum()) + np.repeat(first[v] - np.cumsum(n) + n, n)
                q, item = np.repeat(q, n) + i, order[at]
                close = np.bitwise_count(queries[q] ^ self.prints[item]) <= self.radius
                found.append(q[close] * len(self.prints) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Benchmark(NamedTuple):
    """Items by size: for each number of shingles the items' ids, shingles and index; and all shingles, with the sizes they occur in."""

    ids: dict[int, list]
    sets: dict[int, list[np.ndarray]]
    words: dict[int, list[int]]
    index: dict[int, BlockIndex]
    known: np.ndarray
    sizes: list[np.ndarray]
    gate: np.ndarray
    short: list[int]  # numbers of words under ``WIDTH`` that items have

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], radius: int = RADIUS) -> Benchmark:
        ids: dict[int, list] = {}
        sets: dict[int, list[np.ndarray]] = {}
        counts: dict[int, list[int]] = {}
        for item, raw in items:
            s, n = shingles(np.frombuffer(raw, np.uint8))
            if len(s):
                ids.setdefault(len(s), []).append(item)
                sets.setdefault(len(s), []).append(s)
                counts.setdefault(len(s), []).append(n)
        index = {m: BlockIndex(np.array([packed(signs(s).sum(axis=0, keepdims=True))[0] for s in group], np.uint64), radius) for m, group in sets.items()}
        everything = np.concatenate([s for g in sets.values() for s in g]) if sets else np.zeros(0, np.uint64)
        size = np.concatenate([np.full(len(s), m) for m, g in sets.items() for s in g]) if sets else np.zeros(0, int)
        known, at = np.unique(everything, return_inverse=True)
        order = np.lexsort((size, at))
        cut = np.searchsorted(at[order], np.arange(1, len(known)))
        sizes = [np.unique(x) for x in np.split(size[order], cut)] if len(known) else []
        gate = np.zeros(1 << 20, bool)
        gate[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return cls(ids, sets, counts, index, known, sizes, gate, sorted({n for c in counts.values() for n in c if n < WIDTH}))

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places of the items' shingles in ``s``."""
        maybe = np.flatnonzero(self.gate[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == s[maybe]]

    def search(self, s: np.ndarray, hits: np.ndarray) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first word, words) of a text's shingles: the best window of each item that reaches the similarity."""
        best: dict[object, tuple[float, int, int]] = {}
        by_size: dict[int, list[int]] = {}
        for p in hits.tolist():
            for m in self.sizes[int(np.searchsorted(self.known, s[p]))].tolist():
                by_size.setdefault(m, []).append(p)
        for m, places in by_size.items():
            take = min(m, len(s))
            # what two sets of these sizes must share to be similar
            least = -(-SIMILARITY[0] * (m + take) // sum(SIMILARITY))
            total = np.zeros(len(s) + 1, np.int64)
            np.add.at(total, np.array(places) + 1, 1)
            total = np.cumsum(total)
            starts = np.flatnonzero(total[take:] - total[: len(total) - take] >= least)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for c in range(0, len(run), 4096):
                    part = run[c : c + 4096]
                    a, b = int(part[0]), int(part[-1])
                    rows = np.zeros((b - a + take + 1, 64), np.int32)
                    np.cumsum(signs(s[a : b + take]), axis=0, out=rows[1:])
                    prints = packed(rows[take:] - rows[: len(rows) - take])
                    q, item = self.index[m].near(prints)
                    for w, t in zip(q.tolist(), item.tolist(), strict=True):
                        x = similar(s[a + w : a + w + take], self.sets[m][t])
                        if x * SIMILARITY[1] >= SIMILARITY[0] - 1e-9:
                            name, n = self.ids[m][t], self.words[m][t]
                            if name not in best or (x, -(a + w)) > (best[name][0], -best[name][1]):
                                best[name] = (x, a + w, n)
        return [(t, x, at, n) for t, (x, at, n) in best.items()]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[object, float, int, int]]]:
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        if not len(self.known):
            return out
        for part in chunks(data, offsets):
            low = lower(part.data)
            w = words(Texts(low, part.offsets, 0))
            h = word_hashes(low, w)
            s = windows(h, WIDTH)
            places = self.hits(s)
            # windows that run into the next text are no shingles of this one
            text = np.searchsorted(w.bounds, places, "right") - 1
            inside = places + WIDTH <= w.bounds[text + 1]
            places, text = places[inside], text[inside]
            for k in np.unique(text).tolist():
                a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                out[part.first + k] = self.search(s[a : b - WIDTH + 1], places[text == k] - a)
            for n in self.short:
                one = runs(h, n)
                places = self.hits(one)
                text = np.searchsorted(w.bounds, places, "right") - 1
                inside = places + n <= w.bounds[text + 1]
                places, text = places[inside], text[inside]
                for k in np.unique(text).tolist():
                    a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                    out[part.first + k] += self.search(one[a : b - n + 1], places[text == k] - a)
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[int, Callable[[int], Benchmark]]:
    """Number of parts of the benchmark, of ``BLOCK_BYTES`` or so, and what fetches one of them."""
    rows = items.select(items[f"`{id_col}`"].alias("item"), items[f"`{text_col}`"].cast("string").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return n, lambda k: Benchmark.of([(r["item"], r["text"].encode()) for r in (rows if n == 1 else rows.filter(part == k)).collect()])


def _mapped(docs: DataFrame, carry: dict[str, str], text_col: str, one: Benchmark) -> DataFrame:
    """``carry`` (output name: column) of each row and ``__found``, the items in its text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(one)
    rows = docs.select(*(docs[f"`{c}`"].alias(k) for k, c in carry.items()), docs[f"`{text_col}`"].cast("string").alias("__text"))
    kind = pa.list_(pa.struct([("item", pa.string()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = shared.value.scan(*column(batch, "__text"))
            array = pa.array([[{"item": str(t), "similarity": x, "first_word": i, "n_words": n} for t, x, i, n in sorted(f, key=lambda y: (y[2], str(y[0])))] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], array], names=[*carry, "__found"])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)]]
    return rows.mapInArrow(lean(run), ", ".join([*ddl, "__found array<struct<item:string,similarity:double,first_word:bigint,n_words:bigint>>"]))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, similarity, first_word, n_words) of every item that a text has a window like.

    The best window of each row and item, the first of equals. Words are as in
    the n-gram join. An item of fewer than five words is only like the same
    words. Null and empty texts and items match nothing; a text shorter than an
    item is one window; rows that repeat stay, items that repeat an id count
    once; empty tables give no rows. A benchmark of over ``BLOCK_BYTES`` is taken
    in parts, one pass over the documents and one table of results each.
    """
    n, part = _blocks(items, item_col, item_text_col)
    kind = items.schema[item_col].dataType

    def found(k):
        rows = _mapped(docs, {id_col: id_col}, text_col, part(k)).select(id_col, F.explode("__found").alias("f"))
        return rows.select(id_col, F.col("f.item").cast(kind).alias(item_col), "f.similarity", "f.first_word", "f.n_words")

    if n == 1:
        return found(0)
    folder, out = shared_folder(docs.sparkSession), None
    for k in range(n):
        one = stored(found(k), folder, f"part{k}")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts have no window like an item; columns as they were, by position. No text is shuffled."""
    n, part = _blocks(items, item_col, item_text_col)
    folder = None
    for k in range(n):
        carry = {f"__c{i}": c for i, c in enumerate(docs.columns)}
        rows = _mapped(docs, carry, text_col, part(k)).filter(F.size("__found") == 0)
        docs = rows.select(*(F.col(x).alias(c) for x, c in carry.items()))
        if k < n - 1:  # what a part leaves is kept, so that one part is held at a time
            made = folder or shared_folder(docs.sparkSession)
            docs, folder = stored(docs, made, f"part{k}"), made
            if k:
                drop_folder(docs.sparkSession, f"{folder}/part{k - 1}")
    return docs
