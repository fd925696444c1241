"""Quality classifier: hashed subword embeddings, averaged and put through a softmax.

A text's features are its words, its pairs of neighbouring words and the byte
n-grams of its words (with the blank before or after), each hashed into one of
``buckets`` rows of an embedding table.  Training is stochastic gradient
descent in numpy on a bounded, documented sample of labelled rows.  As the
output is linear in the embeddings, scoring folds table and output layer into
one number a bucket: a text's logit is a mean of looked-up numbers, worked out
for a whole Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import map_texts
from .tokens import BLANK, Texts, chunks, column, mix, windows, word_hashes, words

#: Lengths of the byte n-grams.
NGRAMS = (3, 4, 5)

#: Labelled rows of each class that training takes at most: those whose ids have the smallest hashes.
SAMPLE_PER_CLASS = 1500

#: Bytes of their texts at most, which the driver trains on: whole texts in the order of those hashes, as long as they fit.
SAMPLE_BYTES = 64 << 20


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: Texts, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, places) of each kind of feature; a place is an offset into the texts' bytes, in order."""
    data, offsets = texts.data, texts.offsets
    low = np.uint64(buckets - 1)
    w = words(texts)
    hashes = word_hashes(data, w)
    yield (hashes & low).astype(np.int64), w.starts
    if len(hashes) > 1:
        pairs = windows(hashes, 2)
        inside = np.ones(len(pairs), bool)
        last = w.bounds[1:-1] - 1
        inside[last[(last >= 0) & (last < len(pairs))]] = False
        yield (pairs[inside] & low).astype(np.int64), w.starts[:-1][inside]
    blank = BLANK[data]
    x = np.where(blank, 0x20, data).astype(np.uint64)
    rolling = x.copy()
    inner = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        for n in range(2, max(NGRAMS) + 1):
            m = len(x) - n + 1
            if m <= 0:
                return
            rolling = rolling[:m] * np.uint64(0x100000001B3) + x[n - 1 :]
            if n > 2:
                inner = inner[:m] & ~blank[n - 2 : n - 2 + m]
            if n in NGRAMS:
                ok = inner[:m].copy()
                for k in range(1, n):
                    at = offsets[1:-1] - k
                    ok[at[(at >= 0) & (at < m)]] = False
                where = np.flatnonzero(ok)
                yield (mix(rolling[where] ^ np.uint64(n << 56)) & low).astype(np.int64), where


class Model(NamedTuple):
    table: np.ndarray  # a number for each bucket: what the feature adds to the logit of the last class over the first
    prior: float  # logit of a text without features

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for part in chunks(data, offsets):
            n = len(part.offsets) - 1
            total, count = np.zeros(n), np.zeros(n)
            if len(part.data):
                for ids, where in features(part, len(self.table)):
                    bounds = np.searchsorted(where, part.offsets)
                    sums = np.zeros(len(ids) + 1)
                    np.cumsum(self.table[ids], out=sums[1:])
                    total += sums[bounds[1:]] - sums[bounds[:-1]]
                    count += np.diff(bounds)
            logit = np.where(count > 0, total / np.maximum(count, 1), self.prior)
            out[part.first : part.first + n] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return out


def train(texts: list[bytes], labels: list[int], buckets: int = 1 << 18, dim: int = 12, epochs: int = 6, rate: float = 1.0, seed: int = 7) -> Model:
    """Learns embeddings and output layer by plain SGD; labels are 0 and 1.

    Without texts, or with one class alone, the model gives the share of ones
    (a half if there are none) to every text.
    """
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.full(buckets, np.log(p / (1 - p)), np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for raw in texts:
        data = np.frombuffer(raw, np.uint8)
        ids = np.concatenate([f[0] for f in features(Texts(data, np.array([0, len(data)]), 0), buckets)]) if len(data) else np.zeros(0, np.int64)
        u, c = np.unique(ids, return_counts=True)
        rows.append((u, (c / max(1, c.sum())).astype(np.float32)))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    # every class weighs the same
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            u, share = rows[i]
            lr = np.float32(rate * (1 - done / steps) * weight[y[i]])
            done += 1
            if not len(u):
                continue
            vectors = emb[u]
            h = share @ vectors
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, h)
            bias -= lr * p * np.float32(0.1)
            emb[u] = vectors - np.outer(share * np.float32(lr * len(u) ** 0.5), back)
    p = np.clip(y.mean(), 0.01, 0.99)
    return Model((emb @ (out[1] - out[0]) + (bias[1] - bias[0])).astype(np.float32), float(np.log(p / (1 - p))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """Trains on rows of ``docs`` with a label and not held out, ``per_class`` of each label and ``most_bytes`` of text at most.

    Only id, text and label are read. Rows without text or label don't count; an
    id with two labels has the smaller one.
    """
    rows = labels.select(labels[f"`{id_col}`"].alias("__id"), labels[f"`{label_col}`"].cast("int").alias("__y"))
    rows = rows.filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id"))).groupBy("__id").agg(F.min("__y").alias("__y"))
    picked = None
    for y in (0, 1):
        one = rows.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # 2 * per_class rows of two numbers
    texts = docs.select(docs[f"`{id_col}`"].alias("__id"), docs[f"`{text_col}`"].cast("string").alias("__t")).join(F.broadcast(picked), "__id").filter(F.col("__t").isNotNull())
    # of 2 * per_class rows or so the first that fit; one task adds up as many numbers
    texts = texts.withColumn("__n", F.octet_length("__t").cast("long")).withColumn("__h", F.xxhash64("__id", "__t"))
    total = F.sum("__n").over(Window.orderBy("__h", "__id", "__y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = texts.select("__id", "__y", "__n", "__h").withColumn("__total", total).filter(F.col("__total") <= most_bytes).agg(F.max("__h")).collect()[0][0]
    texts = texts.filter(F.col("__h") <= fits) if fits is not None else texts.limit(0)
    got = sorted(((r["__id"], r["__y"], r["__t"]) for r in texts.select("__id", "__y", "__t").collect()), key=lambda r: (r[0], r[2]))
    return train([t.encode() for _, _, t in got], [y for _, y, _ in got], **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``score`` of its whole text, from 0 to 1.

    Null and empty texts get the share of ones among the labels. Repeats and
    null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float a bucket, whatever the corpus

    def run(texts: pa.Array) -> list:
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        return [shared.value.scores(*column(batch, "t"))]

    return map_texts(docs, {id_col: id_col}, text_col, run, "score double", [pa.field("score", pa.float64())])
