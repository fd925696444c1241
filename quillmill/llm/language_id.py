"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound from
its letters' vectors, each permuted (rotated) by its place and multiplied; a
text is the bundle (sum) of its trigrams' vectors.  A language's prototype is
the bundle of all its learning texts, and a text is given the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_texts, shared_folder, stored
from .tokens import Texts, chunks, column

#: Vectors have so many numbers.
DIM = 512
#: Letters: a-z have one class each, all others share the rest by a hash; 0 is anything else.
CLASSES = 128
#: Trigram vectors that a worker keeps at most; beyond, it begins anew.
KEPT = 24_000
#: Languages whose prototypes go to every worker (2 KB each); more of them lie in files, so many to a file.
MOST_LANGUAGES = 5_000


class Letters:
    """The class of each code point: that of its lower-case form."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            t = np.zeros(0x110000, np.uint8)
            for cp in range(0x80, 0x110000):
                c = chr(cp)
                if c.isalpha():
                    t[cp] = 27 + (ord(c.lower()[0]) * 2654435761 >> 7) % (CLASSES - 27)
            for i in range(26):
                t[0x61 + i] = t[0x41 + i] = i + 1
            cls._table = t
        return cls._table


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers in order and the bounds of each text's; runs of other characters count as one blank."""
    codes = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=lead[1:])
    at = np.minimum(lead[texts.offsets], len(codes))
    c = Letters.table()[codes]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[at[at < len(c)]] = True
    moved = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    c, at = c[keep].astype(np.int32), moved[at]
    if len(c) < 3:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    g = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    ok = (c[:-2] + c[1:-1] + c[2:]) > 0
    for k in (1, 2):
        cut = at[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(g))]] = False
    bounds = np.zeros(len(ok) + 1, np.int64)
    np.cumsum(ok, out=bounds[1:])
    return g[ok], bounds[np.minimum(at, len(ok))]


class Space:
    """Trigram vectors, made when first met."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (CLASSES, dim))
        self.dim, self.at = dim, [np.roll(letters, 2 - k, axis=1) for k in range(3)]
        self.row = np.full(CLASSES**3, -1, np.int32)
        self.vectors = np.zeros((0, dim), np.float32)

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the vectors of ``grams``, with repeats."""
        u, n = np.unique(grams, return_counts=True)
        total = np.zeros(self.dim, np.float64)
        for i in range(0, len(u), KEPT):
            total += n[i : i + KEPT].astype(np.float32) @ self.of(u[i : i + KEPT])
        return total

    def of(self, u: np.ndarray) -> np.ndarray:
        new = u[self.row[u] < 0]
        if len(new):
            if len(self.vectors) + len(new) > KEPT:
                self.row[:] = -1
                self.vectors, new = self.vectors[:0], u
            a, b, c = new // CLASSES**2, new // CLASSES % CLASSES, new % CLASSES
            self.row[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate([self.vectors, self.at[0][a] * self.at[1][b] * self.at[2][c]])
        return self.vectors[self.row[u]]


_SPACES: dict[tuple[int, int], Space] = {}


def space(dim: int, seed: int) -> Space:
    if (dim, seed) not in _SPACES:
        _SPACES[dim, seed] = Space(dim, seed)
    return _SPACES[dim, seed]


class Profiles(NamedTuple):
    """Prototypes by language: in ``langs`` and ``prototypes``, or, where there are very many, in files of ``MOST_LANGUAGES`` or so each."""

    langs: list[str]
    prototypes: np.ndarray  # unit length, a row a language, in order of their names
    dim: int
    seed: int
    folder: str = ""
    files: tuple[str, ...] = ()

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """Some languages at a time; a file is read anew whenever it is its turn."""
        if self.langs:
            yield self.langs, self.prototypes
        if self.files:
            fs, top = pa.fs.FileSystem.from_uri(self.folder)
            for name in self.files:
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    yield pickle.loads(f.read())

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        said, scores = [], np.zeros(len(offsets) - 1)
        own = space(self.dim, self.seed)
        letters = Letters.table()
        for part in chunks(data, offsets):
            n = len(part.offsets) - 1
            grams, bounds = trigrams(part) if len(part.data) else (np.zeros(0, np.int32), np.zeros(n + 1, np.int64))
            vectors = np.array([own.bundle(grams[bounds[k] : bounds[k + 1]]) for k in range(n)]).reshape(n, self.dim)
            norms = np.linalg.norm(vectors, axis=1)
            best, names = np.full(n, -np.inf), [""] * n
            for langs, prototypes in self.blocks():
                for i in range(0, n, 256):
                    cosines = vectors[i : i + 256] @ prototypes.T
                    at = cosines.argmax(axis=1)
                    for k, (j, x) in enumerate(zip(at.tolist(), cosines[np.arange(len(at)), at].tolist(), strict=True), i):
                        if (-x, langs[j]) < (-best[k], names[k]):
                            best[k], names[k] = x, langs[j]
            for k in range(n):
                if norms[k] and names[k]:
                    said.append(names[k])
                    scores[part.first + k] = min(1.0, max(0.0, float(best[k] / norms[k])))
                else:  # too short for a trigram: any letter at all?
                    raw = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    said.append(names[k] if names[k] and any(letters[ord(c)] for c in raw) else "und")
        return said, scores


def _unit(sums: dict[str, np.ndarray], dim: int) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes; one without a trigram has none."""
    langs = sorted(x for x, v in sums.items() if v.any())
    return langs, np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs]) if langs else np.zeros((0, dim))


def _stored(total: DataFrame, folder: str, parts: int, dim: int) -> tuple[str, ...]:
    """Names of files of prototypes below ``folder``, one a task; a table, committed by Spark, says which count."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(lang, np.zeros(dim))[i] = v
        langs, prototypes = _unit(sums, dim)
        if langs:
            fs, top = pa.fs.FileSystem.from_uri(folder)
            fs.create_dir(f"{top}/profiles", recursive=True)
            name = f"profiles/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{top}/{name}", compression=None) as f:
                pickle.dump((langs, prototypes), f, protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    made = stored(total.repartition(parts, "lang").mapInArrow(run, "file string"), folder, "files")
    return tuple(sorted(r["file"] for r in made.collect()))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = 11) -> Profiles:
    """Prototypes from every row of ``docs`` with a language; the caller leaves held-out rows out.

    Each task bundles its own texts by language; a sum over (language, place)
    adds the tasks up, so the driver gets ``dim`` numbers a language. Over
    ``MOST_LANGUAGES`` languages are kept in files instead, and give the same.
    """
    rows = docs.select(docs[f"`{lang_col}`"].cast("string").alias("lang"), docs[f"`{text_col}`"].cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        own = space(dim, seed)
        sums: dict[str, np.ndarray] = {}

        def given():
            while sums:
                lang, v = sums.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for part in chunks(*column(batch, "text")):
                grams, bounds = trigrams(part)
                of = langs[part.first : part.first + len(part.offsets) - 1]
                for lang in set(of):
                    mine = [grams[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(of == lang)]
                    v = own.bundle(np.concatenate(mine))
                    sums[lang] = sums[lang] + v if lang in sums else v
            if len(sums) > MOST_LANGUAGES:
                yield from given()
        yield from given()

    total = rows.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    known = rows.select("lang").distinct()
    if known.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        folder = shared_folder(docs.sparkSession)
        return Profiles([], np.zeros((0, dim)), dim, seed, folder, _stored(total, folder, -(-known.count() // MOST_LANGUAGES), dim))
    by: dict[str, np.ndarray] = {}
    for lang, i, v in total.collect():  # dim numbers for each of MOST_LANGUAGES at most
        by.setdefault(lang, np.zeros(dim))[i] = v
    return Profiles(*_unit(by, dim), dim, seed)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred`` and ``score`` (cosine, 0 at least) of its whole text.

    ``und`` with 0 where the text is null or has no letter, or nothing was
    learned; a text too short for a trigram has the first language and 0.
    Repeats and null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(texts: pa.Array) -> list:
        return list(shared.value.predict(*column(pa.RecordBatch.from_arrays([texts], names=["t"]), "t")))

    return map_texts(docs, {id_col: id_col}, text_col, run, "lang_pred string, score double", [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
