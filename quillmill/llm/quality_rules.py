"""Quality rules: counts of a text, and n-gram perplexity bands by language.

The language model is a character 4-gram model with modified Kneser-Ney
smoothing.  Spark counts the n-grams of every text, by language; the model is
three sorted arrays an order (hash, log probability, log backoff), looked up by
binary search.  Characters fall into 64 classes, so a 4-gram's hash is its 24
bits and a language's model has 2**24 entries at most, however large the corpus.
A small model is broadcast; a large one is stored by language, and the texts are
dealt by language to be scored. Both are the same model.

A text whose perplexity lies outside its language's band is rejected.  A band's
centre is the median of log perplexity over all the language's texts; its width
comes from their median deviation, scaled by length, so lower and upper bound
are the language's own.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import drop_folder, lean, shared_folder, stored
from .tokens import BLANK, Texts, chunks, column, windows, word_hashes, words

ORDER = 4
BITS = 6
_MASK = (1 << BITS) - 1

#: Model entries, all languages together, that go to every worker (about 16 bytes each). A larger model, as whole, lies in files by language.
MOST_ENTRIES = 6_000_000

#: A band reaches ``LEAST_WIDTH + WIDTH * spread / sqrt(characters)`` to either side in log perplexity: a mean over few characters varies more.
WIDTH, LEAST_WIDTH = 4.0, 0.06

#: Steps of log perplexity a unit, for the medians.
_STEPS = 512

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Classes:
    """The class of each code point: 0 blank, a-z, digits, kinds of punctuation, and hashed others."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            t = np.zeros(0x110000, np.uint8)
            cp = np.arange(0x80, 0x110000, dtype=np.uint64)
            t[0x80:] = 40 + ((cp * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(24)
            t[0x00:0x80] = 39
            for i in range(26):
                t[0x61 + i] = t[0x41 + i] = i + 1
            for i, group in enumerate((b"0123456789", b".", b",", b";:", b"!?", b"'\"`", b"()[]{}", b"-_/\\", b"#*$%&|<>")):
                t[list(group)] = 27 + i
            for cp in range(0xC0, 0x250):  # lower case, so that Ä and ä are one
                t[cp] = t[ord(chr(cp).lower()[0])]
            t[[0x20, *range(0x09, 0x0E)]] = 0
            cls._table = t
        return cls._table


def keys(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """4-gram numbers of all texts in order, and the bounds of each text's.

    Runs of blanks are one; each text begins with three blanks, so it has as
    many 4-grams as characters.
    """
    codes = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=lead[1:])
    at = np.minimum(lead[texts.offsets], len(codes))
    c = Classes.table()[codes]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[at[at < len(c)]] = True
    moved = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    c, at = c[keep].astype(np.uint32), moved[at]
    out = c.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(c)
        before[k:] = c[:-k]
        for j in range(k):
            cut = at[:-1] + j
            before[cut[cut < at[1:]]] = 0
        out |= before << np.uint32(BITS * k)
    return out, at


class Level(NamedTuple):
    """One order of the model: sorted hashes, log probabilities, and log backoff weights as contexts."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def smooth(counts: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """Modified Kneser-Ney from (sorted keys, counts) of orders 1 to n: continuation counts below the highest order."""
    levels: list[Level] = []
    lower: Level | None = None
    for k, n in counts:
        n = n.astype(np.float64)
        n1, n2, n3, n4 = (float((n == i).sum()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = np.array([0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9])
        d = np.clip(d, 0.05, [0.05, 0.95, 1.9, 2.85])
        off = d[np.minimum(n, 3).astype(int)]
        contexts, first = np.unique(k >> BITS, return_index=True)
        total = np.add.reduceat(n, first) if len(n) else np.zeros(0)
        gamma = np.add.reduceat(off, first) / total if len(n) else np.zeros(0)
        size = np.diff(np.append(first, len(n)))
        p = (n - off) / np.repeat(total, size)
        rest = np.repeat(gamma, size)
        if lower is None:
            p = p + rest / (1 << BITS)
        else:
            p = p + rest * np.exp(lower.logp[np.searchsorted(lower.keys, k & np.uint32((1 << BITS * len(levels)) - 1))])
        lower = Level(k.astype(np.uint32), np.log(p).astype(np.float32), contexts.astype(np.uint32), np.log(gamma).astype(np.float32))
        levels.append(lower)
    return levels


def look_up(levels: list[Level], k: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram; what isn't stored backs off to shorter ones."""
    out = np.zeros(len(k), np.float32)
    todo, part = np.arange(len(k)), k
    for order in range(len(levels) - 1, -1, -1):
        level = levels[order]
        if len(level.keys):
            at = np.minimum(np.searchsorted(level.keys, part), len(level.keys) - 1)
            hit = level.keys[at] == part
            out[todo[hit]] += level.logp[at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            context = part >> np.uint32(BITS)
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            out[todo] += np.where(level.contexts[at] == context, level.backoff[at], np.float32(0))
        part = part & np.uint32((1 << BITS * order) - 1)
    out[todo] -= np.float32(BITS * np.log(2))
    return out


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, key, n) over every text; a null language is a language of its own, ``und``."""

    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang):
            k, n = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for part in chunks(*column(batch, "text")):
                if not len(part.data):
                    continue
                k, bounds = keys(part)
                of = langs[part.first : part.first + len(part.offsets) - 1]
                for lang in set(of):
                    mine = k if (of == lang).all() else np.concatenate([k[bounds[j] : bounds[j + 1]] for j in np.flatnonzero(of == lang)])
                    u, n = np.unique(mine, return_counts=True)
                    if lang in sums:
                        a, b = sums[lang]
                        both = np.concatenate([a, u])
                        order = np.argsort(both, kind="stable")
                        s = both[order]
                        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int)
                        sums[lang] = (s[first], np.add.reduceat(np.concatenate([b, n])[order], first)) if len(s) else (s, n)
                    else:
                        sums[lang] = (u, n)
                    if len(sums[lang][0]) > 2_000_000:
                        yield rows(lang)
        for lang in list(sums):
            yield rows(lang)

    rows = docs.select(F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit("und")).alias("lang"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Stored(Mapping):
    """The levels of each language in a file of its own below ``folder``; the last used are kept, of ``MOST_ENTRIES`` at most or one language."""

    def __init__(self, folder: str, files: dict[str, str]):
        self.folder, self.files, self.kept = folder, files, {}

    def __reduce__(self):
        return Stored, (self.folder, self.files)

    def __iter__(self):
        return iter(self.files)

    def __len__(self) -> int:
        return len(self.files)

    def __contains__(self, lang) -> bool:
        return lang in self.files

    def __getitem__(self, lang: str) -> list[Level]:
        got = self.kept.pop(lang, None)
        if got is None:
            # those used longest ago go before another is read
            while self.kept and sum(len(x[-1].keys) for x in self.kept.values()) > MOST_ENTRIES // 2:
                del self.kept[next(iter(self.kept))]
            fs, top = pa.fs.FileSystem.from_uri(self.folder)
            with fs.open_input_stream(f"{top}/{self.files[lang]}", compression=None) as f:
                got = pickle.loads(f.read())
        self.kept[lang] = got
        return got


def store_model(top: DataFrame, folder: str) -> Stored:
    """The model of the 4-grams (lang, key, n) in files by language; a language's counts meet in one task, 2**24 of them at most.

    A table, committed by Spark, names the files that count.
    """

    def run(batches):
        fs, where = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{where}/model", recursive=True)

        def written(lang, parts):
            k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            counts = [(k.astype(np.uint32), n)]
            for order in range(ORDER - 1, 0, -1):
                counts.insert(0, np.unique(counts[0][0] & np.uint32((1 << BITS * order) - 1), return_counts=True))
            name = f"model/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{where}/{name}", compression=None) as f:
                pickle.dump(smooth(counts), f, protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([name])], names=["lang", "file"])

        lang, parts = None, []
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            begin = 0
            for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if own != lang and parts:
                    yield written(lang, parts)
                    parts = []
                lang = own
                parts.append(tuple(batch.column(c).slice(begin, end - begin).to_numpy() for c in (1, 2)))
                begin = end
        if parts:
            yield written(lang, parts)

    rows = top.repartition("lang").sortWithinPartitions("lang", "key").mapInArrow(lean(run), "lang string, file string")
    return Stored(folder, {r["lang"]: r["file"] for r in stored(rows, folder, "files").collect()})


class Model(NamedTuple):
    levels: Mapping[str, list[Level]]

    def log_perplexity(self, texts: Texts, langs: list[str]) -> np.ndarray:
        """Mean negative log probability a character of each text; 0 for an empty one or an unknown language."""
        n = len(texts.offsets) - 1
        if not len(texts.data):
            return np.zeros(n)
        k, bounds = keys(texts)
        logp = np.zeros(len(k), np.float32)
        of = np.repeat(np.array(langs, object), np.diff(bounds))
        for lang in set(langs):
            if lang in self.levels:
                mine = slice(None) if len(set(langs)) == 1 else np.flatnonzero(of == lang)
                logp[mine] = look_up(self.levels[lang], k[mine])
        sums = np.zeros(len(k) + 1)
        np.cumsum(logp, out=sums[1:], dtype=np.float64)
        return -(sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts all texts and smooths the counts; the lower orders' continuation counts are aggregates of the 4-grams.

    Above ``MOST_ENTRIES`` the levels are :class:`Stored`.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    top = stored(count_ngrams(docs, text_col, lang_col), folder, "ngrams")
    if top.count() > MOST_ENTRIES:
        model = Model(store_model(top, shared_folder(spark)))
        drop_folder(spark, folder)
        return model
    orders = [top]
    for order in range(ORDER - 1, 0, -1):
        orders.insert(0, orders[0].groupBy("lang", (F.col("key").bitwiseAND((1 << BITS * order) - 1)).alias("key")).agg(F.count("*").alias("n")))
    raw: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for df in orders:
        pdf = df.orderBy("lang", "key").toArrow().to_pandas(strings_to_categorical=True)  # MOST_ENTRIES at most, 16 bytes each
        for lang, g in pdf.groupby("lang", observed=True):
            raw.setdefault(lang, []).append((g["key"].to_numpy().astype(np.uint32), g["n"].to_numpy()))
    drop_folder(spark, folder)
    return Model({lang: smooth(x) for lang, x in raw.items()})


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for part in chunks(data, offsets):
        i, m = part.first, len(part.offsets) - 1
        if not len(part.data):
            continue
        w = words(part)
        per = lambda flags, o=part.offsets: np.diff(np.concatenate([[0], np.cumsum(flags)])[o])
        out["n_words"][i : i + m] = np.diff(w.bounds)
        out["word_chars"][i : i + m] = per(((part.data & 0xC0) != 0x80) & ~BLANK[part.data])
        out["n_symbols"][i : i + m] = per(_SYMBOL[part.data])
        runs = windows(word_hashes(part.data, w), 8)
        for k, (a, b, s, e) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)):
            lines = [x for x in part.data[s:e].tobytes().split(b"\n") if x and not x.isspace()]
            out["n_dup_lines"][i + k] = len(lines) - len(set(lines))
            if b - a > 8:
                own = runs[a : b - 7]
                s = np.sort(own)
                twice = s[1:][s[1:] == s[:-1]]
                if len(twice):
                    cover = np.zeros(b - a + 1, np.int64)
                    at = np.flatnonzero(np.isin(own, twice))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + 8, -1)
                    out["n_repeat_words"][i + k] = int((np.cumsum(cover[:-1]) > 0).sum())
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: Model, carry: dict[str, str], text_col: str = "text", lang_col: str = "lang", prefix: str = "") -> DataFrame:
    """``carry`` (output name: column) of each row, with the base counts, ``lang`` and ``log_ppl``, all under ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_ENTRIES at most, or names of files
    cols = [docs[f"`{c}`"].alias(k) for k, c in carry.items()]
    rows = docs.select(*cols, F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit("und")).alias("__lang"), docs[f"`{text_col}`"].cast("string").alias("__text"))
    if isinstance(model.levels, Stored):
        # a task has few languages, one after the other; a large language is several tasks'
        rows = rows.repartitionByRange("__lang", F.xxhash64("__text")).sortWithinPartitions("__lang")

    def run(batches):
        for batch in batches:
            data, offsets = column(batch, "__text")
            langs = batch.column(len(carry)).to_pylist()
            got = _measure(data, offsets)
            ppl = np.zeros(len(langs))
            for part in chunks(data, offsets):
                m = len(part.offsets) - 1
                ppl[part.first : part.first + m] = shared.value.log_perplexity(part, langs[part.first : part.first + m])
            arrays = [*batch.columns[: len(carry)], *(pa.array(got[c]) for c in _COUNTS), pa.array(langs, pa.string()), pa.array(ppl)]
            names = [*carry, *(prefix + c for c in (*_COUNTS, "lang", "log_ppl"))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)]]
    return rows.mapInArrow(lean(run), ", ".join([*ddl, *(f"`{prefix}{c}` bigint" for c in _COUNTS), f"`{prefix}lang` string", f"`{prefix}log_ppl` double"]))


def _middle(pairs: list[tuple[int, int]]) -> int:
    """Median of (value, count) pairs."""
    half, seen = sum(n for _, n in pairs) / 2, 0
    for b, n in sorted(pairs):
        seen += n
        if seen >= half:
            return b
    return 0


def _characters(prefix: str = "") -> Column:
    return F.col(f"{prefix}word_chars") + F.col(f"{prefix}n_words")


def _by_lang(values: dict[str, float]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))


def bands(measured: DataFrame) -> dict[str, tuple[float, float]]:
    """(centre, spread) of each language: median log perplexity, and 1.48 times the median of its deviation times the root of the length.

    From histograms of all its texts of 20 words or more, so the driver gets a
    few thousand numbers a language; a language without any has no band.
    """
    rows = measured.filter("n_words >= 20")

    def histogram(value: Column) -> dict[str, list[tuple[int, int]]]:
        by: dict[str, list[tuple[int, int]]] = {}
        for r in rows.groupBy("lang", F.floor(value * _STEPS).cast("long").alias("bin")).agg(F.count("*").alias("n")).collect():
            by.setdefault(r["lang"], []).append((r["bin"], r["n"]))
        return by

    centre = {lang: (_middle(x) + 0.5) / _STEPS for lang, x in histogram(F.col("log_ppl")).items()}
    if not centre:
        return {}
    away = F.abs(F.col("log_ppl") - _by_lang(centre)[F.col("lang")]) * F.sqrt(_characters())
    return {lang: (centre[lang], 1.4826 * (_middle(x) + 0.5) / _STEPS) for lang, x in histogram(away).items()}


def base_failed(prefix: str = "") -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated 8-word windows."""
    return (F.col(f"{prefix}n_words") < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * F.col(f"{prefix}n_words"))


def kept(limits: dict[str, tuple[float, float]], prefix: str = "") -> Column:
    """Not failed, and inside the language's band; a language without a band keeps what hasn't failed."""
    out = ~base_failed(prefix)
    if limits:
        lang = F.col(f"{prefix}lang")
        half = LEAST_WIDTH + WIDTH * _by_lang({k: s for k, (_, s) in limits.items()})[lang] / F.sqrt(F.greatest(F.lit(1), _characters(prefix)))
        away = F.col(f"{prefix}log_ppl") - _by_lang({k: c for k, (c, _) in limits.items()})[lang]
        out = out & F.coalesce(away.between(-half, half), F.lit(True))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, the five counts, ``log_ppl``, ``base_failed`` and ``kept``.

    Null texts have no words, so they fail. Repeats and null ids stay; an empty
    table gives no rows. Two passes over the texts: one counts, one measures.
    """
    model = fit(docs, text_col, lang_col)
    thin = stored(measure(docs, model, {id_col: id_col}, text_col, lang_col), shared_folder(docs.sparkSession), "measured")
    if isinstance(model.levels, Stored):
        drop_folder(docs.sparkSession, model.levels.folder)
    limits = bands(thin)
    return thin.withColumn("base_failed", base_failed()).withColumn("kept", kept(limits))


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns and no others.

    The texts are measured again as they pass, so no text is shuffled unless the
    model is too large for every worker.
    """
    model = fit(docs, text_col, lang_col)
    folder = shared_folder(docs.sparkSession)
    limits = bands(stored(measure(docs, model, {}, text_col, lang_col), folder, "measured"))
    drop_folder(docs.sparkSession, folder)
    prefix = "__rules_"
    carry = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    rows = measure(docs, model, carry, text_col, lang_col, prefix).filter(kept(limits, prefix))
    return rows.select(*(F.col(k).alias(c) for k, c in carry.items()))
