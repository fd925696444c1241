"""Mixing sources to target weights: a Pfair schedule.

A source of weight w out of W is due one block every W/w slots: its k-th block
is released at slot floor(k W / w) and must stand before slot ceil((k + 1) W / w).
Each slot takes the released block with the earliest deadline.  At any slot
every source then has its share to within less than one block.

With whole-number weights the schedule repeats after W slots, a period, in which
each source has as many blocks as its weight.  So a block's period and its round
in it follow from its number.  A source takes part in as many periods as its
blocks fill, and its slots in the last one that it has no block for stay empty.
Sources of equal weight have equal releases and deadlines; those that last
longer go first among them, so a source's rank among them never changes.
A period then only depends on how many sources of each weight are left, and is
worked out as runs of slots, once for each of these numbers; there are no more
of them than lengths of sources, so any number of sources will do.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from math import gcd
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

#: Documents of a bucket, about: the rows that one sort takes.
BUCKET_ROWS = 50_000

#: Runs at most that are sent to all tasks (about 50 bytes each); more are joined by a shuffle.
MOST_RUNS = 200_000


#: Phases up to which a row's is found by comparisons alone, so that whole rows needn't wait for Python.
FEW_PHASES = 64


class Run(NamedTuple):
    """Slots in a row for one round of sources of one weight: ``first`` slot, and the ranks that they are for."""

    weight: int
    round: int
    rank: int
    many: int
    first: int


def period(left: Mapping[int, int]) -> list[Run]:
    """One period of ``left[w]`` sources of each weight w, by earliest deadline first; ties go to the larger weight, then by rank."""
    total = sum(w * m for w, m in left.items())
    due = [(k * total // w, w, k) for w, m in left.items() if m for k in range(w)]
    heapq.heapify(due)
    ready: list[tuple[int, int, int, int]] = []  # deadline, -weight, round, next rank
    out, slot = [], 0
    while due or ready:
        while due and due[0][0] <= slot:
            _, w, k = heapq.heappop(due)
            heapq.heappush(ready, (-(-(k + 1) * total // w), -w, k, 0))
        end, w, k, rank = ready[0]
        # until the round is done or something else is released
        many = left[-w] - rank
        if due:
            many = min(many, due[0][0] - slot)
        out.append(Run(-w, k, rank, many, slot))
        slot += many
        if rank + many == left[-w]:
            heapq.heappop(ready)
        else:
            heapq.heapreplace(ready, (end, w, k, rank + many))
    return out


class Phase(NamedTuple):
    """Periods ``since`` to ``until``, in which the same sources are left; the first begins at slot ``start``, each has ``length`` slots."""

    since: int
    until: int
    start: int
    length: int
    runs: list[Run]


def phases(sources: list[tuple[int, int, int]]) -> list[Phase]:
    """From (weight, periods, number of such sources)."""
    out, since, start = [], 0, 0
    for until in sorted({p for _, p, _ in sources}):
        left: dict[int, int] = {}
        for w, p, m in sources:
            if p >= until:
                left[w] = left.get(w, 0) + m
        length = sum(w * m for w, m in left.items())
        out.append(Phase(since, until, start, length, period(left)))
        start += (until - since) * length
        since = until
    return out


def mixed(
    docs: DataFrame,
    weights: Mapping[str, int] | None = None,
    block_docs: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
    default: int = 1,
    seed: int = 17,
    slot_col: str = "mix_slot",
    place_col: str = "mix_place",
) -> DataFrame:
    """``docs`` with ``slot_col``, the slot of the row's block in the mix, and ``place_col``, its place within the block.

    Ordering by both gives the mix; a slot has one block, or none where a source
    ends within a period. A source's documents are taken in the order of the MD5
    of seed and id, ``block_docs`` at a time. Sources without a weight get
    ``default``; a null source is a source of its own. All rows stay: equal rows
    get neighbouring places, null ids stand first. An empty table gives no rows;
    columns of these two names are replaced, others may have any name. Any
    number of sources and any weights will do; the driver gets one row for each
    weight and length of sources, and works in proportion to that number times
    the sum of the different weights.
    """
    if any(w < 1 for w in (weights or {}).values()) or default < 1:
        raise ValueError("weights are whole numbers of 1 or more")
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (slot_col, place_col)]
    carry = {f"c{i}": c for i, c in enumerate(keep)}
    source = F.coalesce(F.concat(F.lit("s"), docs[f"`{source_col}`"].cast("string")), F.lit("")).alias("source")
    ident = docs[f"`{id_col}`"].cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident, F.lit(""))).cast("binary"))
    rows = docs.select(*(docs[f"`{c}`"].alias(k) for k, c in carry.items()), source, F.coalesce(F.when(ident.isNotNull(), key), F.lit("")).alias("key"))
    own = spark.createDataFrame([("s" + s, w) for s, w in (weights or {}).items()], "source string, weight long")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n")).join(own, "source", "left").select("source", "n", F.coalesce("weight", F.lit(default)).cast("long").alias("weight"))
    blocks = F.ceil(F.col("n") / block_docs).cast("long")
    by_weight = {r["weight"]: r["most"] for r in sizes.groupBy("weight").agg(F.max("n").alias("most")).collect()}
    names = [F.col(k).alias(c) for k, c in carry.items()]
    if not by_weight:
        return rows.select(*names, F.lit(0).cast("long").alias(slot_col), F.lit(0).cast("int").alias(place_col))
    common = gcd(*by_weight)
    sizes = sizes.withColumn("weight", F.expr(f"weight div {common}")).withColumn("periods", F.ceil(blocks / F.col("weight")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("weight").orderBy(F.desc("periods"), "source")) - 1
    known = sizes.select("source", "weight", rank.cast("long").alias("rank"))
    plan = phases([tuple(r) for r in sizes.groupBy("weight", "periods").agg(F.count("*").alias("m")).collect()])

    # a hot source is dealt into many buckets by its hash; counts of the buckets give each row its number
    buckets = max(1, -(-max(by_weight.values()) // BUCKET_ROWS))
    leading = F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10).cast("double"), F.lit(0.0))
    rows = rows.withColumn("bucket", F.floor(leading * buckets / float(1 << 32)).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "bucket").orderBy("key")
    numbered = rows.withColumn("own", F.row_number().over(within) - 1).join(counts, ["source", "bucket"]).withColumn("number", F.col("before") + F.col("own"))
    placed = numbered.join(known, "source").withColumn("block", F.expr(f"number div {int(block_docs)}"))
    placed = placed.withColumn("turn", F.expr("block div weight")).withColumn("round", F.expr("block % weight"))
    ends = np.array([p.until for p in plan])  # one number a phase

    @F.arrow_udf(IntegerType())
    def phase_of(turn: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends, turn.to_numpy(zero_copy_only=False), "right"), pa.int32())

    table = [(i, p.since, p.start, p.length, *r) for i, p in enumerate(plan) for r in p.runs]
    runs = spark.createDataFrame(table, "phase int, since long, start long, length long, weight long, round long, rank0 long, many long, first long")
    runs = F.broadcast(runs) if len(table) <= MOST_RUNS else runs
    few = sum(((F.col("turn") >= p.until).cast("int") for p in plan), F.lit(0))
    out = placed.withColumn("phase", few if len(plan) <= FEW_PHASES else phase_of("turn")).join(runs, ["phase", "weight", "round"])
    out = out.filter((F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("many")))
    slot = F.col("start") + (F.col("turn") - F.col("since")) * F.col("length") + F.col("first") + F.col("rank") - F.col("rank0")
    return out.select(*names, slot.cast("long").alias(slot_col), (F.col("number") % block_docs).cast("int").alias(place_col))
