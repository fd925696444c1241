"""N-gram Jaccard join: documents that share 80 % of their 5-word shingles, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .frames import drop_folder, finished, shared_folder, stored
from .tokens import chunks, column, shingle_sets


def extract(batch: pa.RecordBatch) -> Iterator[setjoin.Sets]:
    """The shingle set of each text."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for part in chunks(*column(batch, "text")):
        found = list(shingle_sets(part))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        yield setjoin.Sets(ids[part.first : part.first + len(found)], np.zeros(len(found), np.int32), bounds, np.concatenate(found), np.zeros((len(found), 2), np.uint64))


def roots(parents: DataFrame, folder: str) -> DataFrame:
    """(cls, root) from (cls, parent), where every class has one earlier parent at most: pointer jumping."""
    now, k = stored(parents, folder, "parents0"), 0
    while True:
        up = now.select(F.col("cls").alias("parent"), F.col("parent").alias("grand"))
        k += 1
        nxt = stored(now.join(up, "parent", "left").select("cls", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), folder, f"parents{k}")
        if nxt.filter("moved").isEmpty():
            return nxt.select("cls", F.col("parent").alias("root"))
        now = nxt.select("cls", "parent")


def merged(links: DataFrame, folder: str) -> DataFrame:
    """(node, root): the smallest node that can be reached, of nodes in ``links`` (x, y).

    Each round hangs every node on the least of its neighbours and itself,
    follows the pointers to their ends and keeps the links between different
    ends, until none is left.
    """
    done, k = None, 0
    left = stored(links.filter("x != y").distinct(), folder, "links0")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy(F.col("x").alias("cls")).agg(F.min("y").alias("parent")).filter("parent < cls")
        ends = roots(least, f"{folder}/round{k}")
        end = lambda c, e=ends: e.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}"))
        k += 1
        moved = left.join(end("x"), "x", "left").join(end("y"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
        left = stored(moved.filter("x != y").distinct(), folder, f"links{k}")
        if done is None:
            done = ends
        else:
            further = ends.select(F.col("cls").alias("root"), F.col("root").alias("next"))
            chained = done.join(further, "root", "left").select("cls", F.coalesce("next", "root").alias("root"))
            done = chained.unionByName(ends.join(done.select("cls"), "cls", "left_anti"))
        done = stored(done, folder, f"done{k}")
    return done if done is not None else left.select(F.col("x").alias("cls"), F.col("y").alias("root"))


def open_columns(cols: DataFrame, tree: DataFrame, folder: str, name: str) -> DataFrame:
    """``cols`` with each class's root, without the columns that one root holds alone."""
    known = stored(cols.join(tree, "cls", "left").withColumn("root", F.coalesce("root", "cls")), folder, f"{name}_roots")
    some = known.groupBy("elem").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("elem")
    return stored(known.join(some, "elem", "left_semi"), folder, name)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = setjoin.SMALL, flush: int = setjoin.FLUSH) -> DataFrame:
    """(id, n_shingles, component_id) of every row with an id: the smallest id that links reach.

    Two documents link when their shingle sets' intersection has at least 80 %
    of the size of their union; equal sets always do. Null and empty texts have
    no shingles and are their own component. Rows that repeat an id are rows of
    their own, each in the component of its text; an empty table gives none.
    ``small`` and ``flush`` steer work and memory, see :mod:`.setjoin`.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    ids = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    p = setjoin.plan(ids, extract, folder)
    cols = setjoin.columns(p, setjoin.rarity(setjoin.counted(p)), small, flush)
    table = setjoin.members(p, cols)
    # tables of columns and sets may be as large as the texts: each goes when the last that reads it is stored
    drop = lambda *names: [drop_folder(spark, f"{folder}/{x}") for x in names]

    linked = stored(setjoin.verified(setjoin.first_pairs(cols), table, folder, "linked", p), folder, "linked")
    drop("linked_sets")
    tree = roots(linked.select(F.col("a").alias("cls"), F.col("b").alias("parent")), f"{folder}/tree")
    known = open_columns(cols.select("elem", "cls", "n", "pos", "sketch", "sketch2", "doc", "line"), tree, folder, "open1")
    drop("columns", "open1_roots")
    # the classes of large groups that aren't like the earliest: most find another here, and what a root holds needs no more pairs
    wide = table.filter("wide IS NOT NULL").select("cls", "wide").dropDuplicates(["cls"])
    known = stored(known.join(wide, "cls"), folder, "open2")
    drop("open1")
    ring = stored(setjoin.verified(setjoin.ring_pairs(known), table, folder, "ring", p), folder, "ring")
    drop("ring_sets")
    tree = merged(linked.select("a", "b").unionByName(ring.select("a", "b")).toDF("x", "y"), f"{folder}/forest")
    known = open_columns(known.drop("root"), tree, folder, "open3")
    drop("open2", "open3_roots")
    order = F.struct("x.doc", "x.cls") < F.struct("y.doc", "y.cls")
    more = setjoin.full_pairs(known, known, (F.col("x.root") != F.col("y.root")) & order & setjoin.within_wide("x", "y"))
    late = stored(setjoin.verified(more, table, folder, "late", p), folder, "late")
    drop("late_sets", "open3")

    # classes by their smallest document, so that the least node of a component is its id
    links = linked.unionByName(ring).unionByName(late).select("a_doc", "b_doc").toDF("x", "y")
    ends = merged(links, f"{folder}/merge")
    small = table.groupBy("cls").agg(F.min("doc").alias("least"))
    first = table.select("doc", "n", "cls").join(small, "cls").select(F.col("doc").alias("id"), F.col("n").alias("n_shingles"), "least")
    named = first.join(ends.select(F.col("cls").alias("least"), "root"), "least", "left").select("id", "n_shingles", F.coalesce("root", "least").alias("component_id"))
    # rows without shingles are not in the table
    empty = ids.filter("id IS NOT NULL").filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return finished(named.unionByName(empty).withColumnRenamed("id", id_col), folder)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's, and those without an id; columns as they were."""
    gone = components(docs, id_col, text_col).filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone"], "left_anti")


