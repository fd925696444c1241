"""Small helpers that the operators share: row-wise Arrow maps and shared folders."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def map_texts(df: DataFrame, keys: dict[str, str], text_col: str, fn: Callable[[pa.Array], Sequence], fields: str, out: Sequence[pa.Field]) -> DataFrame:
    """``keys`` (output name: column) of each row with what ``fn`` makes of its text.

    Only these columns are read. ``fn`` gets a batch of texts (nulls stay null)
    and returns one array or list per field of ``out``; ``fields`` is the same
    as DDL. Rows stay rows: repeats and null keys are kept, no rows give none.
    """
    bounded_batches(df.sparkSession)
    n = len(keys)
    picked = df.select(*(df[f"`{c}`"].alias(k) for k, c in keys.items()), df[f"`{text_col}`"].cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            made = fn(batch.column(n))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], schema=pa.schema([*(batch.schema.field(i) for i in range(n)), *out]))

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n]), fields])
    return picked.mapInArrow(run, ddl)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    Where the setting is empty (a local session in a test) it is set to a
    temporary folder once.
    """
    bounded_batches(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            top = made.get()
        else:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            top = "file://" + tempfile.mkdtemp(prefix="quillmill-")
            spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quillmill-{uuid.uuid4().hex}"


#: While a table is stored: a query's shuffle files go when it ends, not when the driver next collects its garbage.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Bytes of rows that Python gets at a time, where the session has Spark's own default of 64 MB: that much is held several times over.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Rows that the JVM reads at a time, where the session has Spark's own default of 4,096: whole texts of so many are one array of many MB, grown by doubling.
READ_ROWS = 512
_READ, _READ_DEFAULT = "spark.sql.parquet.columnarReaderBatchSize", "4096"

#: Bytes of an Arrow batch that Python gives out, about: the JVM takes buffers for a whole one, rounded up to a power of two, and keeps them.
PART_BYTES = 1 << 20


def in_parts(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch's rows, ``most`` (``PART_BYTES``) bytes of its binary columns at a time; a larger row stands alone."""
    if not len(batch):
        return
    sizes = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in batch.columns if pa.types.is_binary(c.type)]
    total, i = np.concatenate([[0], np.cumsum(np.sum(sizes, axis=0, dtype=np.int64))]), 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(total, total[i] + (most or PART_BYTES), "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


#: Arrays of so many bytes go back to the system as soon as they are freed; glibc would raise its bound to 32 MB by and by.
_MAPPED = 4 << 20


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``, in a worker that gives back what a task took.

    Workers are kept for further tasks. Without this an idle one holds as much
    as its largest task took, beside whatever the JVM takes then.
    """

    def run(batches):
        malloc("mallopt", -3, _MAPPED)  # M_MMAP_THRESHOLD
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            malloc("malloc_trim", 0)

    return run


def malloc(name: str, *args: int) -> None:
    """Calls a function of glibc's allocator, where there is one."""
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):
        pass


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded by bytes, and few rows are read at a time, unless it set bounds of its own."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if spark.conf.get(_READ, _READ_DEFAULT) == _READ_DEFAULT:
        spark.conf.set(_READ, str(READ_ROWS))


def stored(df: DataFrame, folder: str, name: str, row_group: int | None = None) -> DataFrame:
    """``df`` written once below ``folder`` and read again: later uses neither recompute it nor depend on executors.

    What was shuffled for it is freed at once. ``row_group`` bounds the bytes of
    rows that are read at a time, where rows are large.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}"
    before = {k: spark.conf.get(k, None) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        writer = df.write.mode("overwrite")
        (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _with_session(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def _with_session(spark: SparkSession, folder: str) -> None:
    """The folder goes when the session's JVM ends, if it is still there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def finished(df: DataFrame, folder: str) -> DataFrame:
    """``df``, made from tables below ``folder``, stored beside it; the folder goes."""
    out = stored(df, f"{folder}-result", "rows")
    drop_folder(df.sparkSession, folder)
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
