"""A script over a stream of files: stateless, so each micro-batch is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import run
from ..plans.compiler import Plan, changes


def changes_stream(files: DataFrame, plan: Plan) -> DataFrame:
    """``changes`` of a streaming ``files(path, text)``; nothing is kept between batches."""
    if not files.isStreaming:
        raise ValueError("files is no stream")
    return changes(files, plan)


def to_tables(files: DataFrame, plan: Plan, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes changed files to ``out/changes`` and a summary a batch to ``out/summary``.

    A batch that is run again after a failure replaces its own folders, so each is there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        ch = changes(batch, plan).persist()
        try:
            ch.filter("changed").write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
            run.summary(ch).write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
        finally:
            ch.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
