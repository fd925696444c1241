"""Where changes go: files in place, a table of pre-images, and back."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError


def _put(path: str, text: str) -> None:
    """Writes a file beside the old one and moves it there, so that a lost task leaves no half file."""
    folder = os.path.dirname(path) or "."
    try:
        fd, tmp = tempfile.mkstemp(prefix=".quillmill-", dir=folder)
        with os.fdopen(fd, "wb") as f:
            f.write(text.encode())
        if os.path.exists(path):
            os.chmod(tmp, os.stat(path).st_mode & 0o7777)
        os.replace(tmp, path)
    except OSError as e:
        raise SourceError(f"{path}: {e}") from e


def _writer():
    base = os.getcwd()  # workers keep the folder that they were started in

    def write(rows) -> None:
        for r in rows:
            _put(os.path.join(base, r["path"]), r["text"])

    return write


def write_files(changes: DataFrame, column: str = "after") -> None:
    """Changed files written in place by the executors; the same text again if a task is repeated.

    ``changes`` must be stored (see :func:`.tables.kept`): what is made from the files can't be made again once they are written.
    """
    changes.filter("changed").select("path", F.col(column).alias("text")).foreachPartition(_writer())


def backup(changes: DataFrame, table: str) -> None:
    """Appends the pre-images of changed files to the table at ``table``, by absolute path; a path's first one stays."""
    spark = changes.sparkSession
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(os.getcwd() + "/"), F.regexp_replace("path", r"^(?:\./)+", "")))
    new = changes.filter("changed").select(path.alias("path"), F.col("before").alias("text")).dropDuplicates(["path"])
    try:
        new = new.join(spark.read.parquet(table).select("path"), "path", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").parquet(table)


def undo(spark: SparkSession, table: str) -> int:
    """Writes every pre-image back, from whatever folder; returns how many."""
    old = spark.read.parquet(table)
    old.select("path", "text").foreachPartition(_writer())
    return old.count()
