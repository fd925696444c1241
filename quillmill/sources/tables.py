"""Tables that a run keeps while it overwrites what they were made from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session without it, a folder of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(top)
    return top


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    A lost executor then costs nothing that can't be read once more, whatever
    became of the files that ``df`` came from. The table goes with the session.
    """
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/quillmill-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
