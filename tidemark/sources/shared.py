"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set if the
    master is local, as in tests; on a cluster, whose executors wouldn't see it, that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame, root: str | None = None, name: str = "bars") -> DataFrame:
    """df as a table, read again: several branches of a plan read it then, and nothing stays in memory."""
    path = f"{root or shared_root(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
