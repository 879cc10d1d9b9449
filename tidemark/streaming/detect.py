"""Detection on a stream of snapshot files.

Filters and classification look at one row, so they run on a stream as they are;
the top-k of a whole snapshot doesn't, and is left out. A snapshot delivered
twice is told apart by day and symbol, which a watermark lets the state forget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import finite_columns
from tidemark.operators import detect
from tidemark.params import Params
from tidemark.sources.bars import SNAPSHOT


def snapshot_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(f"bar_date date, {SNAPSHOT}").parquet(folder)


def candidates_stream(snapshots: DataFrame, p: Params, late: str = "7 days") -> DataFrame:
    """Candidates of a stream of snapshots with a bar_date, each day and symbol once."""
    timed = finite_columns(snapshots).withColumn("_time", F.col("bar_date").cast("timestamp"))
    once = timed.withWatermark("_time", late).dropDuplicatesWithinWatermark(["_time", "symbol"]).drop("_time")
    return detect.classify(detect.universe(detect.by_exchange(detect.screener(once, p), p.exchanges), p), p, F.col("bar_date"))


def write_candidates(stream: DataFrame, path: str, checkpoint: str):
    """Append candidates to a Parquet table until all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
