"""Stage tables: typed, versioned tables below one folder, and reports.

A missing table reads as an empty one. Candidates and statistics without rows
leave the table before them as it is; raw data replaces the lags it brings and
leaves the others. Every write is a new version, whole or not at all.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import versions

CANDIDATES = "Date date, Symbol string, Exchange string, Event_Type string, Price double, `Change_%` double, Volume double"
ANALYSIS = "Time_Lag string, Indicator string, AVG_Spikers double, AVG_Grinders double, Difference double, Ratio double"
STATS = "Metric string, Value double"


def read_table(spark: SparkSession, root: str, name: str, schema: str | StructType) -> DataFrame:
    """ValueError if the table has other columns or types."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = versions.read(spark, root, name, schema)
    return spark.createDataFrame([], schema) if found is None else found


def read_candidates(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "candidates", CANDIDATES)


def read_raw_data(spark: SparkSession, root: str, schema: StructType, lags: tuple[int, ...] | None = None) -> DataFrame:
    """All lags, or those asked for: only their parts are read."""
    wanted = None if lags is None else {f"T-{k}" for k in lags}
    found = versions.read(spark, root, "raw_data", schema, None if wanted is None else lambda v: v.get("lag") in wanted or "lag" not in v)
    return spark.createDataFrame([], schema) if found is None else found


def write_table(df: DataFrame, root: str, name: str) -> None:
    """In place of all that is there."""
    versions.write(df, root, name)


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Rows beside those that are there."""
    versions.write(df, root, name, keep=lambda v, _: True)


def write_unless_empty(df: DataFrame, root: str, name: str) -> bool:
    """Whether df had rows and was written."""
    if df.isEmpty():
        return False
    write_table(df, root, name)
    return True


def write_candidates(df: DataFrame, root: str) -> bool:
    return write_unless_empty(df, root, "candidates")


def write_stats(df: DataFrame, root: str) -> bool:
    return write_unless_empty(df, root, "stats")


def write_analysis(df: DataFrame, root: str) -> None:
    write_table(df, root, "analysis")


def raw_parts(raw: DataFrame) -> dict:
    """Raw data is parted by lag, and by the month of the event where it has one."""
    months = {"month": F.date_format("Event_Date", "yyyy-MM")} if "Event_Date" in raw.columns else {}
    return months | {"lag": F.col("Time_Lag")}


def write_raw_data(df: DataFrame, root: str) -> None:
    """Replaces only the lags in df; without a column Time_Lag the whole table."""
    if "Time_Lag" not in df.columns:
        write_table(df, root, "raw_data")
        return
    versions.write(df, root, "raw_data", raw_parts(df), lambda v, new: v.get("lag") not in {x["lag"] for x in new})


def retain_raw_data(spark: SparkSession, root: str, as_of: datetime.date, days: int) -> None:
    """Drops events older than so many days: months before the border's go as a whole, the border's is written again."""
    oldest = as_of - datetime.timedelta(days=days)
    month = f"{oldest:%Y-%m}"
    younger = lambda df: df.where(F.col("Event_Date") >= F.lit(oldest))
    by = {"month": F.date_format("Event_Date", "yyyy-MM"), "lag": F.col("Time_Lag")}
    versions.replace(spark, root, "raw_data", lambda v: (v.get("month") or month) < month, lambda v: v.get("month") == month, younger, by)


def write_report(analysis: DataFrame, stats: DataFrame, root: str) -> None:
    """Two CSV tables in the order of their rows."""
    analysis.write.mode("overwrite").option("header", True).csv(f"{root}/summary_comparison")
    stats.write.mode("overwrite").option("header", True).csv(f"{root}/statistics")


def write_backup(raw: DataFrame, root: str) -> None:
    """Raw data once more, as CSV."""
    raw.write.mode("overwrite").option("header", True).csv(f"{root}/raw_data_csv")


def read_report(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    read = lambda schema, name: spark.read.schema(schema).option("header", True).csv(f"{root}/{name}")
    return read(ANALYSIS, "summary_comparison"), read(STATS, "statistics")


#: The tables of a run.
STAGES = ("candidates", "raw_data", "analysis", "stats")


def register_tables(spark: SparkSession, root: str, database: str) -> None:
    """The tables of a run that are there, as external tables of a database of the catalog."""
    for name in STAGES:
        if versions.version(spark, root, name):
            versions.register(spark, database, root, name)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables in the catalog."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
