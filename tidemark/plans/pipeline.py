"""detect -> collect -> analyze, stage by stage or in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import analyze, detect, lags
from tidemark.operators.history import event_keys
from tidemark.params import Params
from tidemark.sources import bars as bar_source
from tidemark.sources import tables, versions
from tidemark.sources.shared import shared_root, stored  # noqa: F401


def events_of_bars(bars: DataFrame, p: Params) -> DataFrame:
    """Candidates of every day of a table of bars."""
    return detect.detect_history(bar_source.snapshots(bars), p)


def raw_of_bars(bars: DataFrame, p: Params) -> DataFrame:
    """Raw data for every event of a table of bars, which two branches read."""
    return lags.collect(events_of_bars(bars, p), bars, p)


def detect_stage(bars: DataFrame, root: str, p: Params, fresh: bool = True) -> bool:
    """Writes the candidates of all bars; not ``fresh``, those of days and symbols that the table lacks are added
    to it. Whether rows were written."""
    found = events_of_bars(bars, p)
    if fresh:
        return tables.write_candidates(found, root)
    known = tables.read_candidates(bars.sparkSession, root).select("Date", "Symbol").distinct()
    new = stored(found.join(known, ["Date", "Symbol"], "left_anti").select(found.columns), shared_root(bars.sparkSession), "new_candidates")
    if new.isEmpty():
        return False
    tables.append_table(new, root, "candidates")
    return True


def collect_stage(spark: SparkSession, bars: DataFrame, root: str, p: Params, memo: bool = False) -> int | None:
    """Writes the raw data of the candidates that are there. With ``memo`` samples of earlier runs
    below root are taken where their slices haven't changed, and the number of events computed is returned."""
    candidates = tables.read_candidates(spark, root)
    if not memo:
        tables.write_raw_data(lags.collect(candidates, bars, p), root)
        return None
    sampled, computed = lags.remembered_samples(event_keys(candidates), bars, p, root)
    tables.write_raw_data(lags.raw_rows(candidates, sampled), root)
    return computed


def analyze_stage(spark: SparkSession, root: str, p: Params) -> bool:
    """Comparison, statistics and report of the raw data that is there; False, and nothing written, without any."""
    raw = versions.read(spark, root, "raw_data", choose=lambda v: v.get("lag") in {f"T-{k}" for k in p.lags} or "lag" not in v)
    if raw is None:
        return False
    tables.write_analysis(analyze.compare(raw), root)
    tables.write_stats(analyze.statistics(raw, p.lags), root)
    tables.write_report(analyze.report_order(tables.read_table(spark, root, "analysis", tables.ANALYSIS)), tables.read_table(spark, root, "stats", tables.STATS), root)
    return True


def run(spark: SparkSession, bars: DataFrame, root: str, p: Params) -> None:
    """All stages, each from the table the last one wrote, and the report."""
    bars = stored(bars, root)
    detect_stage(bars, root, p)
    collect_stage(spark, bars, root, p)
    analyze_stage(spark, root, p)
