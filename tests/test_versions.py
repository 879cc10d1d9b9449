"""Versioned tables, retention, the catalog, the memo and all correlations."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extensions, lags
from tidemark.params import Params
from tidemark.plans import pipeline
from tidemark.sources import tables, versions
from tidemark.sources.bars import BARS

RAW = "Symbol string, Event_Date date, Time_Lag string, close double"


def raw(spark, rows):
    return spark.createDataFrame([(s, datetime.date.fromisoformat(d) if d else None, k, c) for s, d, k, c in rows], RAW)


ROWS = [("A", "2024-01-31", "T-1", 1.0), ("A", "2024-02-01", "T-1", 2.0), ("A", "2024-02-20", "T-3", 3.0), ("B", "2024-03-05", "T-1", 4.0), ("C", None, "T-1", 5.0)]


def got(spark, root, **how):
    return sorted(r["close"] for r in versions.read(spark, root, "raw_data", **how).collect())


def test_a_write_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,), (2,)], "x int")
    versions.write(df, root, "t")
    boom = df.select(F.when(F.col("x") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        versions.write(boom, root, "t")
    assert versions.read(spark, root, "t").count() == 2 and versions.numbers(spark, root, "t") == [1]
    # and one that dies between its data and its commit
    monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        versions.write(df.limit(0), root, "t")
    monkeypatch.undo()
    assert versions.read(spark, root, "t").count() == 2
    gone = versions.collect(spark, root, "t")
    assert 1 <= len(gone) <= 2 and versions.read(spark, root, "t").count() == 2


def test_a_part_gets_a_file_and_not_one_of_each_task(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(400).select(F.concat(F.lit("S"), F.col("id")).alias("Symbol"), F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("Event_Date"), F.lit("T-1").alias("Time_Lag"), F.col("id").cast("double").alias("close"))
    tables.write_raw_data(rows.repartition(8), root)
    assert len(list(tmp_path.glob("raw_data/data-*/*/*/*.parquet"))) == 3 and got(spark, root) == [float(i) for i in range(400)]


def test_two_writers_and_old_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,), (2,)], "x int")
    made = versions.write(df, root, "t")
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, "t", made)
    versions.write(df, root, "t", keep=lambda v, new: True)
    versions.write(df.limit(1), root, "t")
    assert [versions.read(spark, root, "t", number=n).count() for n in (1, 2, 3)] == [2, 4, 1]
    assert versions.read(spark, root, "t", number=9) is None and versions.read(spark, root, "none") is None
    assert len(versions.collect(spark, root, "t", keep=1)) == 2 and versions.numbers(spark, root, "t") == [3]
    assert versions.read(spark, root, "t").count() == 1
    with pytest.raises(ValueError, match="x"):
        versions.read(spark, root, "t", spark.createDataFrame([], "x string").schema)


def test_lags_are_replaced_and_old_months_dropped(spark, tmp_path):
    root = str(tmp_path)
    tables.write_raw_data(raw(spark, ROWS), root)
    schema = raw(spark, []).schema
    assert sorted(r["close"] for r in tables.read_raw_data(spark, root, schema, (3,)).collect()) == [3.0]
    tables.write_raw_data(raw(spark, [("D", "2024-02-02", "T-3", 9.0)]), root)
    assert got(spark, root) == [1.0, 2.0, 4.0, 5.0, 9.0]
    before = dict(versions.version(spark, root, "raw_data").parts)
    tables.retain_raw_data(spark, root, datetime.date(2024, 3, 1), 28)  # from February 2 on
    assert got(spark, root) == [4.0, 5.0, 9.0]
    after = dict(versions.version(spark, root, "raw_data").parts)
    assert {v["month"] for p, v in after.items() if p in before} == {"2024-03", None}  # as they were
    assert got(spark, root, number=2) == [1.0, 2.0, 4.0, 5.0, 9.0]
    tables.retain_raw_data(spark, root, datetime.date(2023, 3, 1), 28)
    assert got(spark, root) == [4.0, 5.0, 9.0]
    tables.write_raw_data(raw(spark, []), root)
    assert got(spark, root) == [4.0, 5.0, 9.0]
    tables.retain_raw_data(spark, f"{root}/none", datetime.date(2023, 3, 1), 28)


def test_catalog(spark, tmp_path):
    root = str(tmp_path)
    tables.write_raw_data(raw(spark, ROWS), root)
    tables.write_stats(spark.createDataFrame([("n", 1.0)], tables.STATS), root)
    tables.register_tables(spark, root, "some_run")
    assert tables.list_tables(spark, "some_run") == ["raw_data", "stats"]
    found = spark.table("some_run.raw_data")
    assert sorted(r["close"] for r in found.where("by_lag = 'T-1' and by_month = '2024-02'").collect()) == [2.0] and found.count() == 5
    tables.write_stats(spark.createDataFrame([("n", 2.0)], tables.STATS), root)
    tables.register_tables(spark, root, "some_run")
    assert spark.table("some_run.stats").first()["Value"] == 2.0
    spark.sql("DROP DATABASE some_run CASCADE")
    assert versions.read(spark, root, "stats").count() == 1  # the tables were external


def test_memo(spark, tmp_path):
    root, day = str(tmp_path), datetime.date(2024, 6, 3)
    series = lambda s, n, bump=0.0: [(s, day - datetime.timedelta(days=i + 1), 1.0, 2.0, 0.5, 1.0 + i + (bump if i == 5 else 0), 10.0) for i in range(n)]
    events = spark.createDataFrame([("A", day), ("B", day), ("short", day), ("no bars", day)], "symbol string, event_date date")
    bars = lambda *rows: spark.createDataFrame([x for r in rows for x in r], BARS)
    p = Params(lags=(1, 5))
    first, n = lags.remembered_samples(events, bars(series("A", 60), series("B", 60), series("short", 10)), p, root)
    assert n == 3 and sorted((r["symbol"], r["lag"]) for r in first.collect()) == [("A", 1), ("A", 5), ("B", 1), ("B", 5)]
    later = bars(series("A", 60), series("B", 60, 7.0), series("short", 10))
    second, n = lags.remembered_samples(events, later, p, root)
    want = lags.samples(lags.with_history(lags.slices(events, later, 90), 50), later, p)
    assert n == 1 and second.select(*[f"`{c}`" for c in want.columns]).exceptAll(want).count() == 0 and second.count() == 4
    assert lags.remembered_samples(events, later, p, root)[1] == 0
    assert lags.remembered_samples(events, later, Params(lags=(1,)), root)[1] == 3  # other lags are other samples
    none, n = lags.remembered_samples(events.limit(0), later, p, f"{root}/none")
    assert n == 0 and none.count() == 0


def test_correlations_of_all_pairs(spark):
    rows = [("T-1", 1.0, 2.0, None, 5.0, 1), ("T-1", 2.0, 1.0, 1.0, 5.0, 0), ("T-1", 4.0, None, 3.0, 5.0, 1), ("T-1", 3.0, 7.0, 2.0, 5.0, 1), ("T-3", 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "Time_Lag string, a double, `b.x` double, c double, flat double, f int")
    found = {(r["Indicator_A"], r["Indicator_B"]): r["Correlation"] for r in extensions.correlations(df).collect()}
    assert found.keys() == {("a", "b.x"), ("a", "c"), ("b.x", "c"), ("a", "f"), ("b.x", "f"), ("c", "f")}
    assert math.isclose(found["a", "c"], 1.0) and math.isclose(found["b.x", "c"], 1.0)
    xs, ys = (1.0, 2.0, 3.0), (2.0, 1.0, 7.0)
    mx, my = sum(xs) / 3, sum(ys) / 3
    r = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    assert math.isclose(found["a", "b.x"], r)


def test_stages_alone(spark, tmp_path):
    """Detection adds only what its table lacks, and analysis without raw data writes nothing."""
    root, day = str(tmp_path), datetime.date(2001, 1, 1)
    made = [(s, day + datetime.timedelta(days=i), 1.0, 1.0, 1.0, 1.0 + i * k, 1e6) for s, k in (("A", 1.0), ("B", 0.01)) for i in range(9)]
    bars, p = spark.createDataFrame(made, BARS), Params(min_bars=2, lags=(1, 3))
    early = bars.where("bar_date < DATE '2001-01-05'")
    assert not pipeline.analyze_stage(spark, root, p) and not pipeline.detect_stage(bars.limit(0), root, p, fresh=False)
    counts = [(pipeline.detect_stage(b, root, p, fresh=False), tables.read_candidates(spark, root).count()) for b in (early, early, bars, bars)]
    assert counts == [(True, 6), (False, 6), (True, 16), (False, 16)]
    assert pipeline.events_of_bars(bars, p).exceptAll(tables.read_candidates(spark, root)).count() == 0
