"""Detection on a stream gives the batch's candidates, repeated files or not."""

import datetime

from tidemark.operators import detect
from tidemark.params import Params
from tidemark.sources.bars import SNAPSHOT
from tidemark.streaming.detect import candidates_stream, snapshot_stream, write_candidates

DAY = datetime.date(2024, 3, 1)


def test_stream(spark, tmp_path):
    rows = [(DAY, "america", f"NYSE:S{i}", 10.0, float(i), 1.0, 2e5, None, None, None) for i in range(30)]
    snaps = spark.createDataFrame(rows, f"bar_date date, {SNAPSHOT}")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    p = Params()
    for _ in range(2):  # the same snapshot arrives twice
        snaps.write.mode("append").parquet(source)
        query = write_candidates(candidates_stream(snapshot_stream(spark, source), p), out, str(tmp_path / "state"))
        query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(map(str, got.collect())) == sorted(map(str, detect.detect_history(snaps, p).collect())) and got.count() == 29
