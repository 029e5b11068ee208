from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ionweave.streaming import windows as S


@pytest.fixture
def events(spark, tmp_path):
    t0 = datetime(2031, 1, 1)
    rows = [(i % 3, t0 + timedelta(minutes=17 * i + (90 if i > 20 else 0)), float(i)) for i in range(40)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "k int, ts timestamp, intensity double").repartition(3).write.parquet(path)
    return spark.read.parquet(path), path


def stream(spark, path):
    return spark.readStream.schema("k int, ts timestamp, intensity double").option("maxFilesPerTrigger", 1).parquet(path)


def test_tumbling_equals_batch(spark, events):
    df, path = events
    got = S.run_available(S.tumbling(stream(spark, path), "1 hour", "3650 days", "k"), "complete")
    want = df.groupBy(F.window("ts", "1 hour"), "k").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("i"))
    assert sorted((r["k"], r["start"], r["n"], r["intensity"]) for r in got.collect()) == sorted((r["k"], r["window"]["start"], r["n"], r["i"]) for r in want.collect())


def test_sessions_equal_batch(spark, events):
    df, path = events
    got = S.run_available(S.sessions(stream(spark, path), "1 hour", "3650 days", "k"), "complete")
    want = df.groupBy(F.session_window("ts", "1 hour"), "k").count()
    assert sorted((r["k"], r["start"], r["n"]) for r in got.collect()) == sorted((r["k"], r["session_window"]["start"], r["count"]) for r in want.collect())


def test_exclusion(spark, tmp_path):
    t0 = datetime(2031, 1, 1)
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([(1, t0 + timedelta(seconds=s), 1.0) for s in (0, 5, 10, 14, 20, 31)] + [(2, t0, 1.0)], "k int, ts timestamp, intensity double").coalesce(1).write.parquet(path)
    got = S.run_available(S.exclude_repeats(stream(spark, path), "k", 10.0))
    assert sorted((r["k"], (r["ts"] - t0).seconds) for r in got.collect()) == [(1, 0), (1, 10), (1, 20), (1, 31), (2, 0)]
