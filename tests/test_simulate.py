from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import simulate as S
from ionweave.operators import windows as W


def test_profile_borders_hold_the_target():
    lo, hi = S.emg_support(100.0, 2.0, 0.4, 0.9, 0.05)
    assert S.emg_mass(0.0, hi, 100.0, 2.0, 0.4, 20_000) == pytest.approx(0.9, abs=0.02) and S.emg_mass(lo, hi, 100.0, 2.0, 0.4, 20_000) == pytest.approx(0.9, abs=0.02)


def test_occurrence_and_abundance(spark):
    frames = spark.createDataFrame([(i + 1, 0.5 * i) for i in range(200)], "frame_id int, time double")
    peptides = spark.createDataFrame([(1, 40.0, 2.0, 0.5), (2, 60.0, 1.0, 1.0)], "peptide_id int, mu double, sigma double, lam double")
    occ = {r["peptide_id"]: r for r in S.frame_occurrence(peptides, frames, 0.95, 0.1, 400).collect()}
    for k, mu, s, lam in ((1, 40.0, 2.0, 0.5), (2, 60.0, 1.0, 1.0)):
        lo, hi = S.emg_support(mu, s, lam, 0.95, 0.1, 400)
        t = 0.5 * np.arange(200)
        assert (occ[k]["first"], occ[k]["last"]) == (np.abs(t - lo).argmin() + 1, np.abs(t - hi).argmin() + 1)
    total = {r["peptide_id"]: r["t"] for r in S.frame_abundance(S.frame_occurrence(peptides, frames, 0.95, 0.1, 400), frames, 0.5, 200).groupBy("peptide_id").agg(F.sum("abundance").alias("t")).collect()}
    assert all(0.85 < v < 1.0 for v in total.values())
    events = spark.createDataFrame([(1, 39.0, 40.0), (2, 40.0, 40.0), (3, 300.0, 301.0)], "event int, start double, end double")
    got = {(r["peptide_id"], r["event"]): r["abundance"] for r in S.event_abundance(peptides, events, 0.95, 0.1, 400).collect()}
    assert set(got) == {(1, 1)} and got[1, 1] == pytest.approx(S.emg_mass(39.0, 40.0, 40.0, 2.0, 0.5, 400), rel=1e-9)


def test_mode(spark):
    mu = spark.range(1).select(S.mu_of_mode(F.lit(100.0), F.lit(2.0), F.lit(0.5)).alias("m")).first()["m"]
    x = np.arange(95, 105, 0.001)
    y = [S.emg_mass(v, v + 1e-6, mu, 2.0, 0.5, 1) for v in x]
    assert x[int(np.argmax(y))] == pytest.approx(100.0, abs=0.02)


def test_sampling(spark):
    p = spark.createDataFrame([(i % 7, i) for i in range(700)] + [(99, 10_000)], "protein_id int, peptide_id int")
    got = S.sample_peptides(p, 100, 3)
    rows = [tuple(r) for r in got.collect()]
    assert len(set(rows)) == len(rows) and 90 <= len(rows) <= 100 and sorted(rows) == sorted(tuple(r) for r in S.sample_peptides(p.repartition(5), 100, 3).collect())
    assert S.sample_peptides(p.limit(0), 10).count() == 0
    n = S.numbered(p, "peptide_id").agg(F.count_distinct("number").alias("n"), F.max("number").alias("m")).first()
    assert tuple(n) == (701, 700)


def test_noise_and_efficiency(spark):
    df = spark.createDataFrame([(i, float(i % 50)) for i in range(2000)] + [(5000, None)], "row_id int, events double")
    x = S.with_noise(df, "events", 5.0, 1, "row_id").agg(F.min("events"), F.max("events"), F.count("events")).first()
    assert 0 <= x[0] and x[1] <= 49.0 and x[2] == 2000
    e = df.select(S.log_normal_efficiency(keys=["row_id"]).alias("e")).agg(F.min("e"), F.max("e"), F.avg(F.log10("e"))).first()
    assert 1e-4 <= e[0] and e[1] <= 1.0 and e[2] == pytest.approx(-2.0, abs=0.05)
    peaks = spark.createDataFrame([(1, 5, 7, 100.0, 2.0), (1, 5, 7, 100.0, 2.0), (3, 9, 9, 50.0, 1.0)], "frame_id int, scan int, tof int, mz double, intensity double")
    t = spark.createDataFrame([(10, 1), (11, 2)], "frame_id int, window_group int")
    src = spark.createDataFrame([(1, 1), (2, 1), (4, 2)], "source_id int, window_group int")  # 2 and 4 are empty
    got = [tuple(r) for r in S.sample_noise(t, src, peaks, 3, 1.1, by="window_group").collect()]
    assert got == [(10, 5, 100_000_000, 12.0)]


def test_stable_key(spark):
    def key(*parts):
        out = b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)
        return hashlib.sha256(out).hexdigest()[:32]

    rows = [("a|b", "c"), ("a", "b|c"), ("", "é"), ("x" * 300, "1")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.stable_key(F.col("a"), F.col("b")).alias("k"))
    assert [r["k"] for r in df.collect()] == [key(*r) for r in rows]


def test_ordered_statistics_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate((rng.normal(0, 1e6, 3000).round(1), np.full(1500, 7.0)))
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "k int, v double")
    q = {r["k"]: (r["v0"], r["v1"]) for r in W.exact_quantiles(df, F.col("v"), (0.5, 0.9), "k").collect()}
    for k in (0, 1):
        assert q[k] == pytest.approx(tuple(np.quantile(v[k::2], (0.5, 0.9))))
    c = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    got = [r["s"] for r in W.running(c, "v", {"s": ("sum", "c"), "m": ("min", "c")}, descending=True).orderBy(F.desc("v")).collect()]
    _, n = np.unique(v, return_counts=True)
    assert got == np.cumsum(n[::-1]).tolist()
    s = W.gap_sessions(df.where("k = 0").select("v"), "v", 800.0, [], block=5000.0).groupBy("session").agg(F.count(F.lit(1)).alias("n")).orderBy("session").collect()
    x = np.sort(v[0::2])
    cuts = np.flatnonzero(np.diff(x) > 800.0) + 1
    assert [r["n"] for r in s] == [len(p) for p in np.split(x, cuts)]
    nb = {r["t"]: (r["before"], r["after"]) for r in W.neighbours(spark.createDataFrame([(float(t),) for t in (1, 2, 9, 40, 41)], "t double"), "t", F.floor(F.col("t") / 8)).collect()}
    assert nb == {1.0: (None, 2.0), 2.0: (1.0, 9.0), 9.0: (2.0, 40.0), 40.0: (9.0, 41.0), 41.0: (40.0, None)}
    assert W.exact_quantiles(df.limit(0), F.col("v"), (0.5,), "k").count() == 0


def test_pasef_draws_are_the_first_by_hash(spark):
    """The border on hashes changes no draw: neither with plenty of windows, nor where too few lie below it, nor where fewer exist than asked for."""
    targets = spark.createDataFrame([(i, 40 * (i % 3)) for i in range(30)], "frame_id int, scan_center int")
    windows = spark.createDataFrame([(i, i % 4, i % 50, i % 50 + 6) for i in range(600)] + [(1000, 1, 78, 84)], "window_id long, source_id int, scan_begin int, scan_end int")
    peaks = spark.createDataFrame([(f, s, 10 * f + s, 100.0 + s, 1.0) for f in range(4) for s in range(90)], "frame_id int, scan int, tof int, mz double, intensity double")
    pairs = targets.crossJoin(windows).where("abs((scan_begin + scan_end) / 2 - scan_center) <= 5").withColumn("h", F.xxhash64("frame_id", "window_id", F.lit(0)))
    by = {}
    for r in pairs.collect():
        by.setdefault(r["frame_id"], []).append((r["h"], r["window_id"], r["source_id"], r["scan_begin"], r["scan_end"]))
    want = {}
    for f, near in by.items():
        for _, _, _, a, b in sorted(near)[:2]:
            for s in range(a, b + 1):
                want[f, s] = want.get((f, s), 0) + 1.0
    assert {len(v) for v in by.values()} >= {1} and max(map(len, by.values())) > 60
    for spare in (64, -15, 0):  # -15: a border that one window in a target reaches on average
        rows = S.sample_pasef_noise(targets, windows, peaks, 2, 1.1, 5, spare=spare).collect()
        assert len(rows) == len(want) and {(r["frame_id"], r["scan"]): r["intensity"] for r in rows} == want
