from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import clusters as C

IM = "im_id long, ms_type int, frame_lo int, frame_hi int, scan int, scan_lo int, scan_hi int, scan_sigma double, tof_lo int, tof_hi int"


def run_of(spark, n_frames=30):
    """One mobility peak with two humps in time at places 8 and 20, about scan 50, tof 100."""
    frames = spark.createDataFrame([(10 + 2 * i, 5.0 + i, 0, "clash") for i in range(n_frames)], "frame_id int, time double, ms_type int, im_id string")
    rows = []
    for i in range(n_frames):
        h = 100 * math.exp(-0.5 * ((i - 8) / 1.5) ** 2) + 60 * math.exp(-0.5 * ((i - 20) / 1.5) ** 2)
        if h > 1:
            rows += [(10 + 2 * i, 50 + d, 100 + d, h * w, 1) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))]
    rows += [(26, 400, 100, 9999.0, 1), (27, 50, 100, 9999.0, 1), (26, 50, 5000, 9999.0, 1)]  # another scan, no frame of the run, another tof
    peaks = spark.createDataFrame(rows, "frame_id int, scan int, tof int, intensity double, lo int")
    im = spark.createDataFrame([(1, 0, 14, 60, 50, 48, 52, None, 90, 110), (2, 0, 14, 61, 50, 48, 52, None, 90, 110), (3, 0, 14, 60, 300, 290, 310, 2.0, 90, 110)], IM)
    return peaks, im, frames


def test_traces_and_peaks(spark):
    peaks, im, frames = run_of(spark)
    traces = C.rt_traces(peaks, im, frames, "ms_type", pad=1)
    got = traces.collect()
    assert [(r["im_id"], r["lo"], len(r["trace"])) for r in got] == [(1, 1, 26)]  # 2: a border frame is missing; 3: no signal
    assert got[0]["trace"][7] == pytest.approx(100.0, rel=1e-3) and got[0]["times"][7] == 13.0
    rt = sorted((r["place"], r["fallback"]) for r in C.rt_peaks(traces, smooth_s=1.0, min_distance_s=3.0).collect())
    assert rt == [(8, False), (20, False)]
    one = C.rt_peaks(traces, min_prominence=1e9).collect()
    assert len(one) == 1 and one[0]["fallback"] and one[0]["frame_lo"] <= 8 <= one[0]["frame_hi"]


def test_fallback_and_area(spark):
    df = spark.createDataFrame([([0.0, 5.0, 10.0, 5.0, 0.0],), ([3.0],), ([0.0, 0.0],), ([],), (None,)], "y array<double>")
    got = [r["p"] for r in df.select(C.fallback_peak(F.col("y"), 0.5).alias("p")).collect()]
    assert (got[0]["apex"], got[0]["mu"], got[0]["left"], got[0]["right"]) == (2, 2.0, 1.0, 3.0) and got[0]["area"] == pytest.approx(15.0)
    assert (got[1]["apex"], got[1]["left"], got[1]["right"], got[1]["area"]) == (0, 0.0, 0.0, 0.0) and got[2:] == [None, None, None]


def test_boxes(spark):
    im = spark.createDataFrame([(1, 0, 0, 0, 50, 48, 52, None, 90, 110), (2, 0, 0, 0, 3, 0, 6, 4.0, 0, 10**9), (3, 0, 0, 0, 50, 30, 90, None, 5, 1)], IM)
    rt = spark.createDataFrame([(1, 4, 6), (2, 9, 2), (3, 0, 50)], "im_id long, frame_lo int, frame_hi int")
    got = {r["im_id"]: tuple(r)[1:] for r in C.boxes(im, rt, F.lit(20), F.lit(1000), rt_pad=1).collect()}
    assert got == {1: (3, 7, 45, 54, 90, 110), 2: (1, 10, 0, 15, 0, 999), 3: (0, 19, 30, 90, 1, 5)}


def test_whole_run(spark):
    peaks, im, frames = run_of(spark)
    got = sorted((r["mu_place"], r["mu_scan"], r["mu_tof"], r["mz_mu"]) for r in C.run(peaks, im, frames, "ms_type", smooth_s=1.0, min_distance_s=3.0, mz_of=lambda t: t / 10.0).collect())
    assert [round(g[0]) for g in got] == [8, 20] and all(abs(g[1] - 50) < 0.1 and abs(g[2] - 100) < 0.1 and abs(g[3] - 10) < 0.1 for g in got)


def test_scores(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(9).tolist(), rng.random(12).tolist()
    df = spark.createDataFrame([(1, a, b, None, None), (2, a, a, a, b), (3, None, None, None, None), (4, [1.0, 2.0], b, [1.0] * 5, b)], "i int, p array<double>, q array<double>, r array<double>, s array<double>")
    got = {r["i"]: r["x"] for r in df.select("i", C.xic_score(F.col("p"), F.col("q"), F.col("r"), F.col("s"), F.when(F.col("i") != 3, F.lit(2.0)), F.when(F.col("i") != 3, F.lit(2.0))).alias("x")).collect()}
    r = np.corrcoef(a, b[:9])[0, 1]
    ratio = math.exp(-abs(math.log(sum(b) / sum(a))) / 1.5)
    assert got[1] == pytest.approx((0.45 * (r + 1) / 2 + 0.1 * ratio) / 0.55) and got[2] == pytest.approx((0.45 + 0.45 * (r + 1) / 2 + 0.1) / 1.0)
    assert got[3] is None and got[4] == pytest.approx(math.exp(-abs(math.log(sum(b) / 3.0)) / 1.5))
    s = spark.range(1).select(C.axis_scale(F.lit(10.0), F.lit(2.0), 0.5).alias("a"), C.axis_scale(F.lit(0.0), F.lit(2.0), 0.5).alias("b"), C.axis_reach(0.5, F.lit(10.0), F.lit(1.25)).alias("c")).first()
    assert tuple(s) == (1.25, 1.0, 2.0)


def test_empty(spark):
    peaks, im, frames = run_of(spark)
    assert C.rt_peaks(C.rt_traces(peaks.limit(0), im, frames, "ms_type")).count() == 0
    assert C.rt_peaks(C.rt_traces(peaks, im.limit(0), frames, "ms_type")).count() == 0


def test_dense_cells_equal_brute_force(spark):
    from ionweave.operators import clustering as K

    rng = np.random.default_rng(11)
    pts = np.concatenate([rng.normal(0, 0.3, (120, 2)), rng.normal((1.9, 0), 0.25, (120, 2)), rng.uniform(-4, 6, (60, 2)), np.tile([[4.0, 4.0]], (40, 1)), np.tile([[4.5, 4.0]], (40, 1)), np.tile([[4.5, 4.51]], (40, 1))])
    eps, least = 0.5, 6
    d = ((pts[:, None] - pts[None]) ** 2).sum(2) <= eps * eps
    core = d.sum(1) >= least
    label = {i: i for i in range(len(pts)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            m = min(label[j] for j in label if d[i, j])
            if m < label[i]:
                label[i], changed = m, True
    want = [label.get(i, min((label[j] for j in label if d[i, j]), default=-1)) for i in range(len(pts))]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r["id"]: (r["cluster"], r["core"]) for r in K.dbscan(df, ["x", "y"], eps, least).collect()}
    assert [got[i] for i in range(len(pts))] == [(w, bool(c)) for w, c in zip(want, core)]


@pytest.mark.parametrize("block, chunk", [(32, 1_000_000), (3, 1)])
def test_traces_equal_brute_force(spark, block, chunk):
    rng = np.random.default_rng(5)
    frames = [(int(f), float(i), k) for k in (0, 1) for i, f in enumerate(range(100 * k, 100 * k + 40))]
    peaks = [(int(rng.integers(0, 140)), int(rng.integers(-3, 12)), int(rng.integers(0, 50)), float(rng.integers(0, 9))) for _ in range(1500)] + [(5, None, 1, 1.0), (5, 1, 1, None)]
    im = []
    for i in range(80):
        a, b = (int(x) for x in rng.integers(0, 40, 2))
        s, t = int(rng.integers(-3, 10)), int(rng.integers(0, 40))
        im.append((i, i % 2, a + 100 * (i % 2), b + 100 * (i % 2), s, s + int(rng.integers(-1, 4)), *((0, 10**9) if i % 3 == 0 else (t, t + 8))))
    want = {}
    for i, k, a, b, s0, s1, t0, t1 in im:
        lo, hi = max(min(a, b) - 100 * k - 1, 0), min(max(a, b) - 100 * k + 1, 39)
        y = [sum(w for f, s, t, w in peaks if None not in (s, w) and f == 100 * k + p and s0 <= s <= s1 and t0 <= t <= t1) for p in range(lo, hi + 1)]
        if max(y) > 0:
            want[i] = (lo, [float(p) for p in range(lo, hi + 1)], y)
    p = spark.createDataFrame(peaks, "frame_id int, scan int, tof int, intensity double")
    m = spark.createDataFrame(im, "im_id long, key int, frame_lo int, frame_hi int, scan_lo int, scan_hi int, tof_lo int, tof_hi int")
    got = C.rt_traces(p, m, spark.createDataFrame(frames, "frame_id int, time double, key int"), "key", pad=1, block=block, chunk=chunk).collect()
    assert len(got) == len(want) and {r["im_id"]: (r["lo"], r["times"], r["trace"]) for r in got} == want


def test_fallback_values_are_computed_once(spark):
    """Named values within the peak do not multiply its work: the filter of low places and the maximum occur once each, however often they are used."""
    df = spark.createDataFrame([([0.0, 5.0, 10.0, 5.0, 0.0],)], "y array<double>").select(C.fallback_peak(F.col("y"), 0.5).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") <= 3 and plan.count("array_max(") <= 3
    assert df.first()["p"]["area"] == pytest.approx(15.0)


def test_traces_do_not_search_the_axis(spark):
    """No row carries or searches the frames of the whole run; boxes of the traces' peaks come out as before."""
    peaks, im, frames = run_of(spark)
    traces = C.rt_traces(peaks, im, frames, "ms_type", pad=1)
    assert "array_position" not in traces._jdf.queryExecution().optimizedPlan().toString()
    p = traces.withColumn("p", C.fallback_peak(F.col("trace"))).select("im_id", (F.col("lo") + F.floor("p.left")).alias("frame_lo"), (F.col("lo") + F.ceil("p.right")).alias("frame_hi"))
    assert [tuple(r) for r in C.boxes(im, p, F.lit(30), F.lit(6000), rt_pad=1).collect()] == [(1, 3, 13, 45, 54, 90, 110)]


@pytest.mark.parametrize("block, unit", [(32, 1.0), (32, 0.125), (3, 1.0), (7, 0.125)])
def test_fallback_boxes_equal_boxes_of_joined_peaks(spark, block, unit):
    """Spans that are met whole and spans put together of parts give the boxes of brute-force traces, for whole and for fractional intensities; every peak is in reach of tof."""
    rng = np.random.default_rng(7)
    frames = spark.createDataFrame([(i, float(i), 0) for i in range(60)], "frame_id int, time double, ms_type int")
    peaks = [(int(rng.integers(0, 60)), int(rng.integers(0, 14)), int(rng.integers(0, 50)), unit * int(rng.integers(0, 9))) for _ in range(700)]
    im = [(i, 0, a, min(a + int(rng.integers(0, 7 if i % 2 else 60)), 59), s, s - 1, s + 1, None if i % 3 else 2.5, 0, 10**9) for i, (a, s) in enumerate(rng.integers((0, 0), (60, 13), (90, 2)).tolist())]
    traces = [(i, lo, [float(sum(w for f, s, _, w in peaks if f == p and s0 <= s <= s1)) for p in range(lo, hi + 1)]) for i, _, a, b, _, s0, s1, *_ in im for lo, hi in [(max(a - 2, 0), min(b + 2, 59))]]
    p = spark.createDataFrame([t for t in traces if max(t[2]) > 0], "im_id long, lo int, trace array<double>").withColumn("p", C.fallback_peak(F.col("trace")))
    ends = [(F.col("lo") + F.least(F.greatest(e, F.lit(0)), F.size("trace") - 1)).alias(c) for e, c in ((F.floor("p.left"), "frame_lo"), (F.ceil("p.right"), "frame_hi"))]
    spans, sizes = spark.createDataFrame(im, IM), (F.lit(60), F.lit(50))
    want = sorted(map(tuple, C.boxes(spans, p.select("im_id", *ends), *sizes, rt_pad=1, im_pad=1).collect()))
    q = C.rt_traces(spark.createDataFrame(peaks, "frame_id int, scan int, tof int, intensity double"), spans, frames, "ms_type", pad=2, block=block)
    for t in q.collect():
        assert t["trace"] == pytest.approx(traces[t["im_id"]][2]) and t["lo"] == traces[t["im_id"]][1]
    got = C.fallback_boxes(spark.createDataFrame(peaks, "frame_id int, scan int, tof int, intensity double"), spans, frames, "ms_type", n_places=sizes[0], n_tof=sizes[1], pad=2, rt_pad=1, im_pad=1, block=block)
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == want


def test_fallback_ends_equal_the_peak_of_each_trace(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    inf, nan = math.inf, math.nan
    rows = [[3.0], [5.0, 5.0], [0.0, 4.0, 4.0, 0.0], [1.0, 9.0], [9.0, 1.0], [8.0, 9.0, 8.0], [0.0, inf, 1.0], [1.0, nan, 2.0], [0.9, 0.9, 10.0, 0.9, 0.9]]
    rows += [(rng.integers(0, 9, n) ** 3 * (rng.random(n) < 0.7) + (k == 0)).astype(float).tolist() for k in range(40) for n in (1, 2, 3, 10, 17)]
    rows = [y for y in rows if not max(y) <= 0]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(rows)], "i int, y array<double>").withColumn("p", C.fallback_peak(F.col("y")))
    want = [(r["a"], r["b"]) for r in df.orderBy("i").select(*[(F.col("i") + F.least(F.greatest(e, F.lit(0)), F.size("y") - 1)).alias(c) for e, c in ((F.floor("p.left"), "a"), (F.ceil("p.right"), "b"))]).collect()]
    assert list(zip(*(x.tolist() for x in C.fallback_ends(pa.table({"lo": np.arange(len(rows), dtype=np.int32), "trace": rows}))))) == want


def test_boxes_query_neither_joins_nor_walks_traces(spark, tmp_path):
    """Boxes are made where the traces are: no join by mobility peak, and no function over a trace's elements row by row."""
    from ionweave.plans.cluster_queries import QUERIES

    spark.sql("SELECT id AS s_suppkey FROM range(60)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT id AS o_orderkey, id * 7 AS o_custkey, 1.0D AS o_totalprice FROM range(50)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS l_orderkey, id * 11 AS l_partkey, id % 60 AS l_suppkey, 1.0D AS l_quantity, 1.0D AS l_extendedprice FROM range(500)").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = QUERIES["i212_boxes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "(im_id#" not in "".join(x for x in plan.splitlines() if "Join" in x) and "filter(" not in plan and "aggregate(" not in plan


def test_peaks_of_many_traces_equal_one_by_one():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 4, 9, 14, 40):
        y = np.concatenate([rng.integers(0, 6, (60, n)), rng.integers(0, 2, (20, n)) * 50, np.zeros((2, n)), np.full((2, n), 3)]).astype(float)
        t = np.cumsum(rng.choice([0.5, 1.0, 3.0], (len(y), n)), axis=1)
        for o in ({}, {"smooth_s": 1.0, "noise_factor": 1.0, "min_distance_s": 3.0}, {"smooth_s": 2.0, "min_prominence": 0.5, "min_width_s": 1.0, "min_distance_s": 6.0, "of_best": 0.3}):
            want = [(i, *p) for i in range(len(y)) for p in C.trace_peaks(y[i], t[i], **o)]
            got = list(zip(*(v.tolist() for v in C.traces_peaks(y, t, **o))))
            assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose(np.array(got), np.array(want), rtol=1e-9, atol=1e-9)


def test_box_moments_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    peaks = [(int(rng.integers(0, 60)), int(rng.integers(0, 20)), int(rng.integers(0, 50)), float(rng.integers(0, 9))) for _ in range(1500)]
    spec = []
    for i in range(80):
        a, b, c = (int(rng.integers(-5, m)) for m in (60, 20, 50))
        spec.append((i, a, a + int(rng.integers(-1, 40)), b, b + int(rng.integers(0, 5)), *((0, 10**6) if i % 3 == 0 else (c, c + 9))))
    want = {}
    for i, *e in spec:
        hit = np.array([p for p in peaks if all(e[2 * d] <= p[d] <= e[2 * d + 1] for d in range(3))])
        if len(hit) and hit[:, 3].sum() > 0:
            mu = [np.average(hit[:, d], weights=hit[:, 3]) for d in range(3)]
            want[i] = (len(hit), hit[:, 3].sum(), *(v for d in range(3) for v in (mu[d], math.sqrt(np.average((hit[:, d] - mu[d]) ** 2, weights=hit[:, 3])))))
    p = spark.createDataFrame(peaks, "frame_id int, scan int, tof int, intensity double")
    s = spark.createDataFrame(spec, "cluster_id long, frame_id_lo int, frame_id_hi int, scan_lo int, scan_hi int, tof_lo int, tof_hi int")
    got = {r["cluster_id"]: tuple(r)[1:] for r in C.box_moments(p, s, width=7.0, chunk=5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
