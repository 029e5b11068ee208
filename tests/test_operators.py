"""Literal cases and invariants of the instrument operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ionweave.functions import arrays as A
from ionweave.functions import chemistry as C
from ionweave.functions import physics as Y
from ionweave.operators import assembly as M
from ionweave.operators import binning as B
from ionweave.operators import clustering as K
from ionweave.operators import evaluation as E
from ionweave.operators import filters as I
from ionweave.operators import greedy as G
from ionweave.operators import hashing as H
from ionweave.operators import joins as J
from ionweave.operators import ranking as T
from ionweave.operators import setops as S
from ionweave.operators import windows as W
from ionweave.sources import codec, formats


def peaks(spark, rows):
    return spark.createDataFrame([(float(m), float(i)) for m, i in rows], "mz double, intensity double")


def pairs_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_quantise(spark):
    p = peaks(spark, [(100.123, 10), (100.121, 20), (100.131, 30)])
    assert pairs_of(B.to_resolution(p, 1), "mz", "intensity") == [(100.1, 60.0)]
    assert pairs_of(B.to_resolution(p, 2), "mz", "intensity") == [(100.12, 30.0), (100.13, 30.0)]


def test_plane_bands_hold_the_whole_axis(spark):
    rows = [(1, 5, t, float(t), 1.0) for t in (0, 15_999, 16_000, 149_999)]
    got = B.plane(spark.createDataFrame(rows, "frame_id int, scan int, tof int, mz double, intensity double"), None, 8)
    assert pairs_of(got, "band", "intensity") == [(0, 3.0), (7, 1.0)]


def test_value_windows(spark):
    p = peaks(spark, [(100, 10), (101, 20), (102.5, 30), (103, 40)])
    got = {r["window"]: r["n"] for r in W.value_windows(p, 1.0, 1, 10.0).collect()}
    assert got == {100: 1, 101: 1, 102: 1, 103: 1}
    both = {r["window"] for r in W.value_windows(p, 1.0, 1, 10.0, overlapping=True).collect()}
    assert {100, 102, -100, -103} <= both


def test_overlapping_windows_meet_at_zero(spark):
    p = peaks(spark, [(0.2, 1), (0.3, 1)])
    assert {r["window"]: r["n"] for r in W.value_windows(p, 1.0, 1, 0.0, overlapping=True).collect()} == {0: 4}


def test_spectrum_arithmetic(spark):
    a, b = peaks(spark, [(100.523, 10), (101.923, 20)]), peaks(spark, [(101.235, 15), (105.112, 30)])
    assert [x[1] for x in pairs_of(S.spectrum_add(a, b), "mz", "intensity")] == [10.0, 15.0, 20.0, 30.0]
    assert pairs_of(S.spectrum_add(a, a, sign=-1), "mz", "intensity") == [(100.523, 0.0), (101.923, 0.0)]
    twice = peaks(spark, [(100.0, 1), (100.0, 2)])
    assert pairs_of(S.spectrum_add(twice, twice, strict=True), "mz", "intensity") == [(100.0, 5.0)]


def test_deisotope(spark):
    p = peaks(spark, [(500, 1000), (501.003, 500), (502.006, 250), (600, 800)]).withColumn("k", F.lit(1))
    assert pairs_of(G.deisotope(p, ["k"], 10.0), "mz") == [(500.0,), (600.0,)]


def test_top_spectrum(spark):
    p = peaks(spark, [(100, 10), (200, 50), (300, 30), (400, 100), (500, 20)]).withColumn("tof", F.lit(1))
    assert pairs_of(T.top_spectrum(p, 3), "mz", "place") == [(200.0, 1), (300.0, 2), (400.0, 3)]


def test_islands(spark):
    df = spark.createDataFrame([(1, 5), (6, 8), (3, 4), (10, 12), (14, 20)], "a int, b int")
    assert pairs_of(W.islands(df, "a", "b"), "a", "b") == [(1, 8), (10, 12), (14, 20)]


def test_centroid_sessions(spark):
    p = peaks(spark, [(100.0, 1), (100.05, 3), (100.2, 5)])
    assert pairs_of(W.centroid(p, 0.1, []), "n", "intensity") == [(1, 5.0), (2, 4.0)]
    assert sum(r["intensity"] for r in W.centroid(p, 0.1, [], normalise=True).collect()) == pytest.approx(1.0)


def test_local_maxima_keep_the_earlier_of_equals(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (9, 2.0)], "tof int, intensity double")
    assert pairs_of(W.local_maxima(df, 2), "tof") == [(1,), (9,)]


def test_interval_joins_equal_brute_force(spark):
    rnd = random.Random(1)
    a = [(i, x := rnd.randrange(100), x + rnd.randrange(12), y := rnd.randrange(60), y + rnd.randrange(9)) for i in range(150)]
    b = [(i, x := rnd.randrange(100), x + rnd.randrange(30), y := rnd.randrange(60), y + rnd.randrange(9)) for i in range(150)] + [(999, 5, 1, 0, 9)]
    l = spark.createDataFrame(a, "i int, a0 int, a1 int, a2 int, a3 int")
    r = spark.createDataFrame(b, "j int, b0 int, b1 int, b2 int, b3 int")
    one = pairs_of(J.bucketed_interval_join(l, r, ("a0", "a1"), ("b0", "b1"), 7), "i", "j")
    assert one == sorted((x[0], y[0]) for x in a for y in b if y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    two = pairs_of(J.bucketed_box_join(l, r, [(("a0", "a1"), ("b0", "b1"), 7), (("a2", "a3"), ("b2", "b3"), 5)]), "i", "j")
    assert two == sorted((x[0], y[0]) for x in a for y in b if y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2] and x[3] <= y[4] and y[3] <= x[4])


def test_as_of_and_nearest_equal_brute_force(spark):
    rnd = random.Random(2)
    left = [(i, rnd.randrange(3), rnd.randrange(200)) for i in range(120)]
    right = sorted({(rnd.randrange(3), rnd.randrange(200)) for _ in range(40)})
    l = spark.createDataFrame(left, "i int, k int, t long")
    r = spark.createDataFrame([(k, t, t * 10) for k, t in right], "k int, t long, v long")

    def before(k, t):
        return max((u for q, u in right if q == k and u <= t), default=None)

    for block in (None, F.floor(F.col("t") / 16)):
        got = {x["i"]: x["right_t"] for x in J.as_of(l, r, "t", ["k"], ["v"], block=block).collect()}
        assert got == {i: before(k, t) for i, k, t in left}
    got = {x["i"]: x["near_t"] for x in J.nearest(l, r, "t", ["k"], ["v"], F.floor(F.col("t") / 16)).collect()}
    assert got == {i: min((u for q, u in right if q == k), key=lambda u: (abs(u - t), u), default=None) for i, k, t in left}


def test_nearest_key_prefers_exact_then_below(spark):
    l = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "i int, ce long").withColumn("g", F.lit(1))
    r = spark.createDataFrame([(10, "x"), (11, "y"), (19, "a"), (21, "b"), (31, "c")], "ce long, v string").withColumn("g", F.lit(1))
    assert pairs_of(J.nearest_key(l, r, "ce", ["g"]), "i", "v") == [(1, "x"), (2, "a"), (3, "c")]


def test_last_window_wins(spark):
    w = spark.createDataFrame([(1, 0, 0, 50, 100.0, 10.0, 5.0), (1, 1, 20, 30, 200.0, 10.0, 6.0)], "window_group int, row_order int, scan_begin int, scan_end int, isolation_mz double, isolation_width double, collision_energy double")
    p = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (1, 31), (1, 60)], "window_group int, scan int")
    assert pairs_of(J.last_window(p, w, ["window_group"]), "scan", "isolation_mz") == [(10, 100.0), (20, 200.0), (30, 200.0), (31, 100.0)]


def test_physics(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("v")).first()["v"]
    assert f(Y.ccs(F.lit(0.5), F.lit(1000.0), F.lit(2))) == pytest.approx(201.64796734428452)
    assert f(Y.one_over_k0(F.lit(806.5918693771381), F.lit(1000.0), F.lit(2))) == pytest.approx(2.0)
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        assert f(Y.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=2e-7)
    assert f(Y.lambda_of(F.lit(1000.0))) == pytest.approx(0.56309)
    assert sum(f(Y.averagine_weights(F.lit(2000.0), 6))) == pytest.approx(1.0)
    assert [f(Y.binomial_pmf(F.lit(2), k, 0.8)) for k in range(4)] == pytest.approx([0.04, 0.32, 0.64, 0.0])
    assert f(Y.emg_mass(F.lit(0.0), F.lit(100.0), F.lit(40.0), F.lit(3.0), F.lit(0.5), 2000)) == pytest.approx(1.0, abs=1e-3)
    assert A.adaptive_integral(math.sin, 0, math.pi) == pytest.approx(2.0)
    lo, hi = A.emg_bounds(50.0, 2.0, 0.5)
    assert lo < 50 < hi
    assert f(J.logistic_window(F.lit(700.0), F.lit(700.0), F.lit(20.0))) > 0.999 > 0.01 > f(J.logistic_window(F.lit(720.0), F.lit(700.0), F.lit(20.0)))


def test_calibration_inverts(spark):
    df = spark.range(1, 200_000, 997).select(F.col("id").alias("tof"))
    for c2, c3 in ((0.0, 0.0), (0.02, 0.0), (0.02, 1e-5)):
        mz = Y.tof_to_mz(F.col("tof"), 0.2, 24864.0, 312.0, 1574.24, c2, c3)
        assert df.where(Y.mz_to_tof(mz, 0.2, 24864.0, 312.0, 1574.24, c2, c3) != F.col("tof")).count() == 0


def test_chemistry(spark):
    df = spark.createDataFrame([(1, "PEPTIDEH"), (2, "PEPC[UNIMOD:4]TIDEH"), (3, "")], "k int, sequence string")
    mass = {r["k"]: (r["a"], r["b"]) for r in df.select("k", C.mono_mass(F.col("sequence")).alias("a"), C.mass_by_counts(F.col("sequence")).alias("b")).collect()}
    assert mass[1][0] == pytest.approx(936.4188766862999) and all(a == pytest.approx(b) for a, b in mass.values())
    ions = {(r["kind"], r["ordinal"]): r for r in C.product_ions(df.where("k = 2"), "k").collect()}
    assert len(ions) == 16 and ions["b", 4]["ion"] == "PEPC[UNIMOD:4]" and ions["y", 1]["ion"] == "H"
    assert ions["b", 3]["mass"] + ions["y", 6]["mass"] == pytest.approx(mass[2][0])
    assert df.where("k = 1").select(C.protonizable(F.col("sequence"))).first()[0] == 2
    assert {r["element"]: r["n"] for r in C.peptide_formula(df.where("k = 1"), "k").collect()} == {"C": 40, "H": 60, "N": 10, "O": 16}
    f = spark.createDataFrame([("H2O",), ("C6H12O6",), ("Xx2",), ("h2o",)], "f string").select("f", C.formula_mass(F.col("f")).alias("m"))
    got = {r["f"]: r["m"] for r in f.collect()}
    assert got["H2O"] == pytest.approx(18.0105646837) and got["C6H12O6"] == pytest.approx(180.0633881) and got["Xx2"] is None and got["h2o"] is None
    d = spark.createDataFrame([("p", "MKAAAAAAARPGGGGGGGGKCCCCCCCC")], "k string, sequence string")
    assert pairs_of(C.digest(d, "k", 1), "peptide") == [("AAAAAAARPGGGGGGGGK",), ("AAAAAAARPGGGGGGGGKCCCCCCCC",), ("CCCCCCCC",), ("MKAAAAAAARPGGGGGGGGK",)]
    keys = {r[0] for r in spark.createDataFrame([("IC[UNIMOD:4]K",), ("LC[UNIMOD:4]K",)], "s string").select(C.peptidoform_key(F.col("s"))).collect()}
    assert keys == {"LCK|1:4"}


def test_encoding_keeps_the_tail_of_long_sequences(spark, tmp_path):
    long = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"
    spark.createDataFrame([(1, long), (2, long[:-1] + "M"), (3, "AC(UniMod:4)")], "row_id long, sequence_modified string").write.parquet(str(tmp_path / "parse_diann_report.parquet"))
    got = {r["row_id"]: r["ids"] for r in entry.queries()["i313_encode_whole"](spark, str(tmp_path)).collect()}
    assert len(got[1]) == 30 and 0 not in got[1] and got[1][:29] == got[2][:29] and got[1][29] != got[2][29]
    assert got[3][1:] == [1] + [0] * 28


def test_isotope_distributions():
    water = G.isotope_distribution({"H": 2, "O": 1})
    assert water[0][0] == pytest.approx(18.0105646863, abs=1e-6) and sum(p for _, p in water) == pytest.approx(1.0, abs=1e-3)
    c = [(12.0, 0.99), (13.0, 0.01)]
    direct = [(0.0, 1.0)]
    for _ in range(5):
        direct = G.convolve(direct, c, 1e-3, 0.0, 50)
    power = G.convolve_power(c, 5, 1e-3, 0.0, 50)
    assert [x for p in power for x in p] == pytest.approx([x for p in direct for x in p])


def plain_convolve(a, b, tolerance, threshold, most):
    out = []
    for ma, pa in a:
        for mb, pb in b:
            if pa * pb >= threshold:
                near = next((e for e in out if abs(e[0] - ma - mb) < tolerance), None)
                if near:
                    near[1] += pa * pb
                else:
                    out.append([ma + mb, pa * pb])
    return sorted(map(tuple, sorted(out, key=lambda e: -e[1])[:most]))


def test_convolution_equals_the_plain_walk():
    rng = np.random.default_rng(4)
    for tolerance in (1e-6, 1e-3, 5e-3, 0.3):
        a, b = ([(float(x), float(y)) for x, y in zip(rng.integers(0, 6, 30) + rng.normal(0, 2e-3, 30), rng.random(30))] for _ in range(2))
        got, want = G.convolve(a, b, tolerance, 0.01, 40), plain_convolve(a, b, tolerance, 0.01, 40)
        assert len(got) == len(want) and [x for e in got for x in e] == pytest.approx([x for e in want for x in e], abs=1e-12)


def test_reported_peaks_are_those_of_the_whole_distribution(spark):
    counts = {"C": 147, "H": 232, "N": 40, "O": 46, "S": 1}
    whole = G.isotope_distribution(counts)
    assert sum(p for _, p in whole) == pytest.approx(1.0, abs=1e-3)
    nominal = np.array([1.0])
    for e, n in counts.items():
        one = np.zeros(5)
        for m, p in G.ISOTOPES[e]:
            one[round(m - G.ISOTOPES[e][0][0])] += p
        for _ in range(n):
            nominal = np.convolve(nominal, one)[:12]
    lightest = whole[0][0]
    for k in range(6):
        assert sum(p for m, p in whole if round(m - lightest) == k) == pytest.approx(nominal[k], abs=1e-3)
    df = spark.createDataFrame([("x", counts)], "k string, counts map<string,int>")
    got = [(r["mass"], r["abundance"]) for r in G.isotope_spectra(df, "k", 5).orderBy("peak").collect()]
    assert got == sorted(sorted(whole, key=lambda e: -e[1])[:5])


def test_prominence_and_suppression():
    found = G.prominences(np.array([0, 1, 0, 3, 1, 2, 0.0]))
    assert [(i, p) for i, p, _, _ in found] == [(1, 1.0), (3, 3.0), (5, 1.0)]
    assert G.suppress([1, 2, 3], [0.0, 1.0, 5.0], [5.0, 6.0, 1.0], 2.0) == [1, 2]


def test_scheduler_excludes_and_avoids_collisions():
    s = G.Scheduler(1, 2, 5, 10)
    assert s.frame(1, [(1, 100, 9.0), (2, 105, 8.0), (3, 200, 7.0), (4, 300, 6.0)]) == [(0, 1), (0, 3)]
    assert s.frame(2, [(1, 100, 9.0), (2, 105, 8.0)]) == [(0, 2)]
    assert s.frame(7, [(1, 100, 9.0)]) == [(0, 1)]


def test_schedule_walks_all_ions_of_a_frame(spark):
    rows = [(r, f, i, 100 if i < 300 else 100 + 60 * (i - 299), float(1000 - i)) for r in (1, 2) for f in (3, 6) for i in range(304)]
    df = spark.createDataFrame(rows, "run int, frame_id int, ion int, scan int, intensity double")
    want, until = [], {}
    for r, f in ((1, 3), (1, 6), (2, 3), (2, 6)):
        used = [[], []]
        for _, _, i, scan, _ in sorted((x for x in rows if x[:2] == (r, f)), key=lambda x: -x[4]):
            slot = next((k for k, u in enumerate(used) if len(u) < 4 and all(abs(scan - s) > 25 for s in u)), None)
            if slot is not None and until.get((r, i), -1) < f:
                used[slot].append(scan)
                until[r, i] = f + 25
                want.append((r, f, slot, i))
    assert (1, 3, 0, 300) in want and pairs_of(G.schedule(df, "run", slots=2, per_slot=4), "run", "frame_id", "slot", "ion") == sorted(want)
    wide = spark.createDataFrame([(1, 3, i, 30 * i, 1.0) for i in range(200)], "run int, frame_id int, ion int, scan int, intensity double")
    assert G.schedule(wide, "run").count() == 7 * 15


def test_isotope_chain(spark):
    rows = [(1, 1, 500.0, 10.0), (1, 2, 500.5017, 8.0), (1, 3, 501.0034, 4.0), (1, 4, 700.0, 5.0)]
    df = spark.createDataFrame([(g, i, m, r, 1, 5, 1, 5) for g, i, m, r in rows], "g int, cluster_id long, mz double, raw_sum double, rt_lo int, rt_hi int, im_lo int, im_hi int")
    got = pairs_of(G.isotope_chains(df, ["g"]), "feature", "charge", "place", "cluster_id")
    assert got == [(1, 2, 0, 1), (1, 2, 1, 2), (1, 2, 2, 3), (4, 0, 0, 4)]


def chains_of(spark, rows, **kw):
    df = spark.createDataFrame([(1, i, float(m), float(r), 1, 5, 1, 5) for i, m, r in rows], "g int, cluster_id long, mz double, raw_sum double, rt_lo int, rt_hi int, im_lo int, im_hi int")
    out = {}
    for r in G.isotope_chains(df, ["g"], max_charge=1, **kw).orderBy("place").collect():
        out.setdefault(r["feature"], []).append(r["cluster_id"])
    return out


def test_isotope_chain_stops_against_the_envelope(spark):
    up = [(i, 500 + i * Y.ISOTOPE_SPACING, r) for i, r in enumerate((100, 60, 58, 20))]  # 58 does not fall by 5 %
    assert chains_of(spark, up, envelope=False) == {0: [0, 1, 2, 3]}
    assert chains_of(spark, up) == {0: [0, 1], 2: [2, 3]}
    down = [(i, 500 + i * Y.ISOTOPE_SPACING, r) for i, r in enumerate((58, 60, 100))]
    assert chains_of(spark, down) == {0: [0], 1: [1, 2]}
    assert chains_of(spark, up, envelope=False, max_members=2) == {0: [0, 1], 2: [2, 3]}
    rnd = random.Random(5)
    for _ in range(3):
        rows = [(i, 500 + i * Y.ISOTOPE_SPACING, rnd.randrange(1, 100) + i / 100) for i in range(12)]
        raw, free, want = [r for _, _, r in rows], set(range(12)), {}
        for seed in sorted(free, key=lambda i: -raw[i]):
            if seed in free:
                chain = [seed]
                for way in (1, -1):
                    at, place = seed, 1
                    while at + way in free:
                        lam, k = 0.000594 * (rows[seed][1] - 1.0072765) - 0.03091, min(place, 7)
                        w = [math.exp(-lam) * lam**n / math.factorial(n) for n in (k - 1, k)]
                        if w[1] > w[0] * 1.001 and raw[at + way] < raw[at] * 1.05 or w[1] < w[0] * 0.999 and raw[at + way] > raw[at] * 0.95:
                            break
                        at, place = at + way, place + 1
                        chain.append(at)
                free -= set(chain)
                want[min(chain)] = sorted(chain)
        assert chains_of(spark, rows) == want


def test_components_and_dbscan(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (7, 6), (6, 5), (9, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in K.connected_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 11}
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (30, 3)), [[20.0, 20, 20]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")
    labels = {r["id"]: r["cluster"] for r in K.dbscan(df, ["x", "y", "z"], 0.5, 5).collect()}
    assert {labels[i] for i in range(30)} == {0} and {labels[i] for i in range(30, 60)} == {30} and labels[60] == -1
    assert K.dbscan(df.limit(0), ["x", "y", "z"], 0.5, 5).count() == 0


def test_rank_statistics(spark):
    rnd = random.Random(3)
    vals = [float(rnd.randrange(-50, 50)) / 4 for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "v double")
    assert B.upper_median(df, "v").first()["v"] == sorted(vals)[50]
    assert B.nearest_rank_quantile(df, "v", 0.9).first()["v"] == sorted(vals)[90]
    buckets = E.rank_bucket(spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double"), "v", 4, ["i"]).collect()
    order = sorted((v, i) for i, v in enumerate(vals))
    want = {i: max(1, math.ceil(4 * r / 100)) for r, (_, i) in enumerate(order)}
    assert {r["i"]: r["bucket"] for r in buckets} == want


def test_folds_are_even(spark):
    sizes = [r["n"] for r in I.folds(spark.range(103), 5, "id").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_deduplicate_and_shares(spark):
    df = spark.createDataFrame([("A", 2, 1.0, 10.0), ("A", 2, 3.0, 20.0), ("B", 2, 0.0, 4.0), ("B", 2, 0.0, 8.0)], "s string, z int, intensity double, rt double")
    got = {r["s"]: (r["intensity"], r["rt"]) for r in E.deduplicate(df, ["s", "z"], ["rt"]).collect()}
    assert got == {"A": (4.0, 17.5), "B": (0.0, 6.0)}
    assert pairs_of(E.relative_abundance(df, "s"), "s", "relative_abundance") == [("A", 0.25), ("A", 0.75), ("B", 1.0), ("B", 1.0)]


def test_sim_hash_is_stable(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 64))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i int, e array<float>")
    planes = H.hyperplanes(64, 10, 7)
    got = {r["i"]: r["k"] for r in df.select("i", H.sim_hash(F.col("e"), planes).alias("k")).collect()}
    assert got == {i: sum(1 << b for b, p in enumerate(planes) if np.dot(r.astype(np.float32).astype(float), p) > 0) for i, r in enumerate(v)}


@pytest.mark.parametrize("n", [0, 1, 1000, 20_000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    scan, tof, inten = rng.integers(0, 50, n), rng.integers(0, 300, n), rng.integers(1, 1000, n)
    s, t, i = codec.decode_frame(codec.encode_frame(scan, tof, inten, 50))
    want = codec.sum_and_sort(scan, tof, inten)
    assert (s == want[0]).all() and (t == want[1]).all() and (i == want[2]).all() and i.sum() == inten.sum()


def test_lzf():
    assert codec.lzf_decompress(bytes([2]) + b"abc" + bytes([0b01000000, 2]), 7) == b"abcabca"


def test_names_and_lists(spark):
    df = spark.createDataFrame([("A", "1")], "`Peptide `string, `Quantity` string")
    got = formats.normalise_names(df, formats.FINDING_NAMES, ("sequence",)).first()
    assert (got["sequence"], got["intensity"], got["charge"]) == ("A", "1", None)
    with pytest.raises(ValueError):
        formats.normalise_names(df.drop("Peptide "), formats.FINDING_NAMES, ("sequence",))
    assert spark.range(1).select(formats.parse_list(F.lit("['a', \"b\"]"))).first()[0] == ["a", "b"]


def test_target_decoy(spark):
    rows = [(1, 9.0, 1, False), (1, 8.0, 2, True), (2, 7.0, 3, False), (3, 6.0, 4, True), (4, 5.0, 5, False)]
    df = spark.createDataFrame(rows, "spec int, s double, m long, decoy boolean")
    assert pairs_of(M.target_decoy(df, "spec", "s", "m"), "spec", "m", "q") == [(1, 1, 0.0), (2, 3, 0.0), (3, 4, pytest.approx(1 / 3)), (4, 5, pytest.approx(1 / 3))]


def test_cluster_boxes_reach_all_peaks(spark, tmp_path):
    f = lambda rows, cols, name: spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / f"{name}.parquet"))
    f([(s, 5, t, 100.0, 1.0) for s, t in ((3, 10), (150, 149_999), (2500, 9))], "l_suppkey long, l_partkey long, l_orderkey long, l_extendedprice double, l_quantity double", "lineitem")
    f([(i,) for i in range(1, 2501)], "s_suppkey long", "supplier")
    f([(i, 0, 500.0) for i in range(1, 2501)], "o_orderkey long, o_custkey long, o_totalprice double", "orders")
    got = entry.queries()["i211_evaluate_clusters_whole"](spark, str(tmp_path))
    assert {r["apex_frame"] for r in got.collect()} == {3, 150, 2500}
    assert got.agg(F.sum("n")).first()[0] == 1 + 9 + 9  # boxes that hold frames 3, 150 and 2500


def test_empty_inputs(spark):
    p = spark.createDataFrame([], "frame_id int, scan int, tof int, mz double, intensity double, mobility double")
    for out in (B.to_resolution(p, 1, "frame_id"), W.centroid(p, 0.1, ["tof"], "frame_id"), W.value_windows(p, 1.0, 1, 0.0), G.deisotope(p, ["frame_id"]), T.top_spectrum(p, 3, "frame_id"), B.upper_median(p, "mz"), M.scan_slices(p)):
        assert out.count() == 0


def test_target_sums_equal_brute_force(spark):
    """Sums are made where peaks meet their targets: values as by brute force, and no pair is shuffled."""
    from ionweave.operators import assembly as M

    rng = np.random.default_rng(7)
    mz = np.concatenate([rng.uniform(100, 101, 300), [0.0, 500.0, 500.05, 499.95, 500.0501]])
    peaks = [(i % 7 if i % 11 else None, float(m), (i % 13) / 13, float(i % 5) if i % 17 else None) for i, m in enumerate(mz)] + [(1, None, 0.5, 1.0), (1, -3.0, 0.5, 1.0)]
    targets = [(i % 50 if i % 23 else None, float(m)) for i, m in enumerate(rng.uniform(100, 101, 60))] + [(90, 500.0), (91, 0.0), (92, -3.0), (93, None), (94, 700.0)]
    want = {"frame_id": {}, "bin": {}}
    for t, m in targets:
        for frame, x, mobility, w in peaks:
            if m is not None and x is not None and m * (1 - 1e-4) <= x <= m * (1 + 1e-4):
                for k, v in (("frame_id", frame), ("bin", round(mobility * 1000))):
                    want[k].setdefault((t, v), []).append(w)
    want = {k: {key: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for key, v in d.items()} for k, d in want.items()}
    p, t = spark.createDataFrame(peaks, "frame_id int, mz double, mobility double, intensity double"), spark.createDataFrame(targets, "target_id long, target_mz double")
    for name, got in (("frame_id", M.chromatograms(p, t, 100.0)), ("bin", M.mobilograms(p, t, 100.0))):
        rows = got.collect()
        assert len(rows) == len(want[name]) and {(r["target_id"], r[name]): r["intensity"] for r in rows} == want[name]
    small = M.target_sums(p, t, 100.0, F.col("frame_id"), "frame_id", windows=1, chunk=1).collect()
    assert {(r["target_id"], r["frame_id"]): r["intensity"] for r in small} == want["frame_id"]
    once = M.chromatograms(p, t, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_k" not in once.split("FlatMapCoGroupsInArrow")[0]


def test_target_sums_shuffle_peaks_once_and_leave_in_runs(spark, tmp_path):
    """Where targets share no id, peaks pass one shuffle; the result's order keeps its files small."""
    rng = np.random.default_rng(5)
    peaks = [(int(f), float(m), float(w)) for f, m, w in zip(rng.integers(0, 1000, 4000), rng.uniform(500, 500.5, 4000), rng.integers(1, 51, 4000), strict=True)]
    targets = [(int(i), float(m)) for i, m in zip(rng.permutation(2000), rng.uniform(500, 500.5, 2000), strict=True)]
    p, t = spark.createDataFrame(peaks, "frame_id int, mz double, intensity double").coalesce(1), spark.createDataFrame(targets, "target_id long, target_mz double").coalesce(1)
    got = M.chromatograms(p, t, 100.0)
    got.write.parquet(str(tmp_path / "sums"))
    out = spark.read.parquet(str(tmp_path / "sums"))
    frame, mz, w = (np.array(c) for c in zip(*peaks, strict=True))
    hit = [(mz >= m * (1 - 1e-4)) & (mz <= m * (1 + 1e-4)) for _, m in targets]
    rows = sum(len(np.unique(frame[h])) for h in hit)
    assert out.count() == rows == out.select("target_id", "frame_id").distinct().count()
    sums = {r["target_id"]: r["s"] for r in out.groupBy("target_id").agg(F.sum("intensity").alias("s")).collect()}
    assert sums == {i: w[h].sum() for (i, _), h in zip(targets, hit, strict=True)}
    assert sum(f.stat().st_size for f in (tmp_path / "sums").glob("*.parquet")) < rows
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.chromatograms(p, t, 100.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # peaks for shared ids are dropped before their shuffle, which a join of two shuffles would not do
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
