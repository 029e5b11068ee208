"""Queries from mobility peaks to clusters, of cluster scores, and of simulated runs. Names begin with the inventory number."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ionweave.functions import physics as Y
from ionweave.operators import clusters as C
from ionweave.operators import simulate as S
from ionweave.plans.match_queries import pairs
from ionweave.plans.peak_queries import _R6, r6
from ionweave.plans.registry import Registry

R = Registry()

# mobility peaks: each survey cluster sits on six survey frames of the run
_N = "(SELECT count(*) FROM {frames} WHERE ms_type = 0)"
_IM = f"SELECT cluster_id AS im_id, 0 AS ms_type, CAST(3 * (cluster_id % {_N} + 1) AS INT) AS frame_lo, CAST(3 * least(cluster_id % {_N} + 6, {_N}) AS INT) AS frame_hi, CAST(im_lo + 6 AS INT) AS scan, im_lo AS scan_lo, im_hi AS scan_hi, CASE WHEN cluster_id % 3 = 0 THEN CAST(2.5 AS DOUBLE) END AS scan_sigma, 0 AS tof_lo, 1000000000 AS tof_hi FROM {{ms1}}"
_IM_SQL = _IM.format(ms1="v_ms1", frames="v_frame_info")
_TRACES = f"""im AS ({_IM_SQL}), f AS (SELECT frame_id, row_number() OVER (ORDER BY time, frame_id) - 1 AS place FROM v_frame_info WHERE ms_type = 0),
s AS (SELECT im_id, scan_lo, scan_hi, greatest(a.place - 2, 0) AS lo, least(b.place + 2, (SELECT max(place) FROM f)) AS hi FROM im JOIN f a ON a.frame_id = frame_lo JOIN f b ON b.frame_id = frame_hi),
c AS (SELECT im_id, f.place, sum(p.intensity) AS i FROM s JOIN f ON f.place BETWEEN lo AND hi JOIN v_peaks p ON p.frame_id = f.frame_id AND p.scan BETWEEN scan_lo AND scan_hi GROUP BY im_id, f.place),
d AS (SELECT im_id, lo, unnest(range(lo, hi + 1)) AS place FROM s WHERE im_id IN (SELECT im_id FROM c)),
t AS (SELECT d.im_id, d.lo, d.place, coalesce(c.i, 0) AS i FROM d LEFT JOIN c ON c.im_id = d.im_id AND c.place = d.place)"""


def _im(v):
    return v.spark.sql(_IM.replace("{ms1}", "{a}").replace("{frames}", "{b}"), a=v.ms1, b=v.frame_info)


def _traces(v):
    return C.rt_traces(v.peaks, _im(v), v.frame_info.where("ms_type = 0"), "ms_type", pad=2)


R.add("i203_rt_traces", lambda v: _traces(v).select("im_id", "lo", F.posexplode("trace").alias("k", "intensity")).select("im_id", (F.col("lo") + F.col("k")).alias("place"), "intensity"), f"WITH {_TRACES} SELECT im_id, CAST(place AS INT) AS place, i AS intensity FROM t", "ms1 frame_info peaks")
R.add("i203_expand", lambda v: C.rt_peaks(_traces(v), smooth_s=1.0, noise_factor=1.0, min_distance_s=3.0).select("im_id", "place", "frame_lo", "frame_hi", "fallback"))
_FALLBACK = f"""{_TRACES}, y AS (SELECT im_id, lo, list(CAST(i AS DOUBLE) ORDER BY place) AS y FROM t GROUP BY im_id, lo),
a AS (SELECT *, len(y) AS n, list_max(y) AS top, list_position(y, list_max(y)) - 1 AS apex, list_max(y) * 0.1 AS level FROM y),
b AS (SELECT *, coalesce(list_max(list_filter(range(n), lambda k: y[k + 1] <= level AND k < apex)), 0) AS l, coalesce(list_min(list_filter(range(n), lambda k: y[k + 1] <= level AND k > apex)), n - 1) AS r FROM a),
e AS (SELECT *, CASE WHEN apex > 0 THEN l + coalesce((level - y[l + 1]) / nullif(y[l + 2] - y[l + 1], 0), 0) ELSE 0 END AS left_x,
  CASE WHEN apex < n - 1 THEN r - 1 + coalesce((level - y[r]) / nullif(y[r + 1] - y[r], 0), 0) ELSE n - 1 END AS right_x FROM b),
g AS (SELECT *, greatest(left_x, 0) AS p, least(right_x, n - 1) AS q FROM e)"""
R.add(
    "i204_fallback_peak",
    lambda v: _traces(v).select("im_id", C.fallback_peak(F.col("trace")).alias("p")).select("im_id", F.col("p.apex").alias("apex"), "p.height", "p.prominence", *[r6(f"p.{c}").alias(c) for c in ("mu", "left", "right", "area")]),
    f"""WITH {_FALLBACK} SELECT im_id, CAST(apex AS INT) AS apex, top AS height, top - list_min(y) AS prominence, {_R6('list_sum(list_transform(range(n), lambda k: k * y[k + 1])) / list_sum(y)')} AS mu, {_R6('left_x')} AS "left", {_R6('right_x')} AS "right",
  {_R6('coalesce(list_sum(list_transform(range(n - 1), lambda k: CASE WHEN least(q, k + 1) > greatest(p, k) THEN (y[k + 1] + (y[k + 2] - y[k + 1]) * (greatest(p, k) - k) + y[k + 1] + (y[k + 2] - y[k + 1]) * (least(q, k + 1) - k)) / 2 * (least(q, k + 1) - greatest(p, k)) ELSE 0 END)), 0)')} AS area FROM g""",
    "ms1 frame_info peaks",
)
R.add(
    "i212_boxes",
    lambda v: C.fallback_boxes(v.peaks, _im(v), v.frame_info.where("ms_type = 0"), "ms_type", n_places=v.frame_info.where("ms_type = 0").agg(F.count(F.lit(1))).scalar(), n_tof=v.peaks.agg(F.max("tof") + 1).scalar(), pad=2, rt_pad=1, im_pad=1),
    f"""WITH {_FALLBACK}, w AS (SELECT im.*, CAST(lo + least(greatest(floor(left_x), 0), n - 1) AS INT) AS f0, CAST(lo + least(greatest(ceil(right_x), 0), n - 1) AS INT) AS f1, greatest(scan_lo - 1, 0) AS a, scan_hi + 1 AS b,
  CAST(greatest(10, scan_hi - scan_lo + 1, CASE WHEN scan_sigma > 0 THEN ceil(6 * scan_sigma) + 1 ELSE 0 END) AS INT) AS want FROM g JOIN im USING (im_id))
SELECT im_id, greatest(least(f0, f1) - 1, 0) AS rt_lo, CAST(least(greatest(f0, f1) + 1, (SELECT max(place) FROM f)) AS INT) AS rt_hi, CASE WHEN b - a + 1 < want THEN least(a, greatest(scan - want // 2, 0)) ELSE a END AS scan_lo,
  CASE WHEN b - a + 1 < want THEN greatest(b, scan + want - 1 - want // 2) ELSE b END AS scan_hi, 0 AS tof_lo, (SELECT max(tof) FROM v_peaks) AS tof_hi FROM w""",
    "ms1 frame_info peaks",
)
R.add("i213_cluster_run", lambda v: C.run(v.peaks.where("ms_type = 0").select("frame_id", "scan", "tof", "intensity"), _im(v), v.frame_info.where("ms_type = 0"), "ms_type", mz_of=lambda t: Y.boundary_tof_to_mz(t, 100.0, 1700.0, 600_000), smooth_s=1.0))
_FIRST = "(cluster_id % (SELECT count(*) FROM {b}) + (SELECT min(frame_id) FROM {c}))"
_SPEC = f"SELECT cluster_id, CAST({_FIRST} AS INT) AS frame_id_lo, CAST({_FIRST} + 8 AS INT) AS frame_id_hi, im_lo AS scan_lo, im_hi AS scan_hi, CAST(0 AS INT) AS tof_lo, CAST((SELECT max(tof) FROM {{c}}) AS INT) AS tof_hi FROM {{a}}"


def _spec(v):
    return v.spark.sql(_SPEC, a=v.ms1, b=v.frame_info, c=v.peaks)


def _moments_sql(box: str, name: str) -> str:
    mom = ", ".join(f"sum(intensity * p.{a}) / sum(intensity) AS mu_{a}, sqrt(greatest(sum(intensity * CAST(p.{a} AS DOUBLE) * p.{a}) / sum(intensity) - (sum(intensity * p.{a}) / sum(intensity)) ** 2, 0)) AS sigma_{a}" for a in ("frame_id", "scan", "tof"))
    return f"{name} AS (SELECT cluster_id, count(*) AS n, sum(intensity) AS raw_sum, {mom} FROM {box} b JOIN v_peaks p ON p.frame_id BETWEEN frame_id_lo AND frame_id_hi AND p.scan BETWEEN scan_lo AND scan_hi AND p.tof BETWEEN tof_lo AND tof_hi GROUP BY cluster_id)"


_BOX_SQL = "s AS (" + _SPEC.format(a="v_ms1", b="v_frame_info", c="v_peaks") + ")"
_R3 = lambda c: f"round(({c}) * 1e3) / 1e3"
R.add("i211_box_moments", lambda v: C.box_moments(v.peaks, _spec(v)).select("cluster_id", "n", "raw_sum", *[(F.round(F.col(f"mu_{a}") * 1e3) / 1e3).alias(f"mu_{a}") for a in ("frame_id", "scan", "tof")]), f"WITH {_BOX_SQL}, {_moments_sql('s', 'm')} SELECT cluster_id, n, raw_sum, {', '.join(f'{_R3(f'mu_{a}')} AS mu_{a}' for a in ('frame_id', 'scan', 'tof'))} FROM m", "ms1 frame_info peaks")
_CUT = ", ".join(f"greatest({a}_lo, CAST(floor(mu_{a} - greatest(3 * sigma_{a}, 0.5)) AS INT)) AS {a}_lo, least({a}_hi, CAST(ceil(mu_{a} + greatest(3 * sigma_{a}, 0.5)) AS INT)) AS {a}_hi" for a in ("frame_id", "scan", "tof"))
R.add("i211_refined", lambda v: C.refine(v.peaks, _spec(v)).select("cluster_id", "n", "raw_sum"), f"WITH {_BOX_SQL}, {_moments_sql('s', 'm')}, c AS (SELECT cluster_id, {_CUT} FROM s JOIN m USING (cluster_id)), {_moments_sql('c', 'k')} SELECT cluster_id, n, raw_sum FROM k", "ms1 frame_info peaks")
_MZ = lambda t: f"(10 + (sqrt(1700.0) - 10) / 600000 * ({t})) ** 2"
R.add("i217_decorate", lambda v: C.decorate(C.box_moments(v.peaks, _spec(v)), lambda t: Y.boundary_tof_to_mz(t, 100.0, 1700.0, 600_000)).select("cluster_id", *[(F.round(F.col(c) * 1e3) / 1e3).alias(c) for c in ("mz_mu", "mz_sigma")]), f"WITH {_BOX_SQL}, {_moments_sql('s', 'm')} SELECT cluster_id, {_R3(_MZ('mu_tof'))} AS mz_mu, {_R3(f'({_MZ('mu_tof + sigma_tof')} - {_MZ('mu_tof - sigma_tof')}) / 2')} AS mz_sigma FROM m", "ms1 frame_info peaks")


def _pair_rows(v):
    """Candidate pairs with fits made of their bounds."""
    p = pairs(v)
    for s in "ab":
        p = p.withColumns({f"{s}_rt_mu": (F.col(f"{s}_rt_lo") + F.col(f"{s}_rt_hi")) / 2, f"{s}_rt_sigma": (F.col(f"{s}_rt_hi") - F.col(f"{s}_rt_lo")) / 6, f"{s}_im_mu": (F.col(f"{s}_im_lo") + F.col(f"{s}_im_hi")) / 2, f"{s}_im_sigma": (F.col(f"{s}_im_hi") - F.col(f"{s}_im_lo")) / 6})
    return C.pair_features(p)


_GEO = """WITH p AS (SELECT a.cluster_id AS ms1_id, b.cluster_id AS ms2_id, a.raw_sum, a.rt_lo AS l1, a.rt_hi AS h1, b.rt_lo AS l2, b.rt_hi AS h2, abs((a.rt_lo + a.rt_hi) / 2 - (b.rt_lo + b.rt_hi) / 2) AS d, abs((a.im_lo + a.im_hi) / 2 - (b.im_lo + b.im_hi) / 2) AS e,
  greatest((a.rt_hi - a.rt_lo) / 6, 0.05) AS s1, greatest((b.rt_hi - b.rt_lo) / 6, 0.05) AS s2, greatest((a.im_hi - a.im_lo) / 6, 0.5) AS i1, greatest((b.im_hi - b.im_lo) / 6, 0.5) AS i2, greatest(least(a.im_hi, b.im_hi) - greatest(a.im_lo, b.im_lo) + 1, 0) AS o, greatest(a.im_hi, b.im_hi) - least(a.im_lo, b.im_lo) + 1 AS u,
  (least(a.rt_hi, b.rt_hi) - greatest(a.rt_lo, b.rt_lo) + 1) / ((a.rt_hi - a.rt_lo + 1) + (b.rt_hi - b.rt_lo + 1) - (least(a.rt_hi, b.rt_hi) - greatest(a.rt_lo, b.rt_lo) + 1)) AS j
  FROM v_ms1 a JOIN v_ms2 b ON a.window_group = b.window_group AND a.rt_lo <= b.rt_hi AND b.rt_lo <= a.rt_hi AND least(a.im_hi, b.im_hi) - greatest(a.im_lo, b.im_lo) + 1 >= 6),
q AS (SELECT *, greatest(least(h1, h2) - greatest(l1, l2), 0) / (greatest(h1, h2) - least(l1, l2)) AS jac, exp(-0.5 * (d * d / (0.5 * (s1 * s1 + s2 * s2)) + e * e / (0.5 * (i1 * i1 + i2 * i2)))) AS shape FROM p WHERE j >= 0.5)"""
R.add("i276_geometric_score", lambda v: _pair_rows(v).select("ms1_id", "ms2_id", r6("jaccard_rt").alias("jaccard_rt"), r6("shape").alias("shape"), r6(C.geometric_score(F.col("a_raw_sum"))).alias("score")), f"{_GEO} SELECT ms1_id, ms2_id, {_R6('jac')} AS jaccard_rt, {_R6('shape')} AS shape, {_R6('jac + shape + 0.75 * exp(-d / 0.75) + 0.75 * exp(-e / 3) + 0.5 * o / u + 0.25 * ln(1 + raw_sum)')} AS score FROM q", "ms1 ms2")
_EMB = "e AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS p, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vectors(v):
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")


def _corr(a: str, b: str, n: int) -> str:
    m = lambda t: f"list_sum(list_transform(range(1, {n + 1}), lambda k: {t})) / {n}"
    return f"greatest(-1, least(1, ({m(f'{a}[k] * {b}[k]')} - {m(f'{a}[k]')} * {m(f'{b}[k]')}) / sqrt(({m(f'{a}[k] * {a}[k]')} - ({m(f'{a}[k]')}) ** 2) * ({m(f'{b}[k] * {b}[k]')} - ({m(f'{b}[k]')}) ** 2))))"


R.add(
    "i277_xic_score",
    lambda v: _vectors(v).select("vec_id", r6(C.xic_score(F.col("p"), F.col("q"), F.slice("p", 1, 9), F.slice("q", 1, 9), F.lit(1.0), F.lit(1.0))).alias("score")),
    f"WITH {_EMB} SELECT vec_id, {_R6(f'0.45 * 0.5 * ({_corr('p', 'q', 64)} + 1) + 0.45 * 0.5 * ({_corr('p', 'q', 9)} + 1) + 0.1 * exp(-abs(ln(list_sum(list_transform(q, lambda x: greatest(x, 0))) / list_sum(list_transform(p, lambda x: greatest(x, 0))))) / 1.5)')} AS score FROM e",
)
R.add("i335_axis_scales", lambda v: v.peaks.groupBy("frame_id").agg((F.max("mz") - F.min("mz")).alias("span"), F.avg("mz").alias("centre")).select("frame_id", r6(C.axis_scale(F.col("span"), F.col("centre") / 40000 * 3, 0.05)).alias("scale"), r6(C.axis_reach(0.05, F.col("span"), C.axis_scale(F.col("span"), F.lit(2.0), 0.05))).alias("reach")), f"SELECT frame_id, {_R6('CASE WHEN max(mz) > min(mz) THEN 0.05 * (max(mz) - min(mz)) / (2 * avg(mz) / 40000 * 3) ELSE 1 END')} AS scale, {_R6('CASE WHEN max(mz) > min(mz) THEN 2.0 ELSE 0 END')} AS reach FROM v_peaks GROUP BY frame_id", "peaks")

# simulated runs: one peptide a frame, elution profiles of one shape


def _profiles(v):
    return v.frame_info.select(F.col("frame_id").alias("peptide_id"), F.col("time").cast("double").alias("mu"), F.lit(2.0).alias("sigma"), F.lit(0.5).alias("lam"))


def _erfc_sql(z: str) -> str:
    t = f"(1 / (1 + 0.5 * abs({z})))"
    p = str(Y.ERF[-1])
    for c in reversed(Y.ERF[:-1]):
        p = f"({c} + {t} * {p})"
    return f"CASE WHEN {z} >= 0 THEN {t} * exp(-({z}) * ({z}) + {p}) ELSE 2 - {t} * exp(-({z}) * ({z}) + {p}) END"


def _mass_sql(lo: str, hi: str, mu: str, steps: int) -> str:
    """Riemann sum of the profile (sigma 2, lambda 0.5) with ``steps`` terms."""
    z = f"(({mu} + 2.0 - x) / {math.sqrt(2.0) * 2.0})"
    return f"(SELECT sum(0.25 * exp(0.25 * (2 * {mu} + 2.0 - 2 * x)) * ({_erfc_sql(z)})) * (({hi}) - ({lo})) / {steps} FROM (SELECT ({lo}) + k * (({hi}) - ({lo})) / {steps} AS x FROM range({steps}) r(k)) g)"


_SUPPORT = f"""q AS (SELECT frame_id AS peptide_id, time AS mu FROM v_frame_info), g AS (SELECT i FROM range(163) r(i)),
u AS (SELECT peptide_id, mu, min(i) AS hi FROM q, g WHERE i > 0 AND {_mass_sql('mu - 42', 'mu - 42 + i', 'mu', 60)} >= 0.9 GROUP BY ALL),
w AS (SELECT peptide_id, mu, max(i) AS lo, hi FROM u, g WHERE i < hi AND {_mass_sql('mu - 42 + i', 'mu - 42 + hi', 'mu', 60)} >= 0.9 GROUP BY ALL)"""
_OCC = f"""{_SUPPORT}, n AS (SELECT peptide_id, mu, arg_min(frame_id, {{'d': abs(time - (mu - 42 + lo)), 't': time}}) AS f0, arg_min(frame_id, {{'d': abs(time - (mu - 42 + hi)), 't': time}}) AS f1 FROM w, v_frame_info GROUP BY peptide_id, mu)"""
_occ = lambda v: S.frame_occurrence(_profiles(v), v.frame_info, 0.9, 1.0, 60)
R.add("i258_frame_occurrence", lambda v: _occ(v).select("peptide_id", "first", "last"), f'WITH {_OCC} SELECT peptide_id, least(f0, f1) AS "first", greatest(f0, f1) AS "last" FROM n', "frame_info")
R.add("i259_frame_abundance", lambda v: S.frame_abundance(_occ(v), v.frame_info, 1.0, 40).select("peptide_id", "frame_id", r6("abundance").alias("abundance")), f"WITH {_OCC} SELECT peptide_id, frame_id, {_R6(_mass_sql('time - 1', 'time', 'mu', 40))} AS abundance FROM n JOIN v_frame_info f ON f.frame_id BETWEEN f0 AND f1", "frame_info")
R.add("i260_event_abundance", lambda v: S.event_abundance(_profiles(v), v.frame_info.select(F.col("frame_id").alias("event"), F.col("time").cast("double").alias("start"), (F.col("time") + 0.25 * (F.col("frame_id") % 3 + 1)).alias("end")), 0.9, 1.0, 60).select("peptide_id", "event", r6("abundance").alias("abundance")), f"WITH {_SUPPORT}, e AS (SELECT frame_id AS event, CAST(time AS DOUBLE) AS a, time + 0.25 * (frame_id % 3 + 1) AS b FROM v_frame_info) SELECT peptide_id, event, {_R6(_mass_sql('a', 'b', 'mu', 60))} AS abundance FROM w JOIN e ON b >= mu - 42 + lo AND a <= mu - 42 + hi", "frame_info")
R.add("i284_profile_parameters", lambda v: v.table("peptides").select("row_id", S.scaled_beta(1.0, 5.0, 2, 3, 7, "row_id").alias("sigma"), S.scaled_beta(0.5, 2.0, 2, 2, 8, "row_id").alias("k")).withColumn("lam", 1 / (F.col("k") * F.col("sigma"))).select("row_id", "sigma", "lam", S.mu_of_mode(F.lit(600.0), F.col("sigma"), F.col("lam")).alias("mu")))


def _newton_sql() -> str:
    """Rows of (place, y, x) after ten Newton steps."""
    e = f"exp(x * x) * ({_erfc_sql('x')})"
    return f"WITH RECURSIVE s AS (SELECT p_partkey, CAST(0 AS INT) AS k, CAST(p_size AS DOUBLE) / 10 AS y, CASE WHEN p_size < 20 THEN 1 / (p_size / 10.0::DOUBLE * {math.sqrt(math.pi)}) ELSE -sqrt(ln(p_size / 20.0::DOUBLE)) END AS x FROM part UNION ALL SELECT p_partkey, k + 1, y, x - ({e} - y) / (2 * x * {e} - {2 / math.sqrt(math.pi)}) FROM s WHERE k < 10) SELECT p_partkey, round(x * 1e4) / 1e4 AS x FROM s WHERE k = 10"


R.add("i284_erfcx_inverse", lambda v: v.table("part").select("p_partkey", (F.round(S.erfcx_inverse(F.col("p_size").cast("double") / 10) * 1e4) / 1e4).alias("x")), _newton_sql())
R.add(
    "i434_series_intensity",
    lambda v: _vectors(v).select("vec_id", F.explode(F.zip_with(F.sequence(F.lit(0), F.lit(63)), S.series_intensity(F.col("p"), F.get(F.array(F.lit("none"), F.lit("precursor"), F.lit("fragment")), (F.col("vec_id") % 3).cast("int")), F.lit(3.0), F.lit(0.5), F.when(F.col("vec_id") % 2 == 0, F.col("q"))), lambda i, x: F.struct(i.alias("i"), x.alias("x")))).alias("s")).select("vec_id", "s.i", r6("s.x").alias("x")),
    f"WITH {_EMB} SELECT vec_id, CAST(k AS INT) AS i, {_R6('CASE WHEN vec_id % 3 = 1 THEN p[k + 1] * 1.5 WHEN vec_id % 3 = 2 AND vec_id % 2 = 0 THEN q[k + 1] * 3 ELSE p[k + 1] * 3 END')} AS x FROM e, range(64) r(k)",
)
R.add("i346_sample_peptides", lambda v: S.sample_peptides(v.table("peptides").where("protein_id is not null").select("protein_id", F.col("row_id").alias("peptide_id")), 500))
_sources = lambda v: v.dia_info.select(F.col("frame_id").alias("source_id"), "window_group")
R.add("i348_pasef_noise", lambda v: S.sample_pasef_noise(v.frame_info.select("frame_id", (F.col("frame_id") * 37 % 500).alias("scan_center")), v.pasef.select(F.col("precursor_id").alias("window_id"), F.col("frame_id").alias("source_id"), "scan_begin", "scan_end"), v.peaks, 3, 0.5, 10))
R.add("i349_dia_noise", lambda v: S.sample_noise(v.dia_info, _sources(v), v.peaks.select("frame_id", "scan", "tof", "mz", "intensity"), 4, 0.25, by="window_group"))
R.add("i349_dia_noise_all", lambda v: S.sample_noise(v.dia_info.select("frame_id", "window_group").where("window_group = 2"), v.dia_info.where("window_group = 2").orderBy("frame_id").limit(1).select(F.col("frame_id").alias("source_id"), "window_group"), v.peaks, 2, 1.1, by="window_group"), "WITH t AS (SELECT frame_id FROM v_dia_info WHERE window_group = 2) SELECT t.frame_id, scan, CAST(round(mz * 1000000) AS BIGINT) AS k, 2 * sum(intensity) AS intensity FROM t, v_peaks p WHERE p.frame_id = (SELECT min(frame_id) FROM t) GROUP BY t.frame_id, scan, CAST(round(mz * 1000000) AS BIGINT)", "dia_info peaks")
R.add("i450_efficiency", lambda v: S.with_noise(v.table("peptides").select("row_id", "events", S.log_normal_efficiency(keys=["row_id"]).alias("efficiency")), "events", 10.0, 5, "row_id"))
R.add("i450_noise_none", lambda v: S.with_noise(v.table("peptides").where("events >= 0").select("row_id", "events"), "events", 0.0, 5, "row_id", log=True).select("row_id", r6("events").alias("events")), f"SELECT row_id, {_R6('events')} AS events FROM peptides WHERE events >= 0")
R.add("i451_dilution", lambda v: S.dilute(v.table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), v.table("nation").where("n_nationkey < 3").select(F.get(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")), F.col("n_nationkey").cast("int")).alias("o_orderpriority"), (F.col("n_nationkey") / 4.0).alias("factor")), "o_orderpriority", "o_totalprice").select("o_orderkey", r6("o_totalprice").alias("amount")), f"SELECT o_orderkey, {_R6("o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 0.25 WHEN '3-MEDIUM' THEN 0.5 ELSE 1.0 END")} AS amount FROM orders")
R.add("i451_rescale", lambda v: S.rescale(v.table("peptides").where("monoisotopic_mass is not null").select("row_id", F.col("monoisotopic_mass").alias("rt")), "rt", 0.0, 120.0).select("row_id", r6("rt").alias("rt")), f"SELECT row_id, {_R6('(monoisotopic_mass - min(monoisotopic_mass) OVER ()) * 120 / (max(monoisotopic_mass) OVER () - min(monoisotopic_mass) OVER ())')} AS rt FROM peptides WHERE monoisotopic_mass IS NOT NULL")
_LE = lambda p: f"unhex(lpad(hex(octet_length(encode({p}))), 2, '0') || '00000000000000') || encode({p})"
R.add("i456_stable_keys", lambda v: v.table("parse_diann_report").where("sequence is not null and charge is not null").select("row_id", S.stable_key(F.col("sequence"), F.col("charge"), F.lit(0)).alias("analyte")), f"SELECT row_id, substr(sha256({_LE('sequence')} || {_LE('CAST(charge AS VARCHAR)')} || {_LE("'0'")}), 1, 32) AS analyte FROM parse_diann_report WHERE sequence IS NOT NULL AND charge IS NOT NULL")
R.add("i456_conditions", lambda v: S.with_condition(v.table("region")).select("r_regionkey", "condition_id", S.schema_version(v.spark, 1).select("value").scalar().alias("value"), *[S.experiment_conditions(v.spark, source="sim", gradient_length_s=3600.0).select(c).scalar().alias(n) for c, n in (("condition_id", "c"), ("source", "source"), ("gradient_length_s", "gradient_length_s"))]), "SELECT r_regionkey, CAST(NULL AS BIGINT) AS condition_id, CAST(1 AS BIGINT) AS value, CAST(1 AS BIGINT) AS c, 'sim' AS source, 3600.0::DOUBLE AS gradient_length_s FROM region")

QUERIES, ORACLES = R.queries, R.oracles
