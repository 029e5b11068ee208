"""Queries over joins, matches, evaluation and clusters. Names begin with the operator's inventory number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ionweave.functions import physics as Y
from ionweave.operators import clustering as K
from ionweave.operators import evaluation as E
from ionweave.operators import greedy as G
from ionweave.operators import hashing as H
from ionweave.operators import joins as J
from ionweave.operators import windows as W
from ionweave.plans.peak_queries import _R6, r6
from ionweave.plans.registry import Registry

R = Registry()

_PASEF = """SELECT p.precursor_id, k.frame_id, k.scan, k.tof, k.intensity, p.collision_energy FROM v_pasef p JOIN v_peaks k ON k.frame_id = p.frame_id
  AND k.scan BETWEEN p.scan_begin - (p.scan_end - p.scan_begin) // 20 AND p.scan_end + (p.scan_end - p.scan_begin) // 20"""


def pasef_extract(v):
    """Selections with their scan margin of a twentieth, met with peaks by frame and scan bucket."""
    margin = F.floor((F.col("scan_end") - F.col("scan_begin")) / 20).cast("int")
    sel = v.pasef.withColumn("lo", F.col("scan_begin") - margin).withColumn("hi", F.col("scan_end") + margin).select("precursor_id", "frame_id", "lo", "hi", "collision_energy")
    return J.point_in_interval(v.peaks, sel, "scan", ("lo", "hi"), 32.0, ["frame_id"]).select("precursor_id", "frame_id", "scan", "tof", "intensity", "collision_energy")


R.add("i067_pasef_extract", lambda v: pasef_extract(v).groupBy("precursor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")), f"SELECT precursor_id, count(*) AS n, sum(intensity) AS intensity FROM ({_PASEF}) x GROUP BY precursor_id", "pasef peaks")
R.add("i069_step_filter", lambda v: J.point_in_interval(v.peaks.join(v.dia_info, "frame_id").select("window_group", "scan", "tof", "intensity"), W.islands(v.windows, "scan_begin", "scan_end", "window_group"), "scan", ("scan_begin", "scan_end"), 64.0, ["window_group"]).select("window_group", "scan", "tof", "intensity"), "SELECT d.window_group, p.scan, p.tof, p.intensity FROM v_peaks p JOIN v_dia_info d USING (frame_id) WHERE EXISTS (SELECT 1 FROM v_windows w WHERE w.window_group = d.window_group AND p.scan BETWEEN w.scan_begin AND w.scan_end)", "peaks dia_info windows")
R.add("i080_pasef_join", lambda v: v.table("pasefframemsmsinfo").select(F.col("precursor").alias("precursor_id"), "frame", "collisionenergy", F.col("row_id").alias("sel")).join(v.table("precursors").select(F.col("id").alias("precursor_id"), "charge", F.col("row_id").alias("prec")), "precursor_id").join(v.table("frames").select(F.col("id").alias("frame"), "time_s"), "frame"), "SELECT s.precursor AS precursor_id, s.frame, s.collisionenergy, s.row_id AS sel, p.charge, p.row_id AS prec, f.time_s FROM pasefframemsmsinfo s JOIN precursors p ON p.id = s.precursor JOIN frames f ON f.id = s.frame")
R.add("i081_last_selection", lambda v: v.table("precursors").select("row_id", "id").join(v.table("pasefframemsmsinfo").where("precursor is not null").groupBy("precursor").agg(F.max_by(F.struct("frame", "collisionenergy"), "row_id").alias("s")).select(F.col("precursor").alias("id"), "s.frame", "s.collisionenergy"), "id"), "SELECT p.id, p.row_id, s.frame, s.collisionenergy FROM precursors p JOIN (SELECT *, row_number() OVER (PARTITION BY precursor ORDER BY row_id DESC) AS r FROM pasefframemsmsinfo WHERE precursor IS NOT NULL) s ON s.precursor = p.id AND s.r = 1")
R.add("i082_ions_peptides", lambda v: v.table("peptides").select("row_id", "monoisotopic_mass").withColumn("charge", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).withColumn("mz", r6(Y.mz_of_mass(F.col("monoisotopic_mass"), F.col("charge")))).where("mz between 400 and 1200").select("row_id", "charge", "mz"), f"SELECT row_id, charge, {_R6('(monoisotopic_mass + charge * 1.007276466621) / charge')} AS mz FROM peptides, (SELECT unnest([1, 2, 3, 4]) AS charge) z WHERE {_R6('(monoisotopic_mass + charge * 1.007276466621) / charge')} BETWEEN 400 AND 1200")


def three_way(v):
    matched, missed, false = E.match_results(v.truth.where("intensity > 0"), v.report, ["seq_id", "charge"])
    kinds = [matched.select("seq_id", "charge", F.lit("matched").alias("kind"), F.col("r_q").alias("q")), missed.select("seq_id", "charge", F.lit("missed").alias("kind"), F.lit(None).cast("double").alias("q")), false.select("seq_id", "charge", F.lit("false").alias("kind"), F.col("r_q").alias("q"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


R.add("i085_match_results", three_way, "WITH r AS (SELECT seq_id, charge, min(q) AS q FROM v_report GROUP BY ALL) SELECT t.seq_id, t.charge, 'matched' AS kind, q FROM v_truth t JOIN r USING (seq_id, charge) UNION ALL SELECT t.seq_id, t.charge, 'missed', NULL FROM v_truth t ANTI JOIN r USING (seq_id, charge) UNION ALL SELECT r.seq_id, r.charge, 'false', q FROM r ANTI JOIN v_truth t USING (seq_id, charge)", "truth report")
R.add("i086_correlation_join", lambda v: E.correlation(v.truth.join(v.report.select("seq_id", "charge", F.col("intensity").alias("found")), ["seq_id", "charge"]), "intensity", "found", "charge").select("charge", "n", r6("pearson").alias("pearson"), r6("mae").alias("mae"), r6("median_error").alias("median_error")), f"SELECT charge, count(*) AS n, {_R6('corr(t.intensity, r.intensity)')} AS pearson, {_R6('avg(abs(t.intensity - r.intensity))')} AS mae, {_R6('quantile_cont(abs(t.intensity - r.intensity), 0.5)')} AS median_error FROM v_truth t JOIN v_report r USING (seq_id, charge) GROUP BY charge", "truth report")

_WIN = "(SELECT * FROM (SELECT d.frame_id, s.scan, w.*, row_number() OVER (PARTITION BY d.frame_id, s.scan ORDER BY row_order DESC) AS r FROM v_dia_info d JOIN (SELECT DISTINCT frame_id, scan FROM v_peaks) s USING (frame_id) JOIN v_windows w ON w.window_group = d.window_group AND s.scan BETWEEN w.scan_begin AND w.scan_end) x WHERE r = 1)"


def settings(v):
    return J.last_window(v.peaks.join(v.dia_info, "frame_id").select("window_group", "frame_id", "scan"), v.windows, ["window_group"])


def transmitted(v):
    """Peaks with the probability of passing their window: survey peaks pass, fragment peaks without a setting do not."""
    p = v.peaks.join(v.dia_info, "frame_id", "left").join(settings(v), ["window_group", "scan"], "left")
    prob = F.when(F.col("window_group").isNull(), 1.0).when(F.col("isolation_mz").isNull(), 0.0).otherwise(J.logistic_window(F.col("mz"), F.col("isolation_mz"), F.col("isolation_width")))
    return p.withColumn("p", prob)


R.add("i089_transmission_lookup", lambda v: settings(v), "SELECT DISTINCT window_group, scan, isolation_mz, isolation_width, collision_energy, row_order FROM " + _WIN + " y", "peaks dia_info windows")
R.add("i090_window_setting", lambda v: settings(v).where("window_group = 2").select("scan", "isolation_mz"), "SELECT DISTINCT scan, isolation_mz FROM " + _WIN + " y WHERE window_group = 2", "peaks dia_info windows")
R.add("i091_collision_energy", lambda v: v.peaks.select("frame_id", "scan").distinct().join(v.dia_info, "frame_id", "left").join(settings(v), ["window_group", "scan"], "left").select("frame_id", "scan", F.coalesce("collision_energy", F.lit(0.0)).alias("collision_energy")), "SELECT s.frame_id, s.scan, coalesce(y.collision_energy, 0.0) AS collision_energy FROM (SELECT DISTINCT frame_id, scan FROM v_peaks) s LEFT JOIN " + _WIN + " y USING (frame_id, scan)", "peaks dia_info windows")
R.add("i092_dda_energy", lambda v: J.point_in_interval(v.peaks.select("frame_id", "scan").distinct(), v.pasef.select("frame_id", "scan_begin", "scan_end", "precursor_id", F.col("collision_energy").alias("ce")), "scan", ("scan_begin", "scan_end"), 32.0, ["frame_id"]).groupBy("frame_id", "scan").agg(F.min_by("ce", "precursor_id").alias("ce")), "SELECT s.frame_id, s.scan, arg_min(p.collision_energy, p.precursor_id) AS ce FROM (SELECT DISTINCT frame_id, scan FROM v_peaks) s JOIN v_pasef p ON p.frame_id = s.frame_id AND s.scan BETWEEN p.scan_begin AND p.scan_end GROUP BY ALL", "peaks pasef")
R.add("i093_precursor_selections", lambda v: v.pasef.groupBy("precursor_id").agg(F.count(F.lit(1)).alias("n"), F.min("collision_energy").alias("lo")), "SELECT precursor_id, count(*) AS n, min(collision_energy) AS lo FROM v_pasef GROUP BY precursor_id", "pasef")
R.add("i095_transmitted", lambda v: transmitted(v).where("p > 0.5 and window_group is not null").groupBy("frame_id", "scan").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")), "SELECT p.frame_id, p.scan, count(*) AS n, sum(p.intensity) AS intensity FROM v_peaks p JOIN " + _WIN + " y USING (frame_id, scan) WHERE 1 / (1 + exp(-15 * (mz - (isolation_mz - isolation_width / 2 - 0.25)))) - 1 / (1 + exp(-15 * (mz - (isolation_mz + isolation_width / 2 + 0.25)))) > 0.5 GROUP BY ALL", "peaks dia_info windows")
R.add("i265_transmit_frame", lambda v: transmitted(v).where("p > 0.5").select("frame_id", "scan", "tof", r6(F.col("intensity") * F.col("p")).alias("intensity")))
_tile = lambda v: v.windows.withColumn("mz_lo", F.col("isolation_mz") - F.col("isolation_width") / 2).withColumn("mz_hi", F.col("isolation_mz") + F.col("isolation_width") / 2)
R.add("i098_groups_for_point", lambda v: J.point_in_interval(v.table("precursors").where("averagemz is not null and scannumber is not null").select("row_id", F.col("averagemz").alias("mz"), (F.col("scannumber") / 2).alias("scan")), _tile(v).select("window_group", "scan_begin", "scan_end", "mz_lo", "mz_hi"), "mz", ("mz_lo", "mz_hi"), 64.0).where("scan between scan_begin and scan_end").select("row_id", "window_group").distinct(), "SELECT DISTINCT row_id, window_group FROM precursors p JOIN v_windows w ON averagemz BETWEEN isolation_mz - isolation_width / 2 AND isolation_mz + isolation_width / 2 AND scannumber / 2 BETWEEN scan_begin AND scan_end", "windows")
R.add("i099_tiles_for_precursor", lambda v: J.point_in_interval(v.ms1.select("cluster_id", F.col("mz"), "im_lo"), _tile(v).select("window_group", "row_order", "scan_begin", "scan_end", "mz_lo", "mz_hi"), "mz", ("mz_lo", "mz_hi"), 64.0).where("im_lo between scan_begin and scan_end").select("cluster_id", "window_group", "row_order"), "SELECT cluster_id, w.window_group, row_order FROM v_ms1 m JOIN v_windows w ON m.mz BETWEEN isolation_mz - isolation_width / 2 AND isolation_mz + isolation_width / 2 AND im_lo BETWEEN scan_begin AND scan_end", "ms1 windows")
R.add("i100_tiles_for_fragment", lambda v: J.bucketed_interval_join(v.ms2.select("cluster_id", "window_group", "im_lo", "im_hi"), v.windows.select("window_group", "row_order", "scan_begin", "scan_end"), ("im_lo", "im_hi"), ("scan_begin", "scan_end"), 64.0, ["window_group"]).groupBy("window_group", "row_order").agg(F.count(F.lit(1)).alias("n")), "SELECT w.window_group, row_order, count(*) AS n FROM v_ms2 m JOIN v_windows w ON m.window_group = w.window_group AND im_lo <= scan_end AND scan_begin <= im_hi GROUP BY ALL", "ms2 windows")

_PAIRS = """SELECT a.cluster_id AS ms1_id, b.cluster_id AS ms2_id, a.window_group, a.raw_sum AS a_raw_sum, b.raw_sum AS b_raw_sum, b.mz AS b_mz, b.rt_lo AS b_rt_lo, b.im_lo AS b_im_lo,
  (least(a.rt_hi, b.rt_hi) - greatest(a.rt_lo, b.rt_lo) + 1) / ((a.rt_hi - a.rt_lo + 1) + (b.rt_hi - b.rt_lo + 1) - (least(a.rt_hi, b.rt_hi) - greatest(a.rt_lo, b.rt_lo) + 1)) AS jaccard,
  least(a.im_hi, b.im_hi) - greatest(a.im_lo, b.im_lo) + 1 AS im_overlap
  FROM v_ms1 a JOIN v_ms2 b ON a.window_group = b.window_group AND a.rt_lo <= b.rt_hi AND b.rt_lo <= a.rt_hi AND least(a.im_hi, b.im_hi) - greatest(a.im_lo, b.im_lo) + 1 >= 6"""


def pairs(v):
    return J.candidates(v.ms1, v.ms2, 0.5, min_im_overlap=6)


_best = lambda: (F.desc("jaccard"), F.desc("im_overlap"), F.desc("a_raw_sum"), F.asc("ms1_id"))
_MS2 = ["ms2_id", "b_mz", "b_rt_lo", "b_im_lo", "b_raw_sum"]
R.add("i101_candidates", lambda v: pairs(v).groupBy("window_group").agg(F.count(F.lit(1)).alias("n"), F.sum("im_overlap").cast("long").alias("overlap"), F.sum("ms1_id").alias("ids")), f"SELECT window_group, count(*) AS n, CAST(sum(im_overlap) AS BIGINT) AS overlap, CAST(sum(ms1_id) AS BIGINT) AS ids FROM ({_PAIRS}) p WHERE jaccard >= 0.5 GROUP BY window_group", "ms1 ms2")
R.add("i103_rt_buckets", lambda v: v.ms1.select("cluster_id", F.explode(F.sequence(F.floor(F.col("rt_lo") / 4), F.floor(F.col("rt_hi") / 4))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "SELECT bucket, count(*) AS n FROM (SELECT unnest(range(rt_lo // 4, rt_hi // 4 + 1)) AS bucket FROM v_ms1) x GROUP BY bucket", "ms1")
R.add("i106_best_ms1", lambda v: J.best_match(pairs(v), ["window_group", *_MS2], *_best()).groupBy("ms1_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b_raw_sum").alias("raw_sum")), f"SELECT ms1_id, count(*) AS n, sum(b_raw_sum) AS raw_sum FROM (SELECT *, row_number() OVER (PARTITION BY window_group, ms2_id, b_mz, b_rt_lo, b_im_lo, b_raw_sum ORDER BY jaccard DESC, im_overlap DESC, a_raw_sum DESC, ms1_id) AS r FROM ({_PAIRS}) p WHERE jaccard >= 0.5) x WHERE r = 1 GROUP BY ms1_id", "ms1 ms2")


def scored(v):
    ratio = F.exp(-F.abs(F.ln(F.col("b_raw_sum") / F.col("a_raw_sum"))) / 1.5)
    return pairs(v).where("a_raw_sum > 0 and b_raw_sum > 0").withColumn("score", r6((F.col("jaccard") + 0.25 * ratio) / 1.25))


R.add("i107_best_by_score", lambda v: J.best_match(scored(v), ["window_group", *_MS2], F.desc("score"), F.asc("ms1_id")).groupBy("ms1_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT ms1_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY window_group, ms2_id, b_mz, b_rt_lo, b_im_lo, b_raw_sum ORDER BY {_R6('(jaccard + 0.25 * exp(-abs(ln(b_raw_sum / a_raw_sum)) / 1.5)) / 1.25')} DESC, ms1_id) AS r FROM ({_PAIRS}) p WHERE jaccard >= 0.5 AND a_raw_sum > 0 AND b_raw_sum > 0) x WHERE r = 1 GROUP BY ms1_id", "ms1 ms2")
R.add("i109_reverse_map", lambda v: J.best_match(pairs(v), ["window_group", *_MS2], *_best()).groupBy("ms1_id").agg(F.size(F.collect_list("ms2_id")).alias("members")), f"SELECT ms1_id, CAST(count(*) AS INT) AS members FROM (SELECT *, row_number() OVER (PARTITION BY window_group, ms2_id, b_mz, b_rt_lo, b_im_lo, b_raw_sum ORDER BY jaccard DESC, im_overlap DESC, a_raw_sum DESC, ms1_id) AS r FROM ({_PAIRS}) p WHERE jaccard >= 0.5) x WHERE r = 1 GROUP BY ms1_id", "ms1 ms2")
R.add("i224_pseudo_spectra", lambda v: J.best_match(J.best_match(pairs(v), ["window_group", *_MS2], *_best()).withColumn("g", F.col("ms1_id")), ["window_group", "g", "ms2_id"], F.desc("b_raw_sum"), F.asc("b_mz"), F.asc("b_rt_lo"), F.asc("b_im_lo")).withColumn("_r", F.row_number().over(Window.partitionBy("window_group", "ms1_id").orderBy(F.desc("b_raw_sum"), "b_mz", "ms2_id", "b_rt_lo", "b_im_lo"))).where("_r <= 5").groupBy("window_group", "ms1_id").agg(F.array_sort(F.collect_list("b_mz")).alias("mz")).select("window_group", "ms1_id", F.size("mz").alias("n"), F.get("mz", F.lit(0)).alias("first_mz")), f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY window_group, ms2_id, b_mz, b_rt_lo, b_im_lo, b_raw_sum ORDER BY jaccard DESC, im_overlap DESC, a_raw_sum DESC, ms1_id) AS r FROM ({_PAIRS}) p WHERE jaccard >= 0.5), c AS (SELECT *, row_number() OVER (PARTITION BY window_group, ms1_id, ms2_id ORDER BY b_raw_sum DESC, b_mz, b_rt_lo, b_im_lo) AS s FROM b WHERE r = 1), t AS (SELECT *, row_number() OVER (PARTITION BY window_group, ms1_id ORDER BY b_raw_sum DESC, b_mz, ms2_id, b_rt_lo, b_im_lo) AS t FROM c WHERE s = 1) SELECT window_group, ms1_id, CAST(count(*) AS INT) AS n, min(b_mz) AS first_mz FROM t WHERE t <= 5 GROUP BY ALL", "ms1 ms2")
R.add("i110_energy_key", lambda v: J.nearest_key(v.table("pasefframemsmsinfo").where("collisionenergy is not null").select("row_id", F.round(F.col("collisionenergy") * 10).cast("long").alias("ce"), (F.col("scannumbegin") % 4).alias("charge")), v.table("pasefframemsmsinfo").where("collisionenergy is not null").select((F.round(F.col("collisionenergy") * 10) + F.col("scannumend") % 3 - 1).cast("long").alias("ce"), (F.col("scannumbegin") % 4).alias("charge"), "isolationmz").groupBy("ce", "charge").agg(F.min("isolationmz").alias("isolationmz")), "ce", ["charge"]).select("row_id", "ce", "matched_key", "isolationmz"), "WITH l AS (SELECT row_id, CAST(round(collisionenergy * 10) AS BIGINT) AS ce, scannumbegin % 4 AS charge FROM pasefframemsmsinfo WHERE collisionenergy IS NOT NULL), d AS (SELECT CAST(round(collisionenergy * 10) + scannumend % 3 - 1 AS BIGINT) AS ce, scannumbegin % 4 AS charge, min(isolationmz) AS isolationmz FROM pasefframemsmsinfo WHERE collisionenergy IS NOT NULL GROUP BY ALL), m AS (SELECT l.row_id, l.ce, d.ce AS matched_key, d.isolationmz, CASE d.ce - l.ce WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS t FROM l JOIN d ON l.charge = d.charge AND abs(d.ce - l.ce) <= 1) SELECT row_id, ce, arg_min(matched_key, t) AS matched_key, arg_min(isolationmz, t) AS isolationmz FROM m GROUP BY row_id, ce")
R.add("i111_prefix_exists", lambda v: v.truth.join(v.report.select("seq_id", "charge"), ["seq_id", "charge"], "left_semi").select("seq_id", "charge"), "SELECT seq_id, charge FROM v_truth SEMI JOIN v_report USING (seq_id, charge)", "truth report")
R.add("i112_render_precursors", lambda v: v.peaks.select("frame_id", "tof", "scan", "intensity", "mz").join(v.truth.select(F.col("seq_id").cast("int").alias("tof"), "charge"), "tof").groupBy("frame_id", "scan", F.round("mz").cast("long").alias("k")).agg(F.sum(F.col("intensity") * F.col("charge")).alias("intensity")), "SELECT frame_id, scan, CAST(round(mz) AS BIGINT) AS k, sum(p.intensity * t.charge) AS intensity FROM v_peaks p JOIN v_truth t ON t.seq_id = p.tof GROUP BY frame_id, scan, CAST(round(mz) AS BIGINT)", "peaks truth")
R.add("i123_as_of", lambda v: J.as_of(v.traces.where("ms_level = 2").select("event_id", "trace_id", "ts"), v.traces.where("ms_level = 1").select("trace_id", "ts", "intensity").groupBy("trace_id", "ts").agg(F.max("intensity").alias("intensity")), "ts", ["trace_id"], ["intensity"], block=F.date_trunc("day", "ts")).select("event_id", "right_intensity", "right_ts"), "SELECT l.event_id, r.intensity AS right_intensity, r.ts AS right_ts FROM (SELECT * FROM v_traces WHERE ms_level = 2) l ASOF LEFT JOIN (SELECT trace_id, ts, max(intensity) AS intensity FROM v_traces WHERE ms_level = 1 GROUP BY ALL) r ON l.trace_id = r.trace_id AND l.ts >= r.ts", "traces")
R.add("i123_nearest", lambda v: J.nearest(v.ms2.select("cluster_id", "window_group", "mz").withColumn("x", F.floor(F.col("mz") * 100).cast("long")).select("cluster_id", "window_group", "x"), v.ms1.withColumn("x", F.floor(F.col("mz") * 100).cast("long")).groupBy("window_group", "x").agg(F.min("cluster_id").alias("ms1_id")), "x", ["window_group"], ["ms1_id"], F.floor(F.col("x") / 1024)).select("window_group", "near_x", F.abs(F.col("near_x") - F.col("x")).alias("d")).groupBy("window_group").agg(F.sum("d").alias("d"), F.count("near_x").alias("n")), "WITH l AS (SELECT window_group, CAST(floor(mz * 100) AS BIGINT) AS x FROM v_ms2), r AS (SELECT DISTINCT window_group, CAST(floor(mz * 100) AS BIGINT) AS x FROM v_ms1), a AS (SELECT l.window_group, l.x, r.x AS b FROM l ASOF LEFT JOIN r ON l.window_group = r.window_group AND l.x >= r.x), c AS (SELECT a.*, r.x AS f FROM a ASOF LEFT JOIN r ON a.window_group = r.window_group AND a.x <= r.x) SELECT window_group, CAST(sum(least(coalesce(x - b, 9223372036854775807), coalesce(f - x, 9223372036854775807))) AS BIGINT) AS d, count(coalesce(b, f)) AS n FROM c GROUP BY window_group", "ms1 ms2")

# evaluation
R.add("i169_deduplicate", lambda v: E.deduplicate(v.report.withColumn("rt", F.col("q") * 100), ["seq_id", "charge"], ["rt"]).select("seq_id", "charge", r6("intensity").alias("intensity"), r6("rt").alias("rt"), "n_rows"), f"SELECT seq_id, charge, {_R6('sum(intensity)')} AS intensity, {_R6('sum(q * 100 * intensity) / sum(intensity)')} AS rt, count(*) AS n_rows FROM v_report GROUP BY ALL", "report")
R.add("i171_relative_abundance", lambda v: E.relative_abundance(v.report.groupBy("seq_id", "charge").agg(F.max("intensity").alias("intensity")), "seq_id").select("seq_id", "charge", r6("relative_abundance").alias("share")), f"WITH m AS (SELECT seq_id, charge, max(intensity) AS i FROM v_report GROUP BY ALL) SELECT seq_id, charge, {_R6('i / sum(i) OVER (PARTITION BY seq_id)')} AS share FROM m", "report")
R.add("i172_events", lambda v: E.events_from_totals(v.table("orders").select(F.col("o_custkey").alias("seq_id"), F.round("o_totalprice").alias("intensity")), "seq_id", 1000.0), "WITH t AS (SELECT o_custkey AS seq_id, sum(round(o_totalprice)) AS total FROM orders GROUP BY ALL) SELECT seq_id, total, greatest(1, CAST(trunc(total / (SELECT quantile_cont(total, 0.5) FROM t) * 1000) AS BIGINT)) AS events FROM t")
R.add("i173_equal_width", lambda v: E.equal_width(v.frame_info.withColumn("x", F.col("time") / 4), "x", 2.5), "SELECT CAST(ceil(time / 4 / 2.5) - 1 AS BIGINT) AS bin, count(*) AS n FROM v_frame_info GROUP BY ALL", "frame_info")
R.add("i174_charge_breakdown", lambda v: E.rate_by(v.truth, v.report, ["seq_id", "charge"], F.col("charge"), "z"), "SELECT t.charge AS z, count(*) AS n, count(r.seq_id) AS identified, count(r.seq_id) / count(*) AS rate FROM v_truth t LEFT JOIN (SELECT DISTINCT seq_id, charge FROM v_report) r USING (seq_id, charge) GROUP BY t.charge", "truth report")
R.add("i175_intensity_bins", lambda v: E.rank_bucket(v.truth, "intensity", 5, ["seq_id"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("intensity").alias("lo"), F.max("intensity").alias("hi")), "SELECT CAST(greatest(1, ceil(5 * (r - 1) / greatest(n - 1, 1))) AS INT) AS bucket, count(*) AS n, min(intensity) AS lo, max(intensity) AS hi FROM (SELECT intensity, row_number() OVER (ORDER BY intensity, seq_id) AS r, count(*) OVER () AS n FROM v_truth) x GROUP BY bucket", "truth")
R.add("i176_mass_accuracy", lambda v: E.mass_accuracy(v.table("precursors").where("largestpeakmz > 0 and monoisotopicmz > 0"), "largestpeakmz", "monoisotopicmz", "charge").select("charge", "n", *[r6(c).alias(c) for c in ("mean_ppm", "median_ppm", "mae_ppm")]), f"SELECT charge, count(*) AS n, {_R6('avg(p)')} AS mean_ppm, {_R6('quantile_cont(p, 0.5)')} AS median_ppm, {_R6('avg(abs(p))')} AS mae_ppm FROM (SELECT charge, (largestpeakmz - monoisotopicmz) / monoisotopicmz * 1e6 AS p FROM precursors WHERE largestpeakmz > 0 AND monoisotopicmz > 0) x GROUP BY charge")
R.add("i178_spearman", lambda v: E.spearman(v.truth.join(v.report.groupBy("seq_id", "charge").agg(F.max("intensity").alias("found")), ["seq_id", "charge"]), "intensity", "found", "charge").select("charge", r6("spearman").alias("spearman")), f"WITH j AS (SELECT t.charge, t.intensity AS a, r.i AS b FROM v_truth t JOIN (SELECT seq_id, charge, max(intensity) AS i FROM v_report GROUP BY ALL) r USING (seq_id, charge)), k AS (SELECT charge, rank() OVER (PARTITION BY charge ORDER BY a) + (count(*) OVER (PARTITION BY charge, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY charge ORDER BY b) + (count(*) OVER (PARTITION BY charge, b) - 1) / 2 AS rb FROM j) SELECT charge, CASE WHEN count(*) >= 3 THEN {_R6('corr(ra, rb)')} END AS spearman FROM k GROUP BY charge", "truth report")
_Q = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]
R.add("i180_fdp_curve", lambda v: E.fdp_curve(v.report, v.truth, ["seq_id", "charge"], _Q), "WITH r AS (SELECT seq_id, charge, min(q) AS q FROM v_report GROUP BY ALL), c AS (SELECT q, t.seq_id IS NULL AS f FROM r LEFT JOIN (SELECT DISTINCT seq_id, charge FROM v_truth) t USING (seq_id, charge)), h AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08, 0.1]::DOUBLE[]) AS threshold) SELECT threshold, count(q) AS n_reported, count(q) FILTER (WHERE f) AS n_false, count(q) FILTER (WHERE f) / nullif(count(q), 0) AS fdp FROM h LEFT JOIN c ON q <= threshold GROUP BY threshold", "report truth")
R.add("i181_gate", lambda v: E.gate(v.truth.join(v.report.select("seq_id", "charge").distinct().withColumn("f", F.lit(1)), ["seq_id", "charge"], "left").agg((F.count("f") / F.count(F.lit(1))).alias("rate")), {"rate": (">=", 0.3)}), "SELECT count(r.seq_id) / count(*) >= 0.3 AS rate_ok, count(r.seq_id) / count(*) >= 0.3 AS passed FROM v_truth t LEFT JOIN (SELECT DISTINCT seq_id, charge FROM v_report) r USING (seq_id, charge)", "truth report")
R.add("i182_dda_metrics", lambda v: v.table("pasefframemsmsinfo").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("precursor").alias("precursors"), F.countDistinct("frame").alias("frames")).withColumn("redundancy", r6(F.col("events") / F.col("precursors"))), f"SELECT count(*) AS events, count(DISTINCT precursor) AS precursors, count(DISTINCT frame) AS frames, {_R6('count(*) / count(DISTINCT precursor)')} AS redundancy FROM pasefframemsmsinfo")
R.add("i183_summary_point", lambda v: E.at_target(E.fdp_curve(v.report, v.truth, ["seq_id", "charge"], _Q), 0.05).select("threshold", "n_reported"), "SELECT 0.04::DOUBLE AS threshold, count(*) AS n_reported FROM (SELECT seq_id, charge, min(q) AS q FROM v_report GROUP BY ALL) r WHERE q <= 0.04", "report truth")
R.add("i184_profile", lambda v: E.profile(v.ms1, ["mz", "raw_sum"]).select("column", "q", r6("value").alias("value")), f"SELECT c AS \"column\", q, {_R6('quantile_cont(x, q)')} AS value FROM (SELECT 'mz' AS c, mz AS x FROM v_ms1 UNION ALL SELECT 'raw_sum', raw_sum FROM v_ms1) d, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS q) z GROUP BY c, q".replace("quantile_cont(x, q)", "CASE q WHEN 0 THEN min(x) WHEN 0.25 THEN quantile_cont(x, 0.25) WHEN 0.5 THEN quantile_cont(x, 0.5) WHEN 0.75 THEN quantile_cont(x, 0.75) ELSE max(x) END"), "ms1")
R.add("i121_species", lambda v: v.report.join(v.truth.select("seq_id", (F.col("seq_id") % 3).alias("species")).distinct(), "seq_id").groupBy("species", "charge").agg(F.countDistinct("seq_id").alias("n")), "SELECT t.seq_id % 3 AS species, r.charge, count(DISTINCT r.seq_id) AS n FROM v_report r JOIN v_truth t USING (seq_id) GROUP BY ALL", "report truth")
R.add("i158_pearson_traces", lambda v: v.traces.groupBy("trace_id", F.date_trunc("hour", "ts").alias("h")).agg(F.sum(F.when(F.col("ms_level") == 1, F.col("intensity")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("ms_level") == 2, F.col("intensity")).otherwise(0.0)).alias("b")).groupBy("trace_id").agg(F.when(F.count(F.lit(1)) >= 3, F.corr("a", "b")).alias("r")).select("trace_id", F.round(F.col("r") * 1e6).cast("long").alias("r")), "SELECT trace_id, CASE WHEN isfinite(r) THEN CAST(round(r * 1e6) AS BIGINT) END AS r FROM (SELECT trace_id, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS r FROM (SELECT trace_id, date_trunc('hour', ts) AS h, sum(CASE WHEN ms_level = 1 THEN intensity ELSE 0 END) AS a, sum(CASE WHEN ms_level = 2 THEN intensity ELSE 0 END) AS b FROM v_traces GROUP BY ALL) x GROUP BY trace_id) y", "traces")

# hashing, clustering, greedy
_planes = H.hyperplanes(64, 8, 7)
R.add("i331_sim_hash", lambda v: v.table("embeddings").select("vec_id", H.sim_hash(F.col("embedding"), _planes).alias("key")), "SELECT vec_id, CAST(" + " + ".join(f"CASE WHEN list_sum([CAST(x AS DOUBLE) * w FOR x, w IN zip]) > 0 THEN {1 << i} ELSE 0 END".replace("[CAST(x AS DOUBLE) * w FOR x, w IN zip]", "list_transform(range(1, 65), lambda j: CAST(embedding[j] AS DOUBLE) * " + str(p) + "[j])") for i, p in enumerate(_planes)) + " AS BIGINT) AS key FROM embeddings")
R.add("i332_hash_tables", lambda v: H.sim_hash_tables(v.table("embeddings"), "vec_id", "embedding", 4, 6))
R.add("i288_cosine", lambda v: v.table("embeddings").join(v.table("embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e")), F.col("q") == F.col("vec_id") + 1).select("vec_id", "q", F.round(H.cosine(F.col("embedding"), F.col("e")) * 1e4).cast("long").alias("c")), "SELECT a.vec_id, b.vec_id AS q, CAST(round(list_sum(list_transform(range(1, 65), lambda j: CAST(a.embedding[j] AS DOUBLE) * b.embedding[j])) / sqrt(list_sum(list_transform(range(1, 65), lambda j: CAST(a.embedding[j] AS DOUBLE) * a.embedding[j])) * list_sum(list_transform(range(1, 65), lambda j: CAST(b.embedding[j] AS DOUBLE) * b.embedding[j]))) * 1e4) AS BIGINT) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
R.add("i288_spectral_angle", lambda v: v.table("embeddings").select("vec_id", H.spectral_angle(F.col("embedding"), F.transform("embedding", lambda x: F.abs(x))).alias("angle")))
R.add("i333_dbscan", lambda v: K.dbscan(v.table("embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]), ["x", "y", "z"], 0.03, 5))
R.add("i336_mixture", lambda v: (lambda m: m[0].transform(m[1]).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")))(K.gaussian_mixture(v.table("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)]), [f"x{i}" for i in range(4)], 3)))
R.add("i337_rescore", lambda v: K.rescore(v.table("parse_diann_report").where("intensity > 0 and q_value is not null and mz is not null").groupBy("row_id").agg(F.first("mz").alias("mz"), F.log1p(F.first("intensity")).alias("i"), F.first("charge").cast("double").alias("z"), (F.first("q_value") < 0.01).cast("int").alias("label")).na.drop(), ["mz", "i", "z"], "label", key="row_id"))
R.add("i339_ccs_fit", lambda v: v.table("parse_diann_report").where("charge between 1 and 4 and inverse_mobility > 0 and mz > 0").withColumn("ccs", Y.ccs(F.col("inverse_mobility"), F.col("mz"), F.col("charge"))).groupBy("charge").agg(F.regr_slope("ccs", F.sqrt("mz")).alias("a"), F.regr_intercept("ccs", F.sqrt("mz")).alias("b")).select("charge", (F.round(F.col("a") * 1e3) / 1e3).alias("a"), (F.round(F.col("b") * 1e3) / 1e3).alias("b")), "WITH c AS (SELECT charge, sqrt(mz) AS s, 18509.8632163405 * charge / sqrt(mz * charge * 28.013 / (mz * charge + 28.013) * 305.0) * inverse_mobility AS ccs FROM parse_diann_report WHERE charge BETWEEN 1 AND 4 AND inverse_mobility > 0 AND mz > 0) SELECT charge, round(regr_slope(ccs, s) * 1e3) / 1e3 AS a, round(regr_intercept(ccs, s) * 1e3) / 1e3 AS b FROM c GROUP BY charge")
R.add("i220_deisotope", lambda v: G.deisotope(v.peaks.select("frame_id", "mz", "intensity"), ["frame_id"], 20.0).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")))
R.add("i199_pick_im", lambda v: G.pick_peaks(v.peaks.groupBy("frame_id", "scan").agg(F.sum("intensity").alias("intensity")), ["frame_id"], "scan", 40.0, min_distance=3.0))
R.add("i200_pick_rt", lambda v: G.pick_peaks(v.peaks.groupBy(F.floor(F.col("tof") / 2000).alias("bin"), "frame_id").agg(F.sum("intensity").alias("intensity")), ["bin"], "frame_id", 20.0, min_distance=2.0, min_width=1.0))
R.add("i214_stitch", lambda v: G.stitch(v.ms1.select("window_group", F.col("cluster_id").alias("id"), F.col("rt_lo").alias("lo"), F.col("rt_hi").alias("hi"), F.col("raw_sum").alias("intensity")), ["window_group"], 1, 12))
R.add("i343_features", lambda v: G.isotope_chains(v.ms1.select("window_group", "cluster_id", "mz", "raw_sum", "rt_lo", "rt_hi", "im_lo", "im_hi"), ["window_group"]).groupBy("window_group", "feature", "charge").agg(F.count(F.lit(1)).alias("n")))
R.add("i344_dda_schedule", lambda v: G.schedule(v.peaks.where("ms_type = 0").groupBy("frame_id", F.col("tof").alias("ion")).agg(F.max("intensity").alias("intensity"), F.min("scan").alias("scan")).withColumn("run", F.lit(1)), "run"))

QUERIES, ORACLES = R.queries, R.oracles
