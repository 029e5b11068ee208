"""Entries of helpers, plug-ins and end-to-end compositions. Names begin with the inventory number."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions import arrays as A
from ionweave.functions import chemistry as C
from ionweave.functions import physics as Y
from ionweave.operators import assembly as M
from ionweave.operators import binning as B
from ionweave.operators import clusters as U
from ionweave.operators import evaluation as E
from ionweave.operators import generators as N
from ionweave.operators import greedy as G
from ionweave.operators import joins as J
from ionweave.operators import ranking as K
from ionweave.operators import simulate as S
from ionweave.operators import windows as W
from ionweave.plans.cluster_queries import _SUPPORT
from ionweave.plans.match_queries import _MS2, _PAIRS, _Q, _best, pairs
from ionweave.plans.more_queries import _path
from ionweave.plans.peak_queries import _R6, r6
from ionweave.plans.registry import Registry
from ionweave.plans.sql_checks import _CDF, _IONS, _STITCH, _residues
from ionweave.session import shared_dir
from ionweave.sources import dataset as D
from ionweave.sources import formats as X
from ionweave.streaming import windows as T

R = Registry()
_PLAIN = "SELECT row_id, sequence FROM parse_diann_report WHERE sequence IS NOT NULL"
_plain = lambda v: v.table("parse_diann_report").where("sequence is not null").select("row_id", "sequence")


def _run_folder(v):
    """A run folder with its metadata tables in the shared folder; the format is one database file, so it has to be a mounted one."""
    import sqlite3
    import uuid
    from pathlib import Path

    path = Path(shared_dir(v.spark).removeprefix("file://"), f"run-{uuid.uuid4().hex}.d", "analysis.tdf")
    path.parent.mkdir(parents=True)
    with sqlite3.connect(path) as con:
        v.frame_info.toPandas().to_sql("Frames", con, index=False)
        v.windows.toPandas().to_sql("Windows", con, index=False)
        pd.DataFrame({"Key": ["Gas", "Temperature"], "Value": ["N2", "31.85"]}).to_sql("GlobalMetadata", con, index=False)
    return str(path)


R.add("i015_generic_table", lambda v: D.read_database_table(v.spark, _run_folder(v), "Windows").select(F.col("window_group").cast("int").alias("window_group"), F.col("row_order").cast("int").alias("row_order"), "isolation_mz"), "SELECT window_group, row_order, isolation_mz FROM v_windows", "windows")
R.add("i031_metadata_writers", lambda v: D.read_database_table(v.spark, _run_folder(v), "Frames").select(F.col("frame_id").cast("int").alias("frame_id"), "time", F.col("ms_type").cast("int").alias("ms_type")), "SELECT frame_id, time, ms_type FROM v_frame_info", "frame_info")
R.add("i425_environment", lambda v: D.key_values(D.read_database_table(v.spark, _run_folder(v), "GlobalMetadata"), "Key", "Value", ["Gas", "Temperature", "Pressure"]).select(F.col("Gas").alias("gas"), F.col("Temperature").cast("double").alias("temperature"), F.col("Pressure").isNull().alias("no_pressure")), "SELECT 'N2' AS gas, 31.85::DOUBLE AS temperature, true AS no_pressure")
R.add("i424_reader_variants", lambda v: D.Dataset(v.peaks.select("frame_id", "scan", "tof", "intensity"), v.frame_info).in_time(3.0, 9.0).withColumn("mz", r6(Y.boundary_tof_to_mz(F.col("tof"), 100.0, 1700.0, 600_000))), f"SELECT frame_id, scan, tof, intensity, {_R6('(10 + (sqrt(1700.0) - 10) / 600000 * tof) ** 2')} AS mz FROM v_peaks WHERE frame_id IN (SELECT frame_id FROM v_frame_info WHERE time BETWEEN 3 AND 9)", "peaks frame_info")
R.add("i426_optional_columns", lambda v: reduce(lambda df, c: df if D.has_column(df, c) else df.withColumn(c, F.lit(None).cast("double")), ("charge", "ccs"), v.table("parse_diann_report").select("row_id", "charge")), "SELECT row_id, charge, CAST(NULL AS DOUBLE) AS ccs FROM parse_diann_report")

# picking and quadrature
R.add(
    "i196_dense_centroid",
    lambda v: W.local_maxima(W.smooth(v.peaks.groupBy("frame_id", F.floor("mz").cast("int").alias("bin")).agg(F.sum("intensity").alias("intensity")), 1, "frame_id", axis="bin"), 2, "frame_id", axis="bin").select("frame_id", "bin", F.col("smoothed").alias("area")),
    "WITH b AS (SELECT frame_id, CAST(floor(mz) AS INT) AS bin, sum(intensity) AS i FROM v_peaks GROUP BY ALL) SELECT frame_id, bin, area FROM (SELECT frame_id, bin, i, sum(i) OVER (PARTITION BY frame_id ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS area, max(i) OVER (PARTITION BY frame_id ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, max(i) OVER (PARTITION BY frame_id ORDER BY bin RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM b) x WHERE i > coalesce(l, -1) AND i >= coalesce(r, -1)",
    "peaks",
)
_series = lambda v: v.peaks.groupBy(F.floor(F.col("tof") / 500).alias("bin"), "frame_id").agg(F.sum("intensity").alias("intensity"))
R.add("i201_time_nms", lambda v: G.pick_peaks(_series(v), ["bin"], "frame_id", 0.0, min_distance=5.0).select("bin", "apex", "height"))
R.add("i202_grid_detection", lambda v: G.pick_peaks(W.gaussian_smooth(v.peaks.groupBy(F.floor(F.col("tof") / 2000).alias("bin"), "scan").agg(F.sum("intensity").alias("intensity")), "scan", 2.0, "bin").select("bin", "scan", F.col("smoothed").alias("intensity")), ["bin"], "scan", 5.0, min_distance=4.0))


def _integral(rate: float):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import math

        return pd.Series([A.adaptive_integral(lambda x: rate * math.exp(-rate * x), p, q) for p, q in zip(a, b)])

    return run


R.add("i256_quadrature", lambda v: v.frame_info.select("frame_id", r6(_integral(0.05)(F.col("time").cast("double") * 0.5, F.col("time").cast("double"))).alias("mass")), f"SELECT frame_id, {_R6('exp(-0.05 * time * 0.5) - exp(-0.05 * time)')} AS mass FROM v_frame_info", "frame_info")
R.add("i457_axis_ticks", lambda v: v.peaks.groupBy("frame_id").agg((F.max("mz") - F.min("mz")).alias("span")).select("frame_id", K.nice_step(F.col("span"), 8).alias("step")), "WITH s AS (SELECT frame_id, (max(mz) - min(mz)) / 8 AS r FROM v_peaks GROUP BY frame_id), b AS (SELECT frame_id, r, CAST(10 AS DOUBLE) ** floor(log10(r)) AS b FROM s WHERE r > 0) SELECT frame_id, b * CASE WHEN r / b <= 1 THEN 1 WHEN r / b <= 2 THEN 2 WHEN r / b <= 5 THEN 5 ELSE 10 END AS step FROM b", "peaks")

# noise and overlays
R.add("i287_detector_noise", lambda v: N.detector_noise(v.peaks, 3, "frame_id", "scan", "tof", "mz").groupBy("frame_id").agg(F.sum("intensity").alias("intensity")))
R.add("i386_custom_noise", lambda v: N.custom_noise(v.peaks, lambda i: i * 0.5, lambda i: i * 0.0, 3, "frame_id", "scan", "tof", "mz").select("frame_id", "scan", "tof", "intensity"), "SELECT frame_id, scan, tof, intensity * 1.5 AS intensity FROM v_peaks", "peaks")
R.add("i350_overlay", lambda v: M.overlay(v.peaks, {0: v.peaks.where("ms_type = 0 and intensity < 10"), 9: v.peaks.where("ms_type = 9 and intensity < 5")}), "SELECT frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT) AS k, sum(intensity) AS intensity FROM (SELECT * FROM v_peaks UNION ALL SELECT * FROM v_peaks WHERE ms_type = 0 AND intensity < 10 UNION ALL SELECT * FROM v_peaks WHERE ms_type = 9 AND intensity < 5) x GROUP BY frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT)", "peaks")

# pseudo-spectra from end to end
_WON = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_group, ms2_id, b_mz, b_rt_lo, b_im_lo, b_raw_sum ORDER BY jaccard DESC, im_overlap DESC, a_raw_sum DESC, ms1_id) AS r FROM ({_PAIRS}) p WHERE jaccard >= 0.5) w WHERE r = 1)"


def pseudo_spectra(v, n: int) -> DataFrame:
    won = J.best_match(pairs(v), ["window_group", *_MS2], *_best())
    top = K.top_n(won, n, ["window_group", "ms1_id"], F.desc("b_raw_sum"), F.asc("b_mz"), F.asc("ms2_id"), F.asc("b_rt_lo"), F.asc("b_im_lo"))
    return top.groupBy("window_group", "ms1_id").agg(F.array_sort(F.collect_list(F.struct("b_mz", "b_raw_sum"))).alias("peaks"))


R.add("i345_pseudo_spectra", lambda v: pseudo_spectra(v, 5).select("window_group", "ms1_id", F.size("peaks").alias("n"), F.get("peaks", F.lit(0))["b_mz"].alias("first")), f"SELECT window_group, ms1_id, CAST(count(*) AS INT) AS n, min(b_mz) AS first FROM (SELECT *, row_number() OVER (PARTITION BY window_group, ms1_id ORDER BY b_raw_sum DESC, b_mz, ms2_id, b_rt_lo, b_im_lo) AS q FROM {_WON} a) b WHERE q <= 5 GROUP BY window_group, ms1_id", "ms1 ms2")
R.add("i420_all_pairs_spectra", lambda v: pairs(v).groupBy("ms1_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b_raw_sum").alias("raw_sum")), f"SELECT ms1_id, count(*) AS n, sum(b_raw_sum) AS raw_sum FROM ({_PAIRS}) p WHERE jaccard >= 0.5 GROUP BY ms1_id", "ms1 ms2")
R.add("i444_search_spectra", lambda v: pseudo_spectra(v, 20).select("ms1_id", F.explode("peaks").alias("p")).groupBy("ms1_id").agg(r6(F.max("p.b_raw_sum") / F.sum("p.b_raw_sum")).alias("base_share")), f"SELECT ms1_id, {_R6('max(b_raw_sum) / sum(b_raw_sum)')} AS base_share FROM (SELECT *, row_number() OVER (PARTITION BY window_group, ms1_id ORDER BY b_raw_sum DESC, b_mz, ms2_id, b_rt_lo, b_im_lo) AS q FROM {_WON} a) b WHERE q <= 20 GROUP BY ms1_id", "ms1 ms2")
R.add("i438_cluster_facade", lambda v: G.stitch(v.ms1.select("window_group", F.col("cluster_id").alias("id"), F.col("rt_lo").alias("lo"), F.col("rt_hi").alias("hi"), F.col("raw_sum").alias("intensity")), ["window_group"], 1, 12).groupBy("window_group").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("members")), _STITCH.replace("WITH RECURSIVE o AS", "WITH o AS") + " SELECT window_group, count(*) AS n, CAST(sum(n) AS BIGINT) AS members FROM s GROUP BY window_group", "ms1")
R.oracles["i438_cluster_facade"] = R.oracles["i438_cluster_facade"].replace("WITH v_ms1", "WITH RECURSIVE v_ms1", 1)

# spectra of ions
R.add("i360_precursor_spectra", lambda v: v.table("peptides").where("monoisotopic_mass is not null").select("row_id", "monoisotopic_mass", F.posexplode(Y.averagine_weights(F.col("monoisotopic_mass"), 4)).alias("k", "w")).select("row_id", "k", r6((F.col("monoisotopic_mass") + F.col("k") * Y.ISOTOPE_SPACING + 2 * Y.MASS_PROTON) / 2).alias("mz"), r6("w").alias("w")), f"WITH l AS (SELECT row_id, monoisotopic_mass AS m, 0.000594 * monoisotopic_mass - 0.03091 AS l FROM peptides WHERE monoisotopic_mass IS NOT NULL), w AS (SELECT row_id, m, CAST(k AS INT) AS k, exp(-l) * l ** k / factorial(CAST(k AS INT)) AS w FROM l, range(4) r(k)) SELECT row_id, k, {_R6(f'(m + k * {Y.ISOTOPE_SPACING!r} + 2 * {Y.MASS_PROTON!r}) / 2')} AS mz, {_R6('w / sum(w) OVER (PARTITION BY row_id)')} AS w FROM w")
_R4 = lambda x: f"round(({x}) * 1e4) / 1e4"
r4 = lambda c: F.round(c * 1e4) / 1e4
R.add("i390_ion_mz", lambda v: _plain(v).select("row_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("z"), C.mono_mass(F.col("sequence")).alias("m")).select("row_id", "z", r4(Y.mz_of_mass(F.col("m"), F.col("z"))).alias("mz")), f"WITH {_residues(_PLAIN)} SELECT row_id, CAST(z AS INT) AS z, {_R4(f'(sum(m) + {Y.MASS_WATER!r} + z * {Y.MASS_PROTON!r}) / z')} AS mz FROM w, (VALUES (1), (2), (3)) c(z) GROUP BY row_id, z")
R.add("i391_complements", lambda v: C.product_ions(_plain(v), "row_id").where("kind = 'b'").join(_plain(v).select("row_id", C.mono_mass(F.col("sequence")).alias("m")), "row_id").select("row_id", "ordinal", r4(F.col("m") - F.col("mass")).alias("complement")), f"WITH {_residues(_PLAIN)} SELECT row_id, CAST(k AS INT) AS ordinal, {_R4(f'sum(m) OVER (PARTITION BY row_id) + {Y.MASS_WATER!r} - sum(m) OVER (PARTITION BY row_id ORDER BY k)')} AS complement FROM w QUALIFY k < n")
R.add("i393_product_spectra", lambda v: C.product_ions(_plain(v), "row_id", charge=2).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), r4(F.min("mz")).alias("lo"), r4(F.max("mz")).alias("hi")), f"WITH {_residues(_PLAIN)}, {_IONS} SELECT row_id, count(*) AS n, {_R4(f'min((mz + {Y.MASS_PROTON!r}) / 2)')} AS lo, {_R4(f'max((mz + {Y.MASS_PROTON!r}) / 2)')} AS hi FROM z GROUP BY row_id")
R.add("i394_find_series", lambda v: C.product_ions(_plain(v), "row_id", charge=2).withColumn("charge", F.lit(2)).unionByName(C.product_ions(_plain(v), "row_id").withColumn("charge", F.lit(1))).where("charge = 1 and kind = 'y' and ordinal <= 3").select("row_id", "ordinal", "ion"), f"WITH {_residues(_PLAIN)}, {_IONS} SELECT row_id, CAST(ordinal AS INT) AS ordinal, ion FROM z WHERE kind = 'y' AND ordinal <= 3")
R.add("i395_all_ions_json", lambda v: C.product_ions(_plain(v), "row_id").groupBy("row_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "ordinal", "ion")))).alias("series")), f"WITH {_residues(_PLAIN)}, {_IONS} SELECT row_id, '[' || string_agg('{{\"kind\":\"' || kind || '\",\"ordinal\":' || ordinal || ',\"ion\":\"' || ion || '\"}}', ',' ORDER BY kind, ordinal) || ']' AS series FROM z GROUP BY row_id")
R.add("i396_prefix_masses", lambda v: C.product_ions(_plain(v), "row_id", ("b",)).select("row_id", "ordinal", r4(F.col("mz")).alias("mz")), f"WITH {_residues(_PLAIN)}, {_IONS} SELECT row_id, CAST(ordinal AS INT) AS ordinal, {_R4('mz')} AS mz FROM z WHERE kind = 'b'")
R.add("i397_more_dictionaries", lambda v: v.spark.createDataFrame(sorted(C.ELEMENT_MASS.items()), "element string, mass double").unionByName(v.spark.createDataFrame([(f"UNIMOD:{k}", m) for k, m in sorted(C.UNIMOD_MASS.items())], "element string, mass double")), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {m!r}::DOUBLE)" for k, m in [*C.ELEMENT_MASS.items(), *((f"UNIMOD:{k}", m) for k, m in C.UNIMOD_MASS.items())]) + ") t(element, mass)")
R.add("i400_density_helpers", lambda v: v.frame_info.select("frame_id", r6(Y.normal_pdf(F.col("time"), 50.0, 9.0)).alias("normal"), r6(Y.exponential_pdf(F.col("time"), 0.02)).alias("exponential"), r6(Y.normal_cdf(F.col("time"), 50.0, 9.0)).alias("cdf")), f"SELECT frame_id, {_R6('exp(-0.5 * ((time - 50.0) / 9.0) ** 2) / (9.0 * sqrt(2 * pi()))')} AS normal, {_R6('0.02 * exp(-0.02 * time)')} AS exponential, {_R6(_CDF('time', '50.0', '9.0'))} AS cdf FROM v_frame_info", "frame_info")

# projections
_ions = lambda v: v.ms1.select(F.col("cluster_id").alias("ion_id"), ((F.col("im_lo") + F.col("im_hi")) / 2).alias("mu"))
_scans = lambda v: J.point_in_interval(v.peaks.select("scan").distinct(), _ions(v).select("ion_id", "mu", (F.col("mu") - 6).alias("lo"), (F.col("mu") + 6).alias("hi")), "scan", ("lo", "hi"), 16.0).select("ion_id", "scan", Y.normal_mass(F.col("scan") - 0.5, F.col("scan") + 0.5, F.col("mu"), F.lit(2.0)).alias("p"))
_SCANS = f"(SELECT ion_id, scan, {_CDF('(scan + 0.5)', 'mu', '2.0')} - ({_CDF('(scan - 0.5)', 'mu', '2.0')}) AS p FROM (SELECT cluster_id AS ion_id, (im_lo + im_hi) / 2 AS mu FROM v_ms1) i JOIN (SELECT DISTINCT scan FROM v_peaks) s ON s.scan BETWEEN mu - 6 AND mu + 6)"
R.add("i401_scan_projection", lambda v: _scans(v).select("ion_id", "scan", r6("p").alias("p")), f"SELECT ion_id, scan, {_R6('p')} AS p FROM {_SCANS} x", "ms1 peaks")
R.add("i435_projector", lambda v: _scans(v).groupBy("ion_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("p") * 1e4) / 1e4).alias("p")), f"SELECT ion_id, count(*) AS n, round(sum(p) * 1e4) / 1e4 AS p FROM {_SCANS} x GROUP BY ion_id", "ms1 peaks")


def _written(v):
    path = _path(v, "distribution")
    _scans(v).select("ion_id", "scan", r6("p").alias("p")).write.parquet(path)
    return v.spark.read.parquet(path)


R.add("i455_distribution_writers", lambda v: _written(v).groupBy("ion_id").agg(F.min("scan").alias("lo"), F.max("scan").alias("hi")), f"SELECT ion_id, min(scan) AS lo, max(scan) AS hi FROM {_SCANS} x GROUP BY ion_id", "ms1 peaks")
R.add("i452_ion_sampling", lambda v: v.ms1.select("cluster_id", N.uniform(4, "cluster_id").alias("u"), Y.averagine_weights(F.col("mz") * 2, 5).alias("w")).select("cluster_id", F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.aggregate(F.slice("w", 1, k), F.lit(0.0), lambda a, x: a + x)), lambda s: s <= F.col("u"))).alias("place")))
R.add("i431_single_frame", lambda v: M.annotate(v.peaks.where("frame_id = 5").withColumn("k", B.mz_key(1)), ["scan", "k"], F.col("tof")).select("scan", "k", "intensity"), "SELECT scan, CAST(round(mz * 10) AS BIGINT) AS k, sum(intensity) AS intensity FROM v_peaks WHERE frame_id = 5 GROUP BY scan, CAST(round(mz * 10) AS BIGINT)", "peaks")
R.add("i368_collected_stream", lambda v: reduce(DataFrame.unionByName, T.batches(v.peaks, "frame_id", 32)).groupBy("ms_type").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")), "SELECT ms_type, count(*) AS n, sum(intensity) AS intensity FROM v_peaks GROUP BY ms_type", "peaks")

# plug-ins: an operator that takes a function of columns
R.add("i380_converter_plug_in", lambda v: U.decorate(v.ms1.select("cluster_id", F.col("rt_lo").cast("double").alias("mu_tof"), F.lit(2.0).alias("sigma_tof")), lambda t: t * 0.5 + 100.0), "SELECT cluster_id, CAST(rt_lo AS DOUBLE) AS mu_tof, 2.0::DOUBLE AS sigma_tof, rt_lo * 0.5 + 100.0 AS mz_mu, 1.0::DOUBLE AS mz_sigma FROM v_ms1", "ms1")
R.add("i381_transmission_plug_in", lambda v: J.transmit_with(v.peaks.join(v.dia_info, "frame_id"), lambda mz: F.when(mz.between(200.0, 700.0), 0.5).otherwise(0.0)).groupBy("frame_id").agg(F.sum("intensity").alias("intensity"), F.count(F.lit(1)).alias("n")), "SELECT frame_id, sum(intensity * 0.5) AS intensity, count(*) AS n FROM v_peaks JOIN v_dia_info USING (frame_id) WHERE mz BETWEEN 200 AND 700 GROUP BY frame_id", "peaks dia_info")
R.add("i382_energy_plug_in", lambda v: v.table("precursors").where("averagemz is not null").select("row_id", r6((lambda mz: F.greatest(mz * 0.03 + 5.0, F.lit(20.0)))(F.col("averagemz"))).alias("energy")), f"SELECT row_id, {_R6('greatest(averagemz * 0.03 + 5.0, 20.0)')} AS energy FROM precursors WHERE averagemz IS NOT NULL")


def _plugged(v):
    path = _path(v, "written")
    D.write_with(v.windows, lambda df: df.write.json(path))
    return v.spark.read.schema(v.windows.schema).json(path)


R.add("i383_writer_plug_in", _plugged, "SELECT * FROM v_windows", "windows")
R.add("i384_generic_resolution", lambda v: B.to_resolution(v.ms2.select("window_group", "mz", F.col("raw_sum").alias("intensity")), 0, "window_group"), "SELECT window_group, CAST(round(mz) AS BIGINT) / 1.0 AS mz, sum(raw_sum) AS intensity FROM v_ms2 GROUP BY window_group, CAST(round(mz) AS BIGINT)", "ms2")


def _registered(v):
    """Functions by name for SQL text: expressions are registered as views, so that they stay in the plan."""
    K.register(v.spark, "nice_mz", "mz DOUBLE", "DOUBLE", "round(mz * 10) / 10")
    return v.spark.sql("select frame_id, nice_mz(mz) as m, count(*) as n from {p} group by frame_id, nice_mz(mz)", p=v.peaks)


R.add("i389_sql_functions", _registered, "SELECT frame_id, round(mz * 10) / 10 AS m, count(*) AS n FROM v_peaks GROUP BY frame_id, round(mz * 10) / 10", "peaks")
R.add("i427_lookup_tables", lambda v: J.last_window(v.peaks.join(v.dia_info, "frame_id").select("window_group", "frame_id", "scan"), v.windows, ["window_group"]).groupBy("window_group").agg(F.count(F.lit(1)).alias("places"), F.max("collision_energy").alias("energy")), "SELECT window_group, count(*) AS places, max(collision_energy) AS energy FROM (SELECT DISTINCT d.window_group, p.scan, arg_max(w.collision_energy, w.row_order) AS collision_energy FROM v_peaks p JOIN v_dia_info d USING (frame_id) JOIN v_windows w ON w.window_group = d.window_group AND p.scan BETWEEN w.scan_begin AND w.scan_end GROUP BY d.window_group, p.scan) x GROUP BY window_group", "peaks dia_info windows")
R.add("i442_target_vectors", lambda v: C.product_ions(_plain(v), "row_id").groupBy("row_id").agg(F.collect_list(F.struct(((F.col("ordinal") - 1) * 6 + F.when(F.col("kind") == "b", 3).otherwise(0)).alias("i"), F.lit(1.0).alias("x"))).alias("e")).select("row_id", F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(173)), lambda i: F.when(F.exists("e", lambda x: x["i"] == i), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x).alias("filled")), "SELECT row_id, 2.0 * (length(sequence) - 1) AS filled FROM parse_diann_report WHERE length(sequence) > 1 AND sequence IS NOT NULL")
R.add("i448_tool_comparison", lambda v: reduce(DataFrame.unionByName, [E.rate_by(v.truth, v.report.where(F.col("charge") % 2 == t), ["seq_id", "charge"], F.col("charge"), "charge").withColumn("tool", F.lit(t)) for t in (0, 1)]).select("tool", "charge", "n", "identified", r6("rate").alias("rate")), f"SELECT t AS tool, x.charge, count(*) AS n, count(r.seq_id) AS identified, {_R6('count(r.seq_id) / count(*)')} AS rate FROM v_truth x, (VALUES (0), (1)) q(t) LEFT JOIN (SELECT DISTINCT seq_id, charge FROM v_report) r ON r.seq_id = x.seq_id AND r.charge = x.charge AND r.charge % 2 = t GROUP BY t, x.charge", "truth report")


# round trips and helpers held against values instead of counts


def _findings_file(v):
    path = _path(v, "findings")
    rows = v.table("findings").select(F.col("sequence").alias(" Peptide "), F.col("charge").alias("Z"), F.col("intensity").cast("string").alias("Quantity"), F.col("rt").alias("RT"), F.col("protein").alias("PROTEIN"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return X.read_findings(v.spark, path).select("sequence", "protein", F.when(~F.isnan("intensity"), F.col("intensity")).alias("intensity"), "charge")


R.add("i044_findings_rows", _findings_file, "SELECT sequence, protein, CASE WHEN NOT isnan(intensity) THEN intensity END AS intensity, CAST(CASE WHEN regexp_full_match(trim(charge), '[+-]?[0-9]+') THEN trim(charge) END AS INT) AS charge FROM findings WHERE sequence IS NOT NULL AND intensity IS NOT NULL")


def _mgf_file(v):
    path = _path(v, "mgf")
    line = lambda x: F.concat(x["mz"].cast("string"), F.lit(" "), x["intensity"].cast("string"))
    p = v.peaks.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mz", "intensity"))), line), "\n").alias("p"))
    p.select(F.concat(F.lit("BEGIN IONS\nTITLE=f"), F.col("frame_id").cast("string"), F.lit("\nPEPMASS=500.5 10\nCHARGE=2+\n"), "p", F.lit("\nEND IONS"))).write.text(path)
    return X.read_mgf(v.spark, path).select(F.substring("title", 2, 9).cast("int").alias("frame_id"), F.explode("peaks").alias("x")).select("frame_id", "x.mz", "x.intensity")


R.add("i041_mgf_peaks", _mgf_file, "SELECT frame_id, mz, intensity FROM v_peaks", "peaks")
R.add("i257_support", lambda v: v.frame_info.select("frame_id", S.support(0.9, 1.0, 60)(F.col("time").cast("double"), F.lit(2.0), F.lit(0.5)).alias("b")).select("frame_id", "b.lo", "b.hi"), f"WITH {_SUPPORT} SELECT peptide_id AS frame_id, mu - 42 + lo AS lo, mu - 42 + hi AS hi FROM w", "frame_info")
_E64 = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
R.add("i342_padded", lambda v: v.table("embeddings").select("vec_id", F.posexplode(A.pad(F.transform("embedding", lambda x: x.cast("double")), 80, -9.0)).alias("i", "x")), f"SELECT vec_id, CAST(k AS INT) AS i, CASE WHEN k < 64 THEN e[k + 1] ELSE -9.0 END AS x FROM (SELECT vec_id, {_E64} AS e FROM embeddings) q, range(80) r(k)")
R.add("i342_masked", lambda v: v.table("embeddings").select("vec_id", F.posexplode(A.mask_by_length(F.transform("embedding", lambda x: x.cast("double")), (F.col("vec_id") % 9).cast("int"), (F.col("vec_id") % 3 + 1).cast("int"))).alias("i", "x")), f"SELECT vec_id, CAST(k AS INT) AS i, CASE WHEN k // 6 >= vec_id % 9 OR k % 3 >= vec_id % 3 + 1 THEN -1.0 ELSE e[k + 1] END AS x FROM (SELECT vec_id, {_E64} AS e FROM embeddings) q, range(64) r(k)")
R.add("i322_dropout_order", lambda v: v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.001).alias("e")).withColumn("d", A.drop_smallest(F.col("e"), 0.25, F.col("vec_id"))).select("vec_id", F.size(F.filter("d", lambda x: x == 0)).alias("n"), r6(F.aggregate(F.zip_with("e", "d", lambda a, b: F.when(b == 0, 0.0).otherwise(F.abs(a - b))), F.lit(0.0), lambda a, x: a + x)).alias("changed"), (F.aggregate(F.zip_with("e", "d", lambda a, b: F.when(b == 0, a).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / 16 <= F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / 64).alias("small")), "SELECT vec_id, CAST(16 AS INT) AS n, 0.0::DOUBLE AS changed, true AS small FROM embeddings")
R.add("i183_points", lambda v: reduce(DataFrame.unionByName, [E.at_target(E.fdp_curve(v.report, v.truth, ["seq_id", "charge"], _Q), t).select(F.lit(t).alias("target"), "threshold", "n_reported") for t in (0.01, 0.05, 0.5)]), f"WITH r AS (SELECT seq_id, charge, min(q) AS q FROM v_report GROUP BY ALL), h AS (SELECT unnest({_Q}::DOUBLE[]) AS t), g AS (SELECT unnest([0.01, 0.05, 0.5]::DOUBLE[]) AS target) SELECT target, max(t) AS threshold, arg_max(n, t) AS n_reported FROM g JOIN (SELECT t, (SELECT count(*) FROM r WHERE q <= t) AS n FROM h) k ON t <= target GROUP BY target", "report truth")

_TERM = "(SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '[UNIMOD:1]-' WHEN row_id % 7 = 0 THEN '[oops]-' ELSE '' END || regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g') || CASE WHEN row_id % 5 = 0 THEN '-[UNIMOD:2]' ELSE '' END AS t, regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g') AS s FROM parse_diann_report WHERE sequence_modified IS NOT NULL)"
_termini = lambda v: v.table("parse_diann_report").where("sequence_modified is not null").select("row_id", F.concat(F.when(F.col("row_id") % 3 == 0, "[UNIMOD:1]-").when(F.col("row_id") % 7 == 0, "[oops]-").otherwise(""), F.regexp_replace("sequence_modified", r"\(UniMod:([0-9]+)\)", "[UNIMOD:$1]"), F.when(F.col("row_id") % 5 == 0, "-[UNIMOD:2]").otherwise("")).alias("t"))
R.add("i303_termini", lambda v: _termini(v).select("row_id", C.parse_termini(F.col("t")).alias("p")).select("row_id", "p.n_term", "p.c_term", F.size("p.residues").alias("n"), F.size(F.filter("p.residues", lambda r: r["unimod"].isNotNull())).alias("mods")).where("n > 0"), f"SELECT row_id, CASE WHEN row_id % 3 = 0 THEN CAST(1 AS INT) END AS n_term, CASE WHEN row_id % 5 = 0 THEN CAST(2 AS INT) END AS c_term, CAST(length(regexp_replace(s, '\\[[^\\]]*\\]', '', 'g')) AS INT) AS n, CAST(len(regexp_extract_all(s, 'UNIMOD')) AS INT) AS mods FROM {_TERM} q WHERE (row_id % 3 = 0 OR row_id % 7 <> 0) AND regexp_full_match(s, '(?:[A-Za-z](?:\\[(?:UNIMOD:[0-9]+)?\\])?){{2,}}')")

R.add("i142_blocks", lambda v: B.inverted_index(v.peaks, 0, 64).select("bin", "block", F.size("postings").alias("n"), F.get("postings", F.lit(0))["frame_id"].alias("first_frame")), "SELECT CAST(round(mz) AS BIGINT) AS bin, CAST(floor(frame_id / 64.0) AS BIGINT) AS block, CAST(count(*) AS INT) AS n, min(frame_id) AS first_frame FROM v_peaks GROUP BY CAST(round(mz) AS BIGINT), floor(frame_id / 64.0)", "peaks")

QUERIES, ORACLES = R.queries, R.oracles
