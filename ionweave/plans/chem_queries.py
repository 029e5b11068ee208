"""Queries over formulas, sequences, arrays, generators and sources. Names begin with the operator's inventory number."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ionweave.functions import chemistry as C
from ionweave.functions import peptidoform as P
from ionweave.functions import physics as Y
from ionweave.operators import binning as B
from ionweave.operators import generators as N
from ionweave.operators import greedy as G
from ionweave.operators import hashing as H
from ionweave.plans.peak_queries import _R6, r6
from ionweave.plans.registry import Registry
from ionweave.session import shared_dir
from ionweave.sources import codec, dataset, formats

R = Registry()


def r4(c):
    return F.round(c * 1e4) / 1e4


def _r4(c):
    return f"round(({c}) * 1e4) / 1e4"


_ERF = "CASE WHEN x >= 0 THEN 1 - tau ELSE tau - 1 END"
_T = "(1 / (1 + 0.5 * abs(x)))"
_POLY = str(Y.ERF[-1])
for _c in reversed(Y.ERF[:-1]):
    _POLY = f"({_c} + {_T} * {_POLY})"
_TAU = f"{_T} * exp(-x * x + {_POLY})"

# physics
R.add("i243_linear_scale", lambda v: v.peaks.select("frame_id", "scan", "tof", (F.col("intensity") * 2.5).alias("intensity")), "SELECT frame_id, scan, tof, intensity * 2.5 AS intensity FROM v_peaks", "peaks")
R.add("i244_normalise_sum", lambda v: v.peaks.join(v.peaks.groupBy("frame_id").agg(F.sum("intensity").alias("s")), "frame_id").select("frame_id", "scan", "tof", r6(F.when(F.col("s") == 0, F.col("intensity")).otherwise(F.col("intensity") * 1000 / F.col("s"))).alias("intensity")), f"SELECT frame_id, scan, tof, {_R6('CASE WHEN sum(intensity) OVER w = 0 THEN intensity ELSE intensity * 1000 / sum(intensity) OVER w END')} AS intensity FROM v_peaks WINDOW w AS (PARTITION BY frame_id)", "peaks")
R.add("i245_base_peak", lambda v: v.peaks.join(v.peaks.groupBy("frame_id").agg(F.max("intensity").alias("m")), "frame_id").select("frame_id", "scan", "tof", r6(F.col("intensity") / F.col("m")).alias("intensity")), f"SELECT frame_id, scan, tof, {_R6('intensity / max(intensity) OVER (PARTITION BY frame_id)')} AS intensity FROM v_peaks", "peaks")
R.add("i246_mz_from_mass", lambda v: v.table("peptides").select("row_id", r6(Y.mz_of_mass(F.col("monoisotopic_mass"), F.lit(2))).alias("mz")), f"SELECT row_id, {_R6('(monoisotopic_mass + 2 * 1.007276466621) / 2')} AS mz FROM peptides")
R.add("i247_ccs", lambda v: v.table("parse_diann_report").select("row_id", r4(Y.ccs(F.col("inverse_mobility"), F.col("mz"), F.col("charge"))).alias("ccs")), f"SELECT row_id, {_r4('18509.8632163405 * charge / sqrt(mz * charge * 28.013 / (mz * charge + 28.013) * (31.85 + 273.15)) * inverse_mobility')} AS ccs FROM parse_diann_report")
R.add("i247_mobility", lambda v: v.table("parse_diann_report").select("row_id", r6(Y.one_over_k0(F.lit(400.0), F.col("mz"), F.col("charge"))).alias("k0")), f"SELECT row_id, {_R6('sqrt(mz * charge * 28.013 / (mz * charge + 28.013) * (31.85 + 273.15)) * 400.0 / (18509.8632163405 * charge)')} AS k0 FROM parse_diann_report")
R.add("i249_tof_to_mz", lambda v: v.peaks.select("tof").distinct().select("tof", r4(Y.tof_to_mz(F.col("tof"), 0.2, 24864.0, 312.0, 157424.0 / 100)).alias("mz"), Y.mz_to_tof(Y.tof_to_mz(F.col("tof"), 0.2, 24864.0, 312.0, 1574.24), 0.2, 24864.0, 312.0, 1574.24).alias("back")), f"SELECT DISTINCT tof, {_r4('pow((tof * 0.2 + 24864.0 - 312.0) / 1574.24, 2)')} AS mz, CAST(tof AS BIGINT) AS back FROM v_peaks", "peaks")
R.add("i249_cubic_calibration", lambda v: v.peaks.select("tof").distinct().select("tof", Y.mz_to_tof(Y.tof_to_mz(F.col("tof"), 0.2, 24864.0, 312.0, 1574.24, 0.02, 1e-5), 0.2, 24864.0, 312.0, 1574.24, 0.02, 1e-5).alias("back")), "SELECT DISTINCT tof, CAST(tof AS BIGINT) AS back FROM v_peaks", "peaks")
R.add("i250_scan_to_mobility", lambda v: v.peaks.select("scan").distinct().select("scan", r6(Y.scan_to_one_over_k0(F.col("scan"), 200.0, -0.2, 33.0, 1.0, 10.0, 240.0, 0.004, 130.0)).alias("k0")), f"SELECT DISTINCT scan, {_R6('1 / (0.004 + 130.0 / least(greatest(200.0 - 0.2 * (scan - 33.0 - 1.0), 10.0), 240.0))')} AS k0 FROM v_peaks", "peaks")
R.add("i251_boundary_converter", lambda v: v.peaks.select("tof").distinct().select("tof", r6(Y.boundary_tof_to_mz(F.col("tof"), 100.0, 1700.0, 400000)).alias("mz")), f"SELECT DISTINCT tof, {_R6('pow(10 + (sqrt(1700) - 10) / 400000 * tof, 2)')} AS mz FROM v_peaks", "peaks")
R.add("i252_calibration_fit", lambda v: v.peaks.groupBy("ms_type").agg(F.regr_slope(F.sqrt("mz"), "tof").alias("a"), F.regr_intercept(F.sqrt("mz"), "tof").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 10").select("ms_type", "n", r6("a").alias("a"), r4(F.col("b")).alias("b")), f"SELECT ms_type, count(*) AS n, {_R6('regr_slope(sqrt(mz), tof)')} AS a, {_r4('regr_intercept(sqrt(mz), tof)')} AS b FROM v_peaks GROUP BY ms_type HAVING count(*) >= 10", "peaks")
R.add("i253_erf", lambda v: v.peaks.select("scan").distinct().select("scan", r6(Y.erf((F.col("scan") - 256) / 100)).alias("erf")), f"WITH x AS (SELECT DISTINCT scan, (scan - 256) / 100 AS x FROM v_peaks), t AS (SELECT scan, x, {_TAU} AS tau FROM x) SELECT scan, {_R6('(' + _ERF + ')')} AS erf FROM t", "peaks")
R.add("i254_normal_mass", lambda v: v.peaks.select("scan").distinct().select("scan", r6(Y.normal_mass(F.col("scan").cast("double"), F.col("scan") + 1.0, 250.0, 60.0)).alias("mass")), f"WITH b AS (SELECT DISTINCT scan, (scan - 250) / 60 / sqrt(2) AS lo, (scan + 1 - 250) / 60 / sqrt(2) AS hi FROM v_peaks), a AS (SELECT scan, 0 AS side, lo AS x FROM b UNION ALL SELECT scan, 1, hi FROM b), t AS (SELECT scan, side, x, {_TAU} AS tau FROM a), e AS (SELECT scan, side, 0.5 * (1 + ({_ERF})) AS c FROM t) SELECT scan, {_R6('sum(CASE side WHEN 1 THEN c ELSE -c END)')} AS mass FROM e GROUP BY scan", "peaks")
R.add("i255_emg_mass", lambda v: v.frame_info.select("frame_id", r6(Y.emg_mass(F.col("time") - 1, F.col("time"), F.lit(40.0), F.lit(5.0), F.lit(0.2), 100)).alias("mass")))
R.add("i261_scan_abundance", lambda v: N.scan_table(v.spark, 500, 0.6, 1.6).select("scan", r6(Y.normal_mass(F.col("mobility") - 0.002, F.col("mobility"), 1.1, 0.05)).alias("abundance")).where("abundance > 0"))
R.add("i263_logistic", lambda v: v.peaks.select("tof", "mz").distinct().select("tof", "mz", r6(Y.logistic(F.col("mz"), 500.0, 0.05)).alias("p")), f"SELECT DISTINCT tof, mz, {_R6('1 / (1 + exp(-0.05 * (mz - 500)))')} AS p FROM v_peaks", "peaks")
R.add("i267_isotope_distribution", lambda v: G.isotope_spectra(v.table("parse_diann_report").where("sequence is not null").select("sequence").distinct().join(C.peptide_formula(v.table("parse_diann_report").where("sequence is not null").select("sequence").distinct().withColumn("key", F.col("sequence")), "key").groupBy(F.col("key").alias("sequence")).agg(F.map_from_entries(F.collect_list(F.struct("element", F.col("n").cast("int").alias("n")))).alias("counts")), "sequence"), "sequence", 5))
R.add("i270_averagine", lambda v: v.table("peptides").select("row_id", F.posexplode(Y.averagine_weights(F.col("monoisotopic_mass"), 5)).alias("k", "w")).select("row_id", "k", r6("w").alias("w")), f"WITH l AS (SELECT row_id, 0.000594 * monoisotopic_mass - 0.03091 AS lam, CAST(k AS INT) AS k FROM peptides, range(5) r(k)), w AS (SELECT row_id, k, exp(-lam) * pow(lam, k) / factorial(k) AS w FROM l WHERE lam IS NOT NULL) SELECT row_id, k, {_R6('w / sum(w) OVER (PARTITION BY row_id)')} AS w FROM w")
R.add("i274_charge_pmf", lambda v: C.charge_states(v.table("parse_diann_report").where("sequence is not null").select("row_id", "sequence"), "row_id").select("row_id", "charge", r6("share").alias("share")), f"WITH s AS (SELECT row_id, 1 + length(regexp_replace(regexp_replace(sequence, '\\[[^]]*\\]', '', 'g'), '[^HRK]', '', 'g')) AS n FROM parse_diann_report WHERE sequence IS NOT NULL) SELECT row_id, CAST(z AS INT) AS charge, CASE WHEN n >= z THEN {_R6('factorial(CAST(n AS INT)) / (factorial(CAST(z AS INT)) * factorial(CAST(greatest(n - z, 0) AS INT))) * pow(0.8, z) * pow(0.2, n - z)')} ELSE 0 END AS share FROM s, range(1, 5) r(z)")
R.add("i275_score_primitives", lambda v: v.ms1.select("cluster_id", r6(Y.exp_decay(F.col("rt_hi") - F.col("rt_lo"), 3.0)).alias("decay"), r6(F.log1p("raw_sum")).alias("l"), r6(Y.pooled_sigma((F.col("rt_hi") - F.col("rt_lo")).cast("double"), (F.col("im_hi") - F.col("im_lo")).cast("double"))).alias("sigma")), f"SELECT cluster_id, {_R6('exp(-abs(rt_hi - rt_lo) / 3.0)')} AS decay, {_R6('ln(1 + raw_sum)')} AS l, {_R6('sqrt(0.5 * ((rt_hi - rt_lo) * (rt_hi - rt_lo) + (im_hi - im_lo) * (im_hi - im_lo)))')} AS sigma FROM v_ms1", "ms1")
R.add("i278_tolerance", lambda v: v.ms1.select("cluster_id", r6(Y.isotope_tolerance(F.col("mz"), 10.0, 0.003)).alias("tol")), f"SELECT cluster_id, {_R6('greatest(mz * 10.0 * 1e-6, 0.003)')} AS tol FROM v_ms1", "ms1")
R.add("i279_energy_policy", lambda v: v.ms1.select("cluster_id", r6(Y.collision_energy(F.col("mz"), "linear", 10.0, 0.03)).alias("ce")), f"SELECT cluster_id, {_R6('10.0 + 0.03 * mz')} AS ce FROM v_ms1", "ms1")
R.add("i280_axis_normalise", lambda v: v.peaks.withColumn("lo", v.peaks.agg(F.min("mz")).scalar()).withColumn("hi", v.peaks.agg(F.max("mz")).scalar()).select("tof", "mz", r6(Y.axis_to_unit(F.col("mz"), F.col("lo"), F.col("hi"))).alias("u")), f"SELECT tof, mz, {_R6('2 * (mz - (SELECT min(mz) FROM v_peaks)) / ((SELECT max(mz) FROM v_peaks) - (SELECT min(mz) FROM v_peaks)) - 1')} AS u FROM v_peaks", "peaks")
R.add("i282_log_mz", lambda v: v.peaks.select("tof", "mz").distinct().select("tof", "mz", (F.round(Y.log_mz(F.col("mz"), 150.0, 50000.0) * 10) / 10).alias("x")), f"SELECT DISTINCT tof, mz, round((ln(mz) - ln(150)) / ln(1 + 1 / 50000.0) * 10) / 10 AS x FROM v_peaks", "peaks")
R.add("i283_densities", lambda v: v.frame_info.select("frame_id", r6(Y.normal_pdf(F.col("time"), 30.0, 8.0)).alias("n"), r6(Y.exponential_pdf(F.col("time"), 0.1)).alias("e"), r6(Y.emg_pdf(F.col("time"), 30.0, 5.0, 0.2)).alias("g")).drop("g"), f"SELECT frame_id, {_R6('exp(-0.5 * pow((time - 30) / 8, 2)) / (8 * sqrt(2 * pi()))')} AS n, {_R6('0.1 * exp(-0.1 * time)')} AS e FROM v_frame_info", "frame_info")
R.add("i285_event_sampling", lambda v: v.table("peptides").select("row_id", N.exponential_events(1000.0, 1, 100000, 3, "peptide_id").alias("events")))
R.add("i286_mz_noise", lambda v: B.to_resolution(N.mz_noise(v.peaks, 5.0, "normal", 11, "frame_id", "scan", "tof", "mz"), 6, "frame_id"))
R.add("i289_regression_metrics", lambda v: v.table("peptides").where("events is not null and monoisotopic_mass is not null").agg(F.avg(F.abs(F.col("events") - F.col("monoisotopic_mass"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("events") - F.col("monoisotopic_mass"), F.lit(2.0)))).alias("rmse"), F.regr_r2("events", "monoisotopic_mass").alias("r2")).select(r4(F.col("mae")).alias("mae"), r4(F.col("rmse")).alias("rmse"), r6("r2").alias("r2")), f"SELECT {_r4('avg(abs(events - monoisotopic_mass))')} AS mae, {_r4('sqrt(avg(pow(events - monoisotopic_mass, 2)))')} AS rmse, {_R6('regr_r2(events, monoisotopic_mass)')} AS r2 FROM peptides WHERE events IS NOT NULL AND monoisotopic_mass IS NOT NULL")

# sequences
_seq = lambda v: v.table("parse_diann_report").where("sequence_modified is not null").select("row_id", F.regexp_replace("sequence_modified", r"\(UniMod:([0-9]+)\)", "[UNIMOD:$1]").alias("sequence"))
_SEQ = "(SELECT row_id, regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g') AS s FROM parse_diann_report WHERE sequence_modified IS NOT NULL) q"
_STRIP = "regexp_replace(s, '\\[UNIMOD:[0-9]+\\]', '', 'g')"
_MASS = " + ".join([str(Y.MASS_WATER)] + [f"(length({_STRIP}) - length(replace({_STRIP}, '{r}', ''))) * {m}" for r, m in C.RESIDUE_MASS.items()] + [f"len(regexp_extract_all(s, '\\[UNIMOD:{n}\\]')) * {m}" for n, m in C.UNIMOD_MASS.items()])
R.add("i290_strip_tags", lambda v: _seq(v).select("row_id", C.strip_tags(F.col("sequence")).alias("bare")), f"SELECT row_id, {_STRIP} AS bare FROM {_SEQ}")
R.add("i291_tokens", lambda v: _seq(v).select("row_id", F.array_join(C.tokens(F.col("sequence")), " ").alias("tokens"), F.size(C.split_tokens(F.col("sequence"))).alias("n")), f"SELECT row_id, array_to_string(regexp_extract_all(s, '[A-Z](?:\\[UNIMOD:[0-9]+\\])*'), ' ') AS tokens, CAST(len(regexp_extract_all(s, '[A-Z]|\\[UNIMOD:[0-9]+\\]')) AS INT) - CAST(0 AS INT) AS n FROM {_SEQ}".replace("CAST(len(regexp_extract_all(s, '[A-Z]|\\[UNIMOD:[0-9]+\\]')) AS INT) - CAST(0 AS INT)", f"CAST(length({_STRIP}) + len(regexp_extract_all(s, 'UNIMOD')) AS INT)"))
R.add("i292_mass_vector", lambda v: _seq(v).select("row_id", F.posexplode(C.mod_vector(F.col("sequence"))).alias("position", "m")).where("m > 0").select("row_id", "position", r6("m").alias("m")))
R.add("i293_composition", lambda v: _seq(v).select("row_id", F.explode(C.composition(F.col("sequence"))).alias("residue", "n")), f"SELECT row_id, r AS residue, CAST(count(*) AS INT) AS n FROM (SELECT row_id, unnest(string_split({_STRIP}, '')) AS r FROM {_SEQ}) x WHERE r <> '' GROUP BY ALL")
R.add("i294_mono_mass", lambda v: _seq(v).select("row_id", r4(C.mass_by_counts(F.col("sequence"))).alias("mass")), f"SELECT row_id, {_r4(_MASS)} AS mass FROM {_SEQ}")
R.add("i295_ion_mass", lambda v: C.product_ions(_seq(v), "row_id", ("y",)).where("ordinal = 1").select("row_id", "ion", r4(F.col("mz")).alias("mz")))
R.add("i296_formula", lambda v: C.peptide_formula(v.table("parse_diann_report").where("sequence is not null").select("row_id", "sequence"), "row_id"), "WITH f(r, e, n) AS (VALUES " + ", ".join(f"('{r}', '{e}', {n})" for r, f in C.RESIDUE_FORMULA.items() for e, n in [(a, int(b or 1)) for a, b in __import__("re").findall("([A-Z][a-z]?)([0-9]*)", f)]) + "), s AS (SELECT row_id, unnest(string_split(sequence, '')) AS r FROM parse_diann_report WHERE sequence IS NOT NULL) SELECT row_id, element, CAST(sum(n) AS BIGINT) AS n FROM (SELECT row_id, e AS element, n FROM s JOIN f USING (r) UNION ALL SELECT row_id, 'H', 2 FROM parse_diann_report WHERE sequence IS NOT NULL UNION ALL SELECT row_id, 'O', 1 FROM parse_diann_report WHERE sequence IS NOT NULL) x GROUP BY ALL")
R.add("i297_product_ions", lambda v: C.product_ions(_seq(v), "row_id").select("row_id", "kind", "ordinal", "ion", r4(F.col("mz")).alias("mz")))
R.add("i298_ion_spectra", lambda v: C.product_ions(_seq(v), "row_id").groupBy("row_id", F.round(F.col("mz") * 100).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")))
R.add("i300_protonizable", lambda v: _seq(v).select("row_id", C.protonizable(F.col("sequence")).alias("n")), f"SELECT row_id, CAST(1 + length(regexp_replace({_STRIP}, '[^HRK]', '', 'g')) AS INT) AS n FROM {_SEQ}")
R.add("i301_formula_parse", lambda v: v.table("nation").select("n_nationkey", F.concat(F.lit("C"), (F.col("n_nationkey") + 2).cast("string"), F.lit("H12N"), (F.col("n_nationkey") + 1).cast("string"), F.lit("O")).alias("f")).select("n_nationkey", "f", F.explode(C.formula_counts(F.col("f"))).alias("element", "n")), "SELECT n_nationkey, 'C' || (n_nationkey + 2) || 'H12N' || (n_nationkey + 1) || 'O' AS f, e AS element, CAST(CASE e WHEN 'C' THEN n_nationkey + 2 WHEN 'H' THEN 12 WHEN 'N' THEN n_nationkey + 1 ELSE 1 END AS INT) AS n FROM nation, (VALUES ('C'), ('H'), ('N'), ('O')) t(e)")
R.add("i302_formula_mass", lambda v: v.table("nation").select("n_nationkey", r4(C.formula_mass(F.concat(F.lit("C"), (F.col("n_nationkey") + 2).cast("string"), F.lit("H12O")))).alias("mass")), f"SELECT n_nationkey, {_r4('(n_nationkey + 2) * 12.0 + 12 * 1.00782503223 + 15.99491461957')} AS mass FROM nation")
R.add("i305_digest", lambda v: C.digest(v.table("documents").select("doc_id", F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("sequence")).where("sequence is not null"), "doc_id", missed=1, lo=7, hi=30).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("peptide")).alias("longest")))
R.add("i306_phospho_sites", lambda v: C.sites(_seq(v), "row_id"), f"SELECT row_id, CAST(p - 1 AS INT) AS position FROM (SELECT row_id, {_STRIP} AS b, unnest(range(1, length({_STRIP}) + 1)) AS p FROM {_SEQ}) x WHERE substr(b, p, 1) IN ('S', 'T', 'Y')")
R.add("i306_site_pairs", lambda v: C.site_pairs(_seq(v), "row_id"), f"WITH s AS (SELECT row_id, p - 1 AS p FROM (SELECT row_id, {_STRIP} AS b, unnest(range(1, length({_STRIP}) + 1)) AS p FROM {_SEQ}) x WHERE substr(b, p, 1) IN ('S', 'T', 'Y')) SELECT a.row_id, CAST(a.p AS INT) AS a, CAST(b.p AS INT) AS b FROM s a JOIN s b ON a.row_id = b.row_id AND a.p < b.p")
R.add("i307_report_sequences", lambda v: v.table("parse_diann_report").select("row_id", P.canonical(F.col("sequence_modified"), P.mod_rows(v.table("mods"))).alias("form")), "SELECT row_id, regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g') AS form FROM parse_diann_report")
R.add("i308_peptidoform_keys", lambda v: _seq(v).select("row_id", C.peptidoform_key(F.col("sequence")).alias("pf"), C.mod_multiset(F.col("sequence")).alias("mods")).select("row_id", F.split("pf", r"\|")[0].alias("backbone"), "mods"), f"SELECT row_id, replace({_STRIP}, 'I', 'L') AS backbone, array_to_string(list_sort(regexp_extract_all(s, 'UNIMOD:([0-9]+)', 1)), ';') AS mods FROM {_SEQ}")
R.add("i309_precursor_id", lambda v: _seq(v).join(v.table("parse_diann_report").select("row_id", "charge"), "row_id").select("row_id", F.concat_ws("_", "sequence", "charge").alias("pid")), f"SELECT q.row_id, concat_ws('_', s, charge) AS pid FROM {_SEQ} JOIN parse_diann_report p ON p.row_id = q.row_id")
R.add("i310_length", lambda v: _seq(v).select("row_id", C.residue_count(F.col("sequence")).alias("n"), C.missed_cleavages(F.col("sequence")).alias("missed")), f"SELECT row_id, CAST(length({_STRIP}) AS INT) AS n, CAST(len(regexp_extract_all({_STRIP}, '[KR][^P]')) AS INT) AS missed FROM {_SEQ}".replace("len(regexp_extract_all(" + _STRIP + ", '[KR][^P]'))", f"list_sum(list_transform(range(1, length({_STRIP})), lambda i: CASE WHEN substr({_STRIP}, i, 1) IN ('K', 'R') AND substr({_STRIP}, i + 1, 1) <> 'P' THEN 1 ELSE 0 END))"))
R.add("i311_list_strings", lambda v: v.table("nation").select("n_nationkey", F.array_join(formats.parse_list(F.concat(F.lit("['"), "n_name", F.lit("', 'x']"))), ";").alias("joined")), "SELECT n_nationkey, n_name || ';x' AS joined FROM nation")
R.add("i312_model_dialects", lambda v: _seq(v).select("row_id", C.model_dialect(F.col("sequence"), "mass").alias("m"), C.model_dialect(F.col("sequence"), "none").alias("bare")).select("row_id", "bare", F.regexp_count("m", F.lit(r"\[\+")).alias("n")), f"SELECT row_id, {_STRIP} AS bare, CAST(len(regexp_extract_all(s, 'UNIMOD')) AS INT) AS n FROM {_SEQ}")
R.add("i313_encode", lambda v: _seq(v).select("row_id", C.encode_tokens(F.col("sequence"), {r: i + 2 for i, r in enumerate(P.RESIDUES)}, 12).alias("ids")), f"SELECT row_id, list_transform(range(1, 13), lambda i: CASE WHEN i > len(t) THEN 0 WHEN length(t[i]) > 1 THEN 1 ELSE CAST(strpos('{P.RESIDUES}', t[i]) + 1 AS INT) END)::INT[] AS ids FROM (SELECT row_id, regexp_extract_all(s, '[A-Z](?:\\[UNIMOD:[0-9]+\\])*') AS t FROM {_SEQ}) x")
R.add("i313_encode_whole", lambda v: _seq(v).select("row_id", C.encode_tokens(F.col("sequence"), {r: i + 2 for i, r in enumerate(P.RESIDUES)}, 30).alias("ids")), f"SELECT row_id, list_transform(range(1, 31), lambda i: CASE WHEN i > len(t) THEN 0 WHEN length(t[i]) > 1 THEN 1 ELSE CAST(strpos('{P.RESIDUES}', t[i]) + 1 AS INT) END)::INT[] AS ids FROM (SELECT row_id, regexp_extract_all(s, '[A-Z](?:\\[UNIMOD:[0-9]+\\])*') AS t FROM {_SEQ}) x")
R.add("i314_sanitise", lambda v: v.table("precursors").select("row_id", F.when(~F.isnan("intensity"), F.col("intensity")).alias("intensity"), F.coalesce("monoisotopicmz", "largestpeakmz", "averagemz").alias("mz")), "SELECT row_id, CASE WHEN NOT isnan(intensity) THEN intensity END AS intensity, coalesce(monoisotopicmz, largestpeakmz, averagemz) AS mz FROM precursors")

# arrays, json
R.add("i315_json_arrays", lambda v: v.peaks.groupBy("frame_id").agg(F.array_sort(F.collect_set("scan")).alias("s")).select("frame_id", F.to_json("s").alias("json"), F.size(F.from_json(F.to_json("s"), "array<int>")).alias("n")).select("frame_id", "n"), "SELECT frame_id, CAST(count(DISTINCT scan) AS INT) AS n FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i316_object_json", lambda v: v.table("nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("json")), "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
R.add("i317_vectorise", lambda v: H.spectrum_vector(v.peaks, 0, "frame_id").select("frame_id", F.size("indices").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")), "SELECT frame_id, CAST(count(DISTINCT round(mz)) AS INT) AS n, sum(intensity) AS total FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i318_sparse_to_dense", lambda v: H.spectrum_vector(v.peaks, 0, "frame_id").select("frame_id", F.posexplode(H.sparse_to_dense(F.col("indices"), F.col("values"), 1100)).alias("i", "v")).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "SELECT frame_id, CAST(1100 AS BIGINT) AS n, sum(intensity) FILTER (WHERE round(mz) < 1100) AS total FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i319_dense_to_sparse", lambda v: v.table("embeddings").select("vec_id", F.size(H.dense_to_sparse(F.transform("embedding", lambda x: x.cast("double")))).alias("n")), "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: round(CAST(x AS DOUBLE), 6) > 0)) AS INT) AS n FROM embeddings")
R.add("i320_reshape", lambda v: v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.expr("i div 6").alias("position"), F.expr("i % 6 div 3").alias("ion"), F.expr("i % 3").alias("charge"), "x").groupBy("position", "ion", "charge").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(i // 6 AS INT) AS position, CAST(i % 6 // 3 AS INT) AS ion, CAST(i % 3 AS INT) AS charge, count(*) AS n FROM embeddings, range(64) r(i) GROUP BY ALL")
R.add("i321_masks", lambda v: v.table("embeddings").select("vec_id", F.aggregate(F.transform("embedding", lambda x, i: F.when(i >= F.col("vec_id") % 64, -1).otherwise(0)), F.lit(0), lambda a, x: a + x).alias("masked")), "SELECT vec_id, CAST(-(64 - vec_id % 64) AS INT) AS masked FROM embeddings")
R.add("i324_flatten_rebuild", lambda v: v.peaks.groupBy("frame_id").agg(F.collect_list(F.struct("scan", "tof", "intensity")).alias("p")).select("frame_id", F.explode("p").alias("x")).select("frame_id", "x.*"), "SELECT frame_id, scan, tof, intensity FROM v_peaks", "peaks")
R.add("i326_map_merge", lambda v: v.table("nation").select("n_nationkey", F.map_zip_with(F.create_map(F.lit("a"), F.col("n_nationkey")), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), lambda k, x, y: F.coalesce(x, F.lit(0)) + y).alias("m")).select("n_nationkey", F.explode("m").alias("k", "n")), "SELECT n_nationkey, k, CAST(CASE k WHEN 'a' THEN n_nationkey + 1 ELSE 2 END AS INT) AS n FROM nation, (VALUES ('a'), ('b')) t(k)")
R.add("i327_mobility_groups", lambda v: v.peaks.groupBy("frame_id", "mobility").agg(F.sum("intensity").alias("i")).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("mobility", "i"))).alias("m")).select("frame_id", F.size("m").alias("n"), F.get("m", F.lit(0))["i"].alias("first")), "SELECT frame_id, CAST(count(*) AS INT) AS n, arg_min(i, mobility) AS first FROM (SELECT frame_id, mobility, sum(intensity) AS i FROM v_peaks GROUP BY ALL) x GROUP BY frame_id", "peaks")

# generators
R.add("i352_timeline", lambda v: N.timeline(v.spark, [("MS1", 0.1), ("MS2", 0.05), ("MS2", 0.05)], 50).select("frame_id", "cycle", "kind", r6("start").alias("start"), r6("end").alias("end")), f"SELECT c.cycle * 3 + e.i + 1 AS frame_id, c.cycle, e.kind, {_R6('c.cycle * 0.2 + e.a')} AS start, {_R6('c.cycle * 0.2 + e.b')} AS \"end\" FROM range(50) c(cycle), (VALUES (0, 'MS1', 0.0, 0.1), (1, 'MS2', 0.1, 0.15), (2, 'MS2', 0.15, 0.2)) e(i, kind, a, b)")
R.add("i353_scheme_check", lambda v: N.check_scheme(v.windows), "SELECT window_group, row_order, 'overlap' AS problem FROM (SELECT *, max(scan_end) OVER (PARTITION BY window_group ORDER BY scan_begin, row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v_windows) x WHERE p >= scan_begin", "windows")
R.add("i355_frame_table", lambda v: N.frame_table(v.spark, 200, 0.5, 5), "SELECT id AS frame_id, id * 0.5 AS time, CAST(CASE WHEN (id - 1) % 5 = 0 THEN 0 ELSE 9 END AS INT) AS ms_type, CASE WHEN (id - 1) % 5 <> 0 THEN (id - 1) % 5 END AS window_group FROM range(1, 201) r(id)")
R.add("i355_scan_table", lambda v: N.scan_table(v.spark, 101, 0.6, 1.6).select("scan", r6("mobility").alias("mobility")), f"SELECT id AS scan, {_R6('1.6 - id * 0.01')} AS mobility FROM range(101) r(id)")
R.add("i358_sliding_windows", lambda v: N.sliding_windows(v.spark, 400.0, 900.0, 20.0, 5.0), "SELECT id AS position, 410.0 + id * 5.0 AS isolation_mz, 20.0 AS isolation_width FROM range(97) r(id)")
R.add("i359_charge_expansion", lambda v: C.charge_states(v.table("peptides").where("sequence is not null").select("row_id", "sequence"), "row_id", least=0.05, renormalise=True).groupBy("charge").agg(F.count(F.lit(1)).alias("n")))
R.add("i361_frame_distribution", lambda v: N.frame_distribution(v.table("peptides").where("monoisotopic_mass is not null").select(F.col("row_id").alias("peptide_id"), F.expr("monoisotopic_mass % 100").alias("rt_mu"), F.lit(2.0).alias("rt_sigma")), v.frame_info, 1.0, width=4.0).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")))
R.add("i365_config_grid", lambda v: v.spark.createDataFrame([(c["name"], json.dumps(c, sort_keys=True)) for c in N.expand_grid({"gradient": 3600, "noise": False}, [{"name": "a"}, {"name": "b", "noise": True}])], "name string, config string"), "SELECT * FROM (VALUES ('a', '{\"gradient\": 3600, \"name\": \"a\", \"noise\": false}'), ('b', '{\"gradient\": 3600, \"name\": \"b\", \"noise\": true}')) t(name, config)")
R.add("i347_protein_events", lambda v: N.protein_events(v.table("peptides").where("protein_id is not null").select("protein_id").distinct(), v.spark.range(1, 1001).select(F.col("id").cast("int").alias("rank"), (1e6 / F.col("id")).alias("events"))))
R.add("i351_derived_seeds", lambda v: v.table("nation").select("n_nationkey", N.derive_seed("n_name").alias("seed")))
R.add("i052_demo_points", lambda v: N.demo_points(v.spark, 10000, 8, 5))

# sources and sinks, each written to the shared folder and read again


def _round_trip_blobs(v):
    whole = v.peaks.groupBy("frame_id", "scan", "tof").agg(F.sum("intensity").alias("intensity"))
    return codec.decode(codec.encode(whole, 512))


def _round_trip_folder(v):
    base = shared_dir(v.spark).removeprefix("file://") + f"/run-{uuid.uuid4().hex}.d"
    d = dataset.Dataset(v.peaks, v.frame_info)
    dataset.write_folder(d, base, 512)
    return dataset.read_folder(v.spark, base, (100.0, 1700.0), 400000, (0.6, 1.6)).peaks.select("frame_id", "scan", "tof", "intensity")


def _library(v):
    r = v.table("parse_diann_report").where("sequence is not null and charge is not null and mz is not null").groupBy("sequence", "charge").agg(F.max("mz").alias("mz"))
    ions = r.select(F.xxhash64("sequence", "charge").alias("ion_id"), "sequence", "charge", "mz", F.lit(0.0).alias("rt"))
    frag = C.product_ions(ions, "ion_id", ("y",)).select("ion_id", F.col("kind").alias("fragment"), F.col("mz").alias("fragment_mz"), F.col("ordinal").cast("double").alias("intensity"))
    return formats.library_rows(ions, frag).groupBy("ModifiedPeptide", "PrecursorCharge").agg(F.count(F.lit(1)).alias("n"), F.max("LibraryIntensity").alias("top"))


R.add("i024_frame_codec", _round_trip_blobs, "SELECT frame_id, scan, tof, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL", "peaks")
R.add("i030_run_folder", _round_trip_folder, "SELECT frame_id, scan, tof, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL", "peaks")
R.add("i038_spectral_library", _library, "SELECT sequence AS ModifiedPeptide, charge AS PrecursorCharge, CAST(length(sequence) - 1 AS BIGINT) AS n, 1.0::DOUBLE AS top FROM (SELECT DISTINCT sequence, charge FROM parse_diann_report WHERE sequence IS NOT NULL AND charge IS NOT NULL AND mz IS NOT NULL) x WHERE length(sequence) BETWEEN 4 AND 50")
R.add("i039_mzml", lambda v: formats.mzml_spectra(v.peaks.withColumn("spec_id", F.col("frame_id"))).select("spec_id", F.regexp_extract("xml", 'defaultArrayLength="([0-9]+)"', 1).cast("long").alias("n")), "SELECT frame_id AS spec_id, count(*) AS n FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i049_pin", lambda v: formats.pin_rows(v.table("peptides").select(F.col("row_id").alias("spec_idx"), "decoy", "sequence", F.col("protein").alias("proteins"), F.col("monoisotopic_mass").alias("mass")), ["mass"]), "SELECT row_id AS SpecId, CAST(CASE WHEN decoy THEN -1 ELSE 1 END AS INT) AS Label, monoisotopic_mass AS mass, sequence AS Peptide, protein AS Proteins FROM peptides")
R.add("i046_fill_intensity", lambda v: formats.fill_intensity(v.table("parse_diann_report").select("row_id", "sequence", "charge", "intensity"), v.table("parse_diann_report").select("sequence", "charge", "intensity")).select("row_id", "intensity"), "SELECT row_id, coalesce(p.intensity, m.i) AS intensity FROM parse_diann_report p LEFT JOIN (SELECT sequence, charge, max(intensity) AS i FROM parse_diann_report GROUP BY ALL) m ON p.sequence = m.sequence AND p.charge = m.charge")

QUERIES, ORACLES = R.queries, R.oracles
