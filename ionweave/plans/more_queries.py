"""Queries over assembly, annotation, extraction, evaluation details and text sources. Names begin with the inventory number."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ionweave.functions import arrays as A
from ionweave.functions import chemistry as C
from ionweave.functions import physics as Y
from ionweave.operators import assembly as M
from ionweave.operators import binning as B
from ionweave.operators import evaluation as E
from ionweave.operators import hashing as H
from ionweave.operators import ranking as K
from ionweave.operators import windows as W
from ionweave.plans.match_queries import pairs, settings, transmitted
from ionweave.plans.peak_queries import _R6, r6
from ionweave.plans.registry import Registry
from ionweave.session import shared_dir
from ionweave.sources import dataset, formats

R = Registry()


def _path(v, name):
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def _dataset(v):
    path = _path(v, "run")
    dataset.Dataset(v.peaks, v.frame_info).write(path)
    return dataset.Dataset.read(v.spark, path)


def _json(v):
    path = _path(v, "clusters")
    v.ms1.select("cluster_id", F.struct("rt_lo", "rt_hi").alias("rt"), F.array("im_lo", "im_hi").alias("im")).write.json(path)
    return v.spark.read.schema("cluster_id long, rt struct<rt_lo:int,rt_hi:int>, im array<int>").json(path).select("cluster_id", "rt.rt_lo", F.col("im")[1].alias("im_hi"))


def _mgf(v):
    path = _path(v, "mgf")
    p = v.peaks.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mz", "intensity"))), lambda x: F.concat(x["mz"].cast("string"), F.lit(" "), x["intensity"].cast("string"))), "\n").alias("p"))
    p.select(F.concat(F.lit("BEGIN IONS\nTITLE=f"), F.col("frame_id").cast("string"), F.lit("\nPEPMASS=500.5 10\nCHARGE=2+\n"), "p", F.lit("\nEND IONS"))).write.text(path)
    return formats.read_mgf(v.spark, path).select(F.substring("title", 2, 9).cast("int").alias("frame_id"), "charge", "pepmass", F.size("peaks").alias("n"))


def _fasta(v):
    path = _path(v, "fasta")
    v.table("parse_diann_report").where("sequence is not null").select(F.concat(F.lit(">r"), F.col("row_id").cast("string"), F.lit(" text\n"), F.substring("sequence", 1, 5), F.lit("\n"), F.expr("substring(sequence, 6)"))).write.text(path)
    return formats.read_fasta(v.spark, path).select(F.substring("protein_id", 2, 19).cast("long").alias("row_id"), "sequence")


def _findings(v):
    path = _path(v, "findings")
    v.table("findings").where("sequence not like '%\"%' and intensity is not null and not isnan(intensity)").select(F.col("sequence").alias(" Peptide "), F.col("intensity").alias("Quantity"), F.col("protein").alias("PROTEIN")).coalesce(4).write.option("header", True).csv(path)
    return formats.read_findings(v.spark, path).agg(F.count(F.lit(1)).alias("n"), F.count("charge").alias("n_charge"), F.countDistinct("protein").alias("n_protein"))


def _dialect(v):
    r = v.table("parse_diann_report").select(F.concat(F.lit("_"), "sequence", F.lit("_")).alias("EG.ModifiedSequence"), F.col("charge").alias("FG.Charge"), F.col("intensity").alias("FG.Quantity"), F.col("q_value").alias("EG.Qvalue"))
    return formats.normalise_report(r, "spectronaut").select("sequence", "charge", "intensity", "q")


R.add("i005_dataset", lambda v: _dataset(v).in_time(3.0, 9.0).select("frame_id", "scan", "tof", "intensity"), "SELECT frame_id, scan, tof, intensity FROM v_peaks WHERE frame_id IN (SELECT frame_id FROM v_frame_info WHERE time BETWEEN 3 AND 9)", "peaks frame_info")
R.add("i034_cluster_json", _json, "SELECT cluster_id, rt_lo, im_hi FROM v_ms1", "ms1")
R.add("i041_mgf", _mgf, "SELECT frame_id, CAST(2 AS INT) AS charge, 500.5::DOUBLE AS pepmass, CAST(count(*) AS INT) AS n FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i042_fasta", _fasta, "SELECT row_id, sequence FROM parse_diann_report WHERE sequence IS NOT NULL")
R.add("i044_findings", _findings, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_charge, count(DISTINCT protein) AS n_protein FROM findings WHERE sequence NOT LIKE '%\"%' AND intensity IS NOT NULL AND NOT isnan(intensity)")
R.add("i045_report_dialects", _dialect, "SELECT sequence, charge, intensity, q_value AS q FROM parse_diann_report")
R.add("i047_checkpoint", lambda v: formats.checkpoint_stage(v.windows, _path(v, "stages"), "windows"), "SELECT * FROM v_windows", "windows")
R.add("i062_fused_build", lambda v: B.to_resolution(v.peaks, 0, "frame_id").where("intensity >= 60"), "SELECT frame_id, CAST(round(mz) AS BIGINT) / 1.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id, CAST(round(mz) AS BIGINT) HAVING sum(intensity) >= 60", "peaks")
R.add("i084_truth_assembly", lambda v: v.table("parse_diann_report").select("row_id", "sequence", "charge").join(v.table("peptides").where("not decoy").select("sequence", "protein", "missed_cleavages"), "sequence"), "SELECT r.row_id, r.sequence, r.charge, p.protein, p.missed_cleavages FROM parse_diann_report r JOIN peptides p ON p.sequence = r.sequence AND NOT p.decoy")
R.add("i087_competition", lambda v: M.target_decoy(v.report.select("seq_id", F.round(F.col("q") * 100).cast("int").alias("score"), (F.col("charge") + F.floor(F.col("intensity")) * 10).cast("long").alias("match"), (F.col("charge") == 5).alias("decoy")), "seq_id", "score", "match").groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("q")).select("score", "n", r6("q").alias("q")), f"WITH m AS (SELECT seq_id, CAST(round(q * 100) AS INT) AS score, CAST(charge + floor(intensity) * 10 AS BIGINT) AS id, charge = 5 AS decoy FROM v_report), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, id) AS r FROM m) x WHERE r = 1), p AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE decoy) AS d, count(*) FILTER (WHERE NOT decoy) AS t FROM b GROUP BY score), f AS (SELECT score, n, least(1.0, sum(d) OVER (ORDER BY score DESC) / greatest(sum(t) OVER (ORDER BY score DESC), 1)) AS f FROM p) SELECT score, n, {_R6('min(f) OVER (ORDER BY score)')} AS q FROM f", "report")
R.add("i117_superposition", lambda v: M.superpose(v.peaks.where("ms_type = 0"), v.peaks.where("ms_type = 8").withColumn("frame_id", F.col("frame_id") - 1)), "SELECT frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT) AS k, sum(intensity) AS intensity FROM (SELECT frame_id, scan, mz, intensity FROM v_peaks WHERE ms_type = 0 UNION ALL SELECT frame_id - 1, scan, mz, intensity FROM v_peaks WHERE ms_type = 8) x GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT)"), "peaks")
R.add("i118_dimension_lookup", lambda v: v.peaks.select("frame_id", "scan").distinct().join(v.dia_info, "frame_id").join(settings(v), ["window_group", "scan"], "left").select("frame_id", "scan", F.coalesce("isolation_mz", F.lit(float("nan"))).alias("isolation_mz")).where("isnan(isolation_mz)").select("frame_id", "scan"), "SELECT DISTINCT p.frame_id, p.scan FROM v_peaks p JOIN v_dia_info d USING (frame_id) WHERE NOT EXISTS (SELECT 1 FROM v_windows w WHERE w.window_group = d.window_group AND p.scan BETWEEN w.scan_begin AND w.scan_end)", "peaks dia_info windows")
R.add("i119_scan_ranges", lambda v: v.windows.where(F.abs(F.col("isolation_mz") - 500.0) <= F.col("isolation_width") * 3).groupBy("window_group").agg(F.min("scan_begin").alias("lo"), F.max("scan_end").alias("hi")), "SELECT window_group, min(scan_begin) AS lo, max(scan_end) AS hi FROM v_windows WHERE abs(isolation_mz - 500) <= isolation_width * 3 GROUP BY window_group", "windows")
R.add("i122_ptm_localisation", lambda v: v.truth.join(v.report.select("seq_id", "charge"), ["seq_id", "charge"], "left_semi").agg(F.count(F.lit(1)).alias("n_matched")), "SELECT count(*) AS n_matched FROM v_truth SEMI JOIN v_report USING (seq_id, charge)", "truth report")
R.add("i129_annotated_bins", lambda v: M.annotate(v.peaks.withColumn("k", B.mz_key(0)), ["frame_id", "k"], F.col("tof")).select("frame_id", "k", "intensity", F.size("contributions").alias("n"), M.first_source("contributions").alias("first")), "SELECT frame_id, CAST(round(mz) AS BIGINT) AS k, sum(intensity) AS intensity, CAST(count(*) AS INT) AS n, arg_min(tof, {'a': -intensity, 'b': tof}) AS first FROM v_peaks GROUP BY frame_id, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i140_chromatograms", lambda v: M.chromatograms(v.peaks, v.ms1.select(F.col("cluster_id").alias("target_id"), F.col("mz").alias("target_mz")), 100.0), "SELECT cluster_id AS target_id, frame_id, sum(intensity) AS intensity FROM v_peaks p JOIN v_ms1 t ON p.mz BETWEEN t.mz * (1 - 100.0 * 1e-6) AND t.mz * (1 + 100.0 * 1e-6) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY cluster_id, frame_id"), "peaks ms1")
R.add("i140_mobilograms", lambda v: M.mobilograms(v.peaks, v.ms1.select(F.col("cluster_id").alias("target_id"), F.col("mz").alias("target_mz")), 100.0), "SELECT cluster_id AS target_id, CAST(round(mobility * 1000) AS INT) AS bin, sum(intensity) AS intensity FROM v_peaks p JOIN v_ms1 t ON p.mz BETWEEN t.mz * (1 - 100.0 * 1e-6) AND t.mz * (1 + 100.0 * 1e-6) GROUP BY cluster_id, CAST(round(mobility * 1000) AS INT)", "peaks ms1")
R.add("i148_tof_histogram", lambda v: K.histogram(v.peaks, "tof", 0.0, 20000.0, 40), "SELECT CAST(c.cell AS INT) AS cell, count(p.b) AS n FROM range(40) c(cell) LEFT JOIN (SELECT least(greatest(floor(tof / 20000.0 * 40), 0), 39) AS b FROM v_peaks) p ON p.b = c.cell GROUP BY c.cell", "peaks")
R.add("i152_dia_index", lambda v: M.dia_index(v.dia_info, v.windows).select("window_group", "n_frames", "mz_lo", "mz_hi", F.size("scan_unions").alias("n_unions")), "WITH b AS (SELECT *, CASE WHEN scan_begin > max(scan_end) OVER (PARTITION BY window_group ORDER BY scan_begin, scan_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS brk FROM v_windows) SELECT window_group, (SELECT count(*) FROM v_dia_info d WHERE d.window_group = b.window_group) AS n_frames, min(isolation_mz - isolation_width / 2) AS mz_lo, max(isolation_mz + isolation_width / 2) AS mz_hi, CAST(1 + sum(brk) AS INT) AS n_unions FROM b GROUP BY window_group", "dia_info windows")
R.add("i156_frame_spacing", lambda v: B.upper_median(v.frame_info.withColumn("d", F.abs(F.col("time") - F.lag("time").over(Window.partitionBy("ms_type").orderBy("time")))), "d", "ms_type").select("ms_type", F.greatest("d", F.lit(1e-3)).alias("d")), "SELECT ms_type, greatest(list_sort(list(d))[count(*) // 2 + 1], 1e-3) AS d FROM (SELECT ms_type, abs(time - lag(time) OVER (PARTITION BY ms_type ORDER BY time)) AS d FROM v_frame_info) x WHERE d IS NOT NULL GROUP BY ms_type", "frame_info")
R.add("i161_cluster_statistics", lambda v: v.ms1.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rt_hi") - F.col("rt_lo") > 3, 1).otherwise(0)).cast("long").alias("n_long"), F.countDistinct("window_group").alias("groups")), "SELECT count(*) AS n, CAST(sum(CASE WHEN rt_hi - rt_lo > 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_long, count(DISTINCT window_group) AS groups FROM v_ms1", "ms1")
R.add("i177_length_bins", lambda v: v.table("parse_diann_report").where("sequence is not null").select(F.when(F.length("sequence") <= 10, "7-10").when(F.length("sequence") <= 15, "11-15").when(F.length("sequence") <= 20, "16-20").when(F.length("sequence") <= 25, "21-25").otherwise("26-30").alias("bin"), (F.col("q_value") <= 0.01).cast("int").alias("ok")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").cast("long").alias("identified")), "SELECT CASE WHEN length(sequence) <= 10 THEN '7-10' WHEN length(sequence) <= 15 THEN '11-15' WHEN length(sequence) <= 20 THEN '16-20' WHEN length(sequence) <= 25 THEN '21-25' ELSE '26-30' END AS bin, count(*) AS n, CAST(sum(CAST(q_value <= 0.01 AS INT)) AS BIGINT) AS identified FROM parse_diann_report WHERE sequence IS NOT NULL GROUP BY bin")
R.add("i179_recall_quartiles", lambda v: E.rank_bucket(v.truth, "intensity", 4, ["seq_id"]).join(v.report.select("seq_id", "charge").distinct().withColumn("f", F.lit(1)), ["seq_id", "charge"], "left").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("found")), "WITH b AS (SELECT seq_id, charge, CAST(greatest(1, ceil(4 * (r - 1) / greatest(n - 1, 1))) AS INT) AS bucket FROM (SELECT *, row_number() OVER (ORDER BY intensity, seq_id) AS r, count(*) OVER () AS n FROM v_truth) x) SELECT bucket, count(*) AS n, count(r.seq_id) AS found FROM b LEFT JOIN (SELECT DISTINCT seq_id, charge FROM v_report) r USING (seq_id, charge) GROUP BY bucket", "truth report")
R.add("i211_evaluate_clusters", lambda v: M.evaluate_clusters(v.peaks, v.ms1.select("cluster_id", (F.col("rt_lo") % 90).alias("frame_lo"), (F.col("rt_lo") % 90 + 8).alias("frame_hi"), F.col("im_lo").alias("scan_lo"), F.col("im_hi").alias("scan_hi"), F.lit(0).alias("tof_lo"), F.lit(20000).alias("tof_hi"))).select("cluster_id", "raw_sum", "n", r6("im_mu").alias("im_mu"), "apex_frame"), f"WITH c AS (SELECT cluster_id, rt_lo % 90 AS f0, rt_lo % 90 + 8 AS f1, im_lo, im_hi FROM v_ms1), h AS (SELECT cluster_id, frame_id, scan, intensity, sum(intensity) OVER (PARTITION BY cluster_id, frame_id) AS fs FROM c JOIN v_peaks p ON p.frame_id BETWEEN f0 AND f1 AND p.scan BETWEEN im_lo AND im_hi AND tof <= 20000) SELECT cluster_id, sum(intensity) AS raw_sum, count(*) AS n, {_R6('sum(intensity * scan) / sum(intensity)')} AS im_mu, arg_max(frame_id, {{'a': fs, 'b': -frame_id}}) AS apex_frame FROM h GROUP BY cluster_id", "peaks ms1")

def _boxes(v):
    """MS1 clusters as boxes over all frames and the whole tof axis of the data."""
    frames, tof = v.frame_info.agg(F.count(F.lit(1))).scalar(), v.peaks.agg(F.struct(F.min("tof").alias("lo"), F.max("tof").alias("hi"))).scalar()
    first = v.peaks.agg(F.min("frame_id")).scalar()
    return v.ms1.withColumn("frame_lo", (F.col("cluster_id") % frames + first).cast("int")).select("cluster_id", "frame_lo", (F.col("frame_lo") + 8).alias("frame_hi"), F.col("im_lo").alias("scan_lo"), F.col("im_hi").alias("scan_hi"), tof["lo"].alias("tof_lo"), tof["hi"].alias("tof_hi"))


R.add("i211_evaluate_clusters_whole", lambda v: M.evaluate_clusters(v.peaks, _boxes(v)).select("cluster_id", "raw_sum", "n", r6("im_mu").alias("im_mu"), "apex_frame"), f"WITH c AS (SELECT cluster_id, cluster_id % n + f AS f0, cluster_id % n + f + 8 AS f1, im_lo, im_hi FROM v_ms1, (SELECT count(*) AS n FROM v_frame_info), (SELECT min(frame_id) AS f FROM v_peaks)), h AS (SELECT cluster_id, frame_id, scan, intensity, sum(intensity) OVER (PARTITION BY cluster_id, frame_id) AS fs FROM c JOIN v_peaks p ON p.frame_id BETWEEN f0 AND f1 AND p.scan BETWEEN im_lo AND im_hi) SELECT cluster_id, sum(intensity) AS raw_sum, count(*) AS n, {_R6('sum(intensity * scan) / sum(intensity)')} AS im_mu, arg_max(frame_id, {{'a': fs, 'b': -frame_id}}) AS apex_frame FROM h GROUP BY cluster_id", "peaks ms1 frame_info")
R.add("i218_stable_ids", lambda v: v.ms1.select("cluster_id", F.xxhash64("window_group", "rt_lo", "rt_hi", "im_lo", "im_hi", "mz").alias("stable_id")))
R.add("i228_sorted_hits", lambda v: pairs(v).groupBy("ms1_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("o"), "ms2_id"))).alias("h")).select("ms1_id", F.size("h").alias("n"), (-F.get("h", F.lit(0))["o"]).alias("best")))
R.add("i239_union", lambda v: v.table("peptides").select("sequence", "protein").unionByName(v.table("findings").select("sequence", "protein")).groupBy("protein").agg(F.count(F.lit(1)).alias("n")), "SELECT protein, count(*) AS n FROM (SELECT protein FROM peptides UNION ALL SELECT protein FROM findings) x GROUP BY protein")
R.add("i242_transmission_sets", lambda v: v.table("embeddings").select("vec_id", F.size(A.transmitted_set(F.col("embedding"), 0.1)).alias("n"), A.any_transmitted(F.col("embedding"), 0.3).alias("some"), A.all_transmitted(F.col("embedding"), -0.4).alias("every")), "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1)) AS INT) AS n, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.3)) > 0 AS some, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > -0.4)) = len(embedding) AS every FROM embeddings")
R.add("i257_bounds", lambda v: v.frame_info.select("frame_id", "time", A.emg_bounds_udf()(F.col("time"), F.lit(2.0), F.lit(0.5)).alias("b")).select("frame_id", (F.col("b.lo") < F.col("time")).alias("below"), (F.col("b.hi") > F.col("time")).alias("above")), "SELECT frame_id, true AS below, true AS above FROM v_frame_info", "frame_info")
R.add("i262_projectors", lambda v: W.neighbours(v.frame_info.where("ms_type = 0"), "time", F.floor(F.col("time") / 64)).where("before is not null and after is not null").select("frame_id", r6(Y.normal_mass((F.col("time") + F.col("before")) / 2, (F.col("time") + F.col("after")) / 2, 40.0, 6.0)).alias("mass")))
R.add("i272_averagine_cosine", lambda v: v.table("peptides").where("monoisotopic_mass is not null").select("row_id", r6(H.cosine(Y.averagine_weights(F.col("monoisotopic_mass"), 6), Y.averagine_weights(F.col("monoisotopic_mass") + 200, 6))).alias("cosine")).where("cosine > 0.9").select("row_id"), "SELECT row_id FROM peptides WHERE monoisotopic_mass IS NOT NULL")
R.add("i273_partial_isotopes", lambda v: v.table("peptides").where("monoisotopic_mass is not null").select("row_id", A.transmitted_isotopes(Y.averagine_weights(F.col("monoisotopic_mass") / 2, 4), Y.averagine_weights(F.col("monoisotopic_mass") / 2, 4), F.array(F.lit(0))).alias("w")).select("row_id", F.size(F.filter("w", lambda x: x > 0)).alias("n")), "SELECT row_id, CAST(1 AS INT) AS n FROM peptides WHERE monoisotopic_mass IS NOT NULL")
R.add("i281_linear_map", lambda v: v.peaks.join(v.peaks.groupBy("frame_id").agg(F.min("mz").alias("lo"), F.max("mz").alias("hi")), "frame_id").select("frame_id", "tof", "scan", r6(Y.linear_map(F.col("mz"), F.col("lo"), F.col("hi"), 0.0, 10.0)).alias("x")), f"SELECT frame_id, tof, scan, {_R6('(mz - min(mz) OVER w) / nullif(max(mz) OVER w - min(mz) OVER w, 0) * 10')} AS x FROM v_peaks WINDOW w AS (PARTITION BY frame_id)", "peaks")
R.add("i299_attach_intensities", lambda v: v.table("embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0)))).alias("i", "x")).where("x > 0").withColumn("s", F.sum("x").over(Window.partitionBy("vec_id"))).groupBy("vec_id").agg(F.round(F.sum(F.col("x") / F.col("s")) * 1e6).cast("long").alias("total")), "SELECT vec_id, CAST(1000000 AS BIGINT) AS total FROM embeddings")
R.add("i322_dropout", lambda v: v.table("embeddings").select("vec_id", A.drop_smallest(F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.001), 0.25, F.col("vec_id")).alias("e")).select("vec_id", F.size(F.filter("e", lambda x: x == 0)).alias("n")), "SELECT vec_id, CAST(16 AS INT) AS n FROM embeddings")
R.add("i323_tensor_index", lambda v: v.peaks.select("frame_id", "scan", F.dense_rank().over(Window.partitionBy("frame_id").orderBy("scan")).alias("scan_index")).distinct(), "SELECT DISTINCT frame_id, scan, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY scan) AS INT) AS scan_index FROM v_peaks", "peaks")
R.add("i341_energy_sweep", lambda v: M.calibrate(v.table("pasefframemsmsinfo").where("collisionenergy is not null").withColumn("z", F.col("scannumbegin") % 3), [20.0, 30.0, 40.0, 50.0], lambda g: -F.abs(F.col("collisionenergy") - g), "z").select("z", "best"), "WITH g AS (SELECT scannumbegin % 3 AS z, e, avg(-abs(collisionenergy - e)) AS m FROM pasefframemsmsinfo, (SELECT unnest([20.0, 30.0, 40.0, 50.0]::DOUBLE[]) AS e) t WHERE collisionenergy IS NOT NULL GROUP BY ALL) SELECT z, arg_max(e, {'a': m, 'b': -e}) AS best FROM g GROUP BY z")
R.add("i342_collate", lambda v: v.table("embeddings").select("vec_id", F.size(A.pad(F.transform("embedding", lambda x: x.cast("double")), 80)).alias("n"), F.size(F.filter(A.mask_by_length(F.transform("embedding", lambda x: x.cast("double")), F.lit(5), F.lit(2)), lambda x: x == -1)).alias("masked")), "SELECT vec_id, CAST(80 AS INT) AS n, CAST(44 AS INT) AS masked FROM embeddings")
R.add("i363_frame_assembly", lambda v: M.render(v.table("peptides").where("monoisotopic_mass is not null").select(F.col("row_id").alias("peptide_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("frame_id")).withColumn("abundance", F.lit(2.0)), v.table("peptides").where("monoisotopic_mass is not null").select(F.col("row_id").alias("peptide_id"), F.col("row_id").alias("ion_id"), F.lit(1.0).alias("share")), v.table("peptides").select(F.col("row_id").alias("ion_id"), F.explode(F.array(F.lit(7), F.lit(8))).alias("scan"), F.lit(0.5).alias("abundance")), v.table("peptides").where("monoisotopic_mass is not null").select(F.col("row_id").alias("ion_id"), F.col("monoisotopic_mass").alias("mz"), F.lit(4.0).alias("abundance")), decimals=0), "SELECT CAST(f AS INT) AS frame_id, CAST(s AS INT) AS scan, CAST(round(monoisotopic_mass) AS BIGINT) AS k, count(*) * 4.0::DOUBLE AS intensity FROM peptides, range(1, 4) a(f), range(7, 9) b(s) WHERE monoisotopic_mass IS NOT NULL GROUP BY f, s, CAST(round(monoisotopic_mass) AS BIGINT)")
R.add("i405_scan_slices", lambda v: M.scan_slices(v.peaks), "SELECT frame_id, scan, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM (SELECT frame_id, scan, n, sum(n) OVER (PARTITION BY frame_id ORDER BY scan) AS e FROM (SELECT frame_id, scan, count(*) AS n FROM v_peaks GROUP BY ALL) x) y", "peaks")
R.add("i404_precursor_frames", lambda v: v.frame_info.join(v.dia_info, "frame_id", "left_anti").select("frame_id"), "SELECT frame_id FROM v_frame_info ANTI JOIN v_dia_info USING (frame_id)", "frame_info dia_info")
R.add("i433_transmission_counts", lambda v: transmitted(v).where("p > 0.5 and window_group is not null").groupBy("tof").agg(F.countDistinct("frame_id").alias("frames"), F.countDistinct("scan").alias("scans")))
R.add("i441_merged_fragments", lambda v: M.merge_fragments(v.ms2.select("window_group", "mz", F.col("raw_sum").alias("intensity")), 50.0, "window_group").select("window_group", r6("mz").alias("mz"), "intensity"), f"SELECT window_group, {_R6('sum(mz * i) / sum(i)')} AS mz, sum(i) AS intensity FROM (SELECT *, sum(brk) OVER (PARTITION BY window_group ORDER BY mz, i) AS s FROM (SELECT window_group, mz, raw_sum AS i, CASE WHEN mz - lag(mz) OVER (PARTITION BY window_group ORDER BY mz, raw_sum) > mz * 50.0 * 1e-6 THEN 1 ELSE 0 END AS brk FROM v_ms2) x) y GROUP BY window_group, s", "ms2")
R.add("i445_balanced_set", lambda v: v.report.where("q <= 0.01").groupBy("seq_id", "charge").agg(F.max("intensity").alias("intensity")), "SELECT seq_id, charge, max(intensity) AS intensity FROM v_report WHERE q <= 0.01 GROUP BY ALL", "report")
R.add("i446_fragment_maps", lambda v: C.product_ions(v.table("parse_diann_report").where("sequence is not null").select("row_id", "sequence"), "row_id").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.col("ordinal").cast("string")).alias("k"), "mz"))).alias("m")).select("row_id", F.size("m").alias("n")), "SELECT row_id, CAST(2 * (length(sequence) - 1) AS INT) AS n FROM parse_diann_report WHERE length(sequence) > 1")
R.add("i447_truth_quantities", lambda v: v.table("peptides").where("not decoy and events is not null").groupBy("sequence").agg(F.round(F.sum(F.col("events") * 10)).cast("long").alias("quantity"), F.countDistinct("peptide_id").alias("n")), "SELECT sequence, CAST(round(sum(events * 10)) AS BIGINT) AS quantity, count(DISTINCT peptide_id) AS n FROM peptides WHERE NOT decoy AND events IS NOT NULL GROUP BY sequence")

QUERIES, ORACLES = R.queries, R.oracles
