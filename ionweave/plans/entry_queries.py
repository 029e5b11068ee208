"""Entries of operators that other queries use under another name, or that no query reached. Names begin with the inventory number."""

from __future__ import annotations



from pyspark.sql import Window
from pyspark.sql import functions as F

from ionweave.functions import arrays as A
from ionweave.functions import chemistry as C
from ionweave.functions import physics as Y
from ionweave.operators import assembly as M
from ionweave.operators import binning as B
from ionweave.operators import clusters as U
from ionweave.operators import evaluation as E
from ionweave.operators import filters as I
from ionweave.operators import generators as N
from ionweave.operators import joins as J
from ionweave.operators import ranking as K
from ionweave.operators import windows as W
from ionweave.plans.match_queries import _PASEF, _WIN, pasef_extract, settings, transmitted
from ionweave.plans.more_queries import _path
from ionweave.plans.peak_queries import _R6, r6
from ionweave.plans.registry import Registry
from ionweave.sources import codec
from ionweave.sources import dataset as D
from ionweave.sources import formats as T

R = Registry()
_PEAK = ("frame_id", "scan", "tof", "mz", "intensity")
_COLS = ", ".join(_PEAK)


def _run(v):
    return D.Dataset(v.peaks, v.frame_info)


# scans and metadata
R.add("i002_cached_frame", lambda v: _run(v).frame(12).select(*_PEAK), f"SELECT {_COLS} FROM v_peaks WHERE frame_id = 12", "peaks")
R.add("i003_raw_frame", lambda v: _run(v).slice([3, 8, 21]).select("frame_id", "scan", "tof", "intensity"), "SELECT frame_id, scan, tof, intensity FROM v_peaks WHERE frame_id IN (3, 8, 21)", "peaks")
R.add("i006_tic_facade", lambda v: _run(v).tic(8).select("frame_id", r6("minutes").alias("minutes"), "tic"), f"SELECT f.frame_id, {_R6('time / 60')} AS minutes, coalesce(sum(intensity), 0) AS tic FROM v_frame_info f LEFT JOIN v_peaks p USING (frame_id) WHERE f.ms_type = 8 GROUP BY f.frame_id, time", "frame_info peaks")
R.add("i009_frame_metadata", lambda v: v.table("frames").where("deleted_at is null").select("id", "time_s", "polarity", "scanmode", "msmstype", "numscans", "numpeaks"), "SELECT id, time_s, polarity, scanmode, msmstype, numscans, numpeaks FROM frames WHERE deleted_at IS NULL")
R.add("i010_dia_info", lambda v: v.dia_info.join(v.frame_info, "frame_id").select("frame_id", "window_group", "time"), "SELECT frame_id, window_group, time FROM v_dia_info JOIN v_frame_info USING (frame_id)", "dia_info frame_info")
R.add("i011_dia_windows", lambda v: v.windows.select("window_group", "scan_begin", "scan_end", (F.col("isolation_mz") - F.col("isolation_width") / 2).alias("mz_lo"), (F.col("isolation_mz") + F.col("isolation_width") / 2).alias("mz_hi"), "collision_energy"), "SELECT window_group, scan_begin, scan_end, isolation_mz - isolation_width / 2 AS mz_lo, isolation_mz + isolation_width / 2 AS mz_hi, collision_energy FROM v_windows", "windows")
R.add("i012_pasef_info", lambda v: v.table("pasefframemsmsinfo").where("precursor is not null and frame is not null").select("row_id", "frame", "scannumbegin", "scannumend", "isolationmz", "isolationwidth", "collisionenergy", "precursor"), "SELECT row_id, frame, scannumbegin, scannumend, isolationmz, isolationwidth, collisionenergy, precursor FROM pasefframemsmsinfo WHERE precursor IS NOT NULL AND frame IS NOT NULL")
R.add("i013_precursors", lambda v: v.table("precursors").select("row_id", "id", F.coalesce("monoisotopicmz", "averagemz", "largestpeakmz").alias("mz"), "charge", "parent"), "SELECT row_id, id, coalesce(monoisotopicmz, averagemz, largestpeakmz) AS mz, charge, parent FROM precursors")
R.add("i014_calibrations", lambda v: D.key_values(v.table("nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("k"), "n_regionkey"), "k", "n_regionkey", ["C0", "C1", "C2"]), "SELECT max(n_regionkey) FILTER (WHERE n_nationkey = 0) AS \"C0\", max(n_regionkey) FILTER (WHERE n_nationkey = 1) AS \"C1\", max(n_regionkey) FILTER (WHERE n_nationkey = 2) AS \"C2\" FROM nation")
R.add("i016_simulation_tables", lambda v: v.table("peptides").where("not decoy").select(F.col("peptide_id"), "sequence", "monoisotopic_mass", "events"), "SELECT peptide_id, sequence, monoisotopic_mass, events FROM peptides WHERE NOT decoy")
R.add("i017_window_tables", lambda v: v.pasef.join(v.windows.select("window_group", "isolation_mz", "scan_begin").withColumnRenamed("scan_begin", "w_begin"), F.col("frame_id") % 5 == F.col("window_group")).select("precursor_id", "window_group", "isolation_mz"), "SELECT precursor_id, window_group, isolation_mz FROM v_pasef JOIN v_windows w ON frame_id % 5 = w.window_group", "pasef windows")
R.add("i019_in_list", lambda v: v.table("peptides").join(v.table("findings").where("charge = '2'").select("protein").distinct(), "protein", "left_semi").select("row_id", "protein"), "SELECT row_id, protein FROM peptides WHERE protein IN (SELECT protein FROM findings WHERE charge = '2' AND protein IS NOT NULL)")
R.add("i020_scalar_readers", lambda v: v.table("frames").agg(F.max("numscans").alias("max_scans"), F.sum("numpeaks").alias("n_peaks"), F.countDistinct("acq_id").alias("runs")), "SELECT max(numscans) AS max_scans, CAST(sum(numpeaks) AS BIGINT) AS n_peaks, count(DISTINCT acq_id) AS runs FROM frames")
R.add("i021_by_source", lambda v: v.table("parse_diann_report").join(v.table("sources").where("trust >= 4").select("source_id", "source_name"), "source_id").select("row_id", "source_name"), "SELECT row_id, source_name FROM parse_diann_report JOIN sources USING (source_id) WHERE trust >= 4")
R.add("i022_has_column", lambda v: v.table("region").select("r_regionkey", F.lit(D.has_column(v.peaks, "mobility")).alias("has"), F.lit(D.has_column(v.peaks, "charge")).alias("lacks")), "SELECT r_regionkey, true AS has, false AS lacks FROM region")

# sinks and sources
_PARTS = ("cluster_id", "window_group", "mz", "raw_sum")


def _again(v, df, name):
    path = _path(v, name)
    df.write.parquet(path)
    return v.spark.read.schema(df.schema).parquet(path)


R.add("i033_cluster_parquet", lambda v: _again(v, v.ms1, "clusters").where("window_group = 3").select(*_PARTS), "SELECT cluster_id, window_group, mz, raw_sum FROM v_ms1 WHERE window_group = 3", "ms1")
R.add("i035_strip_heavy", lambda v: v.table("embeddings").drop("embedding"), "SELECT * EXCLUDE (embedding) FROM embeddings")
R.add("i036_pseudo_spectra_store", lambda v: _again(v, v.ms2.groupBy("window_group", (F.col("cluster_id") % 50).alias("spectrum")).agg(F.array_sort(F.collect_list(F.struct("mz", "raw_sum", "cluster_id"))).alias("peaks")), "spectra").select("window_group", "spectrum", F.size("peaks").alias("n"), F.get("peaks", F.lit(0))["mz"].alias("first")), "SELECT window_group, cluster_id % 50 AS spectrum, CAST(count(*) AS INT) AS n, min(mz) AS first FROM v_ms2 GROUP BY window_group, cluster_id % 50", "ms2")
R.add("i037_parquet_folder", lambda v: v.spark.read.parquet(f"{v.sf_dir}/order[s].parquet").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo")), "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders")
R.add("i043_fasta_split", lambda v: v.table("peptides").where("protein is not null").groupBy(F.pmod(F.crc32(F.col("protein")), F.lit(4)).alias("part")).agg(F.countDistinct("protein").alias("proteins")).agg(F.sum("proteins").alias("proteins")), "SELECT CAST(count(DISTINCT protein) AS BIGINT) AS proteins FROM peptides")
R.add("i048_stage_tables", lambda v: _append(v), "SELECT window_group, count(*) AS n FROM v_windows GROUP BY window_group UNION ALL SELECT window_group + 10, count(*) FROM v_windows GROUP BY window_group + 10", "windows")


def _append(v):
    path = _path(v, "table")
    v.windows.write.parquet(path)
    v.windows.withColumn("window_group", F.col("window_group") + 10).write.mode("append").parquet(path)
    return v.spark.read.schema(v.windows.schema).parquet(path).groupBy("window_group").agg(F.count(F.lit(1)).alias("n"))


R.add("i023_older_codec", lambda v: codec.decode_older(codec.encode_older(v.peaks.withColumn("tof", F.col("tof") + 1))), "SELECT frame_id, scan, tof + 1 AS tof, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id, scan, tof", "peaks")
R.add("i027_batch_encode", lambda v: codec.encode(v.peaks, 512).select("frame_id", "num_peaks"), "SELECT frame_id, count(*) AS num_peaks FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i422_byte_planes", lambda v: codec.decode(codec.encode(v.peaks.where("frame_id <= 20"), 512)).select("frame_id", "scan", "tof", "intensity"), "SELECT frame_id, scan, tof, sum(intensity) AS intensity FROM v_peaks WHERE frame_id <= 20 GROUP BY frame_id, scan, tof", "peaks")
R.add("i039_mzml_documents", lambda v: _mzml(v), "SELECT frame_id AS id, CAST(CASE WHEN ms_type = 0 THEN 1 ELSE 2 END AS INT) AS ms_level, rt, mz, intensity FROM v_peaks", "peaks")
R.add("i122_localisation", lambda v: E.localisation(_forms(v).where("row_id % 2 = 0"), _forms(v).where("row_id % 2 = 1"), "source_id", C.strip_tags).select("source_id", "truth", "identified", "localised", r6("accuracy").alias("accuracy")), f"""WITH r AS (SELECT row_id, source_id, charge, regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g') AS f FROM parse_diann_report WHERE sequence_modified IS NOT NULL AND charge IS NOT NULL AND source_id IS NOT NULL),
s AS (SELECT *, regexp_replace(f, '\\[UNIMOD:[0-9]+\\]', '', 'g') AS b FROM r), t AS (SELECT DISTINCT f, b, charge FROM s WHERE row_id % 2 = 0), g AS (SELECT DISTINCT source_id, f, b, charge FROM s WHERE row_id % 2 = 1),
i AS (SELECT source_id, count(*) AS n FROM t JOIN (SELECT DISTINCT source_id, b, charge FROM g) h USING (b, charge) GROUP BY source_id), e AS (SELECT source_id, count(*) AS n FROM t JOIN g USING (f, charge) GROUP BY source_id)
SELECT source_id, (SELECT count(*) FROM t) AS truth, coalesce(i.n, 0) AS identified, coalesce(e.n, 0) AS localised, {_R6('coalesce(coalesce(e.n, 0) / i.n, 0)')} AS accuracy FROM (SELECT DISTINCT source_id FROM g) d LEFT JOIN i USING (source_id) LEFT JOIN e USING (source_id)""")


def _forms(v):
    return v.table("parse_diann_report").where("sequence_modified is not null and charge is not null and source_id is not null").select("row_id", "source_id", "charge", F.regexp_replace("sequence_modified", r"\(UniMod:([0-9]+)\)", "[UNIMOD:$1]").alias("sequence"))


def _mzml(v):
    path = _path(v, "mzml")
    T.write_mzml(v.peaks.withColumn("ms_level", F.when(F.col("ms_type") == 0, 1).otherwise(2)), path, per_file=64)
    return T.read_mzml(v.spark, path)


# filters
_BOX = dict(mz=(200.0, 600.0), intensity=(5.0, 40.0))
_BOX_SQL = "mz BETWEEN 200 AND 600 AND intensity BETWEEN 5 AND 40"
R.add("i050_viewer_points", lambda v: K.top_n(I.range_filter(v.peaks, **_BOX), 50, ["frame_id"], F.desc("intensity"), F.asc("tof"), F.asc("scan"), F.asc("mz")).select(*_PEAK), f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, tof, scan, mz) AS r FROM v_peaks WHERE {_BOX_SQL}) x WHERE r <= 50", "peaks")
R.add("i054_indexed_range", lambda v: I.range_filter(v.peaks, tof=(1000, 9000), **_BOX).select(*_PEAK), f"SELECT {_COLS} FROM v_peaks WHERE tof BETWEEN 1000 AND 9000 AND {_BOX_SQL}", "peaks")
R.add("i055_scan_spectrum_range", lambda v: I.range_filter(v.peaks, scan=(64, 128), mobility=(0.15, 0.2), **_BOX).select(*_PEAK), f"SELECT {_COLS} FROM v_peaks WHERE scan BETWEEN 64 AND 128 AND mobility BETWEEN 0.15 AND 0.2 AND {_BOX_SQL}", "peaks")
R.add("i058_slice_filter", lambda v: I.range_filter(_run(v).in_time(5.0, 40.0), rt=(10.0, None), **_BOX).select(*_PEAK), f"SELECT {_COLS} FROM v_peaks WHERE frame_id IN (SELECT frame_id FROM v_frame_info WHERE time BETWEEN 5 AND 40) AND rt >= 10 AND {_BOX_SQL}", "peaks frame_info")
R.add("i061_annotated_filter", lambda v: M.annotate(v.peaks.withColumn("k", B.mz_key(0)), ["frame_id", "k"], F.col("tof")).where("intensity >= 60").select("frame_id", "k", "intensity", F.size("contributions").alias("n")), "SELECT frame_id, CAST(round(mz) AS BIGINT) AS k, sum(intensity) AS intensity, CAST(count(*) AS INT) AS n FROM v_peaks GROUP BY frame_id, CAST(round(mz) AS BIGINT) HAVING sum(intensity) >= 60", "peaks")
R.add("i070_step_slices", lambda v: I.type_filter(v.peaks, dict(scan=(0, 99)), dict(scan=(300, 511), mz=(100.0, 900.0))).select(*_PEAK), f"SELECT {_COLS} FROM v_peaks WHERE CASE WHEN ms_type = 0 THEN scan BETWEEN 0 AND 99 ELSE scan BETWEEN 300 AND 511 AND mz BETWEEN 100 AND 900 END", "peaks")
R.add("i074_dispatch", lambda v: I.restrict(v.table("parse_diann_report").where("sequence is not null").select("row_id", "sequence", "charge"), {"min_length": 9, "max_length": 20, "charges": [2, 3], "residues": "ACDEFGHIKLMNPQRSTVWY"}), "SELECT row_id, sequence, charge FROM parse_diann_report WHERE length(sequence) BETWEEN 9 AND 20 AND charge IN (2, 3) AND regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]*')")
R.add("i075_random_split", lambda v: I.folds(v.table("part").select("p_partkey"), 4, "p_partkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "SELECT fold, (SELECT count(*) FROM part) // 4 + CASE WHEN fold <= (SELECT count(*) FROM part) % 4 THEN 1 ELSE 0 END AS n FROM (SELECT CAST(unnest(range(1, 5)) AS INT) AS fold) x")
R.add("i120_membership", lambda v: v.table("findings").join(v.table("parse_diann_report").select("sequence").distinct(), "sequence", "left_anti").select("finding_id"), "SELECT finding_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM parse_diann_report r WHERE r.sequence = f.sequence)")

# joins
R.add("i083_dda_peptides_ions", lambda v: v.table("peptides").where("not decoy and monoisotopic_mass is not null").select("row_id", "events", F.explode(F.array(F.lit(2), F.lit(3))).alias("charge"), "monoisotopic_mass").select("row_id", "charge", r6(Y.mz_of_mass(F.col("monoisotopic_mass"), F.col("charge"))).alias("mz"), "events"), f"SELECT row_id, CAST(z AS INT) AS charge, {_R6(f'(monoisotopic_mass + z * {Y.MASS_PROTON!r}) / z')} AS mz, events FROM peptides, (VALUES (2), (3)) c(z) WHERE NOT decoy AND monoisotopic_mass IS NOT NULL")
R.add("i088_rescore_join", lambda v: v.report.select("seq_id", "charge", "q").join(v.truth.select("seq_id", "charge", F.lit(1).alias("known")), ["seq_id", "charge"], "left").groupBy("charge").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"), F.min("q").alias("q")), "SELECT charge, count(*) AS n, count(t.seq_id) AS known, min(q) AS q FROM v_report r LEFT JOIN v_truth t USING (seq_id, charge) GROUP BY charge", "report truth")
_DDA = lambda v: J.point_in_interval(v.peaks, v.pasef.select("precursor_id", "frame_id", "scan_begin", "scan_end", (F.col("precursor_id") % 900 + 100.0).alias("iso")), "scan", ("scan_begin", "scan_end"), 32.0, ["frame_id"]).withColumn("p", J.logistic_window(F.col("mz"), F.col("iso"), F.lit(200.0)))
_DDA_SQL = "(SELECT k.*, precursor_id, 1 / (1 + exp(-15 * (mz - (precursor_id % 900 + 100.0 - 100 - 0.25)))) - 1 / (1 + exp(-15 * (mz - (precursor_id % 900 + 100.0 + 100 + 0.25)))) AS p FROM v_pasef s JOIN v_peaks k ON k.frame_id = s.frame_id AND k.scan BETWEEN scan_begin AND scan_end)"
R.add("i094_dda_transmission", lambda v: _DDA(v).where("p > 1e-6").select("precursor_id", "frame_id", "scan", "tof", r6("p").alias("p")), f"SELECT precursor_id, frame_id, scan, tof, {_R6('p')} AS p FROM {_DDA_SQL} x WHERE p > 1e-6", "pasef peaks")
R.add("i096_dda_transmitted", lambda v: _DDA(v).where("p > 0.5").groupBy("precursor_id").agg(F.countDistinct("tof").alias("ions"), F.sum("intensity").alias("intensity")), f"SELECT precursor_id, count(DISTINCT tof) AS ions, sum(intensity) AS intensity FROM {_DDA_SQL} x WHERE p > 0.5 GROUP BY precursor_id", "pasef peaks")
R.add("i097_transmitted_in_range", lambda v: transmitted(v).where("p > 0.5 and window_group is not null and frame_id between 20 and 60").groupBy("frame_id").agg(F.countDistinct("tof").alias("ions")), "SELECT p.frame_id, count(DISTINCT tof) AS ions FROM v_peaks p JOIN " + _WIN + " y USING (frame_id, scan) WHERE frame_id BETWEEN 20 AND 60 AND 1 / (1 + exp(-15 * (mz - (isolation_mz - isolation_width / 2 - 0.25)))) - 1 / (1 + exp(-15 * (mz - (isolation_mz + isolation_width / 2 + 0.25)))) > 0.5 GROUP BY p.frame_id", "peaks dia_info windows")
R.add("i102_simple_pairs", lambda v: J.bucketed_interval_join(v.ms1.select("cluster_id", "window_group", F.col("rt_lo").alias("a"), F.col("rt_hi").alias("b")), v.windows.select("row_order", "window_group", (F.col("scan_begin") * 4).alias("c"), (F.col("scan_end") * 4).alias("d")), ("a", "b"), ("c", "d"), 64.0, ["window_group"]).select("cluster_id", "row_order"), "SELECT cluster_id, row_order FROM v_ms1 m JOIN v_windows w ON m.window_group = w.window_group AND rt_lo <= scan_end * 4 AND scan_begin * 4 <= rt_hi", "ms1 windows")
_QUERY = lambda v: v.ms1.where("cluster_id % 20 = 0").select(F.col("cluster_id").alias("query_id"), "window_group", (F.col("mz") * (1 - 2e-4)).alias("q_lo"), (F.col("mz") * (1 + 2e-4)).alias("q_hi"), F.col("mz").alias("q_mz"))
_HITS = "(SELECT a.cluster_id AS query_id, b.cluster_id, a.mz AS q_mz, b.mz, b.raw_sum FROM v_ms1 a JOIN v_ms2 b ON a.window_group = b.window_group AND b.mz BETWEEN a.mz * (1 - 2e-4) AND a.mz * (1 + 2e-4) WHERE a.cluster_id % 20 = 0)"
_hits = lambda v: J.point_in_interval(v.ms2.select("cluster_id", "window_group", "mz", "raw_sum"), _QUERY(v), "mz", ("q_lo", "q_hi"), 1.0, ["window_group"])
R.add("i104_fragment_index", lambda v: _hits(v).select("query_id", "cluster_id"), f"SELECT query_id, cluster_id FROM {_HITS} h", "ms1 ms2")
R.add("i105_thin_candidates", lambda v: _hits(v).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT query_id, count(*) AS n FROM {_HITS} h GROUP BY query_id", "ms1 ms2")
R.add("i108_assignment_modes", lambda v: J.best_match(_hits(v).withColumn("d", F.abs(F.col("mz") - F.col("q_mz"))), ["query_id"], F.asc("d"), F.desc("raw_sum"), F.asc("cluster_id")).select("query_id", "mz"), f"SELECT query_id, mz FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(mz - q_mz), raw_sum DESC, cluster_id) AS r FROM {_HITS} h) x WHERE r = 1", "ms1 ms2")
R.add("i413_index_build", lambda v: v.ms2.groupBy("window_group", F.floor("mz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("mz").alias("lo"), F.max("mz").alias("hi")), "SELECT window_group, CAST(floor(mz) AS BIGINT) AS bucket, count(*) AS n, min(mz) AS lo, max(mz) AS hi FROM v_ms2 GROUP BY window_group, floor(mz)", "ms2")
R.add("i412_index_lookup", lambda v: _hits(v).groupBy("query_id").agg(F.min("mz").alias("lo"), F.max("mz").alias("hi")), f"SELECT query_id, min(mz) AS lo, max(mz) AS hi FROM {_HITS} h GROUP BY query_id", "ms1 ms2")
R.add("i414_scored_lookup", lambda v: K.top_n(_hits(v).withColumn("score", r6(F.exp(-F.abs(F.col("mz") - F.col("q_mz")) * 10))), 3, ["query_id"], F.desc("score"), F.asc("mz"), F.asc("cluster_id")).select("query_id", "mz", "score"), f"SELECT query_id, mz, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mz, cluster_id) AS r FROM (SELECT *, {_R6('exp(-abs(mz - q_mz) * 10)')} AS score FROM {_HITS} h) y) x WHERE r <= 3", "ms1 ms2")
_FRAGMENTS = "SELECT p.frame_id, p.scan, CAST(round(p.mz * 10) AS BIGINT) AS k, sum(p.intensity) AS intensity FROM v_peaks p JOIN {sel} GROUP BY p.frame_id, p.scan, CAST(round(p.mz * 10) AS BIGINT)"
R.add("i113_render_dia", lambda v: v.peaks.join(v.dia_info, "frame_id").join(settings(v).select("window_group", "scan"), ["window_group", "scan"]).groupBy("frame_id", "scan", B.mz_key(1).alias("k")).agg(F.sum("intensity").alias("intensity")), _FRAGMENTS.format(sel=_WIN + " y USING (frame_id, scan)"), "peaks dia_info windows")
R.add("i114_render_dda", lambda v: pasef_extract(v).groupBy("frame_id", "scan", "tof").agg(F.sum("intensity").alias("intensity")), f"SELECT frame_id, scan, tof, sum(intensity) AS intensity FROM ({_PASEF}) x GROUP BY frame_id, scan, tof", "pasef peaks")
R.add("i115_collapsed_scan", lambda v: v.peaks.where("ms_type = 8").groupBy("frame_id", B.mz_key(1).alias("k")).agg(F.sum("intensity").alias("intensity")), "SELECT frame_id, CAST(round(mz * 10) AS BIGINT) AS k, sum(intensity) AS intensity FROM v_peaks WHERE ms_type = 8 GROUP BY frame_id, CAST(round(mz * 10) AS BIGINT)", "peaks")
R.add("i116_peptides_in_frames", lambda v: J.bucketed_interval_join(v.ms1.select("cluster_id", (F.col("rt_lo") % 90).alias("a"), (F.col("rt_lo") % 90 + 8).alias("b")), v.dia_info.select("frame_id", "window_group", F.col("frame_id").alias("f1")), ("a", "b"), ("frame_id", "f1"), 16.0).groupBy("window_group").agg(F.countDistinct("cluster_id").alias("n")), "SELECT d.window_group, count(DISTINCT cluster_id) AS n FROM v_ms1 m JOIN v_dia_info d ON d.frame_id BETWEEN rt_lo % 90 AND rt_lo % 90 + 8 GROUP BY d.window_group", "ms1 dia_info")
R.add("i369_batched_extraction", lambda v: M.extract(v.peaks, v.ms1.where("cluster_id % 10 = 0").select(F.col("cluster_id").alias("target_id"), F.col("mz").alias("target_mz")), 50.0).groupBy("target_id", F.floor(F.col("rt") / 10).alias("batch")).agg(F.count(F.lit(1)).alias("n")), "SELECT cluster_id AS target_id, CAST(floor(rt / 10) AS BIGINT) AS batch, count(*) AS n FROM v_peaks p JOIN v_ms1 t ON p.mz BETWEEN t.mz * (1 - 50.0 * 1e-6) AND t.mz * (1 + 50.0 * 1e-6) WHERE cluster_id % 10 = 0 GROUP BY cluster_id, floor(rt / 10)", "peaks ms1")

# binning and sums
R.add("i128_scan_resolution", lambda v: B.to_resolution(v.peaks, 1, "frame_id", "scan"), "SELECT frame_id, scan, CAST(round(mz * 10.0) AS BIGINT) / 10.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id, scan, CAST(round(mz * 10.0) AS BIGINT)", "peaks")
R.add("i131_merge_spectra", lambda v: B.to_resolution(v.peaks.where("frame_id <= 50").unionByName(v.peaks.where("frame_id > 50")), 0), "SELECT CAST(round(mz) AS BIGINT) / 1.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY CAST(round(mz) AS BIGINT)", "peaks")
R.add("i134_annotated_rebuild", lambda v: M.annotate(v.peaks, ["frame_id", "scan"], F.col("tof")).select("frame_id", "scan", "intensity", F.size("contributions").alias("n"), M.first_source("contributions").alias("first")), "SELECT frame_id, scan, sum(intensity) AS intensity, CAST(count(*) AS INT) AS n, arg_min(tof, {'a': -intensity, 'b': tof}) AS first FROM v_peaks GROUP BY frame_id, scan", "peaks")
R.add("i149_rt_trace", lambda v: I.range_filter(v.peaks, scan=(100, 140)).groupBy("frame_id").agg(F.sum("intensity").alias("intensity")), "SELECT frame_id, sum(intensity) AS intensity FROM v_peaks WHERE scan BETWEEN 100 AND 140 GROUP BY frame_id", "peaks")
R.add("i159_integral_or_sum", lambda v: v.ms1.join(v.peaks.groupBy(F.col("tof").cast("long").alias("cluster_id")).agg(F.sum("intensity").alias("i")), "cluster_id", "left").select("cluster_id", F.coalesce("i", "raw_sum").alias("value")), "SELECT cluster_id, coalesce(i, raw_sum) AS value FROM v_ms1 LEFT JOIN (SELECT tof AS cluster_id, sum(intensity) AS i FROM v_peaks GROUP BY tof) p USING (cluster_id)", "ms1 peaks")
R.add("i162_fragments_per_precursor", lambda v: pasef_extract(v).groupBy("precursor_id").agg(F.countDistinct("tof").alias("fragments")), f"SELECT precursor_id, count(DISTINCT tof) AS fragments FROM ({_PASEF}) x GROUP BY precursor_id", "pasef peaks")
R.add("i164_scan_spectrum_add", lambda v: v.peaks.where("ms_type in (0, 9)").groupBy("scan", B.mz_key(1).alias("k")).agg(F.sum("intensity").alias("intensity")), "SELECT scan, CAST(round(mz * 10) AS BIGINT) AS k, sum(intensity) AS intensity FROM v_peaks WHERE ms_type IN (0, 9) GROUP BY scan, CAST(round(mz * 10) AS BIGINT)", "peaks")
R.add("i165_annotated_add", lambda v: M.annotate(v.peaks.where("ms_type = 0").unionByName(v.peaks.where("ms_type = 8")).withColumn("k", B.mz_key(0)), ["scan", "k"], F.col("ms_type")).select("scan", "k", "intensity", F.size("contributions").alias("n")), "SELECT scan, CAST(round(mz) AS BIGINT) AS k, sum(intensity) AS intensity, CAST(count(*) AS INT) AS n FROM v_peaks WHERE ms_type IN (0, 8) GROUP BY scan, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i166_merge_noise", lambda v: M.superpose(v.peaks.where("ms_type = 9"), v.peaks.where("ms_type = 9 and intensity < 5")), "SELECT frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT) AS k, sum(intensity) AS intensity FROM (SELECT * FROM v_peaks WHERE ms_type = 9 UNION ALL SELECT * FROM v_peaks WHERE ms_type = 9 AND intensity < 5) x GROUP BY frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT)", "peaks")
R.add("i167_frame_abundances", lambda v: v.peaks.groupBy("frame_id").agg(F.countDistinct("tof").alias("ions"), F.sum("intensity").alias("abundance")), "SELECT frame_id, count(DISTINCT tof) AS ions, sum(intensity) AS abundance FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i168_lookup_maps", lambda v: v.table("peptides").where("sequence is not null").groupBy("protein_id").agg(F.countDistinct("peptide_id").alias("peptides"), F.min("sequence").alias("first")), "SELECT protein_id, count(DISTINCT peptide_id) AS peptides, min(sequence) AS first FROM peptides WHERE sequence IS NOT NULL GROUP BY protein_id")
R.add("i170_deduplicate_peptides", lambda v: E.deduplicate(v.report.withColumn("rt", F.col("q") * 100), ["seq_id"], ["rt"]).select("seq_id", r6("intensity").alias("intensity"), r6("rt").alias("rt"), "n_rows"), f"SELECT seq_id, {_R6('sum(intensity)')} AS intensity, {_R6('sum(q * 100 * intensity) / sum(intensity)')} AS rt, count(*) AS n_rows FROM v_report GROUP BY seq_id", "report")

# windows, ranking, sets
R.add("i192_windows_to_frame", lambda v: W.value_windows(v.peaks, 25.0, 1, 0.0, "frame_id").groupBy("frame_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows"), F.sum("intensity").alias("intensity")), "SELECT frame_id, count(*) AS n, count(DISTINCT floor(mz / 25)) AS windows, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i225_cap_top", lambda v: K.top_n(v.peaks.select(*_PEAK), 100, ["frame_id"], F.desc("intensity"), F.asc("mz"), F.asc("tof"), F.asc("scan")), f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, mz, tof, scan) AS r FROM v_peaks) x WHERE r <= 100", "peaks")
R.add("i226_dda_top", lambda v: I.survey_top(v.peaks, 10.0, 15).select("frame_id", "tof", "scan", "mz", "intensity", "rank"), "SELECT frame_id, tof, scan, mz, intensity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, tof, scan, mz) AS r FROM v_peaks WHERE ms_type = 0 AND intensity >= 10) x WHERE r <= 15", "peaks")
R.add("i230_stride", lambda v: W.stride_thin(v.peaks.select(*_PEAK), 64, ["mz", "tof", "scan", "intensity"], "frame_id"), f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY mz, tof, scan, intensity) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM v_peaks) x WHERE i % CAST(ceil(n / 64) AS BIGINT) = 0", "peaks")
R.add("i238_truth_overlap", lambda v: v.report.select("seq_id", "charge").distinct().join(v.truth.select("seq_id", "charge", F.lit(1).alias("t")), ["seq_id", "charge"], "full").agg(F.count(F.lit(1)).alias("either"), F.count("t").alias("truth")), "SELECT count(*) AS either, count(t) AS truth FROM (SELECT DISTINCT seq_id, charge, 1 AS f FROM v_report) r FULL JOIN (SELECT seq_id, charge, 1 AS t FROM v_truth) s USING (seq_id, charge)", "report truth")

# physics and chemistry
R.add("i248_environment_ccs", lambda v: v.table("parse_diann_report").where("inverse_mobility > 0 and mz > 0 and charge is not null").select("row_id", r6(Y.ccs_in(F.col("inverse_mobility"), F.col("mz"), F.col("charge"), 4.0026, 25.0)).alias("ccs")), f"SELECT row_id, {_R6(f'{Y.CCS_CONSTANT!r} * greatest(charge, 1) / sqrt(mz * greatest(charge, 1) * 4.0026 / (mz * greatest(charge, 1) + 4.0026) * (25.0 + {Y.KELVIN!r})) * inverse_mobility')} AS ccs FROM parse_diann_report WHERE inverse_mobility > 0 AND mz > 0 AND charge IS NOT NULL")
R.add("i399_array_ccs", lambda v: v.table("parse_diann_report").where("inverse_mobility > 0 and mz > 0 and charge is not null").groupBy("charge").agg((F.round(F.avg(Y.ccs(F.col("inverse_mobility"), F.col("mz"), F.col("charge"))) * 1e3) / 1e3).alias("ccs")), f"SELECT charge, round(avg({Y.CCS_CONSTANT!r} * charge / sqrt(mz * charge * {Y.MASS_N2!r} / (mz * charge + {Y.MASS_N2!r}) * ({Y.GAS_TEMPERATURE!r} + {Y.KELVIN!r})) * inverse_mobility) * 1e3) / 1e3 AS ccs FROM parse_diann_report WHERE inverse_mobility > 0 AND mz > 0 AND charge IS NOT NULL GROUP BY charge")
R.add("i264_window_object", lambda v: v.windows.select("row_order", *[r6(J.logistic_window(F.lit(m), F.col("isolation_mz"), F.col("isolation_width"))).alias(f"p{int(m)}") for m in (300.0, 500.0, 700.0)]), "SELECT row_order, " + ", ".join(f"{_R6(f'1 / (1 + exp(-15 * ({m} - (isolation_mz - isolation_width / 2 - 0.25)))) - 1 / (1 + exp(-15 * ({m} - (isolation_mz + isolation_width / 2 + 0.25))))')} AS p{m}" for m in (300, 500, 700)) + " FROM v_windows", "windows")
R.add("i266_ion_grid", lambda v: _DDA(v).groupBy("frame_id", F.floor(F.col("scan") / 8).alias("cell")).agg((F.round(F.sum(F.col("intensity") * F.col("p")) * 1e3) / 1e3).alias("signal")), f"SELECT frame_id, CAST(scan // 8 AS BIGINT) AS cell, round(sum(intensity * p) * 1e3) / 1e3 AS signal FROM {_DDA_SQL} x GROUP BY frame_id, scan // 8", "pasef peaks")
R.add("i271_averagine_spectra", lambda v: v.table("peptides").where("monoisotopic_mass is not null").select("row_id", F.posexplode(Y.averagine_weights(F.col("monoisotopic_mass"), 6)).alias("k", "w")).select("row_id", "k", r6("w").alias("w")), "WITH l AS (SELECT row_id, 0.000594 * monoisotopic_mass - 0.03091 AS l FROM peptides WHERE monoisotopic_mass IS NOT NULL), w AS (SELECT row_id, CAST(k AS INT) AS k, exp(-l) * l ** k / factorial(CAST(k AS INT)) AS w FROM l, range(6) r(k)) SELECT row_id, k, " + _R6("w / sum(w) OVER (PARTITION BY row_id)") + " AS w FROM w")
R.add("i417_lut", lambda v: v.spark.range(500, 5001, 50).select(F.col("id").alias("mass"), F.posexplode(Y.averagine_weights(F.col("id").cast("double"), 5)).alias("k", "w")).select("mass", "k", r6("w").alias("w")), "WITH w AS (SELECT m AS mass, CAST(k AS INT) AS k, exp(-(0.000594 * m - 0.03091)) * (0.000594 * m - 0.03091) ** k / factorial(CAST(k AS INT)) AS w FROM range(500, 5001, 50) a(m), range(5) r(k)) SELECT mass, k, " + _R6("w / sum(w) OVER (PARTITION BY mass)") + " AS w FROM w")
R.add("i453_isotope_kernels", lambda v: v.table("peptides").where("monoisotopic_mass is not null").select("row_id", r6(Y.lambda_of(F.col("monoisotopic_mass"))).alias("rate"), r6(F.get(Y.averagine_weights(F.col("monoisotopic_mass"), 4, normalise=False), F.lit(1))).alias("w1")), f"SELECT row_id, {_R6('0.000594 * monoisotopic_mass - 0.03091')} AS rate, {_R6('exp(-(0.000594 * monoisotopic_mass - 0.03091)) * (0.000594 * monoisotopic_mass - 0.03091)')} AS w1 FROM peptides WHERE monoisotopic_mass IS NOT NULL")
R.add("i392_sequence_accessors", lambda v: v.table("parse_diann_report").where("sequence is not null").select("row_id", F.length("sequence").alias("n"), C.protonizable(F.col("sequence")).alias("sites"), C.missed_cleavages(F.col("sequence")).alias("missed")), "SELECT row_id, CAST(length(sequence) AS INT) AS n, CAST(1 + length(regexp_replace(sequence, '[^HRK]', '', 'g')) AS INT) AS sites, CAST(len(regexp_extract_all(regexp_replace(sequence, '([KR])', '\\1\\1', 'g'), '[KR][KR]')) - len(regexp_extract_all(sequence, '[KR]P')) - CASE WHEN regexp_matches(sequence, '[KR]$') THEN 1 ELSE 0 END AS INT) AS missed FROM parse_diann_report WHERE sequence IS NOT NULL")
R.add("i398_residue_count", lambda v: v.table("parse_diann_report").where("sequence_modified is not null").select("row_id", C.residue_count(F.regexp_replace("sequence_modified", r"\(UniMod:([0-9]+)\)", "[UNIMOD:$1]")).alias("n")), "SELECT row_id, CAST(length(regexp_replace(regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g'), '\\[UNIMOD:[0-9]+\\]', '', 'g')) AS INT) AS n FROM parse_diann_report WHERE sequence_modified IS NOT NULL")
R.add("i304_dictionaries", lambda v: v.spark.createDataFrame(sorted(C.RESIDUE_MASS.items()), "residue string, mass double"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {m!r}::DOUBLE)" for k, m in C.RESIDUE_MASS.items()) + ") t(residue, mass)")
R.add("i325_export", lambda v: v.peaks.groupBy("frame_id").agg(F.size(F.collect_list("mz")).alias("n"), F.min("mz").alias("lo"), F.max("scan").alias("top_scan")), "SELECT frame_id, CAST(count(*) AS INT) AS n, min(mz) AS lo, max(scan) AS top_scan FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i328_first_only", lambda v: M.annotate(v.peaks.withColumn("k", B.mz_key(0)), ["frame_id", "k"], F.col("scan")).select("frame_id", "k", M.first_source("contributions").alias("scan")), "SELECT frame_id, CAST(round(mz) AS BIGINT) AS k, arg_min(scan, {'a': -intensity, 'b': scan}) AS scan FROM v_peaks GROUP BY frame_id, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i329_noise_annotation", lambda v: M.annotate(v.peaks.withColumn("k", B.mz_key(0)), ["frame_id", "k"], F.when(F.col("intensity") < 5, "noise").otherwise("signal")).select("frame_id", "k", F.exists("contributions", lambda c: c["source"] == "noise").alias("noisy")), "SELECT frame_id, CAST(round(mz) AS BIGINT) AS k, bool_or(intensity < 5) AS noisy FROM v_peaks GROUP BY frame_id, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i330_annotated_build", lambda v: v.peaks.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("mz", "tof", "scan", "intensity"))).alias("p")).select("frame_id", F.size("p").alias("n"), F.get("p", F.lit(0))["mz"].alias("first")), "SELECT frame_id, CAST(count(*) AS INT) AS n, min(mz) AS first FROM v_peaks GROUP BY frame_id", "peaks")

# generators
R.add("i354_vendor_windows", lambda v: N.sliding_windows(v.spark, 400.0, 1000.0, 25.0, 20.0).withColumn("group", F.col("position") % 4), "SELECT i AS position, 412.5 + i * 20.0 AS isolation_mz, 25.0::DOUBLE AS isolation_width, i % 4 AS \"group\" FROM range(30) r(i)")
R.add("i356_frame_types", lambda v: N.frame_table(v.spark, 400, 0.1, 9).groupBy("ms_type", "window_group").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN (i - 1) % 9 = 0 THEN 0 ELSE 9 END AS ms_type, CASE WHEN (i - 1) % 9 > 0 THEN (i - 1) % 9 END AS window_group, count(*) AS n FROM range(1, 401) r(i) GROUP BY ALL")
R.add("i357_template_frames", lambda v: v.table("frames").where("deleted_at is null").select("acq_id", "id", "numscans", F.row_number().over(Window.partitionBy("acq_id").orderBy("time_s", "id", "row_id")).alias("place")), "SELECT acq_id, id, numscans, CAST(row_number() OVER (PARTITION BY acq_id ORDER BY time_s NULLS FIRST, id, row_id) AS INT) AS place FROM frames WHERE deleted_at IS NULL")
R.add("i436_cycles", lambda v: v.frame_info.where("ms_type = 0").agg(F.count(F.lit(1)).alias("cycles"), F.min("time").alias("first"), F.max("time").alias("last")), "SELECT count(*) AS cycles, min(time) AS first, max(time) AS last FROM v_frame_info WHERE ms_type = 0", "frame_info")
R.add("i437_scheme_from_file", lambda v: N.check_scheme(v.windows.withColumn("scan_end", F.least("scan_end", F.lit(480)))), "WITH w AS (SELECT *, least(scan_end, 480) AS e, max(least(scan_end, 480)) OVER (PARTITION BY window_group ORDER BY scan_begin, row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v_windows) SELECT window_group, row_order, 'reversed' AS problem FROM w WHERE e < scan_begin UNION ALL SELECT window_group, row_order, 'width' FROM w WHERE isolation_width <= 0 UNION ALL SELECT window_group, row_order, 'overlap' FROM w WHERE p >= scan_begin", "windows")
R.add("i449_event_column", lambda v: E.events_from_totals(v.table("lineitem").select(F.col("l_partkey").alias("seq_id"), F.round("l_extendedprice").alias("intensity")), "seq_id", 100.0), "WITH t AS (SELECT l_partkey AS seq_id, sum(round(l_extendedprice)) AS total FROM lineitem GROUP BY ALL) SELECT seq_id, total, greatest(1, CAST(trunc(total / (SELECT quantile_cont(total, 0.5) FROM t) * 100) AS BIGINT)) AS events FROM t")
R.add("i364_annotated_assembly", lambda v: M.annotate(v.peaks.join(v.truth.select(F.col("seq_id").cast("int").alias("tof"), "charge"), "tof").withColumn("k", B.mz_key(0)), ["frame_id", "scan", "k"], F.col("charge")).select("frame_id", "scan", "k", "intensity", F.size("contributions").alias("n")), "SELECT frame_id, scan, CAST(round(mz) AS BIGINT) AS k, sum(p.intensity) AS intensity, CAST(count(*) AS INT) AS n FROM v_peaks p JOIN v_truth t ON p.tof = t.seq_id GROUP BY frame_id, scan, CAST(round(mz) AS BIGINT)", "peaks truth")
R.add("i367_frame_batches", lambda v: v.peaks.groupBy(F.floor((F.col("frame_id") - 1) / 16).alias("batch")).agg(F.countDistinct("frame_id").alias("frames"), F.count(F.lit(1)).alias("peaks")), "SELECT CAST(floor((frame_id - 1) / 16.0) AS BIGINT) AS batch, count(DISTINCT frame_id) AS frames, count(*) AS peaks FROM v_peaks GROUP BY floor((frame_id - 1) / 16.0)", "peaks")

# clusters and indexes of the second inventory
R.add("i402_annotated_noise", lambda v: M.annotate(v.peaks.select("frame_id", "scan", "intensity", F.lit("signal").alias("s")).unionByName(v.peaks.where("intensity < 3").select("frame_id", "scan", "intensity", F.lit("noise").alias("s"))), ["frame_id", "scan"], F.col("s")).select("frame_id", "scan", "intensity", F.size(F.filter("contributions", lambda c: c["source"] == "noise")).alias("noise")), "SELECT frame_id, scan, sum(intensity) AS intensity, CAST(sum(n) AS INT) AS noise FROM (SELECT frame_id, scan, intensity, 0 AS n FROM v_peaks UNION ALL SELECT frame_id, scan, intensity, 1 FROM v_peaks WHERE intensity < 3) x GROUP BY frame_id, scan", "peaks")
R.add("i403_annotated_scans", lambda v: M.annotate(v.peaks, ["frame_id", "scan"], F.col("tof")).select("frame_id", "scan", F.size("contributions").alias("n")), "SELECT frame_id, scan, CAST(count(*) AS INT) AS n FROM v_peaks GROUP BY frame_id, scan", "peaks")
R.add("i406_cluster_predicates", lambda v: v.ms1.select("cluster_id", (F.col("raw_sum") > 100000).alias("strong"), (F.col("im_hi") - F.col("im_lo") >= 12).alias("wide"), F.col("mz").between(100.0, 500.0).alias("inside")), "SELECT cluster_id, raw_sum > 100000 AS strong, im_hi - im_lo >= 12 AS wide, mz BETWEEN 100 AND 500 AS inside FROM v_ms1", "ms1")
R.add("i407_window_bins", lambda v: v.ms1.select("cluster_id", F.floor(F.col("mz") * (1 - 1e-5) * 10).alias("lo"), F.floor(F.col("mz") * (1 + 1e-5) * 10).alias("hi")), "SELECT cluster_id, CAST(floor(mz * (1 - 1e-5) * 10) AS BIGINT) AS lo, CAST(floor(mz * (1 + 1e-5) * 10) AS BIGINT) AS hi FROM v_ms1", "ms1")
_BOXES = "SELECT cluster_id, CAST(cluster_id % 90 + 1 AS INT) AS f0, CAST(cluster_id % 90 + 4 AS INT) AS f1, im_lo, im_hi FROM v_ms1"
_boxes = lambda v: v.ms1.select("cluster_id", (F.col("cluster_id") % 90 + 1).cast("int").alias("f0"), (F.col("cluster_id") % 90 + 4).cast("int").alias("f1"), F.col("im_lo").alias("s0"), F.col("im_hi").alias("s1"))
_points = lambda v: J.bucketed_box_join(v.peaks.select(*_PEAK, F.col("frame_id").alias("_f"), F.col("scan").alias("_s")), _boxes(v), [(("frame_id", "_f"), ("f0", "f1"), 8.0), (("scan", "_s"), ("s0", "s1"), 16.0)])
_POINTS = f"(SELECT cluster_id, p.* FROM ({_BOXES}) b JOIN v_peaks p ON p.frame_id BETWEEN f0 AND f1 AND p.scan BETWEEN im_lo AND im_hi)"
R.add("i408_raw_points", lambda v: W.stride_thin(_points(v).select("cluster_id", *_PEAK), 20, ["frame_id", "scan", "tof", "mz", "intensity"], "cluster_id").select("cluster_id", "frame_id", "scan", "tof"), f"SELECT cluster_id, frame_id, scan, tof FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frame_id, scan, tof, mz, intensity) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM {_POINTS} q) x WHERE i % CAST(ceil(n / 20) AS BIGINT) = 0", "ms1 peaks")
R.add("i409_representative_mz", lambda v: _points(v).groupBy("cluster_id").agg((F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") * 1e6 + 0.0371) / 1e6).alias("mz")), "SELECT cluster_id, round(sum(mz * intensity) / sum(intensity) * 1e6 + 0.0371) / 1e6 AS mz FROM " + _POINTS + " q GROUP BY cluster_id", "ms1 peaks")
R.add("i410_precursor_apex", lambda v: _points(v).groupBy("cluster_id", "frame_id").agg(F.sum("intensity").alias("i")).groupBy("cluster_id").agg(F.max_by("frame_id", F.struct("i", (-F.col("frame_id")).alias("f"))).alias("apex")), f"SELECT cluster_id, arg_max(frame_id, {{'a': i, 'b': -frame_id}}) AS apex FROM (SELECT cluster_id, frame_id, sum(intensity) AS i FROM {_POINTS} q GROUP BY cluster_id, frame_id) x GROUP BY cluster_id", "ms1 peaks")
R.add("i411_feature_map", lambda v: v.ms1.select((F.col("cluster_id") % 1000).alias("feature"), "cluster_id", "raw_sum").groupBy("feature").agg(F.count(F.lit(1)).alias("members"), F.max_by("cluster_id", F.struct("raw_sum", (-F.col("cluster_id")).alias("c"))).alias("top")), "SELECT cluster_id % 1000 AS feature, count(*) AS members, arg_max(cluster_id, {'a': raw_sum, 'b': -cluster_id}) AS top FROM v_ms1 GROUP BY cluster_id % 1000", "ms1")
R.add("i415_thin_projection", lambda v: v.ms2.select("cluster_id", "window_group", "mz", ((F.col("rt_lo") + F.col("rt_hi")) / 2).alias("rt"), ((F.col("im_lo") + F.col("im_hi")) / 2).alias("im")), "SELECT cluster_id, window_group, mz, (rt_lo + rt_hi) / 2 AS rt, (im_lo + im_hi) / 2 AS im FROM v_ms2", "ms2")
R.add("i416_single_score", lambda v: U.pair_features(v.ms1.select("cluster_id", F.col("raw_sum"), *[F.lit(x).alias(c) for c, x in dict(a_rt_mu=10.0, a_rt_sigma=1.0, a_im_mu=100.0, a_im_sigma=4.0, a_im_lo=90, a_im_hi=110).items()], (F.col("rt_lo") % 20).cast("double").alias("b_rt_mu"), F.lit(1.0).alias("b_rt_sigma"), ((F.col("im_lo") + F.col("im_hi")) / 2).alias("b_im_mu"), F.lit(4.0).alias("b_im_sigma"), F.col("im_lo").alias("b_im_lo"), F.col("im_hi").alias("b_im_hi"))).select("cluster_id", r6(U.geometric_score(F.col("raw_sum"))).alias("score")), "WITH p AS (SELECT cluster_id, raw_sum, abs(10.0 - rt_lo % 20) AS d, abs(100.0 - (im_lo + im_hi) / 2) AS e, greatest(least(im_hi, 110) - greatest(im_lo, 90) + 1, 0) AS o, greatest(im_hi, 110) - least(im_lo, 90) + 1 AS u, rt_lo % 20 AS m FROM v_ms1) SELECT cluster_id, " + _R6("greatest(least(13.0, m + 3.0) - greatest(7.0, m - 3.0), 0) / (greatest(13.0, m + 3.0) - least(7.0, m - 3.0)) + exp(-0.5 * (d * d + e * e / 16)) + 0.75 * exp(-d / 0.75) + 0.75 * exp(-e / 3.0) + 0.5 * o / u + 0.25 * ln(1 + raw_sum)") + " AS score FROM p", "ms1")
R.add("i419_rt_frame_sets", lambda v: v.dia_info.join(v.frame_info.where("time between 10 and 50"), "frame_id").groupBy("window_group").agg(F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi")), "SELECT window_group, count(*) AS n, min(frame_id) AS lo, max(frame_id) AS hi FROM v_dia_info JOIN v_frame_info USING (frame_id) WHERE time BETWEEN 10 AND 50 GROUP BY window_group", "dia_info frame_info")
R.add("i418_dia_accessors", lambda v: M.dia_index(v.dia_info, v.windows).select("window_group", F.posexplode("scan_unions").alias("k", "u")).select("window_group", "k", F.col("u.scan_begin").alias("lo"), F.col("u.scan_end").alias("hi")), "WITH b AS (SELECT *, CASE WHEN scan_begin > max(scan_end) OVER (PARTITION BY window_group ORDER BY scan_begin, scan_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS brk FROM v_windows), i AS (SELECT window_group, scan_begin, scan_end, sum(brk) OVER (PARTITION BY window_group ORDER BY scan_begin, scan_end) AS k FROM b) SELECT window_group, CAST(k AS INT) AS k, min(scan_begin) AS lo, max(scan_end) AS hi FROM i GROUP BY window_group, k", "dia_info windows")
R.add("i421_preprocessed_fragments", lambda v: K.top_n(pasef_extract(v).groupBy("precursor_id", "tof").agg(F.sum("intensity").alias("intensity")), 20, ["precursor_id"], F.desc("intensity"), F.asc("tof")), f"SELECT precursor_id, tof, intensity FROM (SELECT *, row_number() OVER (PARTITION BY precursor_id ORDER BY intensity DESC, tof) AS r FROM (SELECT precursor_id, tof, sum(intensity) AS intensity FROM ({_PASEF}) x GROUP BY precursor_id, tof) y) z WHERE r <= 20", "pasef peaks")
R.add("i428_fragment_tables", lambda v: C.product_ions(v.table("parse_diann_report").where("sequence is not null").select("row_id", "sequence"), "row_id").groupBy("row_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last")), "SELECT row_id, kind, length(sequence) - 1 AS n, CAST(length(sequence) - 1 AS INT) AS last FROM parse_diann_report, (VALUES ('b'), ('y')) k(kind) WHERE length(sequence) > 1")
R.add("i429_precursor_ids", lambda v: v.table("pasefframemsmsinfo").where("precursor is not null").select("precursor").distinct(), "SELECT DISTINCT precursor FROM pasefframemsmsinfo WHERE precursor IS NOT NULL")
R.add("i430_full_marginal", lambda v: B.to_resolution(v.peaks.where("ms_type = 0"), 1, "frame_id"), "SELECT frame_id, CAST(round(mz * 10.0) AS BIGINT) / 10.0 AS mz, sum(intensity) AS intensity FROM v_peaks WHERE ms_type = 0 GROUP BY frame_id, CAST(round(mz * 10.0) AS BIGINT)", "peaks")
R.add("i432_fragment_ion_ids", lambda v: pasef_extract(v).where("frame_id between 1 and 5").select("frame_id", "precursor_id").distinct(), f"SELECT DISTINCT frame_id, precursor_id FROM ({_PASEF}) x WHERE frame_id BETWEEN 1 AND 5", "pasef peaks")
R.add("i454_findings_without_charge", lambda v: v.table("findings").where("charge is null and sequence is not null").select("finding_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("charge")), "SELECT finding_id, CAST(z AS INT) AS charge FROM findings, (VALUES (2), (3)) c(z) WHERE charge IS NULL AND sequence IS NOT NULL")
R.add("i447_truth_by_protein", lambda v: v.table("peptides").where("not decoy and events is not null").groupBy("protein").agg(F.countDistinct("sequence").alias("n")), "SELECT protein, count(DISTINCT sequence) AS n FROM peptides WHERE NOT decoy AND events IS NOT NULL GROUP BY protein")
R.add("i440_cluster_report", lambda v: E.profile(v.ms2, ["mz"]).select("column", "q", r6("value").alias("value")).where("q in (0.0, 1.0)"), f"SELECT 'mz' AS \"column\", q, {_R6('CASE WHEN q = 0 THEN (SELECT min(mz) FROM v_ms2) ELSE (SELECT max(mz) FROM v_ms2) END')} AS value FROM (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS q) z", "ms2")
R.add("i385_merge_aggregate", lambda v: v.peaks.groupBy("ms_type", B.mz_key(0).alias("k")).agg(F.sum("intensity").alias("intensity"), F.count(F.lit(1)).alias("n")), "SELECT ms_type, CAST(round(mz) AS BIGINT) AS k, sum(intensity) AS intensity, count(*) AS n FROM v_peaks GROUP BY ms_type, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i443_masked_losses", lambda v: v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).select("vec_id", r6(F.aggregate(F.filter(A.mask_by_length(F.col("e"), F.lit(5), F.lit(2)), lambda x: x != -1), F.lit(0.0), lambda a, x: a + x * x)).alias("loss")), "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, " + _R6("list_sum(list_transform(list_filter(range(64), lambda i: NOT (i // 6 >= 5 OR i % 3 >= 2)), lambda i: e[i + 1] * e[i + 1]))") + " AS loss FROM e")

QUERIES, ORACLES = R.queries, R.oracles
