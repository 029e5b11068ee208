"""Queries over peaks: filters, binning, windows, ranking. Names begin with the operator's inventory number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ionweave.operators import binning as B
from ionweave.operators import filters as I
from ionweave.operators import ranking as K
from ionweave.operators import setops as S
from ionweave.operators import windows as W
from ionweave.plans.registry import Registry

R = Registry()
_R6 = lambda c: f"round(({c}) * 1e6) / 1e6"


def r6(c):
    """Rounded at six decimals by the portable form."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1e6) / 1e6


# sources and codecs in relational form
R.add("i001_frame_scan", lambda v: v.peaks.where("frame_id = 7").select("frame_id", "scan", "tof", "mz", "intensity"), "SELECT frame_id, scan, tof, mz, intensity FROM v_peaks WHERE frame_id = 7", "peaks")
R.add("i004_slice_scan", lambda v: v.peaks.join(v.frame_info.where("time between 2 and 6").select("frame_id"), "frame_id", "left_semi").select("frame_id", "scan", "tof", "mz", "intensity"), "SELECT frame_id, scan, tof, mz, intensity FROM v_peaks WHERE frame_id IN (SELECT frame_id FROM v_frame_info WHERE time BETWEEN 2 AND 6)", "peaks frame_info")
R.add("i007_layout", lambda v: v.frame_info.agg(F.count(F.lit(1)).alias("n_frames"), F.min("time").alias("first"), F.max("time").alias("last"), F.when(F.max((F.col("ms_type") == 9).cast("int")) == 1, "DIA").otherwise("DDA").alias("mode")), "SELECT count(*) AS n_frames, min(time) AS first, max(time) AS last, CASE WHEN max(CAST(ms_type = 9 AS INT)) = 1 THEN 'DIA' ELSE 'DDA' END AS mode FROM v_frame_info", "frame_info")
R.add("i008_global_metadata", lambda v: v.table("nation").agg(*[F.max(F.when(F.col("n_nationkey") == k, F.col("n_name"))).alias(f"value_{k}") for k in range(25)]), "SELECT " + ", ".join(f"max(CASE WHEN n_nationkey = {k} THEN n_name END) AS value_{k}" for k in range(25)) + " FROM nation")
R.add("i018_overlap_read", lambda v: v.ms1.where("rt_lo <= 120 and rt_hi >= 60"), "SELECT * FROM v_ms1 WHERE rt_lo <= 120 AND rt_hi >= 60", "ms1")
R.add("i028_peaks_per_scan", lambda v: v.spark.range(512).select(F.col("id").cast("int").alias("scan")).join(v.peaks.groupBy("scan").agg(F.count(F.lit(1)).alias("n")), "scan", "left").na.fill(0, ["n"]), "SELECT CAST(s.scan AS INT) AS scan, count(p.scan) AS n FROM range(512) s(scan) LEFT JOIN v_peaks p ON p.scan = s.scan GROUP BY s.scan", "peaks")
R.add("i026_encode_order", lambda v: v.peaks.groupBy("frame_id", "scan", "tof").agg(F.least(F.sum("intensity"), F.lit(4294967295.0)).alias("intensity")), "SELECT frame_id, scan, tof, least(sum(intensity), 4294967295.0) AS intensity FROM v_peaks GROUP BY ALL", "peaks")
_step = lambda: F.col("tof") - F.coalesce(F.lag("tof").over(Window.partitionBy("frame_id", "scan").orderBy("tof")), F.lit(-1))
R.add("i029_tof_delta", lambda v: v.peaks.select("frame_id", "scan", "tof").distinct().withColumn("step", _step()), "SELECT frame_id, scan, tof, tof - coalesce(lag(tof) OVER (PARTITION BY frame_id, scan ORDER BY tof), -1) AS step FROM (SELECT DISTINCT frame_id, scan, tof FROM v_peaks) x", "peaks")
R.add("i025_scan_expansion", lambda v: v.peaks.groupBy("frame_id", "scan").agg(F.count(F.lit(1)).cast("int").alias("n")).select("frame_id", "scan", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("place")), "SELECT frame_id, scan, CAST(row_number() OVER (PARTITION BY frame_id, scan) AS INT) AS place FROM v_peaks", "peaks")
R.add("i032_duplicate_frames", lambda v: v.table("frames").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT id, count(*) AS n FROM frames GROUP BY id HAVING count(*) > 1")
R.add("i051_metadata_index", lambda v: v.peaks.agg(F.min("mz").alias("mz_lo"), F.max("mz").alias("mz_hi"), F.min("scan").alias("scan_lo"), F.max("scan").alias("scan_hi"), F.count(F.lit(1)).alias("n_peaks"), F.sum("intensity").alias("total")), "SELECT min(mz) AS mz_lo, max(mz) AS mz_hi, min(scan) AS scan_lo, max(scan) AS scan_hi, count(*) AS n_peaks, sum(intensity) AS total FROM v_peaks", "peaks")

# filters
R.add("i053_spectrum_range", lambda v: I.range_filter(v.peaks, mz=(200.0, 400.0), intensity=(10.0, 40.0)).select("frame_id", "scan", "mz", "intensity"), "SELECT frame_id, scan, mz, intensity FROM v_peaks WHERE mz BETWEEN 200 AND 400 AND intensity BETWEEN 10 AND 40", "peaks")
R.add("i056_frame_range", lambda v: I.range_filter(v.peaks, mz=(100.0, 700.0), scan=(50, 400), mobility=(0.1, 0.8), intensity=(5.0, 40.0), tof=(100, 30000)).select("frame_id", "scan", "tof", "mz", "intensity"), "SELECT frame_id, scan, tof, mz, intensity FROM v_peaks WHERE mz BETWEEN 100 AND 700 AND scan BETWEEN 50 AND 400 AND mobility BETWEEN 0.1 AND 0.8 AND intensity BETWEEN 5 AND 40 AND tof BETWEEN 100 AND 30000", "peaks")
R.add("i057_index_filter", lambda v: I.index_filter(v.peaks, 1, 250.25, 300.75).select("frame_id", "scan", "index", "intensity"), "SELECT frame_id, scan, CAST(round(mz * 10) AS BIGINT) AS index, intensity FROM v_peaks WHERE CAST(round(mz * 10) AS BIGINT) BETWEEN 2502 AND 3008", "peaks")
R.add("i059_type_filter", lambda v: I.type_filter(v.peaks, {"mz": (300.0, 900.0), "intensity": (20.0, None)}, {"mz": (100.0, 500.0)}).select("frame_id", "scan", "ms_type", "mz", "intensity"), "SELECT frame_id, scan, ms_type, mz, intensity FROM v_peaks WHERE CASE WHEN ms_type = 0 THEN mz BETWEEN 300 AND 900 AND intensity >= 20 ELSE mz BETWEEN 100 AND 500 END", "peaks")
R.add("i060_by_type", lambda v: I.by_type(v.peaks, 9).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), "SELECT frame_id, count(*) AS n FROM v_peaks WHERE ms_type = 9 GROUP BY frame_id", "peaks")
R.add("i063_single_scan", lambda v: v.peaks.where("frame_id = 5 and scan = 77").select("scan", "tof", "mz", "intensity"), "SELECT scan, tof, mz, intensity FROM v_peaks WHERE frame_id = 5 AND scan = 77", "peaks")
R.add("i064_sample", lambda v: I.stride_sample(v.peaks, F.col("tof") * 31 + F.col("scan") * 17, 25, 100).select("frame_id", "scan", "tof", "intensity"), "SELECT frame_id, scan, tof, intensity FROM v_peaks WHERE (tof * 31 + scan * 17) % 100 < 25", "peaks")
R.add("i065_mask", lambda v: v.peaks.groupBy("frame_id", "scan").agg(F.array_sort(F.collect_list("intensity")).alias("x")).withColumn("m", F.transform("x", lambda y: y % 2 == 0)).select("frame_id", "scan", F.aggregate(I.mask_array("x", "m"), F.lit(0.0), lambda a, b: a + b).alias("kept")), "SELECT frame_id, scan, coalesce(sum(intensity) FILTER (WHERE intensity % 2 = 0), 0) AS kept FROM v_peaks GROUP BY ALL", "peaks")
R.add("i066_precursor_frames", lambda v: I.survey_top(v.peaks, 10.0, 20).select("frame_id", "scan", "tof", "mz", "intensity"), "SELECT frame_id, scan, tof, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, tof, scan, mz) AS r FROM v_peaks WHERE ms_type = 0 AND intensity >= 10) x WHERE r <= 20", "peaks")
R.add("i068_cluster_filter", lambda v: v.ms1.where("rt_lo >= 100 and rt_hi <= 400 and im_lo >= 50 and im_hi <= 300 and raw_sum >= 50000"), "SELECT * FROM v_ms1 WHERE rt_lo >= 100 AND rt_hi <= 400 AND im_lo >= 50 AND im_hi <= 300 AND raw_sum >= 50000", "ms1")
R.add("i071_frames_in_time", lambda v: v.frame_info.where("time between 10 and 20"), "SELECT * FROM v_frame_info WHERE time BETWEEN 10 AND 20", "frame_info")
R.add("i072_sequence_validity", lambda v: I.valid_sequences(v.table("findings"), "sequence", r"\A(?:[ACDEFGHIKLMNPQRSTVWY](?:\[UNIMOD:[0-9]+\])?){1,30}\z").select("finding_id", "sequence"), "SELECT finding_id, sequence FROM findings WHERE regexp_full_match(sequence, '(?:[ACDEFGHIKLMNPQRSTVWY](?:\\[UNIMOD:[0-9]+\\])?){1,30}')")
R.add("i073_model_filters", lambda v: I.restrict(v.table("parse_diann_report"), {"residues": "ACDEFGHIKLMNPQRSTVWY", "min_length": 8, "max_length": 25, "charges": [2, 3]}).select("row_id", "sequence", "charge"), "SELECT row_id, sequence, charge FROM parse_diann_report WHERE regexp_full_match(regexp_replace(sequence, '\\[[^\\]]*\\]', '', 'g'), '[ACDEFGHIKLMNPQRSTVWY]*') AND length(regexp_replace(sequence, '\\[[^\\]]*\\]', '', 'g')) BETWEEN 8 AND 25 AND charge IN (2, 3)")
R.add("i076_folds", lambda v: I.folds(v.frame_info, 5, "frame_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(f AS INT) AS fold, count(*) AS n FROM (SELECT floor((row_number() OVER () - 1) * 5 / count(*) OVER ()) + 1 AS f FROM v_frame_info) x GROUP BY f", "frame_info")
R.add("i077_reorder", lambda v: v.table("peptides").select("protein_id", "peptide_id", "sequence", "missed_cleavages", "decoy"), "SELECT protein_id, peptide_id, sequence, missed_cleavages, decoy FROM peptides")
R.add("i078_region", lambda v: I.in_box(v.peaks, "rt=0:20&mz=100:300&mobility=0.2:").select("frame_id", "scan", "tof", "mz"), "SELECT frame_id, scan, tof, mz FROM v_peaks WHERE rt BETWEEN 0 AND 20 AND mz BETWEEN 100 AND 300 AND mobility >= 0.2", "peaks")
R.add("i079_il_key", lambda v: v.table("parse_diann_report").select("row_id", I.il_key(F.col("sequence")).alias("seq_key")), "SELECT row_id, replace(sequence, 'I', 'L') AS seq_key FROM parse_diann_report")

# aggregations
R.add("i125_to_resolution", lambda v: B.to_resolution(v.peaks, 1, "frame_id"), "SELECT frame_id, CAST(round(mz * 10.0) AS BIGINT) / 10.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id, CAST(round(mz * 10.0) AS BIGINT)", "peaks")
R.add("i126_indexed_to_resolution", lambda v: B.indexed_to_resolution(v.peaks, 0, "frame_id").withColumn("tof", r6("tof")), f"SELECT frame_id, CAST(round(mz) AS BIGINT) / 1.0 AS mz, sum(intensity) AS intensity, {_R6('avg(tof)')} AS tof FROM v_peaks GROUP BY frame_id, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i127_frame_to_resolution", lambda v: B.frame_to_resolution(v.peaks, 0, "frame_id").withColumn("mobility", r6("mobility")), f"SELECT frame_id, scan, CAST(round(mz) AS BIGINT) / 1.0 AS mz, sum(intensity) AS intensity, CAST(floor(avg(tof)) AS INT) AS tof, {_R6('avg(mobility)')} AS mobility FROM v_peaks GROUP BY frame_id, scan, CAST(round(mz) AS BIGINT)", "peaks")
R.add("i130_union_sum", lambda v: B.union_sum([v.peaks.where("ms_type = 0"), v.peaks.where("ms_type = 8"), v.peaks.where("ms_type = 9")], decimals=2), "SELECT CAST(round(mz * 100.0) AS BIGINT) / 100.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY CAST(round(mz * 100.0) AS BIGINT)", "peaks")
R.add("i132_by_scan", lambda v: B.by_scan(v.peaks).select("frame_id", "scan", "mobility", F.size("peaks").alias("n")), "SELECT frame_id, scan, min(mobility) AS mobility, CAST(count(*) AS INT) AS n FROM v_peaks GROUP BY frame_id, scan", "peaks")
R.add("i133_rebuild_frame", lambda v: B.rebuild_frame(v.peaks), "SELECT frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT) AS mz_key, sum(intensity) AS intensity, arg_max(tof, {'a': mz, 'b': tof}) AS tof, arg_min(mobility, {'a': mz, 'b': tof}) AS mobility FROM v_peaks GROUP BY frame_id, scan, CAST(round(mz * 1000000.0) AS BIGINT)", "peaks")
R.add("i135_flatten", lambda v: B.flatten_by_tof(v.peaks, "frame_id").withColumn("mz", r6("mz")), f"SELECT frame_id, tof, {_R6('avg(mz)')} AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id, tof", "peaks")
R.add("i136_fold_scans", lambda v: B.fold_scans(v.peaks, 16, mean="true").withColumn("mobility", r6("mobility")), f"WITH s AS (SELECT frame_id, scan, min(mobility) AS m FROM v_peaks GROUP BY ALL), m AS (SELECT frame_id, scan // 16 AS fold, {_R6('avg(m)')} AS mobility FROM s GROUP BY ALL) SELECT p.frame_id, CAST(p.fold AS INT) AS fold, p.mz, p.intensity, m.mobility FROM (SELECT frame_id, scan // 16 AS fold, CAST(round(mz * 1000000.0) AS BIGINT) / 1000000.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL) p JOIN m USING (frame_id, fold)", "peaks")
R.add("i136_fold_scans_pairwise", lambda v: B.fold_scans(v.peaks, 16))
R.add("i137_scan_apex", lambda v: B.scan_apex(v.peaks, "frame_id"), "SELECT frame_id, arg_max(mobility, {'a': total, 'b': scan}) AS mobility, max(total) AS total FROM (SELECT frame_id, scan, sum(intensity) AS total, min(mobility) AS mobility FROM v_peaks GROUP BY ALL) s GROUP BY frame_id", "peaks")
R.add("i138_weighted_mobility", lambda v: B.weighted_moments(v.peaks, "scan", "intensity", "frame_id").select("frame_id", "total", r6("mean").alias("mean"), r6("variance").alias("variance")), f"SELECT frame_id, sum(intensity) AS total, {_R6('sum(intensity * scan) / sum(intensity)')} AS mean, {_R6('sum(intensity * scan * scan) / sum(intensity) - (sum(intensity * scan) / sum(intensity)) * (sum(intensity * scan) / sum(intensity))')} AS variance FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i139_signal_moments", lambda v: B.weighted_moments(v.peaks, "scan", "intensity", "frame_id"))
R.add("i141_plane", lambda v: B.plane(v.peaks, 2000, 8).select("band", "frame_id", "scan", "intensity", r6("mz_mean").alias("mz_mean"), r6("mz_std").alias("mz_std")), f"WITH b AS (SELECT *, CAST(tof // 2000 AS INT) AS band FROM v_peaks WHERE tof < 16000), s AS (SELECT band, {_R6('avg(mz)')} AS mz_mean, {_R6('stddev_pop(mz)')} AS mz_std FROM b GROUP BY band) SELECT c.*, mz_mean, mz_std FROM (SELECT band, frame_id, scan, sum(intensity) AS intensity FROM b GROUP BY ALL) c JOIN s USING (band)", "peaks")
R.add("i141_plane_whole", lambda v: B.plane(v.peaks, None, 8).select("band", "frame_id", "scan", "intensity", r6("mz_mean").alias("mz_mean"), r6("mz_std").alias("mz_std")), f"WITH b AS (SELECT *, CAST(tof // (SELECT CAST(ceil((max(tof) + 1) / 8) AS INT) FROM v_peaks) AS INT) AS band FROM v_peaks), s AS (SELECT band, {_R6('avg(mz)')} AS mz_mean, {_R6('stddev_pop(mz)')} AS mz_std FROM b GROUP BY band) SELECT c.*, mz_mean, mz_std FROM (SELECT band, frame_id, scan, sum(intensity) AS intensity FROM b GROUP BY ALL) c JOIN s USING (band)", "peaks")
R.add("i142_inverted_index", lambda v: B.inverted_index(v.peaks, 0).select("bin", F.size("postings").alias("n"), F.get("postings", F.lit(0))["frame_id"].alias("first_frame")), "SELECT CAST(round(mz) AS BIGINT) AS bin, CAST(count(*) AS INT) AS n, min(frame_id) AS first_frame FROM v_peaks GROUP BY CAST(round(mz) AS BIGINT)", "peaks")
R.add("i143_tof_axis", lambda v: B.tof_axis(v.peaks, 50), "SELECT CAST(min(tof) // 50 * 50 AS BIGINT) AS lo, CAST((max(tof) // 50 + 1) * 50 AS BIGINT) AS hi, CAST(max(tof) // 50 + 1 - min(tof) // 50 AS BIGINT) AS n_bins FROM v_peaks", "peaks")
R.add("i144_tof_bins", lambda v: B.tof_bins(v.peaks, 500, "frame_id"), "SELECT frame_id, bin, n, intensity, CAST(coalesce(sum(n) OVER (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", (bin + 0.5) * 500 AS center FROM (SELECT frame_id, CAST(tof // 500 AS BIGINT) AS bin, count(*) AS n, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL) x", "peaks")
R.add("i145_box_sum", lambda v: I.range_filter(v.peaks, tof=(1000, 5000), scan=(100, 200)).agg(F.sum("intensity").alias("total")), "SELECT sum(intensity) AS total FROM v_peaks WHERE tof BETWEEN 1000 AND 5000 AND scan BETWEEN 100 AND 200", "peaks")
R.add("i146_rt_marginal", lambda v: B.marginal(v.peaks.where("tof between 0 and 4000"), "frame_id", 0, 120), "SELECT CAST(f.frame_id AS INT) AS frame_id, coalesce(sum(p.intensity), 0) AS intensity FROM range(121) f(frame_id) LEFT JOIN v_peaks p ON p.frame_id = f.frame_id AND p.tof BETWEEN 0 AND 4000 GROUP BY f.frame_id", "peaks")
R.add("i147_im_marginal", lambda v: B.marginal(v.peaks, "scan", 0, 511), "SELECT CAST(f.scan AS INT) AS scan, coalesce(sum(p.intensity), 0) AS intensity FROM range(512) f(scan) LEFT JOIN v_peaks p ON p.scan = f.scan GROUP BY f.scan", "peaks")
R.add("i150_tof_rt_grid", lambda v: B.grid(v.peaks, 1000), "SELECT CAST(tof // 1000 AS BIGINT) AS bin, frame_id, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL", "peaks")
R.add("i151_range_union", lambda v: W.islands(v.windows, "scan_begin", "scan_end", "window_group"), "SELECT window_group, min(scan_begin) AS scan_begin, max(scan_end) AS scan_end FROM (SELECT *, sum(brk) OVER (PARTITION BY window_group ORDER BY scan_begin, scan_end) AS i FROM (SELECT *, CASE WHEN scan_begin > max(scan_end) OVER (PARTITION BY window_group ORDER BY scan_begin, scan_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS brk FROM v_windows) x) y GROUP BY window_group, i", "windows")
R.add("i153_nearest_rank", lambda v: B.nearest_rank_quantile(v.peaks, "mz", 0.9, "frame_id"), "SELECT frame_id, list_sort(list(mz))[CAST(floor((count(*) * 0.9 - 0.9) + 0.5) AS BIGINT) + 1] AS mz FROM v_peaks GROUP BY frame_id", "peaks")
R.add("i153_nearest_rank_all", lambda v: B.nearest_rank_quantile(v.peaks, "mz", 0.25), "SELECT list_sort(list(mz))[CAST(floor((count(*) * 0.25 - 0.25) + 0.5) AS BIGINT) + 1] AS mz FROM v_peaks", "peaks")
R.add("i154_mad", lambda v: B.mad_noise(v.peaks, "intensity", "frame_id").withColumn("noise", r6("noise")), f"WITH m AS (SELECT frame_id, list_sort(list(intensity))[count(*) // 2 + 1] AS m, count(*) AS n FROM v_peaks GROUP BY frame_id) SELECT frame_id, CASE WHEN any_value(n) < 3 THEN 0.0 ELSE {_R6('list_sort(list(abs(intensity - m)))[count(*) // 2 + 1] * 1.4826')} END AS noise FROM v_peaks JOIN m USING (frame_id) GROUP BY frame_id", "peaks")
R.add("i155_difference_noise", lambda v: B.difference_noise(B.to_resolution(v.peaks, 0, "frame_id"), "intensity", ["mz"], "frame_id").withColumn("noise", r6("noise")), f"WITH b AS (SELECT frame_id, round(mz) AS mz, sum(intensity) AS i FROM v_peaks GROUP BY frame_id, round(mz)), d AS (SELECT frame_id, abs(i - lag(i) OVER (PARTITION BY frame_id ORDER BY mz)) AS d FROM b) SELECT frame_id, {_R6('list_sort(list(d))[count(*) // 2 + 1] / 1.4826')} AS noise FROM d WHERE d IS NOT NULL GROUP BY frame_id", "peaks")
R.add("i157_threshold", lambda v: B.mad_noise(v.peaks, "intensity", "frame_id").select("frame_id", r6(B.threshold(F.col("noise"), fixed=20.0)).alias("fixed"), r6(B.threshold(F.col("noise"), factor=2.0)).alias("adaptive")))
R.add("i160_tic", lambda v: v.frame_info.where("ms_type = 0").join(v.peaks.groupBy("frame_id").agg(F.sum("intensity").alias("tic")), "frame_id", "left").select("frame_id", r6(F.col("time") / 60).alias("minutes"), F.coalesce("tic", F.lit(0.0)).alias("tic")), f"SELECT f.frame_id, {_R6('any_value(time) / 60')} AS minutes, coalesce(sum(intensity), 0) AS tic FROM v_frame_info f LEFT JOIN v_peaks p USING (frame_id) WHERE f.ms_type = 0 GROUP BY f.frame_id", "peaks frame_info")
R.add("i163_frame_add", lambda v: v.peaks.groupBy(F.floor(F.col("frame_id") / 2).alias("pair"), "scan", B.mz_key(6).alias("k")).agg(F.sum("intensity").alias("intensity"), F.avg("mobility").alias("mobility"), F.floor(F.avg("tof")).cast("int").alias("tof"), F.when(F.min("ms_type") == F.max("ms_type"), F.min("ms_type")).otherwise(-1).alias("ms_type")), "SELECT CAST(frame_id // 2 AS BIGINT) AS pair, scan, CAST(round(mz * 1000000.0) AS BIGINT) AS k, sum(intensity) AS intensity, avg(mobility) AS mobility, CAST(floor(avg(tof)) AS INT) AS tof, CASE WHEN min(ms_type) = max(ms_type) THEN min(ms_type) ELSE -1 END AS ms_type FROM v_peaks GROUP BY CAST(frame_id // 2 AS BIGINT), scan, CAST(round(mz * 1000000.0) AS BIGINT)", "peaks")
R.add("i185_cycle_length", lambda v: B.cycle_length(v.frame_info).select(r6("cycle").alias("cycle")), f"SELECT {_R6('avg(d)')} AS cycle FROM (SELECT time - lag(time) OVER (ORDER BY time) AS d FROM v_frame_info WHERE ms_type = 0) x", "frame_info")
R.add("i186_mode", lambda v: B.mode_of(v.table("frames"), "numscans"), "SELECT numscans FROM (SELECT numscans, count(*) AS n FROM frames WHERE numscans > 0 GROUP BY numscans ORDER BY n DESC, numscans LIMIT 1) x")
R.add("i187_cube", lambda v: v.report.cube("charge", "q").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")), "SELECT charge, q, count(*) AS n, CAST(grouping_id(charge, q) AS INT) AS level FROM v_report GROUP BY CUBE (charge, q)", "report")
R.add("i187_rollup", lambda v: v.windows.rollup("window_group", "row_order").agg(F.count(F.lit(1)).alias("n")), "SELECT window_group, row_order, count(*) AS n FROM v_windows GROUP BY ROLLUP (window_group, row_order)", "windows")
R.add("i188_sketch", lambda v: v.peaks.agg(F.approx_count_distinct("tof", 0.01).alias("approximate"), F.countDistinct("tof").alias("exact")).select((F.abs(F.col("approximate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close")), "SELECT true AS close")

# windows and series
R.add("i189_value_windows", lambda v: W.value_windows(v.peaks, 50.0, 5, 30.0, "frame_id"), "SELECT frame_id, CAST(floor(mz / 50) AS BIGINT) AS \"window\", count(*) AS n, sum(intensity) AS intensity, min(mz) AS lo, max(mz) AS hi FROM v_peaks GROUP BY ALL HAVING count(*) >= 5 AND max(intensity) >= 30".replace("GROUP BY ALL", "GROUP BY frame_id, CAST(floor(mz / 50) AS BIGINT)"), "peaks")
R.add("i190_overlapping_windows", lambda v: W.value_windows(v.peaks, 50.0, 5, 30.0, "frame_id", overlapping=True), "SELECT frame_id, \"window\", count(*) AS n, sum(intensity) AS intensity, min(mz) AS lo, max(mz) AS hi FROM (SELECT frame_id, mz, intensity, CAST(floor(mz / 50) AS BIGINT) AS \"window\" FROM v_peaks UNION ALL SELECT frame_id, mz, intensity, CAST(-floor((mz + 25) / 50) AS BIGINT) FROM v_peaks) x GROUP BY frame_id, \"window\" HAVING count(*) >= 5 AND max(intensity) >= 30", "peaks")
R.add("i191_scan_windows", lambda v: W.value_windows(v.peaks, 200.0, 1, 0.0, "frame_id", "scan"), "SELECT frame_id, scan, CAST(floor(mz / 200) AS BIGINT) AS \"window\", count(*) AS n, sum(intensity) AS intensity, min(mz) AS lo, max(mz) AS hi FROM v_peaks GROUP BY frame_id, scan, CAST(floor(mz / 200) AS BIGINT)", "peaks")
R.add("i193_dense_windows", lambda v: W.dense_windows(v.peaks, 100.0, 0, "frame_id").select("frame_id", "window", F.size("vector").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total")), "SELECT frame_id, \"window\", CAST(101 AS INT) AS n, sum(i) AS total FROM (SELECT frame_id, CAST(floor(mz / 100) AS BIGINT) AS \"window\", round(mz) - round(floor(mz / 100) * 100) AS c, arg_max(intensity, {'a': mz, 'b': tof}) AS i FROM v_peaks GROUP BY ALL) x GROUP BY frame_id, \"window\"", "peaks")
R.add("i194_sliding_plan", lambda v: W.sliding_plan(v.frame_info, 20, 10).groupBy("plan").agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), F.count(F.lit(1)).alias("n")), "WITH f AS (SELECT frame_id, row_number() OVER (ORDER BY time, frame_id) - 1 AS pos FROM v_frame_info), n AS (SELECT greatest(0, CAST(ceil((count(*) - 20) / 10.0) AS BIGINT)) AS last FROM f), p AS (SELECT unnest(range(last + 1)) AS plan FROM n) SELECT CAST(plan AS BIGINT) AS plan, min(frame_id) AS lo, max(frame_id) AS hi, count(*) AS n FROM p JOIN f ON pos >= plan * 10 AND pos < plan * 10 + 20 GROUP BY plan", "frame_info")
R.add("i195_centroid", lambda v: W.centroid(v.peaks, 0.1, ["tof", "scan", "intensity"], "frame_id").select("frame_id", r6("mz").alias("mz"), "intensity", "n"), f"SELECT frame_id, {_R6('sum(mz * intensity) / sum(intensity)')} AS mz, sum(intensity) AS intensity, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY frame_id ORDER BY mz, tof, scan, intensity) AS s FROM (SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY frame_id ORDER BY mz, tof, scan, intensity) > 0.1 THEN 1 ELSE 0 END AS brk FROM v_peaks) x) y GROUP BY frame_id, s", "peaks")
R.add("i197_smooth", lambda v: W.smooth(v.peaks, 20, "frame_id", "scan").select("frame_id", "scan", "tof", "smoothed"), "SELECT frame_id, scan, tof, sum(intensity) OVER (PARTITION BY frame_id, scan ORDER BY tof RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS smoothed FROM v_peaks", "peaks")
R.add("i198_local_maxima", lambda v: W.local_maxima(v.peaks, 200, "frame_id").select("frame_id", "scan", "tof", "intensity"), "SELECT frame_id, scan, tof, intensity FROM (SELECT *, max(intensity) OVER (PARTITION BY frame_id ORDER BY tof RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING) AS b, max(intensity) OVER (PARTITION BY frame_id ORDER BY tof RANGE BETWEEN 1 FOLLOWING AND 200 FOLLOWING) AS a FROM v_peaks) x WHERE intensity > coalesce(b, -1) AND intensity >= coalesce(a, -1)", "peaks")
R.add("i205_gaussian_smooth", lambda v: W.gaussian_smooth(B.marginal(v.peaks, "scan", 0, 511).withColumn("g", F.floor(F.col("scan") / 64)), "scan", 1.0, "g").select("scan", (F.round(F.col("smoothed") * 1e6) / 1e6).alias("smoothed")), None)
R.add("i206_sparse_blur", lambda v: W.sparse_blur(v.peaks.groupBy("frame_id", F.floor(F.col("tof") / 100).alias("bin")).agg(F.sum("intensity").alias("intensity")), "bin", 1.0, "frame_id"))
R.add("i207_moment_fit", lambda v: W.moment_fit(v.peaks.groupBy("frame_id", "scan").agg(F.sum("intensity").alias("intensity")), "scan", "frame_id"))
R.add("i208_trapezoid", lambda v: W.trapezoid(v.peaks.groupBy("frame_id", "scan").agg(F.sum("intensity").alias("intensity")), "scan", "intensity", 99.5, 300.25, "frame_id").select("frame_id", r6("area").alias("area")), f"WITH s AS (SELECT frame_id, scan AS x, sum(intensity) AS y FROM v_peaks GROUP BY ALL), g AS (SELECT *, lead(x) OVER (PARTITION BY frame_id ORDER BY x) AS x1, lead(y) OVER (PARTITION BY frame_id ORDER BY x) AS y1 FROM s), c AS (SELECT *, greatest(x, 99.5) AS a, least(x1, 300.25) AS b FROM g WHERE x1 IS NOT NULL) SELECT frame_id, {_R6('sum((y + (y1 - y) * (a - x) / (x1 - x) + y + (y1 - y) * (b - x) / (x1 - x)) / 2 * (b - a))')} AS area FROM c WHERE b > a GROUP BY frame_id", "peaks")
R.add("i209_apexes", lambda v: W.apexes(B.marginal(v.peaks, "scan", 0, 511).withColumn("g", F.floor(F.col("scan") / 512)), "scan", "g").select("scan", r6("apex").alias("apex")), f"WITH s AS (SELECT scan, sum(intensity) AS i FROM v_peaks GROUP BY scan), f AS (SELECT CAST(r.scan AS INT) AS scan, coalesce(i, 0) AS i FROM range(512) r(scan) LEFT JOIN s USING (scan)), n AS (SELECT *, lag(i) OVER (ORDER BY scan) AS l, lead(i) OVER (ORDER BY scan) AS r FROM f) SELECT scan, {_R6('scan + CASE WHEN abs(l - 2 * i + r) > 1e-12 THEN 0.5 * (l - r) / (l - 2 * i + r) ELSE 0 END')} AS apex FROM n WHERE i > l AND i >= r", "peaks")
R.add("i210_interpolate", lambda v: W.interpolate_at(v.frame_info, "time", 12.5, "ms_type", order=["time", "frame_id"]), "WITH r AS (SELECT ms_type, time, row_number() OVER (PARTITION BY ms_type ORDER BY time, frame_id) - 1 AS i, count(*) OVER (PARTITION BY ms_type) AS n FROM v_frame_info), w AS (SELECT ms_type, time, greatest(0, 1 - abs(i - least(12.5, n - 1))) AS w FROM r) SELECT ms_type, sum(time * w) / sum(w) AS time FROM w GROUP BY ms_type", "frame_info")
_near = lambda: (F.col("rt_lo") - F.lag("rt_lo").over(Window.partitionBy("window_group").orderBy("rt_lo", "cluster_id")) <= 1) & (F.abs(F.col("im_lo") - F.lag("im_lo").over(Window.partitionBy("window_group").orderBy("rt_lo", "cluster_id"))) <= 40)
R.add("i215_chain_merge", lambda v: W.chain_merge(v.ms1, ["rt_lo", "cluster_id"], _near(), "window_group").groupBy("window_group", "chain").agg(F.min("rt_lo").alias("rt_lo"), F.max("rt_hi").alias("rt_hi"), F.max("raw_sum").alias("top"), F.count(F.lit(1)).alias("n")).drop("chain"), "SELECT window_group, min(rt_lo) AS rt_lo, max(rt_hi) AS rt_hi, max(raw_sum) AS top, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY window_group ORDER BY rt_lo, cluster_id) AS chain FROM (SELECT *, CASE WHEN rt_lo - lag(rt_lo) OVER w <= 1 AND abs(im_lo - lag(im_lo) OVER w) <= 40 THEN 0 ELSE 1 END AS brk FROM v_ms1 WINDOW w AS (PARTITION BY window_group ORDER BY rt_lo, cluster_id)) x) y GROUP BY window_group, chain", "ms1")
R.add("i216_stride_thin", lambda v: W.stride_thin(v.peaks, 50, ["tof", "scan", "mz", "intensity"], "frame_id").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")), "SELECT frame_id, count(*) AS n, sum(intensity) AS intensity FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY tof, scan, mz, intensity) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS c FROM v_peaks) x WHERE i % CAST(ceil(c / 50.0) AS BIGINT) = 0 GROUP BY frame_id", "peaks")
R.add("i221_analytic", lambda v: v.truth.select("seq_id", F.rank().over(Window.partitionBy("charge").orderBy(F.desc("intensity"))).alias("rank"), F.ntile(4).over(Window.partitionBy("charge").orderBy("intensity", "seq_id")).alias("tile"), F.lead("seq_id").over(Window.partitionBy("charge").orderBy("seq_id")).alias("next_id")), "SELECT seq_id, CAST(rank() OVER (PARTITION BY charge ORDER BY intensity DESC) AS INT) AS rank, CAST(ntile(4) OVER (PARTITION BY charge ORDER BY intensity, seq_id) AS INT) AS tile, lead(seq_id) OVER (PARTITION BY charge ORDER BY seq_id) AS next_id FROM v_truth", "truth")

# ranking
R.add("i222_frame_top", lambda v: K.top_n(v.peaks, 10, ["frame_id"], F.desc("intensity"), F.asc("tof"), F.asc("scan"), F.asc("mz")).select("frame_id", "tof", "scan", "intensity"), "SELECT frame_id, tof, scan, intensity FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, tof, scan, mz) AS r FROM v_peaks) x WHERE r <= 10", "peaks")
R.add("i223_spectrum_top", lambda v: K.top_spectrum(v.peaks, 5, "frame_id").select("frame_id", "mz", "intensity", "place"), "SELECT frame_id, mz, intensity, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY mz, tof, intensity DESC) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY intensity DESC, mz, tof) AS r FROM v_peaks) x WHERE r <= 5", "peaks")
R.add("i227_most_intense", lambda v: K.most_intense(v.ms1, "raw_sum", "cluster_id", "window_group", "rt_lo").select("window_group", "rt_lo", "cluster_id", "raw_sum"), "SELECT window_group, rt_lo, cluster_id, raw_sum FROM (SELECT *, row_number() OVER (PARTITION BY window_group, rt_lo ORDER BY raw_sum DESC, cluster_id) AS r FROM v_ms1) x WHERE r = 1", "ms1")
R.add("i229_value_counts", lambda v: K.value_counts(v.peaks, "scan", 10), "SELECT scan, count(*) AS n FROM v_peaks GROUP BY scan ORDER BY n DESC, scan LIMIT 10", "peaks")
R.add("i231_budget_sample", lambda v: K.budget_sample(v.peaks.select("frame_id", "scan", "tof", "mz", "intensity"), 20, {"frame_id": (0.0, 100.0, 10), "mz": (0.0, 1100.0, 16)}, ["frame_id", "tof", "scan", "mz"]))
R.add("i232_histogram", lambda v: K.histogram(v.peaks, "mz", 0.0, 1200.0, 80), "SELECT CAST(c.cell AS INT) AS cell, count(p.b) AS n FROM range(80) c(cell) LEFT JOIN (SELECT least(greatest(floor((mz - 0.0) / 1200.0 * 80), 0), 79) AS b FROM v_peaks) p ON p.b = c.cell GROUP BY c.cell", "peaks")
R.add("i232_minimap", lambda v: K.minimap(v.peaks, ("mz", 0.0, 1200.0, 96), ("mobility", 0.0, 1.0, 96)), "SELECT CAST(least(greatest(floor(mz / 1200.0 * 96), 0), 95) AS INT) AS x, CAST(least(greatest(floor(mobility * 96), 0), 95) AS INT) AS y, count(*) AS n, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL", "peaks")
R.add("i233_volume", lambda v: K.volume_deposit(v.peaks, {"mz": (0.0, 1200.0, 16), "mobility": (0.0, 1.0, 8)}))

# set operations
def _halves(v):
    """Survey and fragment spectra of each cycle of three frames."""
    p = v.peaks.withColumn("cycle", F.floor(F.col("frame_id") / 3))
    return p.where("ms_type = 0"), p.where("ms_type <> 0")


_KEY = "CAST(round(mz * 1000000.0) AS BIGINT)"
R.add("i234_spectrum_add", lambda v: S.spectrum_add(*_halves(v), "cycle"), f"SELECT CAST(frame_id // 3 AS BIGINT) AS cycle, {_KEY} / 1000000.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY CAST(frame_id // 3 AS BIGINT), {_KEY}", "peaks")
R.add("i234_spectrum_add_strict", lambda v: S.spectrum_add(*_halves(v), "cycle", strict=True), f"WITH a AS (SELECT frame_id // 3 AS c, {_KEY} AS k, arg_max(intensity, {{'a': mz, 'b': intensity}}) AS i FROM v_peaks WHERE ms_type = 0 GROUP BY 1, 2) SELECT CAST(c AS BIGINT) AS cycle, k / 1000000.0 AS mz, sum(i) AS intensity FROM (SELECT * FROM a UNION ALL SELECT frame_id // 3, {_KEY}, intensity FROM v_peaks WHERE ms_type <> 0) x GROUP BY c, k", "peaks")
R.add("i235_spectrum_subtract", lambda v: S.spectrum_add(*_halves(v), "cycle", sign=-1), f"SELECT CAST(frame_id // 3 AS BIGINT) AS cycle, {_KEY} / 1000000.0 AS mz, sum(CASE ms_type WHEN 0 THEN intensity ELSE -intensity END) AS intensity FROM v_peaks GROUP BY CAST(frame_id // 3 AS BIGINT), {_KEY}", "peaks")
R.add("i236_set_algebra", lambda v: S.confusion(v.truth, v.report, ["seq_id", "charge"]), "SELECT seq_id, charge, CASE WHEN max(t) = 1 AND max(f) = 1 THEN 'TP' WHEN max(f) = 1 THEN 'FP' ELSE 'FN' END AS kind FROM (SELECT seq_id, charge, 1 AS t, 0 AS f FROM v_truth UNION ALL SELECT seq_id, charge, 0, 1 FROM v_report) x GROUP BY ALL", "truth report")
R.add("i237_overlap", lambda v: S.overlap(v.truth, v.report, ["seq_id", "charge"]), "WITH t AS (SELECT DISTINCT seq_id, charge FROM v_truth), r AS (SELECT DISTINCT seq_id, charge FROM v_report), n AS (SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM r)) AS n_both, (SELECT count(*) FROM t) AS a, (SELECT count(*) FROM r) AS b) SELECT n_both, a - n_both AS n_a, b - n_both AS n_b, n_both / (a + b - n_both) AS jaccard FROM n", "truth report")
R.add("i240_distinct", lambda v: v.report.dropDuplicates(["seq_id", "charge"]).select("seq_id", "charge"), "SELECT DISTINCT seq_id, charge FROM v_report", "report")
R.add("i241_unique_items", lambda v: S.unique_to_group(v.table("peptides").where("sequence is not null and protein_id is not null"), "sequence", "protein_id"), "SELECT sequence, min(protein_id) AS protein_id FROM peptides WHERE sequence IS NOT NULL AND protein_id IS NOT NULL GROUP BY sequence HAVING count(DISTINCT protein_id) = 1")

QUERIES, ORACLES = R.queries, R.oracles
