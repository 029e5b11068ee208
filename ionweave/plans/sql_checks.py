"""SQL for queries of the other modules that came without any; results with fractions are rounded in both."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions import chemistry as C
from ionweave.functions import physics as Y
from ionweave.plans import chem_queries, core_problems, match_queries, more_queries, peak_queries, stream_queries
from ionweave.plans.cluster_queries import _erfc_sql
from ionweave.plans.match_queries import _PAIRS, _WIN
from ionweave.plans.peak_queries import _R6
from ionweave.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _add(module, name: str, sql: str, views: str = "", rounded: str = "", digits: int = 6) -> None:
    """``rounded`` names the columns that are rounded at ``digits`` decimals on both sides (the SQL does it itself)."""
    query, f = module.QUERIES[name], 10.0**digits

    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.round(F.col(c) * f) / f for c in rounded.split()}) if rounded else df

    QUERIES[name] = run
    ORACLES[name] = with_views(views, sql)


def _r(x: str, digits: int = 6) -> str:
    return f"round(({x}) * 1e{digits}) / 1e{digits}"


_add(peak_queries, "i136_fold_scans_pairwise", "WITH s AS (SELECT frame_id, scan, min(mobility) AS m FROM v_peaks GROUP BY ALL), m AS (SELECT frame_id, scan // 16 AS fold, list_reduce(list(m ORDER BY scan), lambda a, x: (a + x) / 2) AS mobility FROM s GROUP BY frame_id, scan // 16) SELECT p.frame_id, CAST(p.fold AS INT) AS fold, p.mz, p.intensity, m.mobility FROM (SELECT frame_id, scan // 16 AS fold, CAST(round(mz * 1000000.0) AS BIGINT) / 1000000.0 AS mz, sum(intensity) AS intensity FROM v_peaks GROUP BY ALL) p JOIN m USING (frame_id, fold)", "peaks")
_add(peak_queries, "i139_signal_moments", f"WITH s AS (SELECT frame_id, sum(intensity) AS w, sum(intensity * scan) AS a, sum(intensity * CAST(scan AS DOUBLE) ** 2) AS b, sum(intensity * CAST(scan AS DOUBLE) ** 3) AS c FROM v_peaks GROUP BY frame_id), t AS (SELECT *, a / w AS m, greatest(b / w - (a / w) ** 2, 0) AS v FROM s) SELECT frame_id, w AS total, {_r('m', 3)} AS mean, {_r('v', 3)} AS variance, {_r('CASE WHEN v > 1e-12 THEN (c / w - 3 * m * b / w + 2 * m * m * m) / v ** 1.5 ELSE 0 END', 3)} AS skewness FROM t WHERE w > 0", "peaks", "mean variance skewness", 3)
_add(peak_queries, "i157_threshold", f"WITH m AS (SELECT frame_id, list_sort(list(intensity))[count(*) // 2 + 1] AS m, count(*) AS n FROM v_peaks GROUP BY frame_id), x AS (SELECT frame_id, CASE WHEN any_value(n) < 3 THEN 0.0 ELSE list_sort(list(abs(intensity - m)))[count(*) // 2 + 1] * 1.4826 END AS noise FROM v_peaks JOIN m USING (frame_id) GROUP BY frame_id) SELECT frame_id, {_R6('greatest(20.0, 3.0 * noise)')} AS fixed, {_R6('CASE WHEN noise > 0 THEN 2.0 * noise ELSE 1.0 END')} AS adaptive FROM x", "peaks")
_add(peak_queries, "i205_gaussian_smooth", f"WITH m AS (SELECT CAST(s.scan AS INT) AS scan, coalesce(sum(p.intensity), 0) AS i FROM range(512) s(scan) LEFT JOIN v_peaks p USING (scan) GROUP BY s.scan) SELECT a.scan, {_R6('sum(exp(-0.5 * (a.scan - b.scan) ** 2) * b.i) / sum(exp(-0.5 * (a.scan - b.scan) ** 2))')} AS smoothed FROM m a JOIN m b ON a.scan // 64 = b.scan // 64 AND abs(a.scan - b.scan) <= 3 GROUP BY a.scan", "peaks")
_add(peak_queries, "i206_sparse_blur", f"WITH b AS (SELECT frame_id, CAST(floor(tof / 100) AS BIGINT) AS bin, sum(intensity) AS i FROM v_peaks GROUP BY ALL) SELECT frame_id, bin + d AS bin, {_R6('sum(i * exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-3, 4) q(e)))')} AS intensity FROM b, range(-3, 4) k(d) GROUP BY frame_id, bin + d", "peaks", "intensity")
_add(peak_queries, "i207_moment_fit", f"WITH s AS (SELECT frame_id, CAST(scan AS DOUBLE) AS scan, sum(intensity) AS i FROM v_peaks GROUP BY ALL), w AS (SELECT *, greatest(i - max(i) OVER (PARTITION BY frame_id) * 0.1, 0) AS w FROM s), m AS (SELECT frame_id, sum(w * scan) / sum(w) AS mu, sqrt(greatest(sum(w * scan * scan) / sum(w) - (sum(w * scan) / sum(w)) ** 2, 1e-12)) AS sigma FROM w GROUP BY frame_id HAVING sum(w) > 0), g AS (SELECT s.frame_id, mu, sigma, i, exp(-0.5 * ((scan - mu) / sigma) ** 2) AS g FROM s JOIN m USING (frame_id)) SELECT frame_id, {_r('any_value(mu)', 3)} AS mu, {_r('any_value(sigma)', 3)} AS sigma, {_r('regr_slope(i, g)', 3)} AS height, {_r('regr_intercept(i, g)', 3)} AS baseline, {_r('regr_r2(i, g)', 3)} AS r2 FROM g GROUP BY frame_id", "peaks", "mu sigma height baseline r2", 3)
_add(more_queries, "i228_sorted_hits", f"SELECT ms1_id, CAST(count(*) AS INT) AS n, max(jaccard) AS best FROM ({_PAIRS}) p WHERE jaccard >= 0.5 GROUP BY ms1_id", "ms1 ms2")
_AT = lambda x, lo, hi, n: f"least(greatest(({x} - {lo}) / ({hi} - {lo}) * ({n} - 1), 0.0), {n} - 1.0)"
_add(peak_queries, "i233_volume", f"WITH a AS (SELECT intensity, {_AT('mz', '0.0', '1200.0', 16)} AS x, {_AT('mobility', '0.0', '1.0', 8)} AS y FROM v_peaks), c AS (SELECT CAST(least(floor(x) + u, 15) AS INT) AS g_mz, CAST(least(floor(y) + w, 7) AS INT) AS g_mobility, intensity * CASE u WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE w WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS i FROM a, range(2) p(u), range(2) q(w)) SELECT g_mz, g_mobility, {_r('sum(i)', 3)} AS intensity FROM c WHERE i > 0 GROUP BY ALL", "peaks", "intensity", 3)
_Z = f"((45.0 - x) / {math.sqrt(2.0) * 5.0})"
_add(chem_queries, "i255_emg_mass", f"SELECT frame_id, {_R6(f'(SELECT sum(0.1 * exp(0.1 * (85.0 - 2 * x)) * ({_erfc_sql(_Z)})) / 100 FROM (SELECT time - 1 + k / 100 AS x FROM range(100) r(k)) g)')} AS mass FROM v_frame_info", "frame_info")
_CDF = lambda x, m, s: f"0.5 * (2 - ({_erfc_sql(f'(({x} - {m}) / {s} / {math.sqrt(2.0)})')}))"
_add(chem_queries, "i261_scan_abundance", f"WITH s AS (SELECT k AS scan, 1.6 - k * (1.0 / 499) AS m FROM range(500) r(k)) SELECT * FROM (SELECT scan, {_R6(f'{_CDF('m', '1.1', '0.05')} - {_CDF('(m - 0.002)', '1.1', '0.05')}')} AS abundance FROM s) x WHERE abundance > 0")
_add(more_queries, "i262_projectors", f"WITH n AS (SELECT frame_id, (time + lag(time) OVER (ORDER BY time)) / 2 AS a, (time + lead(time) OVER (ORDER BY time)) / 2 AS b FROM v_frame_info WHERE ms_type = 0) SELECT frame_id, {_R6(f'{_CDF('b', '40.0', '6.0')} - {_CDF('a', '40.0', '6.0')}')} AS mass FROM n WHERE a IS NOT NULL AND b IS NOT NULL", "frame_info")
_P = "1 / (1 + exp(-15 * (mz - (isolation_mz - isolation_width / 2 - 0.25)))) - 1 / (1 + exp(-15 * (mz - (isolation_mz + isolation_width / 2 + 0.25))))"
_PASS = f"SELECT p.frame_id, p.scan, p.tof, p.intensity, y.window_group, CASE WHEN d.frame_id IS NULL THEN 1.0 WHEN isolation_mz IS NULL THEN 0.0 ELSE {_P} END AS p, d.frame_id IS NOT NULL AS fragment FROM v_peaks p LEFT JOIN v_dia_info d ON d.frame_id = p.frame_id LEFT JOIN {_WIN} y ON y.frame_id = p.frame_id AND y.scan = p.scan"
_add(match_queries, "i265_transmit_frame", f"SELECT frame_id, scan, tof, {_R6('intensity * p')} AS intensity FROM ({_PASS}) q WHERE p > 0.5", "peaks dia_info windows")
_add(more_queries, "i433_transmission_counts", f"SELECT tof, count(DISTINCT frame_id) AS frames, count(DISTINCT scan) AS scans FROM ({_PASS}) q WHERE p > 0.5 AND fragment GROUP BY tof", "peaks dia_info windows")
_LIST = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_add(match_queries, "i288_spectral_angle", f"WITH e AS (SELECT vec_id, {_LIST} AS p FROM embeddings) SELECT vec_id, {_R6(f'1 - 2 * acos(least(greatest(list_sum(list_transform(p, lambda x: x * abs(x))) / list_sum(list_transform(p, lambda x: x * x)), -1.0), 1.0)) / {math.pi!r}')} AS angle FROM e", rounded="angle")

# chemistry over sequences: one row a residue with its tags
_MASSES = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in C.RESIDUE_MASS.items()) + "}"
_SHIFTS = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in C.UNIMOD_MASS.items()) + "}"
_TAGS = f"list_sum(list_transform(regexp_extract_all(t, 'UNIMOD:([0-9]+)', 1), lambda g: coalesce({_SHIFTS}[g], 0.0)))"


def _residues(source: str) -> str:
    return f"q AS ({source}), r AS (SELECT row_id, unnest(regexp_extract_all(sequence, '[A-Z](?:\\[UNIMOD:[0-9]+\\])*')) AS t, generate_subscripts(regexp_extract_all(sequence, '[A-Z](?:\\[UNIMOD:[0-9]+\\])*'), 1) AS k, len(regexp_extract_all(sequence, '[A-Z](?:\\[UNIMOD:[0-9]+\\])*')) AS n FROM q), w AS (SELECT *, coalesce({_TAGS}, 0.0) AS s, coalesce({_MASSES}[substr(t, 1, 1)], 0.0) + coalesce({_TAGS}, 0.0) AS m FROM r)"


_IONS = f"i AS (SELECT row_id, 'b' AS kind, k AS ordinal, string_agg(t, '') OVER f AS ion, sum(m) OVER f AS mass FROM w WHERE k < n WINDOW f AS (PARTITION BY row_id ORDER BY k) UNION ALL SELECT row_id, 'y', n - k + 1, string_agg(t, '') OVER g, sum(m) OVER g + {Y.MASS_WATER!r} FROM w WHERE k > 1 WINDOW g AS (PARTITION BY row_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), z AS (SELECT row_id, kind, ordinal, ion, (mass + {Y.MASS_PROTON!r}) AS mz FROM i)"
_SEQ = "SELECT row_id, regexp_replace(sequence_modified, '\\(UniMod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g') AS sequence FROM parse_diann_report WHERE sequence_modified IS NOT NULL"
_add(chem_queries, "i292_mass_vector", f"WITH {_residues(_SEQ)} SELECT row_id, CAST(k - 1 AS INT) AS position, {_R6('s')} AS m FROM w WHERE s > 0")
_R4 = "round(mz * 1e4) / 1e4"
_add(chem_queries, "i297_product_ions", f"WITH {_residues(_SEQ)}, {_IONS} SELECT row_id, kind, CAST(ordinal AS INT) AS ordinal, ion, {_R4} AS mz FROM z")
_add(chem_queries, "i295_ion_mass", f"WITH {_residues(_SEQ)}, {_IONS} SELECT row_id, ion, {_R4} AS mz FROM z WHERE kind = 'y' AND ordinal = 1")
_add(chem_queries, "i298_ion_spectra", f"WITH {_residues(_SEQ)}, {_IONS} SELECT row_id, CAST(round(mz * 100) AS BIGINT) AS k, count(*) AS n FROM z GROUP BY row_id, CAST(round(mz * 100) AS BIGINT)")
_add(chem_queries, "i305_digest", "WITH s AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, list_filter(string_split(replace(regexp_replace(s, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '') AS p FROM s), c AS (SELECT doc_id, unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]))) AS x FROM p) SELECT doc_id, count(DISTINCT x) AS n, CAST(max(length(x)) AS INT) AS longest FROM c WHERE length(x) BETWEEN 7 AND 30 GROUP BY doc_id")
_PMF = " UNION ALL ".join(f"SELECT row_id, {z} AS charge, CASE WHEN n >= {z} THEN factorial(n) / ({math.factorial(z)} * factorial(greatest(n - {z}, 0))) * 0.8 ** {z} * 0.2 ** (n - {z}) ELSE 0 END AS share FROM n" for z in range(1, 5))
_add(chem_queries, "i359_charge_expansion", f"WITH n AS (SELECT row_id, CAST(1 + length(regexp_replace(sequence, '[^HRK]', '', 'g')) AS INT) AS n FROM peptides WHERE sequence IS NOT NULL), c AS ({_PMF}) SELECT CAST(charge AS INT) AS charge, count(*) AS n FROM c WHERE share >= 0.05 GROUP BY charge")
_add(chem_queries, "i361_frame_distribution", f"WITH q AS (SELECT monoisotopic_mass % 100 AS mu FROM peptides WHERE monoisotopic_mass IS NOT NULL) SELECT frame_id, count(*) AS n FROM q JOIN v_frame_info ON mu - 6 <= time AND time - 1 <= mu + 6 WHERE {_CDF('time', 'mu', '2.0')} - {_CDF('(time - 1)', 'mu', '2.0')} > 1e-6 GROUP BY frame_id", "frame_info")
_add(chem_queries, "i351_derived_seeds", "SELECT n_nationkey, CAST('0x' || substr(sha256(n_name), 1, 15) AS BIGINT) AS seed FROM nation")

# the data problems
_P1 = core_problems.P1_FOUND_SQL
_add(core_problems, "p1_schemas", _P1[: _P1.index("\np AS (")].rstrip(",\n") + " SELECT file_id, name, coalesce(list_sort(list(DISTINCT tag) FILTER (WHERE tag IS NOT NULL)), []) AS alternatives, count(v) AS n_values, CASE WHEN bool_and(coalesce(tag, 'decimal') IN ('integer', 'decimal')) AND bool_or(tag = 'decimal') THEN 'decimal' ELSE string_agg(DISTINCT tag, '|' ORDER BY tag) END AS fused FROM a GROUP BY file_id, name")
_add(core_problems, "p1_unread", "SELECT file_id, line_no, record_no, reason FROM (SELECT r.*, CASE WHEN f.file_format IS NULL THEN 'file' WHEN f.file_format = 'json' THEN CASE WHEN NOT coalesce(json_valid(payload), false) OR json_type(payload) <> 'OBJECT' THEN 'json' END WHEN header_line IS NULL THEN 'header' WHEN len(string_split(coalesce(payload, ''), chr(9))) > len(string_split(header_line, chr(9))) THEN 'surplus' WHEN len(string_split(coalesce(payload, ''), chr(9))) < len(string_split(header_line, chr(9))) THEN 'short' END AS reason FROM export_rows r LEFT JOIN export_files f USING (file_id)) x WHERE reason IS NOT NULL")
_P3 = core_problems.P3_FOUND_SQL
_add(core_problems, "p3_loaded", _P3[: _P3.index("c AS (SELECT line_id, CASE")].rstrip(",\n") + f""", k AS ({_P3[_P3.index("SELECT line_id, CASE"):_P3.index(" FROM u)")]} FROM u), g AS (SELECT u.*, f.file_id FROM u JOIN findings_raw f USING (line_id) JOIN k USING (line_id) WHERE reason IS NULL),
t AS (SELECT line_id, file_id, {', '.join(f"w[list_position(names, '{c}')] AS {c}" for c in ('protein', 'sequence', 'charge', 'intensity', 'rt', 'im'))} FROM g)
SELECT line_id, file_id, protein, sequence, TRY_CAST(charge AS INT) AS charge, TRY_CAST(intensity AS DOUBLE) AS intensity, TRY_CAST(rt AS DOUBLE) AS rt, TRY_CAST(im AS DOUBLE) AS im, intensity AS intensity_text, rt AS rt_text FROM t""")
_loaded = QUERIES["p3_loaded"]
QUERIES["p3_loaded"] = lambda spark, sf_dir: _loaded(spark, sf_dir).drop("extra")  # a map, which no two engines print alike

# folds, reachability and exclusion, one step a round
_STITCH = """WITH RECURSIVE o AS (SELECT window_group, rt_lo AS lo, rt_hi AS hi, raw_sum AS v, row_number() OVER (PARTITION BY window_group ORDER BY rt_lo, rt_hi, cluster_id) AS k FROM v_ms1),
f AS (SELECT window_group, k, lo, hi, 1 AS n, v, 1 AS part FROM o WHERE k = 1
  UNION ALL SELECT o.window_group, o.k, CASE WHEN joined THEN f.lo ELSE o.lo END, CASE WHEN joined THEN greatest(f.hi, o.hi) ELSE o.hi END, CASE WHEN joined THEN f.n + 1 ELSE 1 END, CASE WHEN joined THEN f.v + o.v ELSE o.v END, CASE WHEN joined THEN f.part ELSE f.part + 1 END
  FROM (SELECT f.*, o.lo - f.hi <= 1 AND greatest(o.hi, f.hi) - f.lo <= 12 AS joined FROM f JOIN o ON o.window_group = f.window_group AND o.k = f.k + 1) f JOIN o ON o.window_group = f.window_group AND o.k = f.k + 1),
s AS (SELECT window_group, part, max(n) AS n, arg_max(lo, k) AS lo, arg_max(hi, k) AS hi, arg_max(v, k) AS v FROM f GROUP BY window_group, part)"""
_add(match_queries, "i214_stitch", with_views("ms1", _STITCH).replace("WITH v_ms1", "WITH RECURSIVE v_ms1").replace(", RECURSIVE o AS", ", o AS") + " SELECT window_group, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(n AS INT) AS n, round(v) AS intensity FROM s")
_stitched = QUERIES["i214_stitch"]
QUERIES["i214_stitch"] = lambda spark, sf_dir: _stitched(spark, sf_dir).withColumn("intensity", F.round("intensity"))
_add(match_queries, "i333_dbscan", "WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), e AS (SELECT a.id, b.id AS id2 FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.03 * 0.03), c AS (SELECT id FROM e GROUP BY id HAVING count(*) >= 5), r(id, m) AS (SELECT id, id FROM c UNION SELECT e.id2, r.m FROM r JOIN e ON e.id = r.id WHERE e.id2 IN (SELECT id FROM c)), l AS (SELECT id, min(m) AS cluster FROM r GROUP BY id), b AS (SELECT e.id, min(l.cluster) AS cluster FROM e JOIN l ON l.id = e.id2 GROUP BY e.id) SELECT p.id, CAST(coalesce(l.cluster, b.cluster, -1) AS BIGINT) AS cluster, l.id IS NOT NULL AS core FROM p LEFT JOIN l ON l.id = p.id LEFT JOIN b ON b.id = p.id")
_add(stream_queries, "i374_exclusion", "WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id UNION ALL SELECT * FROM (SELECT r.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR) AS ts FROM r) x WHERE ts IS NOT NULL) SELECT user_id, epoch_us(ts) AS ts FROM r")
_add(stream_queries, "i375_watermark", "SELECT count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
