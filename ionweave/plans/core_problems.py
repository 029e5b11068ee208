"""Queries of the general data problems: drifting schemas, orphans, rejected rows and units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions import quantities as Q
from ionweave.operators import drift as D
from ionweave.operators import orphans as O
from ionweave.operators import rejects as R
from ionweave.operators import units as U
from ionweave.session import materialise, read

#: The references of the instrument tables: table, field, target table, whether targets can be deleted.
REFERENCES = (("pasefframemsmsinfo", "precursor", "precursors"), ("pasefframemsmsinfo", "frame", "frames"), ("precursors", "parent", "frames"))


#: Columns of the two export tables as the identification tables have them.
EXPORT_COLUMNS = {
    "parse_diann_report": dict(sequence="string", sequence_modified="string", charge="int", mz="double", rt="string", inverse_mobility="double", intensity="double", q_value="double", protein_id="string"),
    "peptides": dict(protein_id="int", sequence="string", decoy="boolean", missed_cleavages="int", retention_time_gru_predictor="double", events="double", phospho_site_a="int", phospho_site_b="int", sequence_original="string", fasta="string"),
}


def _exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, rows = read(spark, sf_dir, "export_files"), read(spark, sf_dir, "export_rows")
    return files, D.tagged_values(files, rows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.changes(*_exports(spark, sf_dir)).select("file_id", "change_kind", "field_name")


def p1_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives per path."""
    return D.fuse(_exports(spark, sf_dir)[1])


def _fused(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    files, tagged = _exports(spark, sf_dir)
    tagged = materialise(tagged, "tagged")  # read by the names, the renames and the table
    moved = D.changes(files, tagged).where("change_kind = 'renamed'").select("file_id", "old_name", F.col("field_name").alias("new_name"))
    return D.fused_table(files, tagged, moved, table, EXPORT_COLUMNS[table])


def p1_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the exports that cannot be taken over as they are."""
    return D.unread(read(spark, sf_dir, "export_files"), read(spark, sf_dir, "export_rows"))


def p1_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "parse_diann_report")


def p1_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "peptides")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, field, target in REFERENCES:
        found = O.orphans(read(spark, sf_dir, table), read(spark, sf_dir, target), row_id="row_id", ref_key=field, parent_key="id", parent_deleted="deleted_at")
        parts.append(found.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), "row_id", "reason", F.date_format("loaded_at", "yyyy-MM-dd").alias("load_day")))
    return reduce(DataFrame.unionByName, parts)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_report(p2_found(spark, sf_dir))


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.load(read(spark, sf_dir, "findings_files"), read(spark, sf_dir, "findings_raw"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rejected(_loaded(spark, sf_dir))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid(_loaded(spark, sf_dir))


#: Retention times: table, identifier, column, the table's own unit.
TIMES = (("parse_diann_report", "row_id", "rt", "min"), ("findings", "finding_id", "rt", "s"), ("peptides", "row_id", "retention_time_gru_predictor", "s"))


def _unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, ident, column, own in TIMES:
        df = read(spark, sf_dir, table)
        rows = df.select(F.lit(table).alias("history"), F.col(ident).alias("row_id"), "source_id", "loaded_at", F.lit(own).alias("own"), F.col(column).alias("_time"))
        if dict(df.dtypes)[column] == "string":
            parts.append(Q.parse_times(rows, "_time").drop("_time"))
        else:
            v = F.when(~F.isnan("_time"), F.col("_time").cast("double"))
            parts.append(rows.select("history", "row_id", "source_id", "loaded_at", "own", v.alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("seconds")))
    sources = read(spark, sf_dir, "sources").select("source_id", F.col("dead_s").alias("low"), F.col("gradient_s").alias("high"))
    notes = read(spark, sf_dir, "source_notes").select("source_id", "valid_from", Q.stated_unit(F.col("note_text")).alias("unit"))
    return U.assign_units(reduce(DataFrame.unionByName, parts), sources, notes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_rows(spark, sf_dir).where("unit_code is not null and unit_code <> own").select(F.col("history").alias("table_name"), "row_id", "unit_code")


def p4_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_rows(spark, sf_dir).select(F.col("history").alias("table_name"), "row_id", "unit_code", "rule", "seconds")


def _p2_part(table: str, field: str, target: str) -> str:
    return f"""SELECT '{table}' AS ref_table, '{field}' AS ref_field, r.row_id,
  CASE WHEN NOT EXISTS (SELECT 1 FROM {target} t WHERE t.id = r.{field}) THEN 'missing'
       WHEN EXISTS (SELECT 1 FROM {target} t WHERE t.id = r.{field} AND t.loaded_at <= r.loaded_at) THEN 'deleted' ELSE 'late' END AS reason,
  strftime(r.loaded_at, '%Y-%m-%d') AS load_day
FROM {table} r WHERE r.{field} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {target} t WHERE t.id = r.{field} AND t.loaded_at <= r.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > r.loaded_at))"""


P2_FOUND_SQL = "\nUNION ALL\n".join(_p2_part(*x) for x in REFERENCES)
P2_REPORT_SQL = f"SELECT ref_table, ref_field, load_day, reason, count(*) AS n_rows FROM ({P2_FOUND_SQL}) f GROUP BY ALL"

_TAG = """CASE WHEN v IS NULL OR v IN ('', 'NA') THEN NULL WHEN regexp_full_match(v, '[Tt]rue|[Ff]alse') THEN 'boolean' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer'
  WHEN regexp_full_match(v, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?[0-9]+[eE][+-]?[0-9]+') THEN 'decimal' ELSE 'text' END"""
P1_FOUND_SQL = f"""WITH f AS (SELECT file_id, file_format, header_line, lag(file_id) OVER (PARTITION BY export_table, producer ORDER BY written_at, file_id) AS prev FROM export_files),
j AS (SELECT r.file_id, r.record_no, e.key AS name, CASE WHEN e.type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN e.type IN ('DOUBLE', 'DECIMAL') THEN 'decimal' WHEN e.type = 'BOOLEAN' THEN 'boolean'
    WHEN e.type = 'ARRAY' THEN 'array' WHEN e.type = 'OBJECT' THEN 'object' WHEN e.type = 'NULL' OR e.atom IN ('""', '"NA"') THEN NULL ELSE 'text' END AS tag, CAST(e.value AS VARCHAR) AS v
  FROM export_rows r JOIN f USING (file_id), json_each(r.payload) e WHERE f.file_format = 'json'),
t AS (SELECT file_id, record_no, name, {_TAG} AS tag, v FROM (
  SELECT r.file_id, r.record_no, unnest(string_split(f.header_line, chr(9))) AS name, unnest(string_split(r.payload, chr(9))) AS v FROM export_rows r JOIN f USING (file_id) WHERE f.file_format <> 'json') x),
a AS (SELECT file_id, record_no, name, tag, CASE WHEN tag IS NOT NULL THEN v END AS v FROM (SELECT * FROM j UNION ALL SELECT * FROM t) y),
p AS (SELECT file_id, name, CASE WHEN bool_and(coalesce(tag, 'decimal') IN ('integer', 'decimal')) AND bool_or(tag = 'decimal') THEN 'decimal' ELSE string_agg(DISTINCT tag, '|' ORDER BY tag) END AS kind FROM a GROUP BY ALL),
d AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.name, o.name) AS name, n.name IS NULL AS gone, o.name IS NULL AS fresh, n.kind AS nk, o.kind AS ok
  FROM (SELECT f.file_id, p.* EXCLUDE (file_id) FROM f JOIN p USING (file_id) WHERE prev IS NOT NULL) n
  FULL JOIN (SELECT f.file_id, p.* EXCLUDE (file_id) FROM f JOIN p ON p.file_id = f.prev) o ON n.file_id = o.file_id AND n.name = o.name),
c AS (SELECT DISTINCT f.file_id, f.prev, x.record_no FROM f JOIN (SELECT DISTINCT file_id, record_no FROM a) x ON x.file_id = f.file_id JOIN (SELECT DISTINCT file_id, record_no FROM a) y ON y.file_id = f.prev AND y.record_no = x.record_no),
m AS (SELECT o.file_id, o.name AS old_name, n.name AS new_name FROM d o JOIN d n ON o.file_id = n.file_id AND o.gone AND n.fresh
  WHERE EXISTS (SELECT 1 FROM c WHERE c.file_id = o.file_id) AND NOT EXISTS (SELECT 1 FROM c LEFT JOIN a x ON x.file_id = c.prev AND x.record_no = c.record_no AND x.name = o.name
    LEFT JOIN a y ON y.file_id = c.file_id AND y.record_no = c.record_no AND y.name = n.name WHERE c.file_id = o.file_id AND x.v IS DISTINCT FROM y.v))
SELECT file_id, 'renamed' AS change_kind, new_name AS field_name FROM m
UNION ALL SELECT file_id, CASE WHEN gone THEN 'removed' ELSE 'added' END, name FROM d WHERE gone AND NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = d.file_id AND m.old_name = d.name) OR fresh AND NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = d.file_id AND m.new_name = d.name)
UNION ALL SELECT file_id, 'retyped', name FROM d WHERE NOT gone AND NOT fresh AND nk <> ok"""

_P4_VALUES = """SELECT 'parse_diann_report' AS table_name, row_id, source_id, loaded_at, rt AS t, 'min' AS own FROM parse_diann_report
  UNION ALL SELECT 'findings', finding_id, source_id, loaded_at, rt, 's' FROM findings
  UNION ALL SELECT 'peptides', row_id, source_id, loaded_at, CASE WHEN NOT isnan(retention_time_gru_predictor) THEN CAST(retention_time_gru_predictor AS VARCHAR) END, 's' FROM peptides"""
P4_FOUND_SQL = f"""WITH v AS (SELECT *, regexp_replace(trim(t), '^RT=', '') AS x FROM ({_P4_VALUES}) a WHERE regexp_matches(t, '[0-9]')),
w AS (SELECT *, TRY_CAST(replace(regexp_extract(x, '^[0-9]+(?:[.,][0-9]+)?'), ',', '.') AS DOUBLE) AS n, trim(lower(rtrim(regexp_replace(x, '^[0-9]+(?:[.,][0-9]+)?', ''), '. '))) AS u, regexp_full_match(x, '[0-9:]+:[0-9.]+|PT.*') AS clock FROM v),
k AS (SELECT source_id, valid_from, CASE regexp_extract(note_text, '(ms|minutes|Sekunden|seconds|heures|hours|s)[]]?$', 1) WHEN 'ms' THEN 'ms' WHEN 'minutes' THEN 'min' WHEN 'heures' THEN 'h' WHEN 'hours' THEN 'h' ELSE 's' END AS unit
  FROM source_notes WHERE regexp_matches(note_text, '(?i)\\brt\\b|retention|rétention') AND regexp_matches(note_text, '(ms|minutes|Sekunden|seconds|heures|hours|[[]s)[]]?$')),
z AS (SELECT w.*, CASE WHEN clock THEN 'clock' WHEN u IN ('s', 'sec', 'seconds', 'sek') THEN 's' WHEN u IN ('min', 'mins', 'minutes', chr(39)) THEN 'min' WHEN u IN ('ms', 'msec', 'milliseconds') THEN 'ms' WHEN u IN ('h', 'hrs', 'hours', 'std') THEN 'h'
    ELSE coalesce((SELECT max_by(unit, valid_from) FROM k WHERE k.source_id = w.source_id AND k.valid_from <= w.loaded_at),
      CASE WHEN CAST(n BETWEEN dead_s AND gradient_s AS INT) + CAST(n * 60 BETWEEN dead_s AND gradient_s AS INT) + CAST(n * 0.001 BETWEEN dead_s AND gradient_s AS INT) + CAST(n * 3600 BETWEEN dead_s AND gradient_s AS INT) = 1 THEN
        CASE WHEN n BETWEEN dead_s AND gradient_s THEN 's' WHEN n * 60 BETWEEN dead_s AND gradient_s THEN 'min' WHEN n * 0.001 BETWEEN dead_s AND gradient_s THEN 'ms' ELSE 'h' END END) END AS unit_code
  FROM w LEFT JOIN sources s USING (source_id))
SELECT table_name, row_id, unit_code FROM z WHERE unit_code <> own"""

_VALUE = """'(?:"(?:[^"]|"")*"|[^"\r\n' || delim || ']*)'"""
_SEQ = R.SEQUENCE_PATTERN.replace("'", "''")
P3_FOUND_SQL = f"""WITH h AS (SELECT file_id, delim, list_transform(string_split(lower(header_line), delim), lambda x: trim(x)) AS names FROM findings_files),
r AS (SELECT line_id, delim, names, raw_line, regexp_full_match(raw_line, {_VALUE} || '(?:[' || delim || ']' || {_VALUE} || ')*') AS sound,
    regexp_extract_all(delim || raw_line, '[' || delim || '](' || {_VALUE} || ')', 1) AS v FROM findings_raw LEFT JOIN h USING (file_id)),
u AS (SELECT *, list_transform(v, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS w FROM r),
c AS (SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN sound IS NULL OR len(v) <> len(names) THEN 'columns'
    WHEN NOT regexp_full_match(coalesce(w[list_position(names, 'sequence')], ''), '{_SEQ}') THEN 'sequence'
    WHEN list_contains(names, 'charge') AND NOT regexp_full_match(w[list_position(names, 'charge')], '[1-6]') THEN 'charge' END AS reason FROM u)
SELECT line_id, reason FROM c WHERE reason IS NOT NULL"""

QUERIES = {"p1_found": p1_found, "p1_schemas": p1_schemas, "p1_unread": p1_unread, "p1_reports": p1_reports, "p1_peptides": p1_peptides, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_loaded": p3_loaded, "p4_found": p4_found, "p4_seconds": p4_seconds}
ORACLES = {"p1_found": P1_FOUND_SQL, "p2_found": P2_FOUND_SQL, "p2_report": P2_REPORT_SQL, "p3_found": P3_FOUND_SQL, "p4_found": P4_FOUND_SQL}
