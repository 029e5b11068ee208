"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions import peptidoform as P
from ionweave.llm import language, packing, survivor, tokens, topn
from ionweave.session import read

TOP = 3
#: Container size of the packing, in tokens.
CAPACITY = 4096
SURVIVOR_FIELDS = ("sequence", "charge", "intensity", "rt")


def findings_survivors(spark: SparkSession, sf_dir: str, policy: str = "record") -> DataFrame:
    """One record per acquisition, peptidoform and charge with two or more findings."""
    mods = P.mod_rows(read(spark, sf_dir, "mods"))
    trust = read(spark, sf_dir, "sources").select("source_id", "trust")
    f = read(spark, sf_dir, "findings").select("finding_id", "acq_id", "source_id", "sequence", "charge", "intensity", "rt", "loaded_at")
    key = F.struct(P.canonical(F.col("sequence"), mods).alias("form"), P.written_charge(F.col("sequence"), F.col("charge")).alias("z"))
    f = f.select("*", F.inline(F.array(key)))  # a generated row, which keeps the optimizer from parsing again for each use
    f = f.join(F.broadcast(trust), "source_id", "left")  # sources is a fixed table of 48 rows
    number = F.regexp_extract(F.col("rt"), r"[0-9][0-9.,:]*", 0)
    fields = {
        "sequence": (F.col("sequence").rlike(rf"\A{P.SEQUENCE_PATTERN}\z"), F.col("form")),
        "charge": (F.col("charge").rlike(r"\A[0-9]+\z"), F.col("z")),
        "intensity": (F.col("intensity").isNotNull() & ~F.isnan("intensity") & (F.col("intensity") > 0), F.col("intensity")),
        "rt": (F.col("rt").rlike("[0-9]"), number),
    }
    return survivor.survivors(f, ["acq_id", "form", "z"], "finding_id", "trust", "loaded_at", fields, policy=policy)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.field_sources(findings_survivors(spark, sf_dir), list(SURVIVOR_FIELDS))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_survivors(spark, sf_dir, "votes").withColumnsRenamed({"form": "peptidoform", "z": "form_charge"})


def p5_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p5_found``, by the policy of votes: each field from the best record of the value with most votes."""
    return survivor.field_sources(findings_survivors(spark, sf_dir, "votes"), list(SURVIVOR_FIELDS))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(read(spark, sf_dir, "precursors"), "parent", "intensity", "id", TOP).select("parent", "id", "rank_no")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text comes back from its ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), counts_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), CAPACITY)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(_segments(spark, sf_dir))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).drop("code")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_segments(spark, sf_dir))


P6_FOUND_SQL = f"""SELECT parent, id, rank_no FROM (
  SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY intensity DESC, id) AS rank_no FROM (
    SELECT parent, id, max(intensity) AS intensity FROM precursors
    WHERE parent IS NOT NULL AND id IS NOT NULL AND intensity IS NOT NULL AND NOT isnan(intensity) GROUP BY parent, id) x) y WHERE rank_no <= {TOP}"""

_FORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(sequence), '(?:/|_\\.)[0-9]+$', ''), '^_+|_+$', '', 'g'), '^(?:[A-Z]|-)\\.(.+)\\.(?:[A-Z]|-)$', '\\1'), '[\\[(]UNIMOD:0*([0-9]+)[\\])]', '[UNIMOD:\\1]', 'gi')"
#: Fixed spelling table of the six modifications: id, name, residues, mass shift with four, two and no decimals.
_MODS = ((4, "Carbamidomethyl", "C", "57[.]0215|57[.]02|57"), (7, "Deamidated", "NQ", "0[.]9840|0[.]98|1"), (21, "Phospho", "STY", "79[.]9663|79[.]97|80"), (34, "Methyl", "R", "14[.]0157|14[.]0156|14[.]02|14"), (35, "Oxidation", "M", "15[.]9949|15[.]99|16"), (121, "GG", "K", "114[.]0429|114[.]04|114"))
for _id, _name, _where, _mass in _MODS:
    _FORM = f"regexp_replace(regexp_replace({_FORM}, '[\\[(]{_name}(?: ?\\([A-Z]+\\))?[\\])]', '[UNIMOD:{_id}]', 'gi'), '([{_where}])\\[\\+(?:{_mass})\\]', '\\1[UNIMOD:{_id}]', 'g')"
_P5_ROWS = f"""WITH a AS (SELECT f.*, s.trust, {_FORM} AS form,
  CAST(coalesce(nullif(regexp_extract(coalesce(charge, ''), '^\\s*(?:z=)?\\+?([0-9]+)(?:\\.0+)?\\+?\\s*$', 1), ''), nullif(regexp_extract(trim(sequence), '(?:/|_\\.)([0-9]+)$', 1), '')) AS INT) AS z
  FROM findings f LEFT JOIN sources s USING (source_id)),
g AS (SELECT *, min(finding_id) OVER w AS group_id, count(*) OVER w AS n FROM a
  WHERE acq_id IS NOT NULL AND z IS NOT NULL AND regexp_full_match(form, '(?:[{P.RESIDUES}](?:\\[UNIMOD:[0-9]+\\])?)+') WINDOW w AS (PARTITION BY acq_id, form, z)),
u AS (SELECT *, 'sequence' AS field_name FROM g WHERE regexp_full_match(sequence, '{P.SEQUENCE_PATTERN}')
  UNION ALL SELECT *, 'charge' FROM g WHERE regexp_full_match(charge, '[0-9]+')
  UNION ALL SELECT *, 'intensity' FROM g WHERE intensity > 0 AND NOT isnan(intensity)
  UNION ALL SELECT *, 'rt' FROM g WHERE regexp_matches(rt, '[0-9]'))"""
P5_FOUND_SQL = _P5_ROWS + """ SELECT group_id, field_name, finding_id FROM (
  SELECT group_id, field_name, finding_id, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust DESC NULLS LAST, loaded_at DESC NULLS LAST, finding_id) AS r FROM u WHERE n >= 2) x WHERE r = 1"""

#: The normalised value of each field and its votes: trust times a half-life of 180 days, summed over the findings that have the value.
_P5_VALUE = "CASE field_name WHEN 'sequence' THEN form WHEN 'charge' THEN CAST(z AS VARCHAR) WHEN 'intensity' THEN CAST(intensity AS VARCHAR) ELSE regexp_extract(rt, '[0-9][0-9.,:]*') END"
P5_VOTES_SQL = _P5_ROWS + f""", x AS (SELECT *, {_P5_VALUE} AS val, coalesce(trust, 0) * 2.0::DOUBLE ** ((epoch_us(loaded_at) / 86400e6 - 20000) / 180) AS vote FROM u WHERE n >= 2),
y AS (SELECT *, sum(vote) OVER (PARTITION BY group_id, field_name, val) AS votes FROM x)
SELECT group_id, field_name, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY round(votes * 1e6) DESC, trust DESC NULLS LAST, loaded_at DESC NULLS LAST, finding_id) AS r FROM y) q WHERE r = 1"""
P7_ROUND_TRIP_SQL = "SELECT doc_id, true AS same FROM documents"

QUERIES = {"p5_found": p5_found, "p5_votes": p5_votes, "p5_survivors": p5_survivors, "p6_found": p6_found, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_segments": p9_segments, "p9_languages": p9_languages}
ORACLES = {"p5_found": P5_FOUND_SQL, "p5_votes": P5_VOTES_SQL, "p7_round_trip": P7_ROUND_TRIP_SQL, "p6_found": P6_FOUND_SQL}
