"""Text sources and sinks of the domain."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ionweave.functions import chemistry as C


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of an MGF file: ``title, pepmass, charge, rt, peaks``; one record a spectrum, split by the reader."""
    raw = spark.read.option("lineSep", "END IONS").text(path).where(F.col("value").contains("BEGIN IONS"))
    body = F.regexp_replace("value", r"(?s)^.*BEGIN IONS\s*", "")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    field = lambda name: F.nullif(F.regexp_extract(body, rf"(?m)^{name}=(.*?)\s*$", 1), F.lit(""))
    peaks = F.transform(F.filter(lines, lambda x: x.rlike(r"^[0-9]")), lambda x: F.struct(F.split(x, r"\s+")[0].cast("double").alias("mz"), F.coalesce(F.get(F.split(x, r"\s+"), F.lit(1)).cast("double"), F.lit(0.0)).alias("intensity")))
    return raw.select(field("TITLE").alias("title"), F.regexp_extract(F.coalesce(field("PEPMASS"), F.lit("")), r"^\S+", 0).try_cast("double").alias("pepmass"), F.regexp_extract(F.coalesce(field("CHARGE"), F.lit("")), r"\d+", 0).try_cast("int").alias("charge"), field("RTINSECONDS").try_cast("double").alias("rt"), peaks.alias("peaks"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``protein_id, header, sequence``."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    return raw.select(F.regexp_extract(head, r"^\S+", 0).alias("protein_id"), head.alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[\s*]+", "").alias("sequence"))


#: Spellings of the findings columns after lower-casing and trimming.
FINDING_NAMES = {"sequence": ("sequence", "peptide", "modified.sequence", "peptide_sequence"), "charge": ("charge", "z", "precursor.charge"), "rt": ("rt", "retention_time", "rt_seconds"), "im": ("im", "inverse_mobility", "1/k0", "ion_mobility"), "intensity": ("intensity", "quantity", "precursor.quantity", "abundance"), "protein": ("protein", "protein_id", "protein.group")}


def normalise_names(df: DataFrame, names: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """Known spellings to canonical columns; missing optional ones become null, missing required ones are refused."""
    low = {c.strip().lower(): c for c in reversed(df.columns)}
    out = []
    for name, spellings in names.items():
        hit = next((low[s] for s in spellings if s in low), None)
        if hit is None and name in required:
            raise ValueError(f"column {name} is missing")
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def read_findings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Findings with normalised names; rows without sequence or intensity are dropped."""
    df = normalise_names(spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path), FINDING_NAMES, ("sequence", "intensity"))
    return df.withColumn("intensity", F.col("intensity").try_cast("double")).withColumn("charge", F.col("charge").try_cast("int")).withColumn("rt", F.col("rt").try_cast("double")).withColumn("im", F.col("im").try_cast("double")).where("sequence is not null and intensity is not null")


#: Columns of three report dialects for sequence, charge, rt, im, intensity, q.
DIALECTS = {
    "diann": ("Modified.Sequence", "Precursor.Charge", "RT", "IM", "Precursor.Quantity", "Q.Value"),
    "spectronaut": ("EG.ModifiedSequence", "FG.Charge", "EG.ApexRT", "EG.IonMobility", "FG.Quantity", "EG.Qvalue"),
    "fragpipe": ("Modified Peptide", "Charge", "Retention", "Ion Mobility", "Intensity", "PeptideProphet Probability"),
}
REPORT = ("sequence", "charge", "rt", "im", "intensity", "q")


def normalise_report(df: DataFrame, dialect: str) -> DataFrame:
    """A report in one of the dialects as ``sequence, charge, rt, im, intensity, q``; probabilities become 1 - p."""
    col = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None)
    cols = dict(zip(REPORT, map(col, DIALECTS[dialect])))
    if dialect == "fragpipe":
        cols["q"] = 1 - F.coalesce(cols["q"].cast("double"), F.lit(0.99))
    out = df.select(*[c.alias(n) for n, c in cols.items()])
    return out.withColumn("sequence", F.regexp_replace("sequence", r"^_|_$", "")).withColumns({n: F.col(n).cast("double") for n in ("rt", "im", "intensity", "q")}).withColumn("charge", F.col("charge").cast("int"))


def fill_intensity(report: DataFrame, ions: DataFrame) -> DataFrame:
    """Missing intensities from the highest ion intensity of (sequence, charge)."""
    top = ions.groupBy("sequence", "charge").agg(F.max("intensity").alias("_i"))
    return report.join(top, ["sequence", "charge"], "left").withColumn("intensity", F.coalesce("intensity", "_i")).drop("_i")


def library_rows(ions: DataFrame, fragments: DataFrame, least: int = 3, longest: int = 50) -> DataFrame:
    """Spectral library in long form: fragments relative to the precursor's strongest, precursors with too few fragments or too long left out.

    ``ions``: ion_id, sequence, charge, mz, rt; ``fragments``: ion_id, fragment, fragment_mz, intensity.
    """
    stats = fragments.groupBy("ion_id").agg(F.max("intensity").alias("_m"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= least) & (F.col("_m") > 0))
    return ions.where(C.residue_count(F.col("sequence")) <= longest).join(stats, "ion_id").join(fragments, "ion_id").select(F.col("sequence").alias("ModifiedPeptide"), F.col("charge").alias("PrecursorCharge"), F.col("mz").alias("PrecursorMz"), F.col("rt").alias("Tr_recalibrated"), F.col("fragment").alias("FragmentType"), F.col("fragment_mz").alias("ProductMz"), (F.col("intensity") / F.col("_m")).alias("LibraryIntensity"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def mzml_spectra(peaks: DataFrame, key: str = "spec_id") -> DataFrame:
    """One XML element per spectrum with base64 arrays, assembled in the JVM: ``key, xml``."""
    g = peaks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    text = lambda f: F.base64(F.encode(F.array_join(F.transform("p", lambda x: x[f].cast("string")), " "), "UTF-8"))
    array = lambda name, f: F.concat(F.lit(f'<binaryDataArray><cvParam name="{name}"/><binary>'), text(f), F.lit("</binary></binaryDataArray>"))
    return g.select(key, F.concat(F.lit('<spectrum index="'), F.col(key).cast("string"), F.lit('" defaultArrayLength="'), F.size("p").cast("string"), F.lit('"><binaryDataArrayList count="2">'), array("m/z array", "mz"), array("intensity array", "intensity"), F.lit("</binaryDataArrayList></spectrum>")).alias("xml"))


#: The accessions of the mzML vocabulary that are written.
MZML = {"m/z array": "MS:1000514", "intensity array": "MS:1000515", "64-bit float": "MS:1000523", "no compression": "MS:1000576", "ms level": "MS:1000511", "centroid spectrum": "MS:1000127", "scan start time": "MS:1000016"}
_MZML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0"><cvList count="1"><cv id="MS" fullName="PSI-MS" URI="https://purl.obolibrary.org/obo/ms.obo"/></cvList><fileDescription><fileContent><cvParam cvRef="MS" accession="MS:1000127" name="centroid spectrum"/></fileContent></fileDescription><softwareList count="1"><software id="ionweave" version="1"/></softwareList><instrumentConfigurationList count="1"><instrumentConfiguration id="IC"/></instrumentConfigurationList><dataProcessingList count="1"><dataProcessing id="DP"><processingMethod order="0" softwareRef="ionweave"/></dataProcessing></dataProcessingList><run id="run" defaultInstrumentConfigurationRef="IC">'


@F.pandas_udf(StringType())
def float64_base64(values: pd.Series) -> pd.Series:
    """Arrays as little-endian 64-bit floats in base64."""
    return values.map(lambda v: base64.b64encode(np.asarray(v, "<f8").tobytes()).decode("ascii"))


@F.pandas_udf(ArrayType(DoubleType()))
def base64_float64(text: pd.Series) -> pd.Series:
    return text.map(lambda t: np.frombuffer(base64.b64decode(t), "<f8"))


def _term(name: str, value: Column | str = "", unit: str = "") -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.concat(F.lit(f'<cvParam cvRef="MS" accession="{MZML[name]}" name="{name}" value="'), value, F.lit(f'"{unit}/>'))


def write_mzml(peaks: DataFrame, path: str, per_file: int = 10_000, key: str = "frame_id") -> None:
    """Spectra as mzML documents, each with at most ``per_file`` neighbouring keys, in folders ``part=N``: every task writes whole documents.

    ``peaks``: key (integer), ms_level, rt (seconds), mz, intensity; m/z ascends within a spectrum. Null m/z or intensities are left out.
    """
    s = peaks.where("mz is not null and intensity is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"), F.min("ms_level").alias("l"), F.min("rt").alias("rt"))
    s = s.withColumn("part", F.floor(F.col(key) / per_file))
    ordinal = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    s = s.withColumn("i", ordinal).withColumn("mz64", float64_base64(F.col("p.mz").cast("array<double>"))).withColumn("int64", float64_base64(F.col("p.intensity").cast("array<double>")))
    array = lambda name, c: F.concat(F.lit('<binaryDataArray encodedLength="'), F.length(c).cast("string"), F.lit('">'), _term("64-bit float"), _term("no compression"), _term(name), F.lit("<binary>"), F.col(c), F.lit("</binary></binaryDataArray>"))
    unit = ' unitCvRef="UO" unitAccession="UO:0000010" unitName="second"'
    xml = F.concat(
        F.lit('<spectrum index="'), F.col("i").cast("string"), F.lit('" id="scan='), F.col(key).cast("string"), F.lit('" defaultArrayLength="'), F.size("p").cast("string"), F.lit('">'), _term("ms level", F.col("l")), _term("centroid spectrum"),
        F.lit('<scanList count="1"><scan>'), _term("scan start time", F.col("rt"), unit), F.lit('</scan></scanList><binaryDataArrayList count="2">'), array("m/z array", "mz64"), array("intensity array", "int64"), F.lit("</binaryDataArrayList></spectrum>"),
    )
    n = s.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    head = n.select("part", F.lit(-1).alias("i"), F.concat(F.lit(_MZML_HEAD + '<spectrumList count="'), F.col("n").cast("string"), F.lit('" defaultDataProcessingRef="DP">')).alias("value"))
    foot = n.select("part", F.lit(2**31 - 1).alias("i"), F.lit("</spectrumList></run></mzML>").alias("value"))
    lines = s.select("part", "i", xml.alias("value")).unionByName(head).unionByName(foot)
    lines.repartition("part").sortWithinPartitions("part", "i").select("part", "value").write.partitionBy("part").text(path)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """``id, ms_level, rt, mz, intensity``, one row a peak, of documents in the form that ``write_mzml`` gives (one spectrum a line)."""
    x = spark.read.text(path).where(F.col("value").startswith("<spectrum "))
    value = lambda name: F.regexp_extract("value", rf'name="{name}" value="([^"]*)"', 1)
    data = F.regexp_extract_all("value", F.lit("<binary>([^<]*)</binary>"), F.lit(1))
    y = x.select(F.regexp_extract("value", r'id="scan=(\d+)"', 1).cast("long").alias("id"), value("ms level").cast("int").alias("ms_level"), value("scan start time").cast("double").alias("rt"), base64_float64(data[0]).alias("m"), base64_float64(data[1]).alias("i"))
    return y.select("id", "ms_level", "rt", F.explode(F.arrays_zip("m", "i")).alias("p")).select("id", "ms_level", "rt", F.col("p.m").alias("mz"), F.col("p.i").alias("intensity"))


def pin_rows(psms: DataFrame, features: list[str]) -> DataFrame:
    """Rescoring table: identifier, label 1 or -1, features, peptide, proteins."""
    return psms.select(F.col("spec_idx").alias("SpecId"), F.when(F.col("decoy"), -1).otherwise(1).alias("Label"), *features, F.col("sequence").alias("Peptide"), F.col("proteins").alias("Proteins"))


def parse_list(text: Column) -> Column:
    """``['a', 'b']`` to an array."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    return F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))


def checkpoint_stage(df: DataFrame, path: str, stage: str) -> DataFrame:
    """A stage written under its name and read again, so that a run can go on from it."""
    df.write.mode("overwrite").parquet(f"{path}/{stage}")
    return df.sparkSession.read.parquet(f"{path}/{stage}")
