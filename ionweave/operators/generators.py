"""Table-producing operators: acquisition timelines, frame and scan tables, window schemes, distributions, seeded noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions import physics as Y


def timeline(spark: SparkSession, events: list[tuple[str, float]], cycles: int) -> DataFrame:
    """``frame_id, cycle, event, kind, start, end``: half-open intervals of repeated cycles of (kind, seconds)."""
    total, rows, at = sum(d for _, d in events), [], 0.0
    for i, (kind, d) in enumerate(events):
        rows.append((i, kind, at, at + d))
        at += d
    cycle = F.explode(F.array(*[F.struct(F.lit(i).alias("event"), F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, k, a, b in rows])).alias("e")
    t = spark.range(cycles).select(F.col("id").alias("cycle"), cycle)
    return t.select((F.col("cycle") * len(events) + F.col("e.event") + 1).alias("frame_id"), "cycle", "e.event", "e.kind", (F.col("cycle") * total + F.col("e.a")).alias("start"), (F.col("cycle") * total + F.col("e.b")).alias("end"))


def frame_table(spark: SparkSession, n: int, cycle: float, precursor_every: int) -> DataFrame:
    """Frame i at time i · cycle; survey frames where (i - 1) mod k = 0, window groups by turn among the others."""
    f = spark.range(1, n + 1).select(F.col("id").alias("frame_id"), (F.col("id") * cycle).alias("time"))
    survey = (F.col("frame_id") - 1) % precursor_every == 0
    return f.withColumn("ms_type", F.when(survey, 0).otherwise(9)).withColumn("window_group", F.when(~survey, (F.col("frame_id") - 1) % precursor_every))


def scan_table(spark: SparkSession, n: int, im_lo: float, im_hi: float) -> DataFrame:
    """Scans descending in mobility over a range."""
    return spark.range(n).select(F.col("id").alias("scan"), (im_hi - F.col("id") * ((im_hi - im_lo) / max(n - 1, 1))).alias("mobility"))


def sliding_windows(spark: SparkSession, lo: float, hi: float, width: float, step: float) -> DataFrame:
    """Positions of a sliding quadrupole: ``position, isolation_mz, isolation_width``; the last one ends at or beyond ``hi``."""
    n = max(1, int(-(-(hi - lo - width) // step)) + 1)
    return spark.range(n).select(F.col("id").alias("position"), (lo + width / 2 + F.col("id") * step).alias("isolation_mz"), F.lit(width).alias("isolation_width"))


def check_scheme(windows: DataFrame) -> DataFrame:
    """Violations: ``window_group, row_order, problem`` (empty when valid): reversed scans, no width, overlap in scan within a group."""
    from pyspark.sql import Window

    w = Window.partitionBy("window_group").orderBy("scan_begin", "row_order")
    x = windows.withColumn("_p", F.max("scan_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    problems = F.array_compact(F.array(F.when(F.col("scan_end") < F.col("scan_begin"), "reversed"), F.when(F.col("isolation_width") <= 0, "width"), F.when(F.col("_p") >= F.col("scan_begin"), "overlap")))
    return x.select("window_group", "row_order", F.explode(problems).alias("problem"))


def frame_distribution(peptides: DataFrame, frames: DataFrame, cycle: float, z: float = 3.0, least: float = 1e-6, width: float = 64.0) -> DataFrame:
    """``peptide_id, frame_id, abundance``: normal mass of each peptide's elution in each frame's interval (t - cycle, t].

    Peptides meet frames through time buckets, within z deviations of their apex.
    """
    from ionweave.operators.joins import bucketed_interval_join

    p = peptides.select("peptide_id", "rt_mu", "rt_sigma", (F.col("rt_mu") - z * F.col("rt_sigma")).alias("_lo"), (F.col("rt_mu") + z * F.col("rt_sigma")).alias("_hi"))
    f = frames.select("frame_id", (F.col("time") - cycle).alias("_a"), F.col("time").alias("_b"))
    j = bucketed_interval_join(p, f, ("_lo", "_hi"), ("_a", "_b"), width)
    return j.select("peptide_id", "frame_id", Y.normal_mass(F.col("_a"), F.col("_b"), F.col("rt_mu"), F.col("rt_sigma")).alias("abundance")).where(F.col("abundance") > least)


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that follows from keys and seed alone: equal in every plan."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def gaussian(seed: int, *keys: str) -> Column:
    """Standard normal by Box and Muller from two such numbers."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *keys))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *keys))


def exponential_events(mean: float, lo: int, hi: int, seed: int, *keys: str) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), (-mean * F.ln(1 - uniform(seed, *keys))).cast("long")))


def mz_noise(df: DataFrame, ppm: float, kind: str, seed: int, *keys: str) -> DataFrame:
    """m/z moved by uniform or normal ppm noise."""
    e = (uniform(seed, *keys) * 2 - 1) * ppm if kind == "uniform" else gaussian(seed, *keys) * (ppm / 3)
    return df.withColumn("mz", F.col("mz") * (1 + e * 1e-6))


def detector_noise(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Intensities with counting noise (normal, of the square root's size), not below 0."""
    return custom_noise(df, lambda i: F.lit(0.0), F.sqrt, seed, *keys)


def custom_noise(df: DataFrame, mean: Callable[[Column], Column], std: Callable[[Column], Column], seed: int, *keys: str) -> DataFrame:
    """Intensities with normal noise whose mean and deviation are functions of the intensity, not below 0."""
    i = F.col("intensity")
    return df.withColumn("intensity", F.greatest(F.lit(0.0), i + mean(i) + std(i) * gaussian(seed, *keys)))


def demo_points(spark: SparkSession, n: int, blobs: int, seed: int) -> DataFrame:
    """Seeded blobs of points ``id, x, y, z, intensity``."""
    p = spark.range(n).withColumn("b", F.col("id") % blobs)
    axes = [(uniform(seed + 10 * i, "b") * 10 + gaussian(seed + 10 * i + 1, "id") * 0.1).alias(a) for i, a in enumerate("xyz")]
    return p.select("id", *axes, (uniform(seed + 99, "id") * 1000).alias("intensity"))


def expand_grid(base: dict, cells: list[dict]) -> list[dict]:
    """Base configuration with each cell laid over it; names must be unique."""
    out = [base | c for c in cells]
    names = [c.get("name") for c in out]
    if len(set(names)) != len(names):
        raise ValueError("names of the grid are not unique")
    return out


def protein_events(proteins: DataFrame, curve: DataFrame) -> DataFrame:
    """Descending abundance curve ``rank, events`` laid on proteins in the order of a hash."""
    from ionweave.operators.filters import folds

    n = proteins.count()
    r = folds(proteins, max(n, 1), "protein_id").withColumnRenamed("fold", "rank")
    return r.join(curve, "rank", "left")


def derive_seed(*keys: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 15), 16, 10).cast("long")
