"""Spectrum arithmetic and set algebra over identifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.binning import mz_key


def spectrum_add(a: DataFrame, b: DataFrame, *keys: str, strict: bool = False, sign: int = 1) -> DataFrame:
    """Outer sum of two spectra, peaks equal at six decimals are one. ``strict`` keeps only the last of the left side's own
    equal peaks (by m/z, then intensity) before adding, as the non-commutative form does. ``sign`` -1 subtracts."""
    left = a.select(*keys, mz_key(6).alias("k"), "mz", "intensity")
    if strict:
        left = left.groupBy(*keys, "k").agg(F.max_by("intensity", F.struct("mz", "intensity")).alias("intensity"))
    both = left.select(*keys, "k", "intensity").unionByName(b.select(*keys, mz_key(6).alias("k"), (F.col("intensity") * sign).alias("intensity")))
    return both.groupBy(*keys, "k").agg(F.sum("intensity").alias("intensity")).select(*keys, (F.col("k") / 1e6).alias("mz"), "intensity")


def confusion(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind``: TP in both, FP only found, FN only true; each key once. One union and one aggregation."""
    both = truth.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("f")))
    flags = both.groupBy(*keys).agg(F.max("t").alias("t"), F.max("f").alias("f"))
    return flags.select(*keys, F.when((F.col("t") == 1) & (F.col("f") == 1), "TP").when(F.col("f") == 1, "FP").otherwise("FN").alias("kind"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of both, only a, only b, and the Jaccard index."""
    c = confusion(a, b, keys).agg(F.count_if(F.col("kind") == "TP").alias("n_both"), F.count_if(F.col("kind") == "FN").alias("n_a"), F.count_if(F.col("kind") == "FP").alias("n_b"))
    return c.withColumn("jaccard", F.col("n_both") / F.nullif(F.col("n_both") + F.col("n_a") + F.col("n_b"), F.lit(0)))


def unique_to_group(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that belong to one group only."""
    g = df.groupBy(item).agg(F.min(group).alias(group), F.max(group).alias("_m"))
    return g.where(F.col(group) == F.col("_m")).drop("_m")
