"""Locality-sensitive hashing and similarity of vectors, inside the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hyperplanes(dim: int, bits: int, seed: int) -> list[list[float]]:
    """Seeded random planes; parameters, not data."""
    return np.random.default_rng(seed).standard_normal((bits, dim)).round(6).tolist()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sim_hash(vector: Column, planes: list[list[float]]) -> Column:
    """One bit per plane, set where the vector lies strictly on its positive side, packed into a long."""
    if len(planes) > 63:
        raise ValueError("at most 63 bits")
    key = F.lit(0).cast("long")
    for i, p in enumerate(planes):
        key = key + F.when(dot(vector, F.array(*map(F.lit, p))) > 0, F.lit(1 << i)).otherwise(0)
    return key


def sim_hash_tables(df: DataFrame, ident: str, vector: str, trials: int, bits: int, seed: int = 7, dim: int = 64) -> DataFrame:
    """``ident, trial, key`` for several tables of hashes."""
    keys = [sim_hash(F.col(vector), hyperplanes(dim, bits, seed + t)) for t in range(trials)]
    return df.select(ident, F.posexplode(F.array(*keys)).alias("trial", "key"))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def spectral_angle(a: Column, b: Column) -> Column:
    return 1 - 2 * F.acos(F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))) / np.pi


def spectrum_vector(df: DataFrame, resolution: int, *keys: str) -> DataFrame:
    """Sparse vectors ``keys, indices, values`` of spectra on an m/z grid."""
    s = df.groupBy(*keys, F.round(F.col("mz") * 10**resolution).cast("int").alias("i")).agg(F.sum("intensity").alias("v"))
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
    return g.select(*keys, F.col("e.i").alias("indices"), F.col("e.v").alias("values"))


def sparse_to_dense(indices: Column, values: Column, size: int) -> Column:
    m = F.map_from_arrays(indices, values)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(m[i], F.lit(0.0)))


def dense_to_sparse(dense: Column) -> Column:
    """Positive entries as (index, value); values are rounded to six decimals before the test."""
    return F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("i"), F.round(x, 6).alias("v"))), lambda e: e["v"] > 0)
