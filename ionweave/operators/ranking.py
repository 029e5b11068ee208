"""Top-n per group, argmax members, thinning, grids and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """n rows per group by a total order; Spark limits each group before the shuffle. n = 0 keeps all."""
    if n == 0:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def top_spectrum(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n most intense peaks, ties by m/z then tof; adds the place by m/z."""
    kept = top_n(df, n, list(keys), F.desc("intensity"), F.asc("mz"), F.asc("tof"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("mz", "tof", F.desc("intensity"))))


def most_intense(df: DataFrame, by: str, ident: str, *keys: str) -> DataFrame:
    """The member of each group with the highest value, the smaller identifier on ties; an aggregation, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(by).alias("v"), (-F.col(ident)).alias("i"))).alias("m")).select(*keys, "m.*")


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties in order of the value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def cell(x: Column, lo: float, hi: float, n: int) -> Column:
    """Zero-based cell of an equal-width grid; the upper border belongs to the last cell, values beyond are clamped."""
    return F.least(F.greatest(F.floor((x - lo) / (hi - lo) * n), F.lit(0)), F.lit(n - 1)).cast("int")


def budget_sample(df: DataFrame, stride: int, axes: dict[str, tuple[float, float, int]], order: list[str]) -> DataFrame:
    """Every ``stride``-th point by a hash of its identifiers, together with the most intense point of each grid cell."""
    even = F.pmod(F.xxhash64(*order), F.lit(stride)) == 0
    grid = df
    for a, (lo, hi, n) in axes.items():
        grid = grid.withColumn(f"_c_{a}", cell(F.col(a), lo, hi, n))
    cells = [f"_c_{a}" for a in axes]
    tops = grid.groupBy(*cells).agg(F.max_by(F.struct(*df.columns), F.struct("intensity", *order)).alias("p")).select("p.*")
    return df.where(even).unionByName(tops).distinct()


def histogram(df: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts per cell, empty cells as 0."""
    c = df.where(F.col(column).isNotNull()).groupBy(cell(F.col(column), lo, hi, n).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("cell")).join(c, "cell", "left").na.fill(0, ["n"])


def minimap(df: DataFrame, a: tuple[str, float, float, int], b: tuple[str, float, float, int]) -> DataFrame:
    """Two-dimensional counts and summed intensity."""
    return df.groupBy(cell(F.col(a[0]), *a[1:]).alias("x"), cell(F.col(b[0]), *b[1:]).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))


def nice_step(span: Column, parts: int) -> Column:
    """The least of 1, 2, 5 or 10 times a power of ten that cuts a span into at most ``parts``; null for no span."""
    raw = F.when(span > 0, span / parts)
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    r = raw / base
    return base * F.when(r <= 1, 1.0).when(r <= 2, 2.0).when(r <= 5, 5.0).otherwise(10.0)


def register(spark: SparkSession, name: str, arguments: str, result: str, body: str) -> None:
    """An expression as a function for SQL text; it is expanded into the plan and optimised like any other."""
    spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")


def volume_deposit(df: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Trilinear scatter of intensity onto a grid: each point gives to the corners of its cell by nearness."""
    at = {a: (F.col(a) - lo) / (hi - lo) * (n - 1) for a, (lo, hi, n) in axes.items()}
    corners = [(F.col("intensity").alias("w"), {})]
    for a, (_, _, n) in axes.items():
        base = F.floor(F.least(F.greatest(at[a], F.lit(0.0)), F.lit(float(n - 1))))
        frac = F.least(F.greatest(at[a], F.lit(0.0)), F.lit(float(n - 1))) - base
        corners = [(w * (frac if up else 1 - frac), {**c, a: F.least(base + up, F.lit(n - 1)).cast("int")}) for w, c in corners for up in (0, 1)]
    each = F.explode(F.array(*[F.struct(*[v.alias(f"g_{a}") for a, v in c.items()], w.alias("w")) for w, c in corners])).alias("x")
    return df.select(each).select("x.*").where("w > 0").groupBy(*[f"g_{a}" for a in axes]).agg(F.sum("w").alias("intensity"))
