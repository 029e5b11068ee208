"""Results against truth: matches, rates by breakdown, correlations, false discovery by threshold, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.windows import exact_quantiles, running


def match_results(truth: DataFrame, report: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched pairs, truth without report, report without truth. The report is first made unique by key (lowest q, then highest intensity)."""
    own = [c for c in report.columns if c not in keys]
    r = report.groupBy(*keys).agg(F.min_by(F.struct(*own), F.struct(F.col("q"), (-F.col("intensity")).alias("i"))).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(f"r_{c}") for c in own])
    return truth.join(r, keys), truth.join(r, keys, "left_anti"), r.join(truth, keys, "left_anti")


def rate_by(truth: DataFrame, found: DataFrame, keys: list[str], by: Column, name: str) -> DataFrame:
    """``name, n, identified, rate`` of the truth, split by an expression."""
    f = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    return truth.join(f, keys, "left").groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.count("_f").alias("identified")).withColumn("rate", F.col("identified") / F.col("n"))


def rank_bucket(df: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    """Adds ``bucket`` 1..k by interpolated rank edges: max(1, ceil(k (r - 1) / (n - 1))).

    Ranks come from counts per value block, so the order needs no single task.
    """
    block = F.floor(F.log2(F.greatest(F.abs(F.col(value)), F.lit(1e-300))) * 64) * F.when(F.col(value) < 0, -1).otherwise(1)
    b = df.withColumn("_b", F.struct(F.signum(F.col(value)).alias("s"), block.alias("b")))
    c = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_b")
    c = c.withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_c")
    r = b.join(F.broadcast(c), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(value, *ties)))  # blocks: at most 64 per power of two
    return r.withColumn("bucket", F.greatest(F.lit(1), F.ceil(k * (F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))).cast("int")).drop("_b", "_before", "_n", "_r")


def correlation(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Pearson, mean and median absolute difference, n; correlations only from three pairs."""
    d = F.abs(F.col(a) - F.col(b))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.corr(a, b)).alias("pearson"), F.avg(d).alias("mae"))
    return _with_median(g, df, d, "median_error", *keys)


def _with_median(g: DataFrame, df: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """Adds the median of a value to aggregates of the same keys, which may be null."""
    m = exact_quantiles(df.select(F.struct(*keys).alias("_k"), value.alias("_x")), F.col("_x"), (0.5,), "_k") if keys else None
    if m is None:
        return g.withColumn(name, exact_quantiles(df, value, (0.5,)).scalar())
    return g.withColumn("_k", F.struct(*keys)).join(m.withColumnRenamed("v0", name), "_k", "left").drop("_k")


def average_ranks(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Mid-ranks by value counts: rows of one value share the mean of their ranks."""
    c = running(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), value, {"_hi": ("sum", "_c")}, *keys)
    c = c.select(*keys, value, (F.col("_hi") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(c, [*keys, value])


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    return average_ranks(average_ranks(df, a, "_ra", *keys), b, "_rb", *keys).groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("_ra", "_rb")).alias("spearman"))


def mass_accuracy(df: DataFrame, observed: str, expected: str, *keys: str) -> DataFrame:
    ppm = (F.col(observed) - F.col(expected)) / F.col(expected) * 1e6
    g = df.groupBy(*keys).agg(F.avg(ppm).alias("mean_ppm"), F.stddev_pop(ppm).alias("std_ppm"), F.avg(F.abs(ppm)).alias("mae_ppm"), F.count(F.lit(1)).alias("n"))
    return _with_median(g, df, ppm, "median_ppm", *keys)


def deduplicate(df: DataFrame, keys: list[str], means: list[str]) -> DataFrame:
    """Summed intensity, intensity-weighted means (plain ones where the total is not above 0), number of rows."""
    total = F.sum("intensity")
    return df.groupBy(*keys).agg(total.alias("intensity"), *[F.when(total > 0, F.sum(F.col(m) * F.col("intensity")) / F.nullif(total, F.lit(0.0))).otherwise(F.avg(m)).alias(m) for m in means], F.count(F.lit(1)).alias("n_rows"))


def localisation(truth: DataFrame, found: DataFrame, by: str, bare: Callable[[Column], Column], form: str = "sequence", charge: str = "charge") -> DataFrame:
    """``by, truth, identified, localised, accuracy``: of the true modified forms those reported with any placement, and those with the true one.

    ``bare`` gives the residues of a form. ``found`` has ``by`` (a tool); forms are compared per charge, each true form counts once.
    """
    t = truth.select(F.col(form).alias("_f"), F.col(charge).alias("_z")).where("_f is not null and _z is not null").distinct()
    t = t.withColumn("_b", bare(F.col("_f")))
    f = found.select(by, F.col(form).alias("_f"), F.col(charge).alias("_z")).where("_f is not null and _z is not null").distinct().withColumn("_b", bare(F.col("_f")))
    loose = t.join(f.select(by, "_b", "_z").distinct(), ["_b", "_z"]).groupBy(by).agg(F.count(F.lit(1)).alias("identified"))
    exact = t.join(f.select(by, "_f", "_z"), ["_f", "_z"]).groupBy(by).agg(F.count(F.lit(1)).alias("localised"))
    n = t.agg(F.count(F.lit(1))).scalar()
    out = found.select(by).distinct().join(loose, by, "left").join(exact, by, "left").na.fill(0, ["identified", "localised"])
    return out.select(by, n.alias("truth"), "identified", "localised", F.coalesce(F.col("localised") / F.nullif("identified", F.lit(0)), F.lit(0.0)).alias("accuracy"))


def relative_abundance(df: DataFrame, group: str) -> DataFrame:
    """Share of each row in its group's intensity, 1 where the group has none. Joined to the sums: groups stay unordered."""
    t = df.groupBy(group).agg(F.sum("intensity").alias("_t"))
    return df.join(t, group).withColumn("relative_abundance", F.when(F.col("_t") > 0, F.col("intensity") / F.col("_t")).otherwise(1.0)).drop("_t")


def events_from_totals(df: DataFrame, group: str, scale: float) -> DataFrame:
    """Summed intensity to whole events by the median of the sums, at least one."""
    t = df.groupBy(group).agg(F.sum("intensity").alias("total"))
    median = exact_quantiles(t, F.col("total"), (0.5,)).scalar()
    return t.withColumn("_m", median).select(group, "total", F.greatest(F.lit(1), (F.col("total") / F.col("_m") * scale).cast("long")).alias("events"))


def fdp_curve(report: DataFrame, truth: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Per threshold the distinct keys reported up to it, those not true, and their share. Each key counts from its lowest q on,
    so one pass gives all thresholds."""
    r = report.groupBy(*keys).agg(F.min("q").alias("q"))
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    cells = r.join(t, keys, "left").withColumn("step", F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda x: x < F.col("q"))))
    per = cells.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count("_t").alias("true"))
    grid = report.sparkSession.createDataFrame(list(enumerate(thresholds)), "step int, threshold double")
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(per, "step", "left").withColumn("n_reported", F.sum(F.coalesce("n", F.lit(0))).over(w)).withColumn("n_true", F.sum(F.coalesce("true", F.lit(0))).over(w))
    return out.select("threshold", "n_reported", (F.col("n_reported") - F.col("n_true")).alias("n_false"), ((F.col("n_reported") - F.col("n_true")) / F.nullif(F.col("n_reported"), F.lit(0))).alias("fdp"))


def at_target(curve: DataFrame, target: float) -> DataFrame:
    """The curve's point with the largest threshold not beyond the target."""
    return curve.where(F.col("threshold") <= target).agg(F.max_by(F.struct("threshold", "n_reported", "fdp"), "threshold").alias("p")).select("p.*")


def gate(metrics: DataFrame, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """Pass or fail per check: name to (``>=`` or ``<=``, bound); a null metric fails."""
    ok = {k: F.coalesce(F.col(k) >= v if op == ">=" else F.col(k) <= v, F.lit(False)) for k, (op, v) in checks.items()}
    every = F.lit(True)
    for v in ok.values():
        every = every & v
    return metrics.select(*[v.alias(f"{k}_ok") for k, v in ok.items()], every.alias("passed"))


def equal_width(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts per right-closed bin of a width."""
    return df.groupBy((F.ceil(F.col(value) / width) - 1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: list[str], qs: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Quantiles of each column in long form."""
    out = None
    for c in columns:
        v = exact_quantiles(df, F.col(c), qs)
        rows = v.select(F.lit(c).alias("column"), F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"v{i}").cast("double").alias("value")) for i, q in enumerate(qs)])))
        out = rows if out is None else out.unionByName(rows)
    return out
