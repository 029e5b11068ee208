"""Value windows, gap sessions and ordered-series analytics, over Spark's window functions.

Every order is total: ids are appended to break ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_windows(df: DataFrame, length: float, min_peaks: int, min_intensity: float, *keys: str, overlapping: bool = False, value: str = "mz") -> DataFrame:
    """Windows of a value axis with at least so many peaks and so high a maximum: ``keys, window, n, intensity, lo, hi``.

    Overlapping: a second family shifted by half a length has negative keys; its window 0 coincides with window 0 of the
    first family, whose peaks then count twice, as that key means both.
    """
    base = F.floor(F.col(value) / length).cast("long")
    if overlapping:
        shifted = (-F.floor((F.col(value) + length / 2) / length)).cast("long")
        df = df.withColumn("window", F.explode(F.array(base, shifted)))
    else:
        df = df.withColumn("window", base)
    g = df.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"), F.max("intensity").alias("_top"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.where((F.col("n") >= min_peaks) & (F.col("_top") >= min_intensity)).drop("_top")


def dense_windows(df: DataFrame, length: float, resolution: int, *keys: str) -> DataFrame:
    """Each window as a vector of fixed width; of several peaks in a cell the last (by m/z, tof) counts."""
    scale = 10**resolution
    width = int(round(length * scale)) + 1
    w = df.withColumn("window", F.floor(F.col("mz") / length).cast("long")).withColumn("cell", (F.round(F.col("mz") * scale) - F.round(F.col("window") * length * scale)).cast("int"))
    cells = w.groupBy(*keys, "window", "cell").agg(F.max_by("intensity", F.struct("mz", "tof")).alias("v"))
    m = cells.groupBy(*keys, "window").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"))
    return m.select(*keys, "window", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vector"))


def value_blocks(df: DataFrame, value: str, *keys: str, n: int = 256) -> DataFrame:
    """Adds ``_b``, the number of the approximate quantile range that a value lies in, per key; equal values share one."""
    e = F.percentile_approx(value, [i / n for i in range(1, n)], 1000)
    x = df.join(df.groupBy(*keys).agg(e.alias("_e")), list(keys)) if keys else df.withColumn("_e", df.agg(e).scalar())
    return x.withColumn("_b", F.size(F.filter("_e", lambda t: t < F.col(value)))).drop("_e")


def running(df: DataFrame, value: str, results: dict[str, tuple[str, str]], *keys: str, descending: bool = False, n: int = 256) -> DataFrame:
    """Running ``sum`` or ``min`` of columns in the order of a value that is unique per key: ``results`` maps a new name to (kind, column).

    The order is taken within blocks of values, and what the blocks before hold is carried over, so no task orders a whole key.
    """
    kind = {"sum": F.sum, "min": F.min}
    way = F.desc if descending else F.asc
    x = value_blocks(df, value, *keys, n=n)
    per = x.groupBy(*keys, "_b").agg(*[kind[k](c).alias(f"_t_{r}") for r, (k, c) in results.items()])
    before = Window.partitionBy(*keys).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)  # at most n rows a key
    per = per.select(*keys, "_b", *[kind[k](f"_t_{r}").over(before).alias(f"_o_{r}") for r, (k, _) in results.items()])
    inside = Window.partitionBy(*keys, "_b").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(per, [*keys, "_b"])
    for r, (k, c) in results.items():
        here = kind[k](c).over(inside)
        x = x.withColumn(r, here + F.coalesce(f"_o_{r}", F.lit(0)) if k == "sum" else F.least(here, F.col(f"_o_{r}")))
    return x.drop("_b", *[f"_o_{r}" for r in results])


def exact_quantiles(df: DataFrame, value: Column, qs: tuple[float, ...], *keys: str) -> DataFrame:
    """``keys, v0, v1, ...``: interpolated quantiles of the non-null values, as exact as sorting gives them, from counts per value."""
    c = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    x = running(c, "_v", {"_hi": ("sum", "_c")}, *keys)
    x = x.join(c.groupBy(*keys).agg(F.sum("_c").alias("_n")), list(keys)) if keys else x.withColumn("_n", c.agg(F.sum("_c")).scalar())
    out = []
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.col("_n") - 1)
        low, high = F.min(F.when(F.col("_hi") > F.floor(at), F.col("_v"))), F.min(F.when(F.col("_hi") > F.ceil(at), F.col("_v")))
        share = F.first(at - F.floor(at))
        out.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(f"v{i}"))
    return x.groupBy(*keys).agg(*out)


def neighbours(df: DataFrame, on: str, block: Column, *keys: str) -> DataFrame:
    """Adds ``before`` and ``after``, the nearest other places on an axis of unique values; ordered within blocks, whose ends are carried over."""
    x = df.withColumn("_b", block)
    inside, across = Window.partitionBy(*keys, "_b").orderBy(on), Window.partitionBy(*keys).orderBy("_b")
    ends = x.groupBy(*keys, "_b").agg(F.min(on).alias("_lo"), F.max(on).alias("_hi")).select(*keys, "_b", F.lag("_hi").over(across).alias("_p"), F.lead("_lo").over(across).alias("_q"))
    x = x.withColumn("_l", F.lag(on).over(inside)).withColumn("_r", F.lead(on).over(inside)).join(ends, [*keys, "_b"])
    return x.withColumn("before", F.coalesce("_l", "_p")).withColumn("after", F.coalesce("_r", "_q")).drop("_b", "_l", "_r", "_p", "_q")


def gap_sessions(df: DataFrame, value: str, gap: Column | float, ties: list[str], *keys: str, block: float | None = None) -> DataFrame:
    """Adds ``session``: a new one begins where the distance to the preceding value exceeds ``gap``.

    With ``block`` a key's axis is ordered in pieces of that length; the last value and the number of sessions before each piece are carried over.
    """
    order = Window.partitionBy(*keys).orderBy(value, *ties)
    if block is None:
        new = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
        return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(order)).drop("_new")
    x = df.withColumn("_b", F.floor(F.col(value) / block))
    across, inside = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys, "_b").orderBy(value, *ties)
    ends = x.groupBy(*keys, "_b").agg(F.max(value).alias("_e")).select(*keys, "_b", F.lag("_e").over(across).alias("_p"))
    x = x.withColumn("_l", F.lag(value).over(inside)).join(ends, [*keys, "_b"]).withColumn("_new", F.coalesce((F.col(value) - F.coalesce("_l", "_p") > gap).cast("int"), F.lit(0)))
    starts = x.groupBy(*keys, "_b").agg(F.sum("_new").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return x.join(starts, [*keys, "_b"]).withColumn("session", F.sum("_new").over(inside) + F.col("_o")).drop("_b", "_l", "_p", "_new", "_o")


def centroid(df: DataFrame, gap: float, ties: list[str], *keys: str, normalise: bool = False) -> DataFrame:
    """Gap sessions to centroids: intensity-weighted m/z and summed intensity (as a share of the keys' sum if normalised)."""
    g = gap_sessions(df, "mz", gap, ties, *keys).groupBy(*keys, "session").agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("mz"), F.sum("intensity").alias("intensity"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("intensity", F.col("intensity") / F.sum("intensity").over(Window.partitionBy(*keys))) if normalise else g


def smooth(df: DataFrame, window: int, *keys: str, axis: str = "tof") -> DataFrame:
    """Adds the intensities of all peaks within ± window on an integer axis."""
    near = Window.partitionBy(*keys).orderBy(axis).rangeBetween(-window, window)
    return df.withColumn("smoothed", F.sum("intensity").over(near))


def local_maxima(df: DataFrame, window: int, *keys: str, axis: str = "tof") -> DataFrame:
    """Peaks greater than all before and not smaller than any after within the window; of equal neighbours the earlier stays."""
    order = Window.partitionBy(*keys).orderBy(axis)
    before, after = F.max("intensity").over(order.rangeBetween(-window, -1)), F.max("intensity").over(order.rangeBetween(1, window))
    return df.where((F.lit(True))).withColumn("_b", before).withColumn("_a", after).where((F.col("intensity") > F.coalesce("_b", F.lit(-math.inf))) & (F.col("intensity") >= F.coalesce("_a", F.lit(-math.inf)))).drop("_a", "_b")


def islands(df: DataFrame, lo: str, hi: str, *keys: str, touch: int = 1) -> DataFrame:
    """Union of inclusive integer ranges that overlap or touch within ``touch``: ``keys, lo, hi``."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.select(*keys, lo, hi).withColumn("_new", F.when(F.col(lo) > reach + touch, 1).otherwise(0))
    return flagged.withColumn("_i", F.sum("_new").over(order)).groupBy(*keys, "_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_i")


def sliding_plan(frames: DataFrame, length: int, hop: int, *keys: str) -> DataFrame:
    """Sliding windows over frames in order of time: ``keys, plan, frame_id, at``; the tail is cut and nothing begins after the
    window that reaches the end."""
    order = Window.partitionBy(*keys).orderBy("time", "frame_id")
    r = frames.withColumn("at", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - length) / hop))
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("at") - length + 1) / hop)), F.least(F.floor(F.col("at") / hop), last)
    return r.where(lo <= hi).withColumn("plan", F.explode(F.sequence(lo, hi))).drop("_n")


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> list[tuple[int, float]]:
    radius = math.ceil(truncate * sigma)
    return [(d, math.exp(-0.5 * (d / sigma) ** 2)) for d in range(-radius, radius + 1)]


def gaussian_smooth(df: DataFrame, axis: str, sigma: float, *keys: str, truncate: float = 3.0) -> DataFrame:
    """Dense series smoothed by a truncated Gaussian, renormalised where the kernel hangs over the edge.

    ``keys, axis, intensity`` must be complete along the axis; each row looks at 2 ceil(truncate sigma) neighbours.
    """
    order = Window.partitionBy(*keys).orderBy(axis)
    num, den = F.lit(0.0), F.lit(0.0)
    for d, w in gaussian_kernel(sigma, truncate):
        x = F.lag("intensity", -d).over(order) if d else F.col("intensity")
        num, den = num + F.coalesce(x * w, F.lit(0.0)), den + F.when(x.isNotNull(), w).otherwise(0.0)
    return df.withColumn("smoothed", num / den)


def sparse_blur(df: DataFrame, axis: str, sigma: float, *keys: str, truncate: float = 3.0) -> DataFrame:
    """Each sparse bin spread over its neighbours by a normalised kernel (bounded: 2 ceil(truncate sigma) + 1 rows a bin)."""
    kernel = gaussian_kernel(sigma, truncate)
    total = sum(w for _, w in kernel)
    spread = F.explode(F.array(*[F.struct((F.col(axis) + d).alias(axis), (F.col("intensity") * (w / total)).alias("intensity")) for d, w in kernel])).alias("x")
    return df.select(*keys, spread).select(*keys, "x.*").groupBy(*keys, axis).agg(F.sum("intensity").alias("intensity"))


def trapezoid(df: DataFrame, x: str, y: str, lo: float, hi: float, *keys: str) -> DataFrame:
    """Integral of a piecewise linear series between two bounds that may fall inside segments."""
    order = Window.partitionBy(*keys).orderBy(x)
    s = df.withColumn("_x1", F.lead(x).over(order)).withColumn("_y1", F.lead(y).over(order)).where(F.col("_x1") > F.col(x))
    a, b = F.greatest(F.col(x), F.lit(lo)), F.least(F.col("_x1"), F.lit(hi))
    at = lambda t: F.col(y) + (F.col("_y1") - F.col(y)) * (t - F.col(x)) / (F.col("_x1") - F.col(x))
    return s.withColumn("_a", a).withColumn("_b", b).where("_b > _a").groupBy(*keys).agg(F.sum((at(F.col("_a")) + at(F.col("_b"))) / 2 * (F.col("_b") - F.col("_a"))).alias("area"))


def parabolic_offset(y0: Column, y1: Column, y2: Column) -> Column:
    """Sub-sample place of a maximum, 0 on a flat top."""
    d = y0 - 2 * y1 + y2
    return F.when(F.abs(d) > 1e-12, 0.5 * (y0 - y2) / d).otherwise(0.0)


def apexes(df: DataFrame, axis: str, *keys: str) -> DataFrame:
    """Strict-left local maxima of a dense series with their parabolic sub-sample place."""
    order = Window.partitionBy(*keys).orderBy(axis)
    s = df.withColumn("_l", F.lag("intensity").over(order)).withColumn("_r", F.lead("intensity").over(order)).where("intensity > _l and intensity >= _r")
    return s.withColumn("apex", F.col(axis) + parabolic_offset(F.col("_l"), F.col("intensity"), F.col("_r"))).drop("_l", "_r")


def interpolate_at(df: DataFrame, value: str, at: float, *keys: str, order: list[str] = ["value"]) -> DataFrame:  # noqa: B006
    """Value at a fractional zero-based place of an ordered series, clamped to its ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    pos = F.least(F.greatest(F.lit(at), F.lit(0.0)), (F.col("_n") - 1).cast("double"))
    weight = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("_i") - pos))
    return r.groupBy(*keys).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))


def chain_merge(df: DataFrame, order: list[str], same: Column, *keys: str) -> DataFrame:
    """Adds ``chain``: neighbours in order for which ``same`` (over lag columns made by the caller) holds share one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce((~same).cast("int"), F.lit(1))).withColumn("chain", F.sum("_new").over(w)).drop("_new")


def stride_thin(df: DataFrame, cap: int, order: list[str], *keys: str) -> DataFrame:
    """Every ceil(total / cap)-th row of each group in order."""
    r = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return r.where(F.col("_i") % F.ceil(F.col("_n") / cap) == 0).drop("_i", "_n")


def moment_fit(df: DataFrame, axis: str, *keys: str, base: float = 0.1) -> DataFrame:
    """Gaussian by moments over a dense series: a baseline (a share of the maximum) is cut off, then weighted mean and
    deviation, height by least squares on the shape, and R² of the fit."""
    top = df.groupBy(*keys).agg((F.max("intensity") * base).alias("_b"))
    s = df.join(top, list(keys)).withColumn("_w", F.greatest(F.col("intensity") - F.col("_b"), F.lit(0.0)))
    m = s.groupBy(*keys).agg(F.sum("_w").alias("_s"), (F.sum(F.col("_w") * F.col(axis)) / F.sum("_w")).alias("mu"), (F.sum(F.col("_w") * F.col(axis) * F.col(axis)) / F.sum("_w")).alias("_q")).where("_s > 0")
    m = m.withColumn("sigma", F.sqrt(F.greatest(F.col("_q") - F.col("mu") * F.col("mu"), F.lit(1e-12)))).drop("_s", "_q")
    g = F.exp(-0.5 * F.pow((F.col(axis) - F.col("mu")) / F.col("sigma"), F.lit(2.0)))
    f = df.join(m, list(keys)).withColumn("_g", g).groupBy(*keys).agg(F.first("mu").alias("mu"), F.first("sigma").alias("sigma"), F.regr_slope("intensity", "_g").alias("height"), F.regr_intercept("intensity", "_g").alias("baseline"), F.regr_r2("intensity", "_g").alias("r2"))
    return f
