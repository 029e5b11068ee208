"""Quantise-and-sum aggregations, moments, marginals, rank statistics and noise estimates.

All are hash aggregations with partial results; statistics over sorted values are taken from value counts, so a group's
values are never gathered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.windows import running


def mz_key(resolution: int, mz: str = "mz") -> Column:
    """Integer bin of an m/z at so many decimals, halves away from zero."""
    return F.round(F.col(mz) * F.lit(float(10**resolution))).cast("long")


def to_resolution(df: DataFrame, resolution: int, *keys: str) -> DataFrame:
    """``keys, mz, intensity`` summed per bin."""
    g = df.groupBy(*keys, mz_key(resolution).alias("_k")).agg(F.sum("intensity").alias("intensity"))
    return g.select(*keys, (F.col("_k") / F.lit(float(10**resolution))).alias("mz"), "intensity")


def indexed_to_resolution(df: DataFrame, resolution: int, *keys: str) -> DataFrame:
    """As above with the mean detector index of each bin."""
    g = df.groupBy(*keys, mz_key(resolution).alias("_k")).agg(F.sum("intensity").alias("intensity"), F.avg("tof").alias("tof"))
    return g.select(*keys, (F.col("_k") / F.lit(float(10**resolution))).alias("mz"), "intensity", "tof")


def frame_to_resolution(df: DataFrame, resolution: int, *keys: str) -> DataFrame:
    """Per scan and bin: summed intensity, mean tof cut to an integer, mean mobility."""
    g = df.groupBy(*keys, "scan", mz_key(resolution).alias("_k")).agg(F.sum("intensity").alias("intensity"), F.avg("tof").cast("int").alias("tof"), F.avg("mobility").alias("mobility"))
    return g.select(*keys, "scan", (F.col("_k") / F.lit(float(10**resolution))).alias("mz"), "intensity", "tof", "mobility")


def union_sum(spectra: list[DataFrame], *keys: str, decimals: int = 6) -> DataFrame:
    """Sum of many spectra; peaks equal at six decimals are one."""
    both = spectra[0].select(*keys, "mz", "intensity")
    for s in spectra[1:]:
        both = both.unionByName(s.select(*keys, "mz", "intensity"))
    return to_resolution(both, decimals, *keys)


def by_scan(df: DataFrame) -> DataFrame:
    """Frames to scan spectra: sorted peaks and the mobility of each scan."""
    return df.groupBy("frame_id", "scan").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"), F.min("mobility").alias("mobility"))


def rebuild_frame(df: DataFrame) -> DataFrame:
    """Frame from scan spectra: key (scan, m/z at six decimals), summed intensity, last tof, first mobility (in order of mz, tof)."""
    order = F.struct("mz", "tof")
    return df.groupBy("frame_id", "scan", mz_key(6).alias("mz_key")).agg(F.sum("intensity").alias("intensity"), F.max_by("tof", order).alias("tof"), F.min_by("mobility", order).alias("mobility"))


def flatten_by_tof(df: DataFrame, *keys: str) -> DataFrame:
    """Per detector index: unweighted mean m/z and summed intensity."""
    return df.groupBy(*keys, "tof").agg(F.avg("mz").alias("mz"), F.sum("intensity").alias("intensity"))


def fold_scans(df: DataFrame, width: int, mean: str = "pairwise") -> DataFrame:
    """Scans folded by integer division; peaks summed at six decimals.

    ``pairwise`` averages mobility as repeated addition does (each further scan weighs as much as all before it);
    ``true`` takes the mean of the scans. Only scan-level rows are gathered for the ordered average.
    """
    group = F.floor(F.col("scan") / width).cast("int")
    peaks = to_resolution(df.withColumn("fold", group), 6, "frame_id", "fold")
    scans = df.groupBy("frame_id", group.alias("fold"), "scan").agg(F.min("mobility").alias("m"))
    if mean == "true":
        mob = scans.groupBy("frame_id", "fold").agg(F.avg("m").alias("mobility"))
    else:
        ordered = scans.groupBy("frame_id", "fold").agg(F.array_sort(F.collect_list(F.struct("scan", "m"))).alias("s"))
        mob = ordered.select("frame_id", "fold", F.aggregate(F.slice("s", 2, width), F.get("s", F.lit(0))["m"], lambda a, x: (a + x["m"]) / 2).alias("mobility"))
    return peaks.join(mob, ["frame_id", "fold"])


def scan_apex(df: DataFrame, *keys: str) -> DataFrame:
    """Mobility of the scan with most intensity; the later scan wins a tie."""
    s = df.groupBy(*keys, "scan").agg(F.sum("intensity").alias("total"), F.min("mobility").alias("mobility"))
    return s.groupBy(*keys).agg(F.max_by("mobility", F.struct("total", "scan")).alias("mobility"), F.max("total").alias("total"))


def weighted_moments(df: DataFrame, x: str, w: str, *keys: str) -> DataFrame:
    """Weighted mean, variance, skewness and total in one pass over power sums about the unweighted group mean's scale."""
    s = df.groupBy(*keys).agg(F.sum(w).alias("w"), *[F.sum(F.col(w) * F.pow(F.col(x), F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3)])
    m = F.col("s1") / F.col("w")
    var = F.greatest(F.col("s2") / F.col("w") - m * m, F.lit(0.0))
    third = F.col("s3") / F.col("w") - 3 * m * F.col("s2") / F.col("w") + 2 * m * m * m
    return s.where("w > 0").select(*keys, F.col("w").alias("total"), m.alias("mean"), var.alias("variance"), F.when(var > 1e-12, third / F.pow(var, F.lit(1.5))).otherwise(0.0).alias("skewness"))


def plane(df: DataFrame, chunk: int | None, n_chunks: int) -> DataFrame:
    """Detector bands: population mean and deviation of m/z and intensity per (band, frame, scan). Without ``chunk`` the bands divide
    the data's whole axis and every peak falls into one; with it, indices beyond the bands drop."""
    width = F.lit(chunk) if chunk else df.agg(F.ceil((F.max("tof") + 1) / F.lit(n_chunks))).scalar()
    b = df.withColumn("band", F.floor(F.col("tof") / width).cast("int")).where(F.col("band") < n_chunks)
    stats = b.groupBy("band").agg(F.avg("mz").alias("mz_mean"), F.stddev_pop("mz").alias("mz_std"))
    cells = b.groupBy("band", "frame_id", "scan").agg(F.sum("intensity").alias("intensity"))
    return cells.join(F.broadcast(stats), "band")  # one row per band, n_chunks at most


def inverted_index(df: DataFrame, resolution: int, frames_per_row: int | None = None) -> DataFrame:
    """Per m/z bin the peaks that fall into it; with ``frames_per_row`` a row a bin and block of frames, so that no list grows with the run."""
    block = [] if frames_per_row is None else [F.floor(F.col("frame_id") / frames_per_row).alias("block")]
    return df.groupBy(mz_key(resolution).alias("bin"), *block).agg(F.array_sort(F.collect_list(F.struct("frame_id", "scan", "intensity"))).alias("postings"))


def tof_axis(df: DataFrame, step: int) -> DataFrame:
    """Step-aligned detector axis of the data: ``lo, hi, n_bins``."""
    lo, hi = F.floor(F.min("tof") / F.lit(step)) * step, (F.floor(F.max("tof") / F.lit(step)) + 1) * step
    return df.agg(lo.alias("lo"), hi.alias("hi")).withColumn("n_bins", ((F.col("hi") - F.col("lo")) / step).cast("long"))


def tof_bins(df: DataFrame, step: int, *keys: str) -> DataFrame:
    """Per bin of the aligned axis: peaks, summed intensity and the offset of its first peak within the keys' rows."""
    g = df.groupBy(*keys, F.floor(F.col("tof") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("center", (F.col("bin") + 0.5) * step)


def marginal(df: DataFrame, axis: str, lo: int, hi: int) -> DataFrame:
    """Sums along an integer axis, zero where nothing is; the axis has a bounded, given range."""
    sums = df.where(F.col(axis).between(lo, hi)).groupBy(axis).agg(F.sum("intensity").alias("intensity"))
    full = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(axis))
    return full.join(sums, axis, "left").select(axis, F.coalesce("intensity", F.lit(0.0)).alias("intensity"))


def grid(df: DataFrame, step: int) -> DataFrame:
    """Detector by frame sums in long form."""
    return df.groupBy(F.floor(F.col("tof") / step).alias("bin"), "frame_id").agg(F.sum("intensity").alias("intensity"))


def rank_value(df: DataFrame, value: str, at: Column, *keys: str) -> DataFrame:
    """``keys, value`` at the zero-based rank ``at`` (an expression over ``n``) of the sorted non-null, non-NaN values.

    Works on value counts: the window runs over distinct values, so repeats cost nothing.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    if not keys:
        run = running(counts, "v", {"hi": ("sum", "c")})
        run = run.withColumn("n", counts.agg(F.sum("c")).scalar())
    else:
        w = Window.partitionBy(*keys)
        run = counts.withColumn("hi", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return run.where(F.col("hi") > at).groupBy(*keys).agg(F.min("v").alias(value)).where(F.col(value).isNotNull())


def nearest_rank_quantile(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """Value at rank round(q (n - 1)), halves up."""
    return rank_value(df, value, F.floor(F.col("n") * q - q + 0.5), *keys)


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return rank_value(df, value, F.floor(F.col("n") / 2), *keys)


def mad_noise(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """1.4826 times the upper median of distances from the upper median; 0 for fewer than three values."""
    med = upper_median(df, value, *keys).withColumnRenamed(value, "_m")
    d = df.join(med, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return upper_median(d, "_d", *keys).join(n, list(keys)).select(*keys, F.when(F.col("_n") < 3, 0.0).otherwise(F.col("_d") * 1.4826).alias("noise"))


def difference_noise(df: DataFrame, value: str, order: list[str], *keys: str) -> DataFrame:
    """Upper median of neighbours' absolute differences over 1.4826."""
    d = df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))))
    return upper_median(d, "_d", *keys).select(*keys, (F.col("_d") / 1.4826).alias("noise"))


def threshold(noise: Column, fixed: float | None = None, factor: float = 3.0) -> Column:
    """Fixed thresholds never go below three times the noise; adaptive ones are 1 where there is no noise."""
    if fixed is not None:
        return F.greatest(F.lit(fixed), 3.0 * noise)
    return F.when(noise > 0, factor * noise).otherwise(1.0)


def mode_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Most common positive value, the smaller on ties."""
    c = df.where(F.col(column) > 0).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.max_by(column, F.struct(F.col("n"), (-F.col(column)).alias("v"))).alias(column))


def cycle_length(frames: DataFrame, ms_type: int = 0) -> DataFrame:
    """Mean spacing of survey frames: their span over their number less one, which needs no ordering."""
    return frames.where(F.col("ms_type") == ms_type).agg(((F.max("time") - F.min("time")) / (F.count(F.lit(1)) - 1)).alias("cycle"))
