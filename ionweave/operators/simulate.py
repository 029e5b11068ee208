"""Simulation of runs: elution profiles over frames and events, sampling of peptides and noise, efficiencies and experiment tables.

Every random choice follows from hashes of keys and a seed, so lost tasks give the same rows again and no plan changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.functions import physics as Y
from ionweave.operators import joins as J
from ionweave.operators.generators import gaussian, uniform
from ionweave.session import materialise


def _erfc(x: np.ndarray) -> np.ndarray:
    t = 1.0 / (1.0 + 0.5 * np.abs(x))
    tau = t * np.exp(-x * x + np.polyval(Y.ERF[::-1], t))
    return np.where(x >= 0, tau, 2.0 - tau)


def emg_mass(lo: float, hi: float, mu: float, sigma: float, lam: float, steps: int) -> float:
    """Left Riemann sum of the density with ``steps`` terms."""
    h = (hi - lo) / steps
    x = lo + h * np.arange(steps)
    e = lam / 2 * np.exp(lam / 2 * (2 * mu + lam * sigma * sigma - 2 * x)) * _erfc((mu + lam * sigma * sigma - x) / (math.sqrt(2) * sigma))
    return float(e.sum() * h)


@lru_cache(maxsize=100_000)
def emg_support(mu: float, sigma: float, lam: float, target: float, step: float, steps: int = 1000, below: float = 20.0, above: float = 60.0) -> tuple[float, float]:
    """Borders on a grid of ``step`` from ``mu - below sigma - 2`` to ``mu + above sigma``: the first with ``target`` of the mass before it, then the last from
    which ``target`` lies before that. Both by bisection, with masses of ``steps`` terms."""
    start, n = mu - below * sigma - 2.0, round((below + above) * sigma / step + 2.0 / step)
    at = lambda i: start + i * step
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if emg_mass(at(0), at(mid), mu, sigma, lam, steps) < target else (lo, mid)
    upper, lo, hi = lo, 0, lo
    while lo < hi:
        mid = hi - (hi - lo) // 2
        lo, hi = (lo, mid - 1) if emg_mass(at(mid), at(upper), mu, sigma, lam, steps) < target else (mid, hi)
    return at(hi), at(upper)


def support(target: float, step: float, steps: int = 1000):
    """``emg_support`` over columns (mu, sigma, lambda), equal parameters computed once a worker: ``struct<lo, hi>``."""

    @F.pandas_udf("lo double, hi double")
    def run(mu: pd.Series, sigma: pd.Series, lam: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([emg_support(*p, target, step, steps) for p in zip(mu, sigma, lam)], columns=["lo", "hi"])

    return run


def frame_occurrence(peptides: DataFrame, frames: DataFrame, target: float = 0.95, step: float = 0.1, steps: int = 1000, block: float = 256.0) -> DataFrame:
    """``peptide_id, mu, sigma, lam, first, last``: the frames nearest to the borders of each elution profile, the earlier on ties.

    ``peptides``: peptide_id, mu, sigma, lam; ``frames``: frame_id, time with ids in order of time.
    """
    p = peptides.select("peptide_id", "mu", "sigma", "lam", support(target, step, steps)("mu", "sigma", "lam").alias("b"))
    f = frames.select("frame_id", F.col("time").cast("double").alias("time"))
    ends = p.select("peptide_id", "mu", "sigma", "lam", F.posexplode(F.array("b.lo", "b.hi")).alias("end", "time"))
    near = J.nearest(ends, f, "time", [], ["frame_id"], F.floor(F.col("time") / block))
    return near.groupBy("peptide_id", "mu", "sigma", "lam").agg(F.min("near_frame_id").alias("first"), F.max("near_frame_id").alias("last"))


def frame_abundance(occurrence: DataFrame, frames: DataFrame, cycle: float, steps: int = 1000, least: float = 0.0) -> DataFrame:
    """``peptide_id, frame_id, abundance``: mass in (time - cycle, time] of each frame from ``first`` to ``last`` that the run has."""
    x = occurrence.withColumn("frame_id", F.explode(F.sequence("first", "last"))).join(frames.select("frame_id", F.col("time").cast("double").alias("time")), "frame_id")
    a = Y.emg_mass(F.col("time") - cycle, F.col("time"), F.col("mu"), F.col("sigma"), F.col("lam"), steps)
    return x.select("peptide_id", "frame_id", a.alias("abundance")).where(F.col("abundance") > least)


def event_abundance(peptides: DataFrame, events: DataFrame, target: float = 0.9999, step: float = 0.1, steps: int = 1000, width: float = 64.0) -> DataFrame:
    """``peptide_id, event, abundance``: mass within each event's own interval, of the events that touch the profile's borders and hold any mass.

    ``events``: event, start, end in seconds. They meet through time buckets.
    """
    p = peptides.select("peptide_id", "mu", "sigma", "lam", support(target, step, steps)("mu", "sigma", "lam").alias("b")).select("*", F.col("b.lo").alias("_lo"), F.col("b.hi").alias("_hi"))
    hit = J.bucketed_interval_join(p.drop("b"), events.select("event", F.col("start").alias("_a"), F.col("end").alias("_b")), ("_lo", "_hi"), ("_a", "_b"), width)
    return hit.select("peptide_id", "event", Y.emg_mass(F.col("_a"), F.col("_b"), F.col("mu"), F.col("sigma"), F.col("lam"), steps).alias("abundance")).where("abundance > 0")


def gamma(shape: int, seed: int, *keys: str) -> Column:
    """Gamma of a whole shape as a sum of exponentials."""
    total = F.lit(0.0)
    for i in range(shape):
        total = total - F.ln(1 - uniform(seed + i, *keys))
    return total


def scaled_beta(lo: float, hi: float, a: int, b: int, seed: int, *keys: str) -> Column:
    """Beta of whole parameters, moved to [lo, hi]."""
    x, y = gamma(a, seed, *keys), gamma(b, seed + 1000, *keys)
    return lo + (hi - lo) * x / (x + y)


def erfcx_inverse(y: Column, rounds: int = 10) -> Column:
    """Inverse of exp(x²) erfc(x) for positive y, by Newton's steps."""
    start = F.when(y < 2, 1.0 / (y * math.sqrt(math.pi))).otherwise(-F.sqrt(F.ln(F.greatest(y, F.lit(2.0)) / 2)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda x, _: x - (Y.erfcx(x) - y) / (2 * x * Y.erfcx(x) - 2 / math.sqrt(math.pi)))


def mu_of_mode(mode: Column, sigma: Column, lam: Column) -> Column:
    """Location of the profile whose maximum lies at ``mode``."""
    return mode + math.sqrt(2) * sigma * erfcx_inverse(math.sqrt(2 / math.pi) / (lam * sigma)) - sigma * sigma * lam


def series_intensity(intensity: Column, mode: Column, events: Column, factor: Column, adjusted: Column) -> Column:
    """Intensities of a fragment series under partial isolation: by events alone (``none``), also by the precursor's transmitted share
    (``precursor``), or from isotopes adjusted fragment by fragment (``fragment``; without them as ``none``)."""
    plain = F.transform(intensity, lambda x: x * events)
    return F.when(mode == "precursor", F.transform(intensity, lambda x: x * events * factor)).when((mode == "fragment") & (F.size(F.coalesce(adjusted, F.array())) > 0), F.transform(adjusted, lambda x: x * events)).otherwise(plain)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``number``, from 0, in the order of a hash; counts of at most 4096 blocks give what lies before each, so no task orders the table."""
    b = df.withColumn("_h", F.xxhash64(*order)).withColumn("_block", F.shiftright("_h", 52))
    counts = b.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("_block").orderBy("_h", *order)) - 1
    return b.join(F.broadcast(before), "_block").withColumn("number", F.col("_before") + at).drop("_h", "_block", "_before")


def sample_peptides(peptides: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """Two stages: ``total`` draws with replacement give each protein a count in proportion to its peptides, then that many of them are taken without
    replacement (all, if the count is higher). ``peptides``: protein_id, peptide_id."""
    slots = numbered(peptides.select("protein_id", "peptide_id"), "peptide_id", "protein_id")
    n = slots.count()
    draws = slots.sparkSession.range(total).select(F.least(F.floor(uniform(seed, "id") * max(n, 1)), F.lit(max(n - 1, 0))).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("_d"))
    count = slots.join(draws, "number").groupBy("protein_id").agg(F.sum("_d").alias("_count"))
    order = Window.partitionBy("protein_id").orderBy(F.xxhash64("peptide_id", F.lit(seed + 1)), "peptide_id")
    return slots.join(count, "protein_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_count")).select("protein_id", "peptide_id")


def log_normal_efficiency(mean: float = -2.0, std: float = 0.6, lo: float = 1e-4, hi: float = 1.0, seed: int = 0, keys: Sequence[str] = ("row_id",), tries: int = 16) -> Column:
    """Ten to the power of a normal, drawn again while outside [lo, hi]; after ``tries`` draws the nearer border."""
    draws = [F.pow(F.lit(10.0), mean + std * gaussian(seed + 2 * i, *keys)) for i in range(tries)]
    return F.coalesce(*[F.when((d >= lo) & (d <= hi), d) for d in draws], F.greatest(F.lit(lo), F.least(F.lit(hi), draws[-1])))


def with_noise(df: DataFrame, column: str, std: float, seed: int, *keys: str, log: bool = False) -> DataFrame:
    """Normal noise on a column, in log1p space with ``log``, clipped to [0, the column's maximum]."""
    top = df.agg(F.max(column)).scalar()
    e = std * gaussian(seed, *keys)
    x = F.expm1(F.log1p(F.col(column)) + e) if log else F.col(column) + e
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.lit(0.0), F.least(x, top))))


def dilute(df: DataFrame, factors: DataFrame, by: str, column: str) -> DataFrame:
    """A column times the factor of its group; groups without one stay."""
    return df.join(factors.select(by, F.col("factor").alias("_f")), by, "left").withColumn(column, F.col(column) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def rescale(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """A column moved from its own range to [lo, hi]; a range of no width gives null."""
    a, b = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return df.withColumn(column, lo + (F.col(column) - a) * (hi - lo) / F.nullif(b - a, F.lit(0.0)))


def sample_noise(targets: DataFrame, sources: DataFrame, peaks: DataFrame, n: int, keep: float, seed: int = 0, *, by: str, decimals: int = 6) -> DataFrame:
    """Noise of a reference run for target frames: ``frame_id, scan, k, intensity``.

    Each target (frame_id, ``by``) takes ``n`` draws among the source frames (``source_id``, ``by``) of its group that have peaks, each peak of a drawn frame is kept with probability
    ``keep``, and peaks of one scan and m/z are summed. Draws are numbers of frames within the group, so targets meet sources by an equi-join.
    """
    full = sources.join(peaks.select(F.col("frame_id").alias("source_id")).distinct(), "source_id", "left_semi")
    ranked = full.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy("source_id")) - 1)
    size = full.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    draws = targets.select("frame_id", by).join(size, by).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_at", F.floor(uniform(seed, "frame_id", "draw") * F.col("_n")))
    hit = draws.join(ranked, [by, "_at"]).select(F.col("frame_id").alias("_t"), "draw", "source_id").join(peaks.withColumnRenamed("frame_id", "source_id"), "source_id")
    kept = hit.where(uniform(seed + 1, "_t", "draw", "source_id", "scan", "tof") < keep)
    return kept.groupBy(F.col("_t").alias("frame_id"), "scan", F.round(F.col("mz") * 10**decimals).cast("long").alias("k")).agg(F.sum("intensity").alias("intensity"))


def sample_pasef_noise(targets: DataFrame, windows: DataFrame, peaks: DataFrame, n: int, keep: float, tolerance: int, seed: int = 0, decimals: int = 6, width: float = 1.0, spare: int = 64) -> DataFrame:
    """Noise for DDA targets (frame_id, scan_center): ``n`` reference windows (window_id, source_id, scan_begin, scan_end) whose centre lies within ``tolerance`` scans, the first by a hash,
    give the peaks of their scans; each is kept with probability ``keep``, then summed.

    Of a target's windows only hashes below a border are ordered, which about ``8 n + spare`` of them reach; a target with too few below it has all of its windows ordered.
    """
    w = windows.withColumn("_c", (F.col("scan_begin") + F.col("scan_end")) / 2)
    spans = targets.select("frame_id", (F.col("scan_center") - tolerance).alias("_lo"), (F.col("scan_center") + tolerance).alias("_hi"))
    meet = lambda w, t: J.point_in_interval(w, t, "_c", ("_lo", "_hi"), width)
    h = F.xxhash64("frame_id", "window_id", F.lit(seed))

    def first(near: DataFrame) -> DataFrame:
        order = Window.partitionBy("frame_id").orderBy("_h", "window_id")
        return near.withColumn("_h", h).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(F.col("frame_id").alias("_t"), "window_id", "source_id", "scan_begin", "scan_end")

    pool = meet(w.groupBy("_c").agg(F.count(F.lit(1)).alias("_w")), spans).groupBy("frame_id").agg(F.sum("_w").alias("_m"))
    border = F.when(F.col("_m") > 8 * n + spare, (2.0**64 * (8 * n + spare) / F.col("_m") - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))
    some = materialise(first(meet(w, spans.join(pool, "frame_id").withColumn("_border", border).drop("_m")).where(h <= F.col("_border"))), "drawn")
    short = pool.join(some.groupBy(F.col("_t").alias("frame_id")).agg(F.count(F.lit(1)).alias("_n")), "frame_id", "left").where(F.coalesce("_n", F.lit(0)) < F.least("_m", F.lit(n))).select("frame_id")
    drawn = some.join(short, some["_t"] == short["frame_id"], "left_anti").unionByName(first(meet(w, spans.join(short, "frame_id"))))
    x = peaks.withColumnRenamed("frame_id", "source_id").join(drawn.select("source_id").distinct(), "source_id", "left_semi").withColumn("_s1", F.col("scan"))
    hit = J.bucketed_interval_join(x, drawn, ("scan", "_s1"), ("scan_begin", "scan_end"), 32.0, ["source_id"])
    kept = hit.where(uniform(seed + 1, "_t", "window_id", "scan", "tof") < keep)
    return kept.groupBy(F.col("_t").alias("frame_id"), "scan", F.round(F.col("mz") * 10**decimals).cast("long").alias("k")).agg(F.sum("intensity").alias("intensity"))


def schema_version(spark: SparkSession, version: int) -> DataFrame:
    return spark.createDataFrame([("schema_version", version)], "key string, value long")


def experiment_conditions(spark: SparkSession, **conditions) -> DataFrame:
    """One row of conditions with ``condition_id`` as its key."""
    return spark.createDataFrame(pd.DataFrame([{"condition_id": 1} | conditions]))


def with_condition(df: DataFrame) -> DataFrame:
    """Adds a reference to the conditions, null for the run's only one, unless it is there."""
    return df if "condition_id" in df.columns else df.withColumn("condition_id", F.lit(None).cast("long"))


def stable_key(*parts: Column) -> Column:
    """128 bits as hex digits from the texts of the parts, each after its length in bytes (8, little-endian), so that no two lists of parts look alike."""
    framed = []
    for p in parts:
        text = F.encode(p.cast("string"), "UTF-8")
        n = F.octet_length(text).cast("long")
        framed += [F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(8)]), text]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, 32)
