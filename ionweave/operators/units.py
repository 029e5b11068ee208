"""Quantities recorded in different units: the unit of every value, and the values in one unit.

A unit written in the value's text counts first, then the one stated by the source's latest note about it. The bare
numbers left are taken source by source: the history of log values is segmented by an exact penalised changepoint search
(PELT), and each segment's level, held against the source's level in seconds, gives the unit by the nearest known
factor. The level in seconds comes from values whose unit a text or note gives, and without any from the middle of the
source's range. An exact check follows: the segment's unit stands if it puts the value into the source's possible range;
where it does not, the other units are tried, and the only one that does replaces it.

Scale: histories are unbounded, so they are first reduced to at most ``MAX_BINS`` time bins with sufficient statistics
(count, sum, sum of squares); the search is exact over these. The width of a bin follows from the span of time, not from
the number of values; changes within one bin (a 2048th of the span) are told apart by the check of each value alone. One
history is at most ``MAX_BINS`` rows in a task. Segments are broadcast up to ``MAX_SEGMENTS``, else joined by shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.quantities import FACTORS, seconds_of
from ionweave.session import materialise

MAX_BINS = 2048
#: More sources than this and segments are joined without a broadcast.
MAX_SOURCES = 10_000
#: More segments than this are joined without a broadcast.
MAX_SEGMENTS = 200_000
PENALTY = 3.0


def pelt(n: np.ndarray, s: np.ndarray, q: np.ndarray, beta: float) -> list[int]:
    """Starts of the segments that minimise squared error plus ``beta`` a segment; exact, with pruning.

    ``n``, ``s``, ``q`` are counts, sums and sums of squares of consecutive bins.
    """
    cn, cs, cq = (np.concatenate(([0.0], np.cumsum(x, dtype=float))) for x in (n, s, q))
    best, last = np.full(len(cn), np.inf), np.zeros(len(cn), dtype=int)
    best[0], live = -beta, np.array([0])
    for t in range(1, len(cn)):
        m = cn[t] - cn[live]
        cost = best[live] + np.maximum((cq[t] - cq[live]) - (cs[t] - cs[live]) ** 2 / np.maximum(m, 1e-300), 0.0)
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k] + beta, live[k]
        live = np.append(live[cost <= best[t]], t)
    out, t = [], len(cn) - 1
    while t > 0:
        out.append(int(last[t]))
        t = int(last[t])
    return out[::-1]


def noise(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
    """Variance of the values about a level, robust against level shifts: the median of the bins' own variances,
    or from differences of neighbouring means where bins hold single values."""
    many = n >= 2
    if many.sum() >= 5:
        v = (q[many] - s[many] ** 2 / n[many]) / (n[many] - 1)
    else:
        m = s / n
        v = np.diff(m) ** 2 / (1 / n[1:] + 1 / n[:-1]) if len(m) > 1 else np.array([0.25])
    return float(max(np.median(np.maximum(v, 0.0)), 1e-3))


SEGMENTS = "history string, source_id long, at0 long, width long, from_bin long, to_bin long, level double, n_values long, unit_segment string"


def _segmenter(search: Callable[..., list[int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One history's bins to its segments, cut by ``search``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        n, s, q = (pdf[c].to_numpy(dtype=float) for c in ("n", "s", "q"))
        starts = search(n, s, q, PENALTY * noise(n, s, q) * math.log(max(n.sum(), 3.0)))
        ends = [*starts[1:], len(n)]
        levels = [s[a:b].sum() / n[a:b].sum() for a, b in zip(starts, ends)]
        centre = pdf["centre"].iloc[0]
        own = pdf["own"].iloc[0]
        units = [own if pd.isna(centre) else min(FACTORS, key=lambda u: abs(x + math.log(FACTORS[u]) - centre)) for x in levels]
        bins = pdf["bin"].to_numpy()
        return pd.DataFrame({"history": pdf["history"].iloc[0], "source_id": pdf["source_id"].iloc[0], "at0": pdf["at0"].iloc[0], "width": pdf["width"].iloc[0], "from_bin": bins[starts], "to_bin": bins[[b - 1 for b in ends]], "level": levels, "n_values": [int(n[a:b].sum()) for a, b in zip(starts, ends)], "unit_segment": units})

    return run


def _fits(value: Column, unit: str) -> Column:
    return F.coalesce((value * F.lit(FACTORS[unit]) >= F.col("low")) & (value * F.lit(FACTORS[unit]) <= F.col("high")), F.lit(False))


def assign_units(values: DataFrame, sources: DataFrame, notes: DataFrame, max_bins: int = MAX_BINS, search: Callable[..., list[int]] = pelt) -> DataFrame:
    """``history, row_id, source_id, loaded_at, value, unit_code, rule, seconds`` of every row with a number.

    ``values``: history, row_id, source_id, loaded_at, own (unit of the history), value, unit, seconds (of
    ``parse_time``). ``sources``: source_id, low, high (in seconds); ``notes``: source_id, valid_from, unit. Rows
    without a number come out without a unit. ``rule`` names what gave the unit: ``text``, ``note``, ``segment`` (the
    segment's unit puts the value into the source's range, or there is no range to hold it against), ``range`` (it does not, and
    exactly one other unit does) or ``own`` (nothing gives a unit: the history's own). Notes and sources are fixed tables.
    """
    n = notes.where("unit is not null and valid_from is not null").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("valid_from", "unit"))).alias("notes"))
    dims = sources.select(F.col("source_id").cast("long").alias("source_id"), "low", "high").join(n.withColumn("source_id", F.col("source_id").cast("long")), "source_id", "left")
    few = sources.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    hint = F.broadcast if few else lambda df: df
    x = values.withColumn("source_id", F.col("source_id").cast("long")).join(hint(dims), "source_id", "left")
    noted = F.try_element_at(F.filter("notes", lambda a: a.valid_from <= F.col("loaded_at")), F.lit(-1)).unit
    bare = F.col("value").isNotNull() & F.col("unit").isNull()
    x = x.withColumn("noted", F.when(bare & (F.size(F.coalesce("notes", F.array())) > 0), noted)).drop("notes")
    x = x.withColumn("at", F.unix_micros(F.col("loaded_at").cast("timestamp"))).withColumn("x", F.when(F.col("value") > 0, F.log("value")))
    x = materialise(x, "values")  # read by the spans, the bins and the result
    told = F.coalesce("seconds", seconds_of(F.col("value"), F.coalesce("unit", "noted")))  # by text or note alone
    middle = F.when((F.col("low") > 0) & (F.col("high") > 0), (F.log("low") + F.log("high")) / 2)
    spans = x.groupBy("history", "source_id").agg(F.min("at").alias("at0"), F.max("at").alias("at1"), F.coalesce(F.avg(F.when(told > 0, F.log(told))), F.max(middle)).alias("centre"), F.min("own").alias("own0"))
    spans = spans.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("at1") - F.col("at0") + 1) / F.lit(max_bins)))).drop("at1")
    binned = x.where(bare & F.col("x").isNotNull() & F.col("at").isNotNull() & F.col("source_id").isNotNull()).join(hint(spans), ["history", "source_id"])
    stats = binned.groupBy("history", "source_id", F.floor((F.col("at") - F.col("at0")) / F.col("width")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.first("centre").alias("centre"), F.first("own0").alias("own"), F.first("at0").alias("at0"), F.first("width").alias("width"))
    segments = materialise(stats.groupBy("history", "source_id").applyInPandas(_segmenter(search), SEGMENTS), "segments")
    turns = segments.withColumn("before", F.lag("unit_segment").over(Window.partitionBy("history", "source_id").orderBy("from_bin")))
    turns = turns.where("before is null or before <> unit_segment")  # only where the unit changes
    placed = turns.groupBy("history", "source_id").agg(F.first("at0").alias("at0"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("from_bin", "unit_segment"))).alias("segments"))
    if few and segments.limit(MAX_SEGMENTS + 1).count() <= MAX_SEGMENTS:
        placed = F.broadcast(placed)
    y = x.join(placed, ["history", "source_id"], "left")
    at_bin = F.floor((F.col("at") - F.col("at0")) / F.col("width"))
    segment = F.try_element_at(F.filter("segments", lambda a: a.from_bin <= at_bin), F.lit(-1)).unit_segment
    segment = F.when(bare & F.col("noted").isNull() & (F.size(F.coalesce("segments", F.array())) > 0), segment)
    y = y.select("*", F.inline(F.array(F.struct(segment.alias("segment"))))).drop("segments")  # a generated row: looked up once a value, not once a use
    # the exact check: the segment's unit must put the value into the range of the source; only where it does not are the others tried
    factor = F.coalesce(*[F.when(F.col("segment") == u, F.lit(f)) for u, f in FACTORS.items()])
    holds = F.col("segment").isNotNull() & (F.col("low").isNull() | F.col("high").isNull() | ((F.col("value") * factor >= F.col("low")) & (F.col("value") * factor <= F.col("high"))))
    y = y.withColumn("holds", F.coalesce(holds, F.lit(False)))
    y = y.withColumn("fits", F.when(bare & F.col("noted").isNull() & ~F.col("holds"), F.array_compact(F.array(*[F.when(_fits(F.col("value"), u), F.lit(u)) for u in FACTORS]))))
    only = F.when(F.size("fits") == 1, F.get("fits", F.lit(0)))
    pick = F.when(F.col("unit").isNotNull(), F.struct("unit", F.lit("text").alias("rule"))).when(F.col("value").isNull(), F.lit(None)).when(F.col("noted").isNotNull(), F.struct(F.col("noted").alias("unit"), F.lit("note").alias("rule")))
    pick = pick.when(F.col("holds"), F.struct(F.col("segment").alias("unit"), F.lit("segment").alias("rule"))).when(only.isNotNull(), F.struct(only.alias("unit"), F.lit("range").alias("rule"))).otherwise(F.struct(F.col("own").alias("unit"), F.lit("own").alias("rule")))
    y = y.withColumn("pick", pick).select("*", F.col("pick.unit").alias("unit_code"), F.col("pick.rule").alias("rule"))
    return y.select("history", "row_id", "source_id", "loaded_at", "own", "value", "unit_code", "rule", F.coalesce("seconds", seconds_of(F.col("value"), F.col("unit_code"))).alias("seconds"))
