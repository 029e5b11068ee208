"""From mobility peaks to clusters: traces along time, their peaks, boxes, evaluated boxes; scores of cluster pairs.

Scale: a trace is one row, an array over the frames of its own peak (padded). A block's peaks meet the spans in it in one task, as slices of the sorted
scans: short spans whole, long ones in parts that are put together. Picking is one pass over such rows in Arrow batches, without a shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from ionweave.functions import physics as Y
from ionweave.operators import joins as J
from ionweave.operators.greedy import prominences, suppress
from ionweave.operators.windows import gaussian_kernel
from ionweave.session import materialise


def frame_axis(frames: DataFrame, *keys: str) -> DataFrame:
    """``keys, axis``: the frames of each key in order of time, as ``struct<time, frame_id>``; metadata of one run."""
    return frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("time").cast("double").alias("time"), "frame_id"))).alias("axis"))


def rt_traces(peaks: DataFrame, im_peaks: DataFrame, frames: DataFrame, *keys: str, pad: int = 0, block: int = 32, chunk: int = 1_000_000, carry: tuple[str, ...] = (), of: Callable[[pa.Table], pa.Table] | None = None, kind: StructType | None = None) -> DataFrame:
    """``im_id, lo, times, trace, carry``: summed intensity of each mobility peak's window in every frame of its span; ``carry``: more columns of ``im_peaks``.

    ``im_peaks``: im_id, keys, frame_lo, frame_hi, scan_lo, scan_hi, tof_lo, tof_hi; ``frames``: frame_id, time, keys. Spans are padded by
    ``pad`` frames and end at the run's. A mobility peak whose border frames the run lacks, or without any intensity, has no trace.

    A span that goes no further than half a block beyond its first frame is met whole, by its first frame's block with the first half of the next; longer
    spans are met in parts by the blocks they touch, and put together. ``of`` makes other rows, of schema ``kind``, of a table of whole traces.
    """
    reach = block // 2
    places = frame_axis(frames, *keys).select(*keys, (F.size("axis") - 1).alias("_last"), F.posexplode("axis").alias("place", "f")).select(*keys, "_last", "place", "f.*")
    at = lambda c, name: F.broadcast(places.groupBy(*keys, "_last", F.col("frame_id").alias(c)).agg(F.min("place").alias(name)))
    kept = [F.col(c).alias(f"_c_{c}") for c in carry]
    spans = im_peaks.select(*keys, "im_id", "frame_lo", "frame_hi", *[F.col(f"{c}_{e}").cast("double") for c in ("scan", "tof") for e in ("lo", "hi")], *kept).where("scan_lo <= scan_hi and tof_lo <= tof_hi")
    spans = spans.join(at("frame_lo", "_a"), [*keys, "frame_lo"]).join(at("frame_hi", "_b").drop("_last"), [*keys, "frame_hi"])
    spans = spans.withColumn("lo", F.greatest(F.least("_a", "_b") - pad, F.lit(0)).cast("int")).withColumn("hi", F.least(F.greatest("_a", "_b") + pad, "_last").cast("int"))
    number = lambda c: F.floor(F.col(c) / block)
    met = lambda k: (*keys, k.alias("_k"), "im_id", "lo", "hi", "scan_lo", "scan_hi", "tof_lo", "tof_hi", *[f"_c_{c}" for c in carry])
    short, long = spans.where(F.col("hi") - F.col("lo") <= reach).select(*met(number("lo"))), spans.where(F.col("hi") - F.col("lo") > reach).select(*met(F.explode(F.sequence(number("lo"), number("hi")))))
    p = peaks.select("frame_id", *[F.col(c).cast("double").alias(f"_{c}") for c in ("scan", "tof", "intensity")]).where("_scan is not null and _tof is not null and _intensity is not null").join(F.broadcast(places), "frame_id").select(*keys, "place", F.lit(None).cast("double").alias("time"), "_scan", "_tof", "_intensity")
    p = p.unionByName(places.select(*keys, "place", "time"), allowMissingColumns=True)
    schema = StructType([im_peaks.schema["im_id"]]).add("lo", IntegerType()).add("first", IntegerType()).add("times", ArrayType(DoubleType())).add("trace", ArrayType(DoubleType()))
    schema = StructType([*schema, *[im_peaks.schema[c] for c in carry]])
    names, columns, none = ["_k", *keys], ["im_id", "lo", "times", "trace", *carry], to_arrow_schema(schema).empty_table()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return none
        place, time, scan, tof, w = (left[c].to_numpy() for c in ("place", "time", "_scan", "_tof", "_intensity"))
        frame = left["_scan"].is_null().to_numpy()
        first, times = int(place[frame].min()), time[frame][np.argsort(place[frame])]
        place, scan, tof, w = (x[~frame] for x in (place - first, scan, tof, w))
        scans = np.unique(scan)
        cell = place * len(scans) + np.searchsorted(scans, scan)
        begin, end = np.maximum(right["lo"].to_numpy() - first, 0), np.minimum(right["hi"].to_numpy() - first, len(times) - 1)
        n = end - begin + 1
        stops = np.cumsum(n)
        at = np.arange(stops[-1]) + np.repeat(begin - (stops - n), n)
        a, b = (at * len(scans) + np.repeat(np.searchsorted(scans, right[c].to_numpy(), side), n) for c, side in (("scan_lo", "left"), ("scan_hi", "right")))
        t0, t1 = right["tof_lo"].to_numpy(), right["tof_hi"].to_numpy()
        every = not len(tof) or (t0.max() <= tof.min() and t1.min() >= tof.max())
        exact = (w == np.floor(w)).all() and np.abs(w).sum() < 2**53
        if every and exact and len(times) * len(scans) <= 4 * (len(cell) + len(at)):  # sums of whole numbers: a window is the difference of two running sums, without any rounding
            running = np.concatenate(([0.0], np.cumsum(np.bincount(cell, w, len(times) * len(scans)))))
            trace = running[b] - running[a]
        else:
            order = np.argsort(cell, kind="stable")
            cell, tof, w = cell[order], tof[order], w[order]
            a, b = np.searchsorted(cell, a), np.searchsorted(cell, b)
            t0, t1 = (None, None) if every else (np.repeat(t0, n), np.repeat(t1, n))
            trace = np.zeros(len(at))
            for i, j, whose, hit in J.slice_pairs(a, b, chunk):
                if not every:
                    inside = (tof[hit] >= t0[i:j][whose]) & (tof[hit] <= t1[i:j][whose])
                    whose, hit = whose[inside], hit[inside]
                trace[i:j] = np.bincount(whose, w[hit], j - i)
        stops = pa.array(np.concatenate(([0], stops)).astype(np.int32))
        return pa.table([right["im_id"], right["lo"], pa.array((begin + first).astype(np.int32)), pa.ListArray.from_arrays(stops, pa.array(times[at])), pa.ListArray.from_arrays(stops, pa.array(trace)), *[right[f"_c_{c}"] for c in carry]], names=schema.names)

    def meet_whole(left: pa.Table, right: pa.Table) -> pa.Table:
        found = meet(left, right).select(columns)
        if found.num_rows:
            trace = found["trace"].combine_chunks()
            found = found.filter(pa.array(~(np.maximum.reduceat(trace.values.to_numpy(), trace.offsets.to_numpy()[:-1]) <= 0)))
        return of(found) if of else found

    near = p.withColumn("_k", F.explode(F.when((F.col("place") >= block) & (F.col("place") % block < reach), F.array(number("place"), number("place") - 1)).otherwise(F.array(number("place")))))
    whole = near.groupBy(*names).cogroup(short.groupBy(*names)).applyInArrow(meet_whole, kind if of else StructType([f for c in columns for f in schema if f.name == c]))
    own = p.withColumn("_k", number("place")).join(F.broadcast(long.select(*names).distinct()), names, "left_semi")  # no more rows than blocks; without any, adaptive execution never reads the peaks for this
    parts = own.groupBy(*names).cogroup(long.groupBy(*names)).applyInArrow(meet, schema)
    rows = parts.groupBy("im_id", "lo", *carry).agg(F.array_sort(F.collect_list(F.struct("first", "times", "trace"))).alias("_p"))
    rows = rows.select("im_id", "lo", F.flatten("_p.times").alias("times"), F.flatten("_p.trace").alias("trace"), *carry).where(F.array_max("trace") > 0)
    return whole.unionByName(rows.mapInArrow(lambda batches: (b for x in batches for b in of(pa.Table.from_batches([x])).to_batches()), kind) if of else rows)


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of values, each computed once a row however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def fallback_peak(y: Column, share: float = 0.1) -> Column:
    """One peak of a trace in which none was found: ``struct<apex, mu, height, prominence, left, right, area>``, null without signal.

    The first maximum, the centroid, and the places where the trace falls to a share of the maximum, linearly interpolated; a side that never does
    ends at the trace's end, extrapolated from its last step. The area is that between the places, within the trace.
    """

    def sides(t: Column) -> Column:
        below = F.filter(F.sequence(F.lit(0), t["n"] - 1), lambda i: F.get(t["y"], i) <= t["level"])
        return bound({"t": t, "below": below}, lambda s: bound({"t": s["t"], "l": F.coalesce(F.array_max(F.filter(s["below"], lambda i: i < s["t"]["apex"])), F.lit(0)), "r": F.coalesce(F.array_min(F.filter(s["below"], lambda i: i > s["t"]["apex"])), s["t"]["n"] - 1)}, ends))

    def ends(s: Column) -> Column:
        t = s["t"]
        cross = lambda a: a + F.coalesce((t["level"] - F.get(t["y"], a)) / F.nullif(F.get(t["y"], a + 1) - F.get(t["y"], a), F.lit(0.0)), F.lit(0.0))
        left, right = F.when(t["apex"] > 0, cross(s["l"])).otherwise(0.0), F.when(t["apex"] < t["n"] - 1, cross(s["r"] - 1)).otherwise((t["n"] - 1).cast("double"))
        return bound({"t": t, "left": left, "right": right}, peak)

    def peak(s: Column) -> Column:
        t = s["t"]
        y, n, left, right = t["y"], t["n"], s["left"], s["right"]
        mu = F.aggregate(F.transform(y, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) / F.aggregate(y, F.lit(0.0), lambda a, x: a + x)
        area = area_between(y, F.greatest(left, F.lit(0.0)), F.least(right, (n - 1).cast("double")))
        return F.struct(t["apex"].alias("apex"), mu.alias("mu"), t["top"].alias("height"), (t["top"] - F.array_min(y)).alias("prominence"), left.alias("left"), right.alias("right"), area.alias("area"))

    found = bound({"y": y, "top": F.array_max(y)}, lambda s: bound({"y": s["y"], "n": F.size(s["y"]), "top": s["top"], "level": s["top"] * share, "apex": (F.array_position(s["y"], s["top"]) - 1).cast("int")}, sides))
    return F.when((F.size(y) > 0) & (F.array_max(y) > 0), found)


def area_between(y: Column, lo: Column, hi: Column) -> Column:
    """Area of the piecewise linear trace between two fractional places."""

    def within(s: Column) -> Column:
        at = lambda i, x: F.get(s["y"], i) + (F.get(s["y"], i + 1) - F.get(s["y"], i)) * (x - i)

        def part(i: Column) -> Column:
            a, b = F.greatest(s["lo"], i.cast("double")), F.least(s["hi"], (i + 1).cast("double"))
            return F.when(b > a, (at(i, a) + at(i, b)) / 2 * (b - a)).otherwise(0.0)

        return F.when(F.size(s["y"]) > 1, F.aggregate(F.transform(F.sequence(F.lit(0), F.size(s["y"]) - 2), part), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)

    return bound({"y": y, "lo": lo, "hi": hi}, within)


def fallback_ends(traces: pa.Table, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of ``fallback_peak`` of each whole trace, as frames that hold its sides; places count from the run's first frame."""
    trace = traces["trace"].combine_chunks()
    size, begin, values = trace.value_lengths().to_numpy(), trace.offsets.to_numpy()[:-1], trace.values.to_numpy()
    first, last = np.zeros(len(size), dtype=np.int32), np.zeros(len(size), dtype=np.int32)
    with np.errstate(invalid="ignore", divide="ignore"):
        for n in np.unique(size):
            same, step, x = np.flatnonzero(size == n), max(1, 1_000_000 // int(n)), np.arange(n)
            for rows in (same[k : k + step] for k in range(0, len(same), step)):
                y, c = values[begin[rows][:, None] + x], np.arange(len(rows))
                apex = y.argmax(axis=1)
                level, at = y[c, apex] * share, apex[:, None]
                low = ~(y > level[:, None])
                l, r = np.where(low & (x < at), x, 0).max(axis=1), np.where(low & (x > at), x, n - 1).min(axis=1)
                a, b = y[c, l], y[c, np.maximum(r - 1, 0)]
                up, down = y[c, np.minimum(l + 1, n - 1)] - a, y[c, r] - b
                left = np.where(apex > 0, l + np.where(up == 0, 0.0, (level - a) / up), 0.0)
                right = np.where(apex < n - 1, r - 1 + np.where(down == 0, 0.0, (level - b) / down), n - 1.0)
                first[rows], last[rows] = (np.where(np.isnan(v), 0, np.clip(v, 0, n - 1)).astype(np.int32) for v in (np.floor(left), np.ceil(right)))
    lo = traces["lo"].to_numpy()
    return lo + first, lo + last


def _at(x: np.ndarray, place: float) -> float:
    return float(np.interp(place, np.arange(len(x)), x))


def _area(y: np.ndarray, lo: float, hi: float) -> float:
    inside = np.arange(np.ceil(lo), np.floor(hi) + 1)
    x = np.concatenate(([lo], inside[(inside > lo) & (inside < hi)], [hi])) if hi > lo else np.array([lo])
    return float(np.trapezoid(np.interp(x, np.arange(len(y)), y), x))


def trace_peaks(y: np.ndarray, t: np.ndarray, *, smooth_s: float = 0.0, min_prominence: float = 0.0, noise_factor: float | None = None, min_distance_s: float = 0.0, min_width_s: float = 0.0, of_trace: float = 0.02, of_best: float = 0.05) -> list[tuple]:
    """Peaks ``(apex, time, height, raw, prominence, left, right, area)`` of one trace.

    The trace is smoothed by ``smooth_s`` seconds (at least three quarters of a frame); the least prominence is ``min_prominence`` or, with
    ``noise_factor``, that many times the noise (median deviation, scaled) if this is more. Of peaks closer than ``min_distance_s`` the higher stays; then peaks with less
    than a share of the whole trace's or of the best peak's area go.
    """
    n = len(y)
    if n < 3:
        return []
    dt = max(float(np.sort(np.abs(np.diff(t)))[(n - 1) // 2]), 1e-3)
    kernel = np.array([w for _, w in gaussian_kernel(max(smooth_s / dt, 0.75))])
    k = len(kernel) // 2
    s = np.convolve(y, kernel)[k : k + n] / np.convolve(np.ones(n), kernel)[k : k + n]
    least = min_prominence
    if noise_factor is not None:
        least = max(least, noise_factor * 1.4826 * float(np.median(np.abs(s - np.median(s)))))
    if y.max() < least:
        return []
    found = []
    for i, prom, left, right in prominences(s):
        if prom >= least and _at(t, right) - _at(t, left) >= min_width_s:
            a, b, c = s[i - 1], s[i], s[i + 1]
            d = a - 2 * b + c
            sub = min(max(0.5 * (a - c) / d, -0.5), 0.5) if abs(d) > 1e-12 else 0.0
            found.append((i, _at(t, i + sub), float(b), float(y[i]), prom, left, right, _area(y, left, right)))
    found = [found[j] for j in suppress(found, [p[1] for p in found], [p[2] for p in found], min_distance_s)]
    whole, best = max(float(np.trapezoid(y)), 1e-6), max([p[7] for p in found] + [1e-6])
    return [p for p in found if p[7] / whole >= of_trace and p[7] / best >= of_best]


def traces_peaks(y: np.ndarray, t: np.ndarray, *, smooth_s: float = 0.0, min_prominence: float = 0.0, noise_factor: float | None = None, min_distance_s: float = 0.0, min_width_s: float = 0.0, of_trace: float = 0.02, of_best: float = 0.05) -> tuple[np.ndarray, ...]:
    """``trace_peaks`` of many traces of one length, one a row: the rows' numbers and then one array for each of its values."""
    m, n = y.shape
    if n < 3 or not m:
        return (np.zeros(0, int), np.zeros(0, int), *[np.zeros(0)] * 7)
    dt, s = np.maximum(np.sort(np.abs(np.diff(t)))[:, (n - 1) // 2], 1e-3), np.empty((m, n))
    for d in np.unique(dt):
        kernel = np.array([w for _, w in gaussian_kernel(max(smooth_s / float(d), 0.75))])
        k = len(kernel) // 2
        norm = np.convolve(np.ones(n), kernel)[k : k + n]
        for i in np.flatnonzero(dt == d):
            s[i] = np.convolve(y[i], kernel)[k : k + n] / norm
    least = np.full(m, float(min_prominence))
    if noise_factor is not None:
        least = np.maximum(least, noise_factor * 1.4826 * np.median(np.abs(s - np.median(s, axis=1)[:, None]), axis=1))
    r, i = np.nonzero((s[:, 1:-1] > s[:, :-2]) & (s[:, 1:-1] >= s[:, 2:]) & ~(y.max(axis=1) < least)[:, None])
    i, c, x = i + 1, np.arange(len(i)), np.arange(n)
    z, at = s[r], i[:, None]
    h = z[c, i]
    above = z > h[:, None]
    a, b = np.where(above & (x < at), x, 0).max(axis=1, initial=0), np.where(above & (x > at), x, n - 1).min(axis=1, initial=n - 1)
    base = np.maximum(np.where((x >= a[:, None]) & (x <= at), z, np.inf).min(axis=1), np.where((x >= at) & (x <= b[:, None]), z, np.inf).min(axis=1))
    prom = h - base
    level = h - prom / 2
    low = z <= level[:, None]
    a, b = np.where(low & (x <= at), x, 0).max(axis=1, initial=0), np.where(low & (x >= at), x, n - 1).min(axis=1, initial=n - 1)

    def cross(e: np.ndarray, step: int) -> np.ndarray:
        v, rise = z[c, e], z[c, np.clip(e + step, 0, n - 1)] - z[c, e]
        ok = (v <= level) & (rise != 0)
        return np.where(ok, e + step * (level - v) / np.where(ok, rise, 1.0), e)

    left, right = cross(a, 1), cross(b, -1)

    def time_at(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        j = np.clip(np.floor(p), 0, n - 2).astype(int)
        return np.where(p >= n - 1, t[r, n - 1], (t[r, j + 1] - t[r, j]) * (p - j) + t[r, j])

    keep = (prom >= least[r]) & (time_at(r, right) - time_at(r, left) >= min_width_s)
    r, i, h, prom, left, right = (v[keep] for v in (r, i, h, prom, left, right))
    before, after = s[r, i - 1], s[r, i + 1]
    d = before - 2 * h + after
    bent = np.abs(d) > 1e-12
    sub = np.where(bent, np.clip(0.5 * (before - after) / np.where(bent, d, 1.0), -0.5, 0.5), 0.0)
    time, raw, seg = time_at(r, i + sub), y[r, i], np.arange(n - 1)
    lo, hi = np.maximum(left[:, None], seg), np.minimum(right[:, None], seg + 1)
    y0, rise = y[r, :-1], np.diff(y)[r]
    area = np.where(hi > lo, (y0 + rise * (lo - seg) + y0 + rise * (hi - seg)) / 2 * (hi - lo), 0.0).sum(axis=1)
    keep = np.ones(len(r), dtype=bool)
    near = (r[1:] == r[:-1]) & (np.abs(np.diff(time)) < min_distance_s)
    for row in np.unique(r[1:][near]):
        own = np.arange(np.searchsorted(r, row), np.searchsorted(r, row, "right"))
        keep[own] = False
        keep[own[suppress(list(own), time[own].tolist(), h[own].tolist(), min_distance_s)]] = True
    found = [v[keep] for v in (r, i, time, h, raw, prom, left, right, area)]
    r, area = found[0], found[-1]
    best = np.full(m, 1e-6)
    np.maximum.at(best, r, area)
    keep = (area / np.maximum(np.trapezoid(y, axis=1), 1e-6)[r] >= of_trace) & (area / best[r] >= of_best)
    return tuple(v[keep] for v in found)


_RT_PEAK = "im_id {kind}, lo int, place int, time double, height double, raw double, prominence double, left double, right double, area double, trace array<double>, times array<double>"


def rt_peaks(traces: DataFrame, *, fallback_below: int = 3, share: float = 0.1, **options) -> DataFrame:
    """Peaks along time of each trace: ``im_id, place, time, height, prominence, left, right, area, frame_lo, frame_hi, fallback``.

    Places count from the run's first frame of the key. A trace with fewer than ``fallback_below`` frames, or in which no peak is found (options of
    ``trace_peaks``), gives its one ``fallback_peak`` instead.
    """
    kind = traces.schema["im_id"].dataType.simpleString()

    schema = to_arrow_schema(StructType.fromDDL(_RT_PEAK.format(kind=kind)))
    names, types = schema.names, schema.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["trace"].value_lengths().to_numpy()
            bare = np.ones(len(size), dtype=bool)
            for n in np.unique(size[size >= max(fallback_below, 3)]):
                rows, step = np.flatnonzero(size == n), max(1, 1_000_000 // int(n))
                for at in (rows[k : k + step] for k in range(0, len(rows), step)):
                    part = batch.take(pa.array(at))
                    r, place, *values = traces_peaks(*(part[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(float) for c in ("trace", "times")), **options)
                    bare[at[r]] = False
                    took = pa.array(r)
                    yield pa.record_batch([part["im_id"].take(took), part["lo"].take(took), pa.array(place.astype(np.int32)), *map(pa.array, values), pa.nulls(len(r), types[-2]), pa.nulls(len(r), types[-1])], names=names)
            rest = batch.filter(pa.array(bare))
            yield pa.record_batch([rest["im_id"], rest["lo"], *[pa.nulls(len(rest), k) for k in types[2:-2]], rest["trace"], rest["times"]], names=names)

    picked = traces.select("im_id", "lo", "times", "trace").mapInArrow(run, _RT_PEAK.format(kind=kind))
    p = picked.withColumn("_f", F.when(F.col("trace").isNotNull(), fallback_peak(F.col("trace"), share)))
    base = F.floor("_f.mu").cast("int")
    second = F.get("times", F.least(base + 1, F.size("times") - 1))
    p = p.withColumn("time", F.coalesce("time", F.get("times", base) + F.least(F.col("_f.mu") - base, F.lit(0.5)) * (second - F.get("times", base))))
    p = p.withColumn("place", F.coalesce("place", base)).withColumn("n", F.size(F.coalesce("trace", F.array())))
    for c in ("height", "prominence", "left", "right", "area"):
        p = p.withColumn(c, F.coalesce(c, F.col(f"_f.{c}")))
    lo, hi = F.greatest(F.floor("left"), F.lit(0)), F.ceil("right")
    hi = F.when(F.col("_f").isNotNull(), F.least(hi, F.col("n") - 1)).otherwise(hi)
    return p.where("height is not null").select("im_id", (F.col("place") + F.col("lo")).cast("int").alias("place"), "time", "height", "prominence", (F.col("left") + F.col("lo")).alias("left"), (F.col("right") + F.col("lo")).alias("right"), "area", (lo + F.col("lo")).cast("int").alias("frame_lo"), (hi + F.col("lo")).cast("int").alias("frame_hi"), F.col("_f").isNotNull().alias("fallback"))


def boxes(im_peaks: DataFrame, rt: DataFrame, n_places: Column, n_tof: Column, *, rt_pad: int = 0, im_pad: int = 0, tof_pad: int = 0, min_span: int = 10, k_sigma: float = 3.0) -> DataFrame:
    """One box per pair of mobility and time peak: ``im_id, rt_lo, rt_hi, scan_lo, scan_hi, tof_lo, tof_hi``.

    ``im_peaks`` has im_id, scan (apex), scan_lo, scan_hi, scan_sigma (may be null), tof_lo, tof_hi. Scans are widened about the apex to the greatest of ``min_span``, the measured width (2 at
    least) and ``2 k sigma + 1``, and always cover what was measured. All ranges are inclusive and end at 0 and at the axis' size.
    """
    return _boxes(im_peaks.select("im_id", *_BOX).join(rt.select("im_id", "frame_lo", "frame_hi"), "im_id"), n_places, n_tof, rt_pad, im_pad, tof_pad, min_span, k_sigma)


def fallback_boxes(peaks: DataFrame, im_peaks: DataFrame, frames: DataFrame, *keys: str, n_places: Column, n_tof: Column, pad: int = 0, block: int = 32, share: float = 0.1, rt_pad: int = 0, im_pad: int = 0, tof_pad: int = 0, min_span: int = 10, k_sigma: float = 3.0) -> DataFrame:
    """``boxes`` of mobility peaks and the ``fallback_peak`` of their traces, made where the traces are, so that these go nowhere and nothing is joined to them."""
    kind = StructType([im_peaks.schema["im_id"]]).add("frame_lo", IntegerType()).add("frame_hi", IntegerType())
    kind = StructType([*kind, *[im_peaks.schema[c] for c in _BOX]])

    def ends(traces: pa.Table) -> pa.Table:
        return pa.table([traces["im_id"], *map(pa.array, fallback_ends(traces, share)), *[traces[c] for c in _BOX]], names=kind.names) if traces.num_rows else to_arrow_schema(kind).empty_table()

    return _boxes(rt_traces(peaks, im_peaks, frames, *keys, pad=pad, block=block, carry=_BOX, of=ends, kind=kind), n_places, n_tof, rt_pad, im_pad, tof_pad, min_span, k_sigma)


_BOX = ("scan", "scan_lo", "scan_hi", "tof_lo", "tof_hi", "scan_sigma")


def _boxes(p: DataFrame, n_places: Column, n_tof: Column, rt_pad: int, im_pad: int, tof_pad: int, min_span: int, k_sigma: float) -> DataFrame:
    last = lambda c, n: F.least(F.greatest(c, F.lit(0)), n - 1)
    p = p.select("im_id", "scan", *[F.col(c).alias(f"_{c}") for c in ("scan_lo", "scan_hi", "tof_lo", "tof_hi")], "scan_sigma", F.col("frame_lo").alias("_f0"), F.col("frame_hi").alias("_f1"))
    lo, hi = F.greatest(F.least("_scan_lo", "_scan_hi") - im_pad, F.lit(0)), F.greatest("_scan_lo", "_scan_hi") + im_pad
    prior = F.when(F.col("scan_sigma") > 0, F.ceil(2 * k_sigma * F.col("scan_sigma")) + 1).otherwise(0)
    want = F.greatest(F.lit(min_span), F.greatest(F.col("_scan_hi") - F.col("_scan_lo") + 1, F.lit(2)), prior).cast("long")
    half = F.floor(want / 2)
    narrow = hi - lo + 1 < want
    return p.select(
        "im_id", last(F.least("_f0", "_f1") - rt_pad, n_places).cast("int").alias("rt_lo"), last(F.greatest("_f0", "_f1") + rt_pad, n_places).cast("int").alias("rt_hi"),
        F.when(narrow, F.least(lo, F.greatest(F.col("scan") - half, F.lit(0)))).otherwise(lo).cast("int").alias("scan_lo"), F.when(narrow, F.greatest(hi, F.col("scan") + want - 1 - half)).otherwise(hi).cast("int").alias("scan_hi"),
        last(F.least("_tof_lo", "_tof_hi") - tof_pad, n_tof).cast("int").alias("tof_lo"), last(F.greatest("_tof_lo", "_tof_hi") + tof_pad, n_tof).cast("int").alias("tof_hi"),
    )


def box_moments(peaks: DataFrame, spec: DataFrame, axes: tuple[str, str, str] = ("frame_id", "scan", "tof"), width: float = 16.0, chunk: int = 1_000_000) -> DataFrame:
    """Fits of each box by moments: ``cluster_id, n, raw_sum`` and for each axis ``mu_A, sigma_A``. ``spec``: cluster_id and A_lo, A_hi of each axis.

    Boxes are cut into blocks of ``width`` on the first axis; in a block each of its places is a run of peaks sorted by the second axis, of which a box takes a slice.
    """
    number = lambda c: F.floor(F.col(c) / width)
    ends = [f"{a}_{e}" for a in axes for e in ("lo", "hi")]
    p = peaks.select(*[F.col(a).cast("double").alias(f"_{a}") for a in axes], F.coalesce(F.col("intensity").cast("double"), F.lit(0.0)).alias("_w")).where(" and ".join(f"_{a} is not null" for a in axes)).withColumn("_k", number(f"_{axes[0]}"))
    boxes = spec.select("cluster_id", *[F.col(e).cast("double").alias(e) for e in ends]).where(" and ".join(f"{a}_lo <= {a}_hi" for a in axes))
    boxes = boxes.withColumn("_k", F.explode(F.sequence(number(ends[0]), number(ends[1]))))
    sums = [f"_{m}_{a}" for a in axes for m in "sq"]
    schema = StructType([spec.schema["cluster_id"]]).add("n", LongType()).add("raw_sum", DoubleType())
    for c in sums:
        schema = schema.add(c, DoubleType())
    none = to_arrow_schema(schema).empty_table()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        x, y, z, w = (left[c].to_numpy() for c in (*(f"_{a}" for a in axes), "_w"))
        order = np.lexsort((y, x))
        x, y, z, w = x[order], y[order], z[order], w[order]
        xs, ys = np.unique(x), np.unique(y)
        cell = np.searchsorted(xs, x) * len(ys) + np.searchsorted(ys, y)
        x0, x1, y0, y1, z0, z1 = (right[e].to_numpy() for e in ends)
        begin = np.searchsorted(xs, x0)
        n = np.maximum(np.searchsorted(xs, x1, "right") - begin, 0)
        stops = np.cumsum(n)
        at, box = np.arange(stops[-1]) + np.repeat(begin - (stops - n), n), np.repeat(np.arange(len(n)), n)
        a, b = (np.searchsorted(cell, at * len(ys) + np.searchsorted(ys, bound, side)[box]) for bound, side in ((y0, "left"), (y1, "right")))
        every, total = z0.max() <= z.min() and z1.min() >= z.max(), np.zeros((2 + len(sums), len(n)))
        for i, j, whose, hit in J.slice_pairs(a, b, chunk):
            first = box[i]
            whose = box[i:j][whose]
            if not every:
                inside = (z[hit] >= z0[whose]) & (z[hit] <= z1[whose])
                whose, hit = whose[inside], hit[inside]
            whose, size, v = whose - first, int(box[j - 1] - first) + 1, w[hit]
            for row, weight in enumerate((None, v, *(u for c in (x, y, z) for u in (v * c[hit], v * c[hit] * c[hit])))):
                total[row, first : first + size] += np.bincount(whose, weight, size)
        met = total[0] > 0
        return pa.table([right["cluster_id"].filter(pa.array(met)), pa.array(total[0][met].astype(np.int64)), *[pa.array(t[met]) for t in total[1:]]], names=schema.names)

    parts = p.groupBy("_k").cogroup(boxes.groupBy("_k")).applyInArrow(meet, schema)
    sums = parts.groupBy("cluster_id").agg(*[F.sum(c).alias(c) for c in ("n", "raw_sum", *sums)])
    out = []
    for a in axes:
        mu = F.col(f"_s_{a}") / F.col("raw_sum")
        out += [mu.alias(f"mu_{a}"), F.sqrt(F.greatest(F.col(f"_q_{a}") / F.col("raw_sum") - mu * mu, F.lit(0.0))).alias(f"sigma_{a}")]
    return sums.where("raw_sum > 0").select("cluster_id", "n", "raw_sum", *out)


def refine(peaks: DataFrame, spec: DataFrame, axes: tuple[str, str, str] = ("frame_id", "scan", "tof"), k_sigma: float = 3.0, width: float = 16.0) -> DataFrame:
    """Boxes evaluated twice: the fits of the given boxes narrow them to ``k_sigma`` deviations, within which they are fitted again."""
    first = box_moments(peaks, spec, axes, width).select("cluster_id", *[F.col(f"{m}_{a}").alias(f"_{m}_{a}") for a in axes for m in ("mu", "sigma")])
    j = spec.join(first, "cluster_id")
    cut = []
    for a in axes:
        r = F.greatest(k_sigma * F.col(f"_sigma_{a}"), F.lit(0.5))
        cut += [F.greatest(F.col(f"{a}_lo"), F.floor(F.col(f"_mu_{a}") - r)).cast("int").alias(f"{a}_lo"), F.least(F.col(f"{a}_hi"), F.ceil(F.col(f"_mu_{a}") + r)).cast("int").alias(f"{a}_hi")]
    return box_moments(peaks, j.select("cluster_id", *cut), axes, width)


def decorate(clusters: DataFrame, mz_of: Callable[[Column], Column]) -> DataFrame:
    """Adds ``mz_mu, mz_sigma`` (fit carried to m/z by the calibration) to fits with ``mu_tof, sigma_tof``, and ``mz_lo, mz_hi`` where bounds are given."""
    mu, s = F.col("mu_tof"), F.col("sigma_tof")
    out = clusters.withColumn("mz_mu", mz_of(mu)).withColumn("mz_sigma", (mz_of(mu + s) - mz_of(mu - s)) / 2)
    return out.withColumn("mz_lo", mz_of(F.col("tof_lo"))).withColumn("mz_hi", mz_of(F.col("tof_hi"))) if "tof_lo" in clusters.columns else out


def run(peaks: DataFrame, im_peaks: DataFrame, frames: DataFrame, *keys: str, pad: int = 2, mz_of: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """The whole way: traces, time peaks, boxes, fits of refined boxes, m/z. Axes are the frame's place, scan and tof."""
    axis = frame_axis(frames, *keys)
    places = axis.select(F.posexplode("axis").alias("place", "f")).select("place", "f.frame_id")
    n_places, n_tof = axis.agg(F.max(F.size("axis"))).scalar(), peaks.agg(F.max("tof") + 1).scalar()
    rt = rt_peaks(rt_traces(peaks, im_peaks, frames, *keys, pad=pad), **options)
    spec = boxes(im_peaks, rt, n_places, n_tof)
    spec = materialise(spec.select(F.xxhash64("im_id", "rt_lo", "rt_hi").alias("cluster_id"), F.col("rt_lo").alias("place_lo"), F.col("rt_hi").alias("place_hi"), "scan_lo", "scan_hi", "tof_lo", "tof_hi"), "boxes")
    fits = refine(peaks.join(places, "frame_id"), spec, ("place", "scan", "tof"))
    return decorate(fits, mz_of) if mz_of else fits


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two traces over their common length; null below three points or without variance."""
    n = F.least(F.size(a), F.size(b))
    z = F.arrays_zip(F.slice(a, 1, F.greatest(n, F.lit(0))).alias("a"), F.slice(b, 1, F.greatest(n, F.lit(0))).alias("b"))
    total = lambda f: F.aggregate(z, F.lit(0.0), lambda s, x: s + f(x))
    sa, sb = total(lambda x: x["a"]), total(lambda x: x["b"])
    va, vb = total(lambda x: x["a"] * x["a"]) / n - (sa / n) * (sa / n), total(lambda x: x["b"] * x["b"]) / n - (sb / n) * (sb / n)
    r = (total(lambda x: x["a"] * x["b"]) / n - sa / n * (sb / n)) / F.sqrt(va * vb)
    return F.when((n >= 3) & (va > 0) & (vb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def xic_score(rt1: Column, rt2: Column, im1: Column, im2: Column, sum1: Column, sum2: Column, weights: tuple[float, float, float] = (0.45, 0.45, 0.10), tau: float = 1.5) -> Column:
    """Score in [0, 1] of two clusters: the weighted mean of what is known of three terms.

    Correlations of time and mobility traces moved from [-1, 1] to [0, 1], and ``exp(-|log ratio| / tau)`` of the time traces' integrals, or of the raw sums where a
    trace is missing. Null when no term is known.
    """
    whole = lambda y, s: F.when(y.isNotNull(), F.aggregate(y, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))).otherwise(F.greatest(s, F.lit(0.0)))
    i1, i2 = whole(rt1, sum1), whole(rt2, sum2)
    ratio = F.when((i1 > 0) & (i2 > 0), F.exp(-F.abs(F.ln(F.greatest(i2 / F.nullif(i1, F.lit(0.0)), F.lit(1e-6)))) / tau))
    terms = [(weights[0], 0.5 * (pearson(rt1, rt2) + 1)), (weights[1], 0.5 * (pearson(im1, im2) + 1)), (weights[2], ratio)]
    top, low = F.lit(0.0), F.lit(0.0)
    for w, s in terms:
        top, low = top + F.coalesce(s * w, F.lit(0.0)), low + F.when(s.isNotNull(), w).otherwise(0.0)
    return F.when(low > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / F.nullif(low, F.lit(0.0)))))


#: Weights of the terms of the geometric score.
GEOMETRIC = {"jaccard": 1.0, "shape": 1.0, "rt_apex": 0.75, "im_apex": 0.75, "im_overlap": 0.5, "intensity": 0.25}


def pair_features(df: DataFrame, min_sigma_rt: float = 0.05, min_sigma_im: float = 0.5) -> DataFrame:
    """Adds the features of pairs with a_/b_ rt_mu, rt_sigma, im_mu, im_sigma, im_lo, im_hi: ``jaccard_rt`` (of three deviations each way), ``rt_delta``, ``im_delta``, ``im_inter``, ``im_union``, ``shape``."""
    span = lambda s, k: F.col(f"{s}_rt_mu") + k * F.col(f"{s}_rt_sigma")
    inter = F.greatest(F.least(span("a", 3), span("b", 3)) - F.greatest(span("a", -3), span("b", -3)), F.lit(0.0))
    union = F.greatest(span("a", 3), span("b", 3)) - F.least(span("a", -3), span("b", -3))
    sr = Y.pooled_sigma(F.greatest("a_rt_sigma", F.lit(min_sigma_rt)), F.greatest("b_rt_sigma", F.lit(min_sigma_rt)))
    si = Y.pooled_sigma(F.greatest("a_im_sigma", F.lit(min_sigma_im)), F.greatest("b_im_sigma", F.lit(min_sigma_im)))
    rt, im = F.abs(F.col("a_rt_mu") - F.col("b_rt_mu")), F.abs(F.col("a_im_mu") - F.col("b_im_mu"))
    both = F.greatest(F.least("a_im_hi", "b_im_hi") - F.greatest("a_im_lo", "b_im_lo") + 1, F.lit(0))
    either = F.greatest("a_im_hi", "b_im_hi") - F.least("a_im_lo", "b_im_lo") + 1
    return df.withColumns({"jaccard_rt": F.coalesce(inter / F.nullif(union, F.lit(0.0)), F.lit(0.0)), "rt_delta": rt, "im_delta": im, "im_inter": both, "im_union": F.greatest(either, F.lit(1)), "shape": F.exp(-0.5 * ((rt / sr) * (rt / sr) + (im / si) * (im / si)))})


def geometric_score(raw_sum: Column, rt_scale: float = 0.75, im_scale: float = 3.0, neutral: float = 0.6) -> Column:
    """Weighted sum over ``pair_features``; a missing shape counts as ``neutral``."""
    g = GEOMETRIC
    return (
        g["jaccard"] * F.col("jaccard_rt") + g["shape"] * F.coalesce("shape", F.lit(neutral)) + g["rt_apex"] * Y.exp_decay(F.col("rt_delta"), rt_scale) + g["im_apex"] * Y.exp_decay(F.col("im_delta"), im_scale)
        + g["im_overlap"] * F.col("im_inter") / F.col("im_union") + g["intensity"] * F.log1p(F.greatest(raw_sum, F.lit(0.0)))
    )


def axis_scale(span: Column, reach: Column, eps: float) -> Column:
    """Multiplier of an axis brought to [-1, 1] by which ``eps`` stands for ``reach`` in its own unit; 1 where there is no span or reach."""
    return F.when((span > 0) & (reach > 0), eps * span / (2 * reach)).otherwise(1.0)


def axis_reach(eps: float, span: Column, scale: Column) -> Column:
    """What ``eps`` stands for on a scaled axis; without limit where the scale is not positive."""
    return F.when(scale > 0, eps * span / (2 * scale)).otherwise(float("inf"))
