"""Interval, range, tolerance and best-match joins.

Ranges never become nested loops: intervals are cut into buckets of one width, buckets meet by an equi-join, and a pair is
kept only in the later of both first buckets, so it comes out once without a distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_box_join(left: DataFrame, right: DataFrame, dims: list[tuple[tuple[str, str], tuple[str, str], float]], keys: list[str] | None = None, residual: Column | None = None) -> DataFrame:
    """Pairs whose boxes overlap on every axis and whose ``keys`` agree. Other column names must differ.

    ``dims`` has for each axis the inclusive interval of the left and of the right side and a bucket width. Each row goes to
    the cells that its box touches; with two axes a cell holds so many fewer rows that dense places do not multiply.
    Intervals much longer than the width make many cells, points one. Rows with a null or reversed interval match nothing.
    """
    keys, buckets = keys or [], [f"_k{i}" for i in range(len(dims))]

    def cut(df: DataFrame, side: int) -> DataFrame:
        tag = "lr"[side]
        for i, dim in enumerate(dims):
            lo, hi = (F.floor(F.col(c) / dim[2]) for c in dim[side])
            df = df.where(F.col(dim[side][0]) <= F.col(dim[side][1])).withColumn(f"_{tag}{i}", lo).withColumn(f"_k{i}", F.explode(F.sequence(lo, hi)))
        return df

    pairs = cut(left, 0).join(cut(right, 1), [*keys, *buckets])
    for i, (l, r, _) in enumerate(dims):
        pairs = pairs.where((F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1])) & (F.col(f"_k{i}") == F.greatest(f"_l{i}", f"_r{i}")))
    if residual is not None:
        pairs = pairs.where(residual)
    return pairs.drop(*buckets, *[f"_{t}{i}" for t in "lr" for i in range(len(dims))])


def bucketed_interval_join(left: DataFrame, right: DataFrame, lspan: tuple[str, str], rspan: tuple[str, str], width: float, keys: list[str] | None = None, residual: Column | None = None) -> DataFrame:
    """Pairs whose inclusive intervals overlap: the join of boxes with one axis."""
    return bucketed_box_join(left, right, [(lspan, rspan, width)], keys, residual)


def point_in_interval(points: DataFrame, spans: DataFrame, point: str, span: tuple[str, str], width: float, keys: list[str] | None = None) -> DataFrame:
    """Points with every inclusive interval that holds them."""
    return bucketed_interval_join(points.withColumn("_p1", F.col(point)), spans, (point, "_p1"), span, width, keys).drop("_p1")


def slice_pairs(a: np.ndarray, b: np.ndarray, chunk: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Members of slices ``[a, b)`` of one sorted array, about ``chunk`` at a time: first and end slice, number of the slice from the first, place in the array."""
    size = b - a
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + chunk, "right")))
        n = size[i:j]
        yield i, j, np.repeat(np.arange(j - i), n), np.arange(n.sum()) + np.repeat(a[i:j] - (np.cumsum(n) - n), n)
        i = j


def last_window(points: DataFrame, windows: DataFrame, keys: list[str], width: float = 32.0) -> DataFrame:
    """The setting of each (frame, scan): of windows that overlap the later row wins. ``points`` need ``keys, scan`` and are
    reduced to distinct places first, so dense frames cost what their places cost."""
    places = points.select(*keys, "scan").distinct()
    hit = point_in_interval(places, windows, "scan", ("scan_begin", "scan_end"), width, keys)
    return hit.groupBy(*keys, "scan").agg(F.max_by(F.struct("isolation_mz", "isolation_width", "collision_energy", "row_order"), "row_order").alias("w")).select(*keys, "scan", "w.*")


def logistic_window(mz: Column, center: Column, width: Column, k: float = 15.0, margin: float = 0.5) -> Column:
    """Transmission of a quadrupole window: a difference of sigmoids about its edges."""
    up = 1.0 / (1.0 + F.exp(-k * (mz - (center - width / 2 - F.lit(margin) / 2))))
    down = 1.0 / (1.0 + F.exp(-k * (mz - (center + width / 2 + F.lit(margin) / 2))))
    return up - down


def transmit_with(df: DataFrame, probability: Callable[[Column], Column], least: float = 0.0) -> DataFrame:
    """Peaks times their probability of transmission, any function of m/z; those not above ``least`` are lost."""
    return df.withColumn("_p", probability(F.col("mz"))).where(F.col("_p") > least).withColumn("intensity", F.col("intensity") * F.col("_p")).drop("_p")


def jaccard(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
    """Overlap over union of inclusive integer intervals."""
    inter = F.greatest(F.least(F.col(hi1), F.col(hi2)) - F.greatest(F.col(lo1), F.col(lo2)) + 1, F.lit(0))
    union = (F.col(hi1) - F.col(lo1) + 1) + (F.col(hi2) - F.col(lo2) + 1) - inter
    return inter / union


def candidates(ms1: DataFrame, ms2: DataFrame, min_jaccard: float, width: float = 8.0, im_width: float = 16.0, min_im_overlap: int = 1, compat: bool = False) -> DataFrame:
    """Survey and fragment clusters of one window group whose rt intervals overlap with at least ``min_jaccard`` and whose
    scan ranges share ``min_im_overlap`` scans. ``compat`` counts disjoint scan ranges as sharing one, so that scans
    cannot narrow the search.
    """
    a = ms1.select(F.col("cluster_id").alias("ms1_id"), "window_group", *[F.col(c).alias(f"a_{c}") for c in ("rt_lo", "rt_hi", "im_lo", "im_hi", "mz", "raw_sum")])
    b = ms2.select(F.col("cluster_id").alias("ms2_id"), "window_group", *[F.col(c).alias(f"b_{c}") for c in ("rt_lo", "rt_hi", "im_lo", "im_hi", "mz", "raw_sum")])
    overlap = F.greatest(F.least("a_im_hi", "b_im_hi") - F.greatest("a_im_lo", "b_im_lo"), F.lit(0 if compat else -1)) + 1
    dims = [(("a_rt_lo", "a_rt_hi"), ("b_rt_lo", "b_rt_hi"), width), (("a_im_lo", "a_im_hi"), ("b_im_lo", "b_im_hi"), im_width)]
    pairs = bucketed_box_join(a, b, dims[:1] if compat else dims, ["window_group"], overlap >= min_im_overlap)
    return pairs.withColumn("jaccard", jaccard("a_rt_lo", "a_rt_hi", "b_rt_lo", "b_rt_hi")).withColumn("im_overlap", overlap).where(F.col("jaccard") >= min_jaccard)


def best_match(pairs: DataFrame, winner_of: list[str], *order: Column) -> DataFrame:
    """One pair per ``winner_of`` by a total order (bounded before the shuffle by the group limit of the ranking)."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*winner_of).orderBy(*order))).where("_r = 1").drop("_r")


def nearest_key(left: DataFrame, right: DataFrame, key: str, by: list[str], steps: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """Tolerance equi-join on an integer key: the exact key, else one of the neighbours in the order given.

    Each left row needs unique ``_row`` by itself; it is made from a hash of all its columns.
    """
    tried = left.withColumn("_all", F.struct(*left.columns)).withColumn("_try", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), (F.col(key) + s).alias("k")) for i, s in enumerate(steps)]))).select("*", F.col("_try.turn").alias("_turn"), F.col("_try.k").alias("_k"))
    other = right.withColumnRenamed(key, "_k").groupBy(*by, "_k").agg(F.min(F.struct(*[c for c in right.columns if c not in (*by, key)])).alias("_v"))
    hit = tried.join(other, [*by, "_k"])
    return hit.groupBy("_all").agg(F.min_by("_v", "_turn").alias("_v"), F.min_by("_k", "_turn").alias("matched_key")).select("_all.*", "matched_key", "_v.*")


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str], carry: list[str], block: Column | None = None, direction: str = "backward") -> DataFrame:
    """For each left row the last right row of the same ``by`` at or before it (or the first at or after it).

    A union and one ordered pass; with ``block`` (a column over ``on``) a key's history is cut into blocks which carry
    their last right row over, so that a hot key is not one task.
    """
    back = direction == "backward"
    t = F.struct(F.col(on).alias("_at"), *carry)
    l = left.select(*by, F.col(on), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(t.alias("r")).schema["r"].dataType).alias("_r"), F.lit(1 if back else 0).alias("_side"))
    r = right.select(*by, F.col(on), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_l"), t.alias("_r"), F.lit(0 if back else 1).alias("_side"))
    u = l.unionByName(r)
    if block is None:
        w = Window.partitionBy(*by).orderBy(F.col(on), F.col("_side")) if back else Window.partitionBy(*by).orderBy(F.desc(on), F.desc("_side"))
        got = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return u.withColumn("_g", got).where("_l is not null").select("_l.*", *[F.col(f"_g.{c}").alias(f"right_{c}") for c in carry], F.col("_g._at").alias(f"right_{on}"))
    if not back:
        raise ValueError("blocks go with backward matches")
    u = u.withColumn("_block", block)
    w = Window.partitionBy(*by, "_block").orderBy(F.col(on), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    inside = u.withColumn("_g", F.last("_r", ignorenulls=True).over(w))
    ends = u.groupBy(*by, "_block").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(on))).alias("_e"))
    carry_w = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_e", F.last("_e", ignorenulls=True).over(carry_w))
    out = inside.where("_l is not null").join(before, [*by, "_block"], "left").withColumn("_g", F.coalesce("_g", "_e"))
    return out.select("_l.*", *[F.col(f"_g.{c}").alias(f"right_{c}") for c in carry], F.col("_g._at").alias(f"right_{on}"))


def nearest(left: DataFrame, right: DataFrame, on: str, by: list[str], carry: list[str], block: Column) -> DataFrame:
    """For each left row the right row of the same ``by`` that is nearest on ``on``; the earlier on ties.

    ``block`` (monotone in ``on``) cuts each key's axis into blocks that are ordered apart; what lies nearest beyond a
    block's ends is carried over from the blocks before and after, so a hot key is not one task.
    """
    t = F.struct(F.col(on).alias("_at"), *carry)
    lt, rt = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType, right.select(t.alias("r")).schema["r"].dataType
    l = left.select(*by, F.col(on), F.struct(*left.columns).alias("_l"), F.lit(None).cast(rt).alias("_r"))
    u = l.unionByName(right.select(*by, F.col(on), F.lit(None).cast(lt).alias("_l"), t.alias("_r"))).withColumn("_block", block)
    w = Window.partitionBy(*by, "_block")
    up, down = w.orderBy(F.asc(on)).rangeBetween(Window.unboundedPreceding, 0), w.orderBy(F.desc(on)).rangeBetween(Window.unboundedPreceding, 0)
    inside = u.withColumn("_b", F.last("_r", ignorenulls=True).over(up)).withColumn("_f", F.last("_r", ignorenulls=True).over(down)).where("_l is not null")
    ends = u.groupBy(*by, "_block").agg(F.max("_r").alias("_hi"), F.min("_r").alias("_lo"))  # structs compare by place first
    c = Window.partitionBy(*by)
    before = c.orderBy(F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    after = c.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select(*by, "_block", F.last("_hi", ignorenulls=True).over(before).alias("_hi"), F.last("_lo", ignorenulls=True).over(after).alias("_lo"))
    x = inside.join(beyond, [*by, "_block"], "left").withColumn("_b", F.coalesce("_b", "_hi")).withColumn("_f", F.coalesce("_f", "_lo"))
    x = x.withColumn("_g", F.when(F.coalesce(F.col("_f._at") - F.col(on) < F.col(on) - F.col("_b._at"), F.col("_b").isNull()), F.col("_f")).otherwise(F.col("_b")))
    return x.select("_l.*", *[F.col(f"_g.{k}").alias(f"near_{k}") for k in carry], F.col("_g._at").alias(f"near_{on}"))
