"""Projections and predicates over peaks. Every range is inclusive at both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(**bounds: tuple[float | None, float | None]) -> Column:
    """Conjunction of inclusive ranges by column; None leaves an end open. Pushed to the scan where columns are plain."""
    terms = [F.lit(True)]
    for name, (lo, hi) in bounds.items():
        if lo is not None:
            terms.append(F.col(name) >= lo)
        if hi is not None:
            terms.append(F.col(name) <= hi)
    return reduce(lambda a, b: a & b, terms[1:] or terms)


def range_filter(df: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Rows within all ranges; rows with a null in a bounded column are out."""
    return df.where(in_ranges(**bounds))


def index_filter(df: DataFrame, resolution: int, mz_min: float, mz_max: float) -> DataFrame:
    """Filter of vectorised peaks: integer index within the scaled bounds, the lower rounded down, the upper up."""
    scale = 10**resolution
    index = F.round(F.col("mz") * scale).cast("long")
    return df.withColumn("index", index).where(F.col("index").between(F.floor(F.lit(mz_min * scale)), F.ceil(F.lit(mz_max * scale))))


def by_type(df: DataFrame, ms_type: int) -> DataFrame:
    return df.where(F.col("ms_type") == ms_type)


def type_filter(df: DataFrame, first: dict, other: dict) -> DataFrame:
    """Bounds ``first`` for survey rows (type 0), ``other`` for all others."""
    survey = F.col("ms_type") == 0
    return df.where((survey & in_ranges(**first)) | (~survey & in_ranges(**other)))


def hash_sample(df: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """Keeps a row if a hash of its keys says so: the same rows in every run, plan and partitioning."""
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def stride_sample(df: DataFrame, expr: Column, keep: int, of: int) -> DataFrame:
    """Systematic sample over an integer expression."""
    return df.where(F.pmod(expr, F.lit(of)) < keep)


def mask(df: DataFrame, column: str) -> DataFrame:
    """Rows whose mask is true; null counts as false."""
    return df.where(F.coalesce(F.col(column), F.lit(False)))


def mask_array(values: str, flags: str) -> Column:
    """Elements of an array whose flag at the same place is true."""
    return F.transform(F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(flags).alias("m")), lambda x: x["m"]), lambda x: x["v"])


def survey_top(df: DataFrame, floor: float, n: int) -> DataFrame:
    """Survey frames' peaks of at least ``floor``, the n most intense per frame; ties by tof, scan, mz."""
    order = Window.partitionBy("frame_id").orderBy(F.desc("intensity"), "tof", "scan", "mz")
    return df.where((F.col("ms_type") == 0) & (F.col("intensity") >= floor)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def valid_sequences(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def restrict(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Applies the model restrictions that are given, in this order: residues, min/max length, modifications, charges."""
    bare = F.regexp_replace("sequence", r"\[[^\]]*\]", "")
    steps = {
        "residues": lambda v: bare.rlike(rf"\A[{v}]*\z"),
        "min_length": lambda v: F.length(bare) >= v,
        "max_length": lambda v: F.length(bare) <= v,
        "modifications": lambda v: F.size(F.array_except(F.regexp_extract_all("sequence", F.lit(r"UNIMOD:(\d+)"), F.lit(1)), F.array(*map(F.lit, v)))) == 0,
        "charges": lambda v: F.col("charge").isin(*v),
    }
    return reduce(lambda d, k: d.where(steps[k](rules[k])), [k for k in steps if k in rules], df)


def folds(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Split into k sets of equal size; the hash order makes it a shuffle that every run repeats.

    The number of rows before each block is found from counts per block, so no task sorts the whole table.
    """
    h = F.xxhash64(*order)
    blocks = df.withColumn("_block", F.shiftright(h, 52)).withColumn("_hash", h)
    counts = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_total", F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = blocks.join(F.broadcast(before.drop("_n")), "_block")  # at most 4096 blocks
    at = F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy("_block").orderBy("_hash", *order)) - 1
    return rows.withColumn("fold", F.floor(at * F.lit(k) / F.col("_total")).cast("int") + 1).drop("_block", "_hash", "_before", "_total")


def il_key(sequence: Column) -> Column:
    """I and L collapse to L."""
    return F.translate(sequence, "I", "L")


def in_box(df: DataFrame, query: str) -> DataFrame:
    """Region query string ``rt=0:10&mz=100:200`` to ranges; unknown axes are refused."""
    bounds = {}
    for part in filter(None, query.split("&")):
        axis, _, span = part.partition("=")
        if axis not in ("rt", "mz", "mobility", "intensity"):
            raise ValueError(f"unknown axis {axis}")
        lo, _, hi = span.partition(":")
        bounds[axis] = (float(lo) if lo else None, float(hi) if hi else None)
    return range_filter(df, **bounds)
