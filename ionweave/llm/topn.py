"""Top N items of every group with a consistent tie rule.

A bounded heap per group is kept while a task reads its rows, so at most N rows per group and task are shuffled,
however large the group; the heaps are merged after the shuffle. Items are compared by score (higher first), then
identifier (smaller first). All rows of one identifier within a group are one item with its highest score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task gathers before it shrinks its heaps.
BUFFER_ROWS = 1 << 18
#: Heap entries that a task keeps; beyond this they are sent on and the heaps start anew, so memory stays bounded.
STATE_ROWS = 1 << 20


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    codes = column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([True], codes[1:] != codes[:-1]))


def shrink(t: pa.Table, n: int) -> pa.Table:
    """The N best items of each group of a table with columns g, s, i."""
    if not t.num_rows:
        return t
    t = t.group_by(["g", "i"], use_threads=False).aggregate([("s", "max")]).rename_columns(["g", "i", "s"]).select(["g", "s", "i"])
    t = t.sort_by([("g", "ascending"), ("s", "descending"), ("i", "ascending")])
    at = np.arange(t.num_rows)
    start = np.maximum.accumulate(np.where(_changes(t["g"]), at, 0))
    return t.filter(pa.array(at - start < n))


def _heaps(n: int, buffer_rows: int, state_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= buffer_rows:
                t = shrink(pa.Table.from_batches(held), n)
                if t.num_rows >= state_rows:
                    yield from t.to_batches()
                    t = t.slice(0, 0)
                held, rows = t.to_batches(), 0
        if held:
            yield from shrink(pa.Table.from_batches(held), n).to_batches()

    return run


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, *, buffer_rows: int = BUFFER_ROWS, state_rows: int = STATE_ROWS) -> DataFrame:
    """``group, ident, score, rank_no`` (1 to n) of the n best items of every group.

    Rows with a null group, null identifier, or a null or NaN score do not compete; infinite scores do. Groups with
    fewer than n items give them all; an empty table gives none. Other columns of ``df`` are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    x = df.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(ident).alias("i")).where("g is not null and s is not null and i is not null")
    if dict(x.dtypes)["s"] in ("double", "float"):
        x = x.where(~F.isnan("s"))
    heaps = x.mapInArrow(_heaps(n, buffer_rows, state_rows), x.schema)
    merged = heaps.repartition("g").groupBy("g", "i").agg(F.max("s").alias("s"))
    ranked = merged.withColumn("rank_no", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))).cast("long")).where(F.col("rank_no") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score), "rank_no")
