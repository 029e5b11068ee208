"""References to records that do not exist.

The keys of the parent table are compressed into contiguous runs; each distinct key that is referred to is matched
as of the run that starts at or before it, and a key beyond the run's end has no parent at all. Only keys that do
exist go on to the comparison of times, which asks whether a version of the parent was alive when the referring row
was loaded.

Scale: references are reduced to their distinct keys before anything else, so a key held by a third of the rows is
one row in the match. Runs are cut at multiples of ``BLOCK`` so that the ordered step works on blocks of bounded
size. In the comparison of times the rows of hot keys meet a broadcast of those few keys (at most
``1 / HOT_SHARE``), all others a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.session import HOT_SHARE

#: Keys per block of the key space; no window of the match sees more keys than this.
BLOCK = 1 << 15


def key_runs(keys: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Contiguous runs of the integer column ``key``: ``block, run_start, run_end, n_keys``.

    Null keys are left out, repeated keys count once, an empty table has no runs. Runs end at block borders.
    """
    distinct = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    blocks = distinct.select(F.floor(F.col("k") / F.lit(block)).alias("block"), "k")
    order = Window.partitionBy("block").orderBy("k")
    islands = blocks.withColumn("island", F.col("k") - F.row_number().over(order))
    return islands.groupBy("block", "island").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"), F.count(F.lit(1)).alias("n_keys")).drop("island")


def match_runs(refs: DataFrame, runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """As-of match of distinct keys (column ``k``) to the preceding run start: ``k, known``."""
    wanted = refs.select(F.floor(F.col("k") / F.lit(block)).alias("block"), "k", F.lit(1).alias("side"), F.lit(None).cast("long").alias("run_end"))
    starts = runs.select("block", F.col("run_start").alias("k"), F.lit(0).alias("side"), "run_end")
    order = Window.partitionBy("block").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(wanted).withColumn("end", F.last("run_end", ignorenulls=True).over(order))
    return both.where("side = 1").select("k", (F.coalesce(F.col("k") <= F.col("end"), F.lit(False))).alias("known"))


def lifetimes(parents: DataFrame, key: str, loaded: str, deleted: str | None) -> DataFrame:
    """Per key the earliest load, and the spans ``[from, to)`` in which some version of it was alive.

    Copies are folded before the spans are gathered: versions never deleted leave only the earliest of them, versions
    deleted at one moment leave the earliest load, and spans that start after the row is alive for good are left out.
    """
    gone = F.col(deleted) if deleted else F.lit(None)
    rows = parents.select(F.col(key).cast("long").alias("k"), F.col(loaded).cast("timestamp_ntz").alias("f"), gone.cast("timestamp_ntz").alias("t")).where("k is not null and f is not null")
    folded = rows.groupBy("k", "t").agg(F.min("f").alias("f")).where("t is null or t > f")
    first = rows.groupBy("k").agg(F.min("f").alias("first_load"))
    spans = folded.groupBy("k").agg(F.min(F.when(F.col("t").isNull(), F.col("f"))).alias("forever_from"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct(F.col("f").alias("f"), F.col("t").alias("t")))).alias("s"))
    spans = spans.select("k", "forever_from", F.filter("s", lambda x: F.coalesce(x.f < F.col("forever_from"), F.lit(True))).alias("spans"))
    return first.join(spans, "k", "left")


def _verdict(loaded: Column) -> Column:
    alive = F.coalesce(F.col("forever_from") <= loaded, F.lit(False)) | F.coalesce(F.exists("spans", lambda x: (x.f <= loaded) & (x.t > loaded)), F.lit(False))
    return F.when(F.col("first_load").isNull(), "missing").when(alive, F.lit(None)).when(F.col("first_load") <= loaded, "deleted").otherwise("late")


def orphans(refs: DataFrame, parents: DataFrame, *, row_id: str, ref_key: str, parent_key: str, ref_loaded: str = "loaded_at", parent_loaded: str = "loaded_at", parent_deleted: str | None = None, block: int = BLOCK, hot_share: float = HOT_SHARE) -> DataFrame:
    """References without a good target: ``row_id, k, loaded_at, reason``, one row for each such referring row.

    ``missing``: no row of ``parents`` has the key; ``deleted``: a row with it was loaded by then, but none was alive;
    ``late``: the key was loaded only later. A null reference is none and gives no row. A parent row without a load
    time counts as a row that has the key but is never loaded. A referring row without a load time is ``missing`` where the
    key is missing and ``late`` otherwise. Repeated referring rows are each reported.
    """
    rows = refs.select(F.col(row_id).alias("row_id"), F.col(ref_key).cast("long").alias("k"), F.col(ref_loaded).cast("timestamp_ntz").alias("loaded_at")).where("k is not null")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    floor = counts.agg(F.sum("n") * F.lit(hot_share)).scalar()
    hot = F.broadcast(counts.where(F.col("n") > floor).select("k"))  # at most 1 / hot_share rows
    known = match_runs(counts.select("k"), key_runs(parents, parent_key, block), block)
    life = lifetimes(parents, parent_key, parent_loaded, parent_deleted)
    keys = known.join(life, "k", "left").withColumn("first_load", F.when(F.col("known"), F.col("first_load"))).select("k", "known", "first_load", "forever_from", "spans")
    marked = rows.join(hot.withColumn("is_hot", F.lit(True)), "k", "left")
    cold = marked.where("is_hot is null").join(keys, "k")
    warm = marked.where("is_hot").join(F.broadcast(keys.join(hot, "k", "left_semi")), "k")
    out = cold.unionByName(warm)
    unloaded = F.when(~F.col("known"), "missing").when(F.col("loaded_at").isNull() | F.col("first_load").isNull(), "late")
    return out.select("row_id", "k", "loaded_at", F.coalesce(unloaded, _verdict(F.col("loaded_at"))).alias("reason")).where("reason is not null")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, day and reason."""
    return found.groupBy("ref_table", "ref_field", "load_day", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
