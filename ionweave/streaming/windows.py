"""Streaming twins: event-time windows, sessions, watermarks and stateful exclusion, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ionweave.session import shared_dir


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; ``ts`` as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, length: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums per event-time window; rows later than ``late`` are dropped."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", length), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "intensity")


def sliding(df: DataFrame, length: str, hop: str, late: str, *keys: str) -> DataFrame:
    g = df.withWatermark("ts", late).groupBy(F.window("ts", length, hop), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "intensity")


def sessions(df: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    """Sessions that end after a gap: the streaming form of gap grouping."""
    g = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "intensity")


def exclude_repeats(df: DataFrame, key: str, seconds: float) -> DataFrame:
    """Dynamic exclusion as a stateful operator: an event counts if its key's last counted one is at least so long ago.

    ``key, ts`` of the counted events. State is one time per key; within a batch a key's events are taken in order.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for f in frames for x in f["ts"]):
            micros = t.value // 1000
            if last is None or micros - last >= seconds * 1e6:
                out.append((k[0], t))
                last = micros
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts"])

    return df.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its output as a table in the shared folder.

    ``append`` writes files; ``complete`` keeps the last state of the result. ``each`` sees every micro-batch instead.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
    if each is not None:
        w.foreachBatch(each).start().awaitTermination()
        return stream
    if mode == "append":
        w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        w.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def batches(df: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """Consecutive ranges of an integer key as DataFrames, for callers that render frame ranges one after the other."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is not None:
        for a in range(lo, hi + 1, size):
            yield df.where(F.col(key).between(a, a + size - 1))
