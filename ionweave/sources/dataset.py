"""Datasets of frames: a facade over peak and metadata tables, and a reader of acquisition folders with a metadata database
and a file of frame blobs."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions import physics as Y

#: Frames read by one task of a folder scan.
FRAMES_PER_TASK = 256


class Dataset:
    """Frames of one run. ``peaks`` should be written by frame id so that predicates on it prune files and row groups."""

    def __init__(self, peaks: DataFrame, frames: DataFrame):
        self.peaks, self.frames = peaks, frames

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dataset:
        return cls(spark.read.parquet(f"{path}/peaks"), spark.read.parquet(f"{path}/frames"))

    def write(self, path: str, files: int = 8) -> None:
        """Range-partitioned and sorted by frame: every file holds a range of frames and row groups prune."""
        self.peaks.repartitionByRange(files, "frame_id").sortWithinPartitions("frame_id", "scan", "tof").write.mode("overwrite").parquet(f"{path}/peaks")
        self.frames.write.mode("overwrite").parquet(f"{path}/frames")

    def frame(self, frame_id: int) -> DataFrame:
        return self.peaks.where(F.col("frame_id") == frame_id)

    def slice(self, ids: list[int] | DataFrame) -> DataFrame:
        """By a short list of ids, or by a table of them."""
        return self.peaks.where(F.col("frame_id").isin(ids)) if isinstance(ids, list) else self.peaks.join(ids.select("frame_id"), "frame_id", "left_semi")

    def in_time(self, lo: float, hi: float) -> DataFrame:
        return self.slice(self.frames.where(F.col("time").between(lo, hi)))

    def tic(self, ms_type: int = 0) -> DataFrame:
        """Summed intensity of each frame of a type, 0 for empty ones, time in minutes."""
        s = self.peaks.groupBy("frame_id").agg(F.sum("intensity").alias("tic"))
        return self.frames.where(F.col("ms_type") == ms_type).join(s, "frame_id", "left").select("frame_id", (F.col("time") / 60).alias("minutes"), F.coalesce("tic", F.lit(0.0)).alias("tic"))

    def layout(self) -> DataFrame:
        """Number of frames, time span, acquisition mode by the fragment type that occurs."""
        return self.frames.agg(F.count(F.lit(1)).alias("n_frames"), F.min("time").alias("first"), F.max("time").alias("last"), F.when(F.max((F.col("ms_type") == 9).cast("int")) == 1, "DIA").when(F.max((F.col("ms_type") == 8).cast("int")) == 1, "DDA").otherwise("PRECURSOR").alias("mode"))

    def duplicates(self) -> DataFrame:
        """Frame ids that occur more than once in the metadata."""
        return self.frames.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_values(df: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """A key/value table as one row."""
    return df.agg(*[F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names])


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def write_with(df: DataFrame, writer: Callable[[DataFrame], None]) -> DataFrame:
    """Hands a table to a writer and goes on with it."""
    writer(df)
    return df


def read_database_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A metadata table of an acquisition database: small next to its peaks, read once on the driver."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = [r[0] for r in con.execute("select name from sqlite_master where type in ('table', 'view')")]
        if table not in names:
            raise ValueError(f"no table {table}")
        pdf = pd.read_sql_query(f'select * from "{table}"', con)
    return spark.createDataFrame(pdf) if len(pdf) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in pdf.columns) or "empty string")


def read_folder(spark: SparkSession, path: str, mz_range: tuple[float, float], tof_max: int, im_range: tuple[float, float]) -> Dataset:
    """A run folder (``analysis.tdf`` and ``analysis.tdf_bin``) as a dataset; blobs are read and decoded by the tasks.

    m/z and mobility are interpolated between the borders of their ranges. The folder must be visible to all workers.
    """
    meta = read_database_table(spark, str(Path(path, "analysis.tdf")), "Frames")
    frames = meta.select(F.col("Id").cast("int").alias("frame_id"), F.col("Time").cast("double").alias("time"), F.col("MsMsType").cast("int").alias("ms_type"), F.col("NumScans").cast("int").alias("num_scans"), F.col("NumPeaks").cast("long").alias("num_peaks"), F.col("TimsId").cast("long").alias("offset"))
    blob_file = str(Path(path, "analysis.tdf_bin"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import struct

        from ionweave.sources.codec import decode_frame

        with open(blob_file, "rb") as f:
            for pdf in it:
                for frame_id, offset, n in zip(pdf["frame_id"], pdf["offset"], pdf["num_peaks"]):
                    if n:
                        f.seek(int(offset))
                        head = f.read(4)
                        s, t, i = decode_frame(head + f.read(struct.unpack("<I", head)[0] - 4))
                        yield pd.DataFrame({"frame_id": frame_id, "scan": s.astype("int32"), "tof": t.astype("int32"), "intensity": i.astype("float64")})

    n = max(1, frames.count() // FRAMES_PER_TASK)
    raw = frames.select("frame_id", "offset", "num_peaks").repartition(n).mapInPandas(run, "frame_id int, scan int, tof int, intensity double")
    peaks = raw.join(frames.select("frame_id", F.col("time").alias("rt"), "ms_type", "num_scans"), "frame_id")
    mobility = im_range[1] - F.col("scan") * ((im_range[1] - im_range[0]) / F.greatest(F.col("num_scans") - 1, F.lit(1)))
    peaks = peaks.select("frame_id", "scan", "tof", "ms_type", "rt", mobility.alias("mobility"), Y.boundary_tof_to_mz(F.col("tof"), *mz_range, tof_max).alias("mz"), "intensity")
    return Dataset(peaks, frames.drop("offset"))


def write_folder(dataset: Dataset, path: str, n_scans: int) -> None:
    """The inverse: frame blobs from the tasks, put one after the other into one file with its metadata database.

    One file is the format; its blobs are streamed to the writer a partition at a time.
    """
    from ionweave.sources.codec import encode

    Path(path).mkdir(parents=True, exist_ok=True)
    blobs = encode(dataset.peaks, n_scans).join(dataset.frames.select("frame_id", "time", "ms_type"), "frame_id").repartitionByRange("frame_id").sortWithinPartitions("frame_id")
    rows, at = [], 0
    with open(Path(path, "analysis.tdf_bin"), "wb") as f:
        for r in blobs.toLocalIterator(prefetchPartitions=True):
            f.write(r["blob"])
            rows.append((r["frame_id"], r["time"], r["ms_type"], n_scans, r["num_peaks"], at))
            at += len(r["blob"])
    with sqlite3.connect(Path(path, "analysis.tdf")) as con:
        con.execute("drop table if exists Frames")
        con.execute("create table Frames (Id integer primary key, Time real, MsMsType integer, NumScans integer, NumPeaks integer, TimsId integer)")
        con.executemany("insert into Frames values (?, ?, ?, ?, ?, ?)", rows)
