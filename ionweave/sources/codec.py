"""Binary frame blobs: 32-bit words regrouped by byte place and compressed; decoded and encoded per frame on workers.

Layout of the words: the number of scans, then twice the peak count of every scan but the last, then pairs of (step of the
detector index within the scan, intensity). The first step of a scan counts from -1.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U32 = np.iinfo(np.uint32).max


def pack_words(words: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on."""
    return words.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def sum_and_sort(scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peaks of one (scan, tof) summed, capped at 32 bits, in order."""
    key = scan.astype(np.int64) << 32 | tof.astype(np.int64)
    u, at = np.unique(key, return_inverse=True)
    total = np.zeros(len(u), dtype=np.uint64)
    np.add.at(total, at, intensity.astype(np.uint64))
    return (u >> 32).astype(np.uint32), (u & U32).astype(np.uint32), np.minimum(total, U32).astype(np.uint32)


def encode_frame(scan: np.ndarray, tof: np.ndarray, intensity: np.ndarray, n_scans: int, level: int = 1) -> bytes:
    import zstandard

    scan, tof, intensity = sum_and_sort(np.asarray(scan), np.asarray(tof), np.asarray(intensity))
    if len(scan) and scan.max() >= n_scans:
        raise ValueError("scan beyond the number of scans")
    step = np.diff(tof.astype(np.int64), prepend=-1)
    first = np.concatenate(([True], scan[1:] != scan[:-1])) if len(scan) else np.zeros(0, bool)
    step[first] = tof[first].astype(np.int64) + 1
    counts = np.bincount(scan, minlength=n_scans)[: n_scans - 1] * 2 if n_scans > 1 else np.zeros(0, int)
    words = np.concatenate(([n_scans], counts, np.column_stack((step, intensity)).ravel())).astype(np.uint32)
    body = zstandard.ZstdCompressor(level=level).compress(pack_words(words))
    return struct.pack("<II", len(body) + 8, n_scans) + body


def decode_frame(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scan, tof, intensity; an empty frame gives empty arrays."""
    import zstandard

    size, n_scans = struct.unpack_from("<II", blob)
    if size <= 8 or not n_scans:
        return (np.zeros(0, np.uint32),) * 3
    words = unpack_words(zstandard.ZstdDecompressor().decompressobj().decompress(bytes(blob[8:size])))
    n, pairs = int(words[0]), words[int(words[0]) :].reshape(-1, 2)
    if not len(pairs):
        return (np.zeros(0, np.uint32),) * 3
    counts = words[1:n].astype(np.int64) // 2
    counts = np.append(counts, len(pairs) - counts.sum())
    scan = np.repeat(np.arange(n, dtype=np.uint32), counts)
    total = np.cumsum(pairs[:, 0].astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0)
    return scan, (total - np.repeat(before, counts) - 1).astype(np.uint32), pairs[:, 1]


def lzf_decompress(data: bytes, size: int) -> bytes:
    """The older block compression: literal runs and back references."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
        else:
            n = c >> 5
            if n == 7:
                n += data[i]
                i += 1
            back = len(out) - ((c & 31) << 8 | data[i]) - 1
            i += 1
            for _ in range(n + 2):
                out.append(out[back])
                back += 1
    if size and len(out) != size:
        raise ValueError("unexpected length")
    return bytes(out)


def lzf_store(data: bytes) -> bytes:
    """The older block form without back references: literal runs of at most 32 bytes."""
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def encode_stream(tof: np.ndarray, intensity: np.ndarray) -> bytes:
    """A scan of the older form: intensities as they stand, before each a negative jump unless it follows the one before by one index."""
    step = np.diff(np.asarray(tof, np.int64), prepend=0)
    words = np.column_stack((-step, np.asarray(intensity, np.int64))).ravel()
    keep = np.ones(len(words), bool)
    keep[::2] = step != 1
    return words[keep].astype("<i4").tobytes()


def decode_stream(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """tof and intensity of a scan of the older form: a negative word moves the index on, an intensity right after another one by one."""
    v = np.frombuffer(raw, "<i4").astype(np.int64)
    peak = v >= 0
    follows = np.concatenate(([True], peak[:-1])) if len(v) else peak
    at = np.cumsum(np.where(peak, follows, -v))
    return at[peak], v[peak]


def encode_older(peaks: DataFrame) -> DataFrame:
    """``frame_id, scan, size, blob`` of every scan with peaks in the older form; indices begin at 1."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        scan, tof, intensity = sum_and_sort(pdf["scan"].to_numpy(), pdf["tof"].to_numpy(), pdf["intensity"].to_numpy())
        cuts = np.flatnonzero(np.diff(scan)) + 1
        streams = [encode_stream(t, i) for t, i in zip(np.split(tof, cuts), np.split(intensity, cuts))]
        return pd.DataFrame({"frame_id": key[0], "scan": scan[np.concatenate(([0], cuts)).astype(int)].astype(np.int32), "size": [len(x) for x in streams], "blob": [lzf_store(x) for x in streams]})

    return peaks.select("frame_id", "scan", "tof", "intensity").groupBy("frame_id").applyInPandas(run, "frame_id int, scan int, size int, blob binary")


def decode_older(scans: DataFrame) -> DataFrame:
    """``frame_id, scan, tof, intensity`` of scans in the older form."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = [decode_stream(lzf_decompress(b, n)) for b, n in zip(pdf["blob"], pdf["size"])]
            n = [len(t) for t, _ in parts]
            yield pd.DataFrame({"frame_id": np.repeat(pdf["frame_id"].to_numpy(np.int32), n), "scan": np.repeat(pdf["scan"].to_numpy(np.int32), n), "tof": np.concatenate([t for t, _ in parts] or [np.zeros(0)]).astype(np.int32), "intensity": np.concatenate([i for _, i in parts] or [np.zeros(0)]).astype(float)})

    return scans.select("frame_id", "scan", "size", "blob").mapInPandas(run, "frame_id int, scan int, tof int, intensity double")


def encode(peaks: DataFrame, n_scans: int, level: int = 1) -> DataFrame:
    """``frame_id, num_peaks, blob`` per frame; a frame is one acquisition step and fits a task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame_id": [key[0]], "num_peaks": [len(pdf)], "blob": [encode_frame(pdf["scan"], pdf["tof"], pdf["intensity"], n_scans, level)]})

    return peaks.select("frame_id", "scan", "tof", "intensity").groupBy("frame_id").applyInPandas(run, "frame_id int, num_peaks long, blob binary")


def decode(blobs: DataFrame) -> DataFrame:
    """``frame_id, scan, tof, intensity`` of frame blobs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for f, b in zip(pdf["frame_id"], pdf["blob"]):
                s, t, i = decode_frame(b)
                yield pd.DataFrame({"frame_id": np.full(len(s), f, np.int32), "scan": s.astype(np.int32), "tof": t.astype(np.int32), "intensity": i.astype(float)})

    return blobs.select("frame_id", "blob").mapInPandas(run, "frame_id int, scan int, tof int, intensity double")


def expand_counts(df: DataFrame, key: str, counts: str) -> DataFrame:
    """Peak counts per scan to one row a peak with its scan."""
    return df.select(key, F.posexplode(counts).alias("scan", "n")).where("n > 0").select(key, "scan", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
