"""Frame rendering and annotation, superposition, signal extraction, cluster evaluation and indexes over acquisition programs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from ionweave.operators import joins as J
from ionweave.operators import windows as W
from ionweave.operators.binning import mz_key


def render(frame_dist: DataFrame, ions: DataFrame, scan_dist: DataFrame, spectra: DataFrame, decimals: int = 4, least: float = 0.0) -> DataFrame:
    """``frame_id, scan, k, intensity``: product of elution, ion share, mobility and isotope abundance, summed per m/z key.

    ``frame_dist``: peptide_id, frame_id, abundance; ``ions``: ion_id, peptide_id, share; ``scan_dist``: ion_id, scan, abundance;
    ``spectra``: ion_id, mz, abundance. Three equi-joins and one aggregation.
    """
    x = ions.join(frame_dist.withColumnRenamed("abundance", "a_frame"), "peptide_id").join(scan_dist.withColumnRenamed("abundance", "a_scan"), "ion_id").join(spectra.withColumnRenamed("abundance", "a_mz"), "ion_id")
    w = F.col("share") * F.col("a_frame") * F.col("a_scan") * F.col("a_mz")
    return x.groupBy("frame_id", "scan", mz_key(decimals).alias("k")).agg(F.sum(w).alias("intensity")).where(F.col("intensity") > least)


def annotate(df: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """Peaks summed per key with the list of what contributed, largest first."""
    c = F.array_sort(F.collect_list(F.struct((-F.col("intensity")).alias("o"), source.alias("source"))))
    return df.groupBy(*keys).agg(F.sum("intensity").alias("intensity"), F.transform(c, lambda e: F.struct((-e["o"]).alias("intensity"), e["source"].alias("source"))).alias("contributions"))


def first_source(contributions: str) -> Column:
    return F.get(F.col(contributions), F.lit(0))["source"]


def superpose(frames: DataFrame, reference: DataFrame, decimals: int = 6) -> DataFrame:
    """Peaks of a reference run added to frames of the same id; frames that only one side has stay."""
    cols = ["frame_id", "scan", "mz", "intensity"]
    return frames.select(*cols).unionByName(reference.select(*cols)).groupBy("frame_id", "scan", mz_key(decimals).alias("k")).agg(F.sum("intensity").alias("intensity"))


def overlay(frames: DataFrame, pools: dict[int, DataFrame], decimals: int = 6) -> DataFrame:
    """Noise by frame type: each frame of a type that has a pool gets the pool's peaks of its id added."""
    types = frames.select("frame_id", "ms_type").distinct()
    noise = [p.select("frame_id", "scan", "mz", "intensity").join(types.where(F.col("ms_type") == t).select("frame_id"), "frame_id", "left_semi") for t, p in pools.items()]
    return superpose(frames, reduce(DataFrame.unionByName, noise), decimals) if noise else superpose(frames, frames.limit(0), decimals)


def extract(peaks: DataFrame, targets: DataFrame, mz_ppm: float, width: float = 1.0) -> DataFrame:
    """Peaks within a tolerance of each target's m/z: ``target_id`` with the peak's columns. ``targets``: target_id, target_mz."""
    t = targets.withColumn("_lo", F.col("target_mz") * (1 - mz_ppm * 1e-6)).withColumn("_hi", F.col("target_mz") * (1 + mz_ppm * 1e-6))
    return J.point_in_interval(peaks, t, "mz", ("_lo", "_hi"), width).drop("_lo", "_hi")


def target_sums(peaks: DataFrame, targets: DataFrame, mz_ppm: float, by: Column, name: str, windows: int = 4, chunk: int = 500_000) -> DataFrame:
    """``target_id, name, intensity``: intensities within a tolerance of each target's m/z, summed per value of ``by``.

    A target is in one bucket of ``windows`` tolerances on the logarithmic axis, and peaks go to each bucket with targets that they may meet. So a target
    meets all its peaks in one task, as a slice of the sorted m/z, and no pair is shuffled; about ``chunk`` pairs are formed at a time and leave the task
    before the next ones are, ordered by ``name`` and then by target: as runs, of which the files of a result with billions of rows are small.
    Peaks are written to the shuffle once. Ids that several targets share are met apart, by peaks of their buckets alone, and their sums are added up afterwards.
    """
    p = mz_ppm * 1e-6
    if not 0 <= p < 1:
        raise ValueError("the tolerance must be at least 0 and below a million ppm")
    reach = math.log((1 + p) / (1 - p))
    at = lambda c, d: F.floor((F.coalesce(F.ln(c), F.lit(-1e6)) + d) / (windows * max(reach, 1e-6)))
    x = peaks.where("mz >= 0").select(F.col("mz").cast("double").alias("_mz"), by.alias(name), F.col("intensity").cast("double").alias("_w"))
    x = x.withColumn("_k", F.explode(F.sequence(at(F.col("_mz"), -reach - 1e-9), at(F.col("_mz"), 1e-9))))
    t = targets.groupBy("target_id").agg(F.collect_list(F.col("target_mz").cast("double")).alias("_all")).select("target_id", (F.size("_all") > 1).alias("_more"), F.explode("_all").alias("_m"))
    t = t.select("target_id", "_more", (F.col("_m") * (1 - p)).alias("_lo"), (F.col("_m") * (1 + p)).alias("_hi")).where("_lo <= _hi").withColumn("_k", at(F.col("_lo"), 0.0))
    schema = StructType([targets.schema["target_id"], x.schema[name]]).add("intensity", DoubleType())
    kind = to_arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        left, right = (rows.filter(of).select(["_x", "_y", c]).sort_by("_x").combine_chunks() for of, c in ((pc.field("_peak"), name), (~pc.field("_peak"), "target_id")))
        del rows
        if not left.num_rows or not right.num_rows:
            return
        mz, known = left["_x"].to_numpy(), left["_y"].is_valid().to_numpy()
        w = np.where(known, left["_y"].to_numpy(), 0.0)
        coded = left[name].chunk(0).dictionary_encode("encode")
        values, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        a, b = np.searchsorted(mz, right["_x"].to_numpy(), "left"), np.searchsorted(mz, right["_y"].to_numpy(), "right")
        for i, j, whose, hit in J.slice_pairs(a, np.maximum(a, b), chunk):
            if not len(hit):
                continue
            first = hit.min()
            met = np.bincount(part := code[first : hit.max() + 1]) > 0
            seen, place = np.flatnonzero(met), (np.cumsum(met) - 1)[part]
            cell, label = place[hit - first] * (j - i) + whose, None
            if len(seen) * (j - i) > 16 * len(cell):
                label, cell = np.unique(cell, return_inverse=True)
            there = np.flatnonzero(np.bincount(cell))
            sums, empty = np.bincount(cell, w[hit])[there], None if known.all() else np.bincount(cell, known[hit])[there] == 0
            there = there if label is None else label[there]
            yield pa.RecordBatch.from_arrays([right["target_id"].chunk(0).take(pa.array(i + there % (j - i))), values.take(pa.array(seen[there // (j - i)])), pa.array(sums, mask=empty)], schema=kind)

    def sums(x: DataFrame, t: DataFrame) -> DataFrame:
        both = x.select("_k", F.lit(True).alias("_peak"), F.col("_mz").alias("_x"), F.col("_w").alias("_y"), name).unionByName(t.select("_k", F.lit(False).alias("_peak"), F.col("_lo").alias("_x"), F.col("_hi").alias("_y"), "target_id"), allowMissingColumns=True)
        return both.repartition("_k").groupBy("_k").applyInArrow(meet, schema)  # grouped rows would go through the shuffle with their key twice

    once, more = t.where("not _more"), t.where("_more")
    some = F.pmod("_k", F.lit(1 << 16))
    near = x.withColumn("_c", some).join(F.broadcast(more.select(some.alias("_c")).distinct()), "_c", "left_semi")
    shared = sums(near, more).groupBy("target_id", name).agg(F.sum("intensity").alias("intensity"))
    return sums(x, once).unionByName(shared).withColumn("intensity", F.col("intensity").cast(peaks.agg(F.sum("intensity").alias("s")).schema["s"].dataType))


def chromatograms(peaks: DataFrame, targets: DataFrame, mz_ppm: float) -> DataFrame:
    return target_sums(peaks, targets, mz_ppm, F.col("frame_id"), "frame_id")


def mobilograms(peaks: DataFrame, targets: DataFrame, mz_ppm: float) -> DataFrame:
    """Mobility in thousandths."""
    return target_sums(peaks, targets, mz_ppm, F.round(F.col("mobility") * 1000).cast("int"), "bin")


def evaluate_clusters(peaks: DataFrame, clusters: DataFrame, width: float = 16.0) -> DataFrame:
    """Per cluster box the raw sum, number of peaks, weighted centres and apex frame.

    ``clusters``: cluster_id, frame_lo, frame_hi, scan_lo, scan_hi, tof_lo, tof_hi. Boxes meet peaks on two axes by cells.
    """
    p = peaks.select("frame_id", "scan", "tof", "mz", "intensity", F.col("frame_id").alias("_f1"), F.col("scan").alias("_s1"))
    dims = [(("frame_id", "_f1"), ("frame_lo", "frame_hi"), width), (("scan", "_s1"), ("scan_lo", "scan_hi"), width)]
    hit = J.bucketed_box_join(p, clusters, dims, residual=F.col("tof").between(F.col("tof_lo"), F.col("tof_hi")))
    w = F.col("intensity")
    per_frame = hit.groupBy("cluster_id", "frame_id").agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_n"), F.sum(w * F.col("scan")).alias("_s"))
    return per_frame.groupBy("cluster_id").agg(F.sum("_w").alias("raw_sum"), F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_w")).alias("im_mu"), (F.sum(F.col("_w") * F.col("frame_id")) / F.sum("_w")).alias("rt_mu"), F.max_by("frame_id", F.struct(F.col("_w"), (-F.col("frame_id")).alias("f"))).alias("apex_frame"))


def dia_index(info: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window group: number of frames, m/z union, merged scan unions."""
    unions = W.islands(windows, "scan_begin", "scan_end", "window_group").groupBy("window_group").agg(F.array_sort(F.collect_list(F.struct("scan_begin", "scan_end"))).alias("scan_unions"))
    mz = windows.groupBy("window_group").agg(F.min(F.col("isolation_mz") - F.col("isolation_width") / 2).alias("mz_lo"), F.max(F.col("isolation_mz") + F.col("isolation_width") / 2).alias("mz_hi"))
    frames = info.groupBy("window_group").agg(F.count(F.lit(1)).alias("n_frames"))
    return mz.join(unions, "window_group").join(frames, "window_group", "left").na.fill(0, ["n_frames"])


def scan_slices(df: DataFrame) -> DataFrame:
    """Runs of each scan in a frame's peaks ordered by scan: ``frame_id, scan, start, end`` (end exclusive)."""
    n = df.groupBy("frame_id", "scan").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("frame_id").orderBy("scan").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("end", F.sum("n").over(w)).select("frame_id", "scan", (F.col("end") - F.col("n")).alias("start"), "end")


def merge_fragments(df: DataFrame, ppm: float, *keys: str) -> DataFrame:
    """Fragments whose m/z lie within a tolerance of their neighbour become one peak; a tolerance not above 0 keeps all."""
    if ppm <= 0:
        return df.select(*keys, "mz", "intensity")
    return W.gap_sessions(df, "mz", F.col("mz") * ppm * 1e-6, ["intensity"], *keys, block=16.0).groupBy(*keys, "session").agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("mz"), F.sum("intensity").alias("intensity")).drop("session")


def target_decoy(psms: DataFrame, spectrum: str, score: str, ident: str) -> DataFrame:
    """Target-decoy competition: the best match of each spectrum, and q-values by score over all of them.

    Counts per score value are accumulated within blocks of scores, so no task holds all matches.
    """
    best = psms.groupBy(spectrum).agg(F.max_by(F.struct("decoy", F.col(score).alias("s"), F.col(ident).alias("m")), F.struct(F.col(score).alias("s"), (-F.col(ident)).alias("i"))).alias("b")).select(spectrum, "b.*")
    per = best.groupBy("s").agg(F.count_if("decoy").alias("d"), F.count_if(~F.col("decoy")).alias("t"))
    sums = W.running(per, "s", {"_d": ("sum", "d"), "_t": ("sum", "t")}, descending=True)
    fdr = sums.select("s", F.least(F.lit(1.0), F.col("_d") / F.greatest("_t", F.lit(1))).alias("f"))
    q = W.running(fdr, "s", {"q": ("min", "f")}).select("s", "q")
    return best.join(q, "s").select(spectrum, F.col("m").alias(ident), "decoy", F.col("s").alias(score), "q")


def calibrate(df: DataFrame, grid: list[float], score, *keys: str) -> DataFrame:
    """The grid value with the best mean score per key, the first on ties. ``score`` maps (rows, grid value) to a Column."""
    s = F.posexplode(F.array(*[score(F.lit(float(g))) for g in grid])).alias("i", "s")
    m = df.select(*keys, s).groupBy(*keys, "i").agg(F.avg("s").alias("m"))
    return m.groupBy(*keys).agg(F.max_by(F.array(*map(F.lit, map(float, grid)))[F.col("i")], F.struct(F.col("m"), (-F.col("i")).alias("o"))).alias("best"), F.max("m").alias("score"))
