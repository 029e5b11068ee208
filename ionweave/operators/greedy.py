"""Order-dependent algorithms, one group at a time in Arrow batches: isotope removal, peak picking with prominence, isotope
chains, stitching, acquisition scheduling and isotope convolution.

Groups are spectra, series, or parts cut by gaps wider than the algorithm can reach, so a group's size follows from the
instrument and not from the amount of data.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.physics import AVERAGINE, ISOTOPE_SPACING, MASS_PROTON
from ionweave.operators.windows import gap_sessions


def isotope_marks(mz: np.ndarray, intensity: np.ndarray, ppm: float, charges: int = 4, isotopes: int = 3) -> np.ndarray:
    """True for peaks that lie, less intense, an isotope spacing above a peak that is not itself marked."""
    marked = np.zeros(len(mz), dtype=bool)
    steps = np.array([ISOTOPE_SPACING * k / z for z in range(1, charges + 1) for k in range(1, isotopes + 1)])
    targets = mz[:, None] + steps
    lo = np.searchsorted(mz, targets * (1 - ppm * 1e-6), side="left")
    hi = np.searchsorted(mz, targets * (1 + ppm * 1e-6), side="right")
    for i in range(len(mz)):
        if not marked[i]:
            for a, b in zip(lo[i], hi[i]):
                a = max(a, i + 1)
                if a < b:
                    marked[a:b] |= intensity[a:b] < intensity[i]
    return marked


def deisotope(df: DataFrame, keys: list[str], ppm: float = 10.0) -> DataFrame:
    """Peaks without isotope peaks; each group is one spectrum. Empty spectra stay empty."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mz", "intensity"], kind="stable")
        return pdf[~isotope_marks(pdf["mz"].to_numpy(float), pdf["intensity"].to_numpy(float), ppm)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def prominences(y: np.ndarray) -> list[tuple[int, float, float, float]]:
    """(index, prominence, left, right) of strict-left local maxima; left and right are where the series crosses half the
    prominence below the peak, linearly interpolated."""
    out = []
    for i in range(1, len(y) - 1):
        if not (y[i] > y[i - 1] and y[i] >= y[i + 1]):
            continue
        higher = np.nonzero(y[:i] > y[i])[0]
        left_base = y[(higher[-1] if len(higher) else 0) : i + 1].min()
        higher = np.nonzero(y[i + 1 :] > y[i])[0]
        right_base = y[i : (i + 1 + higher[0] if len(higher) else len(y) - 1) + 1].min()
        prom = y[i] - max(left_base, right_base)
        level = y[i] - prom / 2
        a = i
        while a > 0 and y[a] > level:
            a -= 1
        b = i
        while b < len(y) - 1 and y[b] > level:
            b += 1
        left = a + (level - y[a]) / (y[a + 1] - y[a]) if y[a] <= level and y[a + 1] != y[a] else float(a)
        right = b - (level - y[b]) / (y[b - 1] - y[b]) if y[b] <= level and y[b - 1] != y[b] else float(b)
        out.append((i, float(prom), float(left), float(right)))
    return out


def suppress(peaks: list[tuple], at: list[float], height: list[float], distance: float) -> list[int]:
    """Greedy by height: indices of peaks at least ``distance`` apart, the earlier one first on ties."""
    kept: list[int] = []
    for i in sorted(range(len(peaks)), key=lambda j: (-height[j], at[j])):
        if all(abs(at[i] - at[j]) >= distance for j in kept):
            kept.append(i)
    return sorted(kept)


def pick_peaks(df: DataFrame, keys: list[str], axis: str, min_prominence: float, min_distance: float = 0.0, min_width: float = 0.0, max_points: int | None = None) -> DataFrame:
    """``keys, apex, height, prominence, left, right, area`` of dense series ``axis, intensity``."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", apex double, height double, prominence double, left double, right double, area double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis)
        x, y = pdf[axis].to_numpy(float), pdf["intensity"].to_numpy(float)
        found = [p for p in prominences(y) if p[1] >= min_prominence and p[3] - p[2] >= min_width]
        kept = suppress(found, [x[p[0]] for p in found], [y[p[0]] for p in found], min_distance)
        rows = []
        for j in kept:
            i, prom, left, right = found[j]
            at = lambda f: float(np.interp(f, np.arange(len(x)), x))  # noqa: B023, E731
            a, b = int(np.ceil(left)), int(np.floor(right)) + 1
            rows.append((*key, x[i], y[i], prom, at(left), at(right), float(y[a:b].sum())))
        return pd.DataFrame(rows, columns=[*keys, "apex", "height", "prominence", "left", "right", "area"])

    return df.groupBy(*keys).applyInPandas(run, schema)


def cut_by_reach(df: DataFrame, axis: str, reach: float, keys: list[str], ties: list[str]) -> DataFrame:
    """Adds ``part``: rows of one part are linked by steps of at most ``reach``; no algorithm that looks no further crosses parts."""
    return gap_sessions(df, axis, reach, ties, *keys, block=64 * reach).withColumnRenamed("session", "part")


def follows(mass: float, place: int, before: float, now: float) -> bool:
    """Whether a raw sum moves as the averagine weight from ``place - 1`` to ``place`` does: up or down by 5 %. Places from the eighth on count as that; nearly
    equal weights ask for nothing."""
    ratio = (AVERAGINE[0] * mass + AVERAGINE[1]) / min(place, 7)  # of neighbouring Poisson weights
    if ratio > 1 + 1e-3:
        return max(now, 0.0) >= max(before, 0.0) * 1.05
    return ratio >= 1 - 1e-3 or max(now, 0.0) <= max(before, 0.0) * 0.95


def isotope_chains(df: DataFrame, keys: list[str], ppm: float = 10.0, absolute: float = 0.005, max_charge: int = 5, min_overlap: float = 0.3, ident: str = "cluster_id", envelope: bool = True, max_members: int | None = None) -> DataFrame:
    """Features: chains of clusters an isotope spacing apart, ``keys, feature, charge, place, cluster_id``.

    Seeds by descending raw_sum; charges 1 to ``max_charge``, the first best length wins; a chain is extended upwards and downwards in m/z while
    a free cluster lies within the tolerance with enough overlap in rt and scan, and each cluster belongs to one chain. With ``envelope`` a direction ends where the next raw_sum does
    not rise or fall as the averagine weights at the seed's mass do, counted from the seed both ways; ``max_members`` limits a chain.
    Parts of the m/z axis further apart than one spacing are independent and are handled apart.
    """
    parts = cut_by_reach(df, "mz", ISOTOPE_SPACING + 0.05, keys, [ident])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", feature {types[ident]}, charge int, place int, {ident} {types[ident]}"

    def share(a: tuple, b: tuple) -> float:
        inter = min(a[1], b[1]) - max(a[0], b[0]) + 1
        return max(inter, 0) / min(a[1] - a[0] + 1, b[1] - b[0] + 1)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mz", ident], kind="stable")
        mz, raw, ids = pdf["mz"].to_numpy(float), pdf["raw_sum"].to_numpy(float), pdf[ident].to_numpy()
        rt, im = pdf[["rt_lo", "rt_hi"]].to_numpy(), pdf[["im_lo", "im_hi"]].to_numpy()
        free = np.ones(len(mz), dtype=bool)

        def step(i: int, target: float) -> int | None:
            tol = max(ppm * 1e-6 * target, absolute)
            a, b = np.searchsorted(mz, [target - tol, target + tol], side="left")
            fit = [j for j in range(a, b) if free[j] and j != i and share(rt[i], rt[j]) >= min_overlap and share(im[i], im[j]) >= min_overlap]
            return min(fit, key=lambda j: (abs(mz[j] - target), -raw[j], j)) if fit else None

        def extend(chain: list, seed: int, z: int, sign: int) -> None:
            mass, seen, at = (mz[seed] - MASS_PROTON) * z, 1, seed
            while max_members is None or len(chain) < max_members:
                j = step(at, mz[at] + sign * ISOTOPE_SPACING / z)
                if j is None or j in chain or (envelope and not follows(mass, seen, raw[at], raw[j])):
                    return
                chain.insert(len(chain) if sign > 0 else 0, j)
                at, seen = j, seen + 1

        rows = []
        for seed in sorted(range(len(mz)), key=lambda j: (-raw[j], ids[j])):
            if not free[seed]:
                continue
            best, best_z = [seed], 0
            for z in range(1, max_charge + 1):
                chain = [seed]
                extend(chain, seed, z, 1)
                extend(chain, seed, z, -1)
                if len(chain) > len(best):
                    best, best_z = chain, z
            free[best] = False
            rows += [(*key[:-1], ids[best[0]], best_z, p, ids[j]) for p, j in enumerate(best)]
        return pd.DataFrame(rows, columns=[*keys, "feature", "charge", "place", ident])

    return parts.groupBy(*keys, "part").applyInPandas(run, schema)


def stitch(df: DataFrame, keys: list[str], max_gap: int, max_span: int, ident: str = "id") -> DataFrame:
    """Ordered fold of intervals ``lo, hi``: a neighbour within ``max_gap`` joins while the whole spans at most ``max_span``.
    ``keys, lo, hi, n, intensity``."""
    parts = cut_by_reach(df.withColumn("_lo", F.col("lo").cast("double")), "_lo", float(max_gap + max_span), keys, ["hi", ident])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", lo long, hi long, n int, intensity double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for lo, hi, v in pdf.sort_values(["lo", "hi", ident])[["lo", "hi", "intensity"]].itertuples(index=False):
            if rows and lo - rows[-1][1] <= max_gap and max(hi, rows[-1][1]) - rows[-1][0] <= max_span:
                rows[-1] = [rows[-1][0], max(hi, rows[-1][1]), rows[-1][2] + 1, rows[-1][3] + v]
            else:
                rows.append([lo, hi, 1, float(v)])
        return pd.DataFrame([(*key[:-1], *r) for r in rows], columns=[*keys, "lo", "hi", "n", "intensity"])

    return parts.groupBy(*keys, "part").applyInPandas(run, schema)


class Scheduler:
    """Data-dependent selection with dynamic exclusion, frame by frame: top precursors whose scans do not collide."""

    def __init__(self, slots: int, per_slot: int, exclusion: int, margin: int):
        self.slots, self.per_slot, self.exclusion, self.margin, self.until = slots, per_slot, exclusion, margin, {}
        self.open(-1)

    def open(self, frame_id: int) -> None:
        """Begins a frame: its slots are empty, and ions whose exclusion has ended are forgotten."""
        self.at, self.left, self.used = frame_id, self.slots * self.per_slot, [[] for _ in range(self.slots)]
        self.until = {i: u for i, u in self.until.items() if u >= frame_id}

    def take(self, ion: int, scan: int) -> int | None:
        """The slot of the frame's next ion by intensity, if it gets one."""
        if self.left and ion not in self.until:
            for slot, taken in enumerate(self.used):
                if len(taken) < self.per_slot and all(abs(scan - s) > self.margin for s in taken):
                    taken.append(scan)
                    self.left -= 1
                    self.until[ion] = self.at + self.exclusion
                    return slot
        return None

    def frame(self, frame_id: int, ions: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
        """(slot, ion) chosen from (ion, scan, intensity)."""
        self.open(frame_id)
        return [(slot, ion) for ion, scan, _ in sorted(ions, key=lambda x: (-x[2], x[0])) if (slot := self.take(ion, scan)) is not None]


def schedule(df: DataFrame, run_key: str, slots: int = 7, per_slot: int = 15, exclusion: int = 25, margin: int = 25) -> DataFrame:
    """``run, frame_id, slot, ion``: each run is one ordered history in one task. All ions of a frame are walked by falling intensity
    until its slots are full. A run comes as a sorted stream of Arrow batches, so a task holds one batch, one frame's slots and
    the ions under exclusion, however long the run is."""
    kind = dict(df.dtypes)

    def go(frames):
        s, at = None, None
        for pdf in frames:
            rows = []
            for run, frame_id, ion, scan in pdf[[run_key, "frame_id", "ion", "scan"]].itertuples(index=False, name=None):
                if s is None or run != at[0]:
                    s, at = Scheduler(slots, per_slot, exclusion, margin), (run, None)
                if frame_id != at[1]:
                    s.open(frame_id)
                    at = (run, frame_id)
                if s.left and (slot := s.take(ion, scan)) is not None:
                    rows.append((run, frame_id, slot, ion))
            yield pd.DataFrame(rows, columns=[run_key, "frame_id", "slot", "ion"])

    ordered = df.select(run_key, "frame_id", "ion", "scan", "intensity").repartition(run_key).sortWithinPartitions(run_key, "frame_id", F.desc("intensity"), "ion")
    return ordered.mapInPandas(go, f"{run_key} {kind[run_key]}, frame_id {kind['frame_id']}, slot int, ion {kind['ion']}")


#: Isotope masses and abundances of the elements of peptides.
ISOTOPES = {
    "C": ((12.0, 0.9893), (13.00335483507, 0.0107)),
    "H": ((1.00782503223, 0.999885), (2.01410177812, 0.000115)),
    "N": ((14.00307400443, 0.99636), (15.00010889888, 0.00364)),
    "O": ((15.99491461957, 0.99757), (16.99913175650, 0.00038), (17.99915961286, 0.00205)),
    "S": ((31.9720711744, 0.9499), (32.9714589098, 0.0075), (33.967867004, 0.0425), (35.96708071, 0.0001)),
}


def convolve(a: list, b: list, tolerance: float, threshold: float, most: int) -> list:
    """Product of two distributions; masses within the tolerance merge into the first of them, rare ones drop, the most abundant stay.

    Products are cut where sorted masses leave a gap of the tolerance, which no merge crosses. A part narrower than the
    tolerance merges into its first product; only wider ones are walked one by one.
    """
    a, b = np.asarray(a, dtype=float).reshape(-1, 2), np.asarray(b, dtype=float).reshape(-1, 2)
    m, p = (a[:, None, 0] + b[None, :, 0]).ravel(), (a[:, None, 1] * b[None, :, 1]).ravel()
    m, p = m[p >= threshold], p[p >= threshold]
    if not len(m):
        return []
    order = np.argsort(m, kind="stable")
    s = m[order]
    starts = np.concatenate(([0], np.nonzero(np.diff(s) >= tolerance)[0] + 1))
    ends = np.concatenate((starts[1:], [len(s)]))
    first = np.empty(len(m), dtype=int)  # of each product the one that it merges into
    first[order] = np.repeat(np.minimum.reduceat(order, starts), ends - starts)
    for i in np.nonzero(s[ends - 1] - s[starts] >= tolerance)[0]:
        heads: list[int] = []
        for j in np.sort(order[starts[i] : ends[i]]):
            first[j] = next((h for h in heads if abs(m[h] - m[j]) < tolerance), j)
            if first[j] == j:
                heads.append(j)
    total = np.bincount(first, weights=p)
    heads = np.unique(first)
    heads = heads[np.argsort(-total[heads], kind="stable")][:most]
    heads = heads[np.lexsort((total[heads], m[heads]))]
    return list(zip(m[heads].tolist(), total[heads].tolist()))


def convolve_power(dist: list, n: int, tolerance: float, threshold: float, most: int) -> list:
    """n-fold convolution by squaring."""
    result, base = [(0.0, 1.0)], list(dist)
    while n:
        if n & 1:
            result = convolve(result, base, tolerance, threshold, most)
        n >>= 1
        if n:
            base = convolve(base, base, tolerance, threshold, most)
    return result


@lru_cache(maxsize=10_000)
def element_power(element: str, n: int, most: int) -> tuple:
    """Distribution of n atoms of an element; finer than that of compositions, so that little is merged or lost before it."""
    return tuple(convolve_power(ISOTOPES[element], n, 1e-6, 1e-12, most))


def isotope_distribution(counts: dict[str, int], tolerance: float = 1e-3, threshold: float = 1e-9, most: int = 200) -> list[tuple[float, float]]:
    """Distribution of a composition, elements in alphabetical order; unknown elements are refused."""
    out = [(0.0, 1.0)]
    for e in sorted(counts):
        out = convolve(out, element_power(e, counts[e], most), tolerance, threshold, most)
    return out


def isotope_spectra(df: DataFrame, key: str, most: int = 8) -> DataFrame:
    """``key, peak, mass, abundance`` per composition ``key, counts map``; each distinct composition is computed once a batch.
    The ``most`` abundant peaks of the finished distribution are reported, by mass."""
    kind = dict(df.dtypes)[key]

    def run(frames):
        cache: dict = {}
        for pdf in frames:
            rows = []
            for k, c in zip(pdf[key], pdf["counts"]):
                comp = tuple(sorted(dict(c).items()))
                if comp not in cache:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[comp] = sorted(sorted(isotope_distribution(dict(comp)), key=lambda e: -e[1])[:most])
                rows += [(k, i, m, p) for i, (m, p) in enumerate(cache[comp])]
            yield pd.DataFrame(rows, columns=[key, "peak", "mass", "abundance"])

    return df.select(key, "counts").mapInPandas(run, f"{key} {kind}, peak int, mass double, abundance double")
