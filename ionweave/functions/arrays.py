"""Array-valued helpers: masks, dropout, transmission sets, isotopes under partial transmission."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def transmitted_set(p: Column, cutoff: float = 0.5) -> Column:
    """Indices whose probability is above the cutoff (strictly)."""
    return F.filter(F.transform(p, lambda x, i: F.when(x > cutoff, i)), lambda i: i.isNotNull())


def any_transmitted(p: Column, cutoff: float = 0.5) -> Column:
    return F.exists(p, lambda x: x > cutoff)


def all_transmitted(p: Column, cutoff: float = 0.5) -> Column:
    return F.forall(p, lambda x: x > cutoff)


def transmitted_isotopes(fragment: Column, complement: Column, allowed: Column) -> Column:
    """Abundance of each fragment isotope i: its own times the sum of the complement's p - i over the transmitted precursor isotopes p."""
    reach = lambda i: F.aggregate(allowed, F.lit(0.0), lambda a, p: a + F.coalesce(F.when(p >= i, F.get(complement, p - i)), F.lit(0.0)))
    return F.transform(fragment, lambda x, i: x * reach(i))


def drop_smallest(values: Column, share: float, seed: Column) -> Column:
    """Zeroes about a share of the entries, small ones first: entries are ranked by value times a hash of their place."""
    n = F.floor(F.size(values) * share).cast("int")
    key = F.transform(values, lambda x, i: F.struct((x * (F.pmod(F.xxhash64(seed, i), F.lit(1000)) + 1)).alias("k"), i.alias("i")))
    gone = F.transform(F.slice(F.array_sort(key), 1, F.greatest(n, F.lit(0))), lambda e: e["i"])
    return F.transform(values, lambda x, i: F.when(F.array_contains(gone, i), 0.0).otherwise(x))


def mask_by_length(values: Column, n_positions: Column, n_charges: Column, charges: int = 3, kinds: int = 2) -> Column:
    """Flat (position, kind, charge) vectors: entries beyond the sequence or its charge become -1."""
    return F.transform(values, lambda x, i: F.when((F.floor(i / (charges * kinds)) >= n_positions) | (i % charges >= n_charges), -1.0).otherwise(x))


def pad(values: Column, length: int, fill: float = 0.0) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), length)), 1, length)


def adaptive_integral(f, a: float, b: float, tolerance: float = 1e-9, depth: int = 40) -> float:
    """Gauss-Kronrod (7, 15) with bisection."""
    # Nodes and weights of the rule.
    x = np.array([0.991455371120813, 0.949107912342759, 0.864864423359769, 0.741531185599394, 0.586087235467691, 0.405845151377397, 0.207784955007898, 0.0])
    wk = np.array([0.022935322010529, 0.063092092629979, 0.104790010322250, 0.140653259715525, 0.169004726639267, 0.190350578064785, 0.204432940075298, 0.209482141084728])
    wg = np.array([0.0, 0.129484966168870, 0.0, 0.279705391489277, 0.0, 0.381830050505119, 0.0, 0.417959183673469])
    nodes, k, g = np.concatenate((-x, x[:-1])), np.concatenate((wk, wk[:-1])), np.concatenate((wg, wg[:-1]))

    def part(lo: float, hi: float, left: int) -> float:
        m, h = (lo + hi) / 2, (hi - lo) / 2
        y = np.array([f(m + h * t) for t in nodes])
        fine, rough = h * (k @ y), h * (g @ y)
        if abs(fine - rough) <= tolerance or not left:
            return fine
        return part(lo, m, left - 1) + part(m, hi, left - 1)

    return part(a, b, depth)


def emg_bounds(mu: float, sigma: float, lam: float, target: float = 0.95, step: float = 0.1, reach: float = 10.0) -> tuple[float, float]:
    """Narrowest symmetric-in-mass interval on a step grid that holds ``target`` of an exponentially modified Gaussian."""
    x = np.arange(mu - reach * sigma, mu + reach * (sigma + 1 / lam), step)
    from math import erf

    z = lam / 2 * (2 * mu + lam * sigma**2 - 2 * x)
    c = np.array([1 - erf(t) for t in (mu + lam * sigma**2 - x) / (np.sqrt(2) * sigma)])
    y = np.where(c > 0, lam / 2 * np.exp(np.minimum(z, 700)) * c, 0.0)
    cdf = np.cumsum(y)
    cdf /= cdf[-1]
    lo, hi = np.searchsorted(cdf, [(1 - target) / 2, (1 + target) / 2])
    return float(x[lo]), float(x[min(hi, len(x) - 1)])


def emg_bounds_udf(target: float = 0.95):
    """Vectorised bounds ``struct<lo, hi>`` of (mu, sigma, lambda)."""

    @F.pandas_udf("lo double, hi double")
    def bounds(mu: pd.Series, sigma: pd.Series, lam: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([emg_bounds(*p, target) for p in zip(mu, sigma, lam)], columns=["lo", "hi"])

    return bounds
