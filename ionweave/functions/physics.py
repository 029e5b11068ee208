"""Closed formulas of ion physics and peak shapes, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masses in unified atomic mass units.
MASS_PROTON = 1.007276466621
MASS_NEUTRON = 1.00866491595
MASS_ELECTRON = 0.00054857990946
MASS_WATER = 18.0105646863
MASS_CO = 27.994915
MASS_NH3 = 17.026549
ISOTOPE_SPACING = 1.00335
# The Mason-Schamp constant, nitrogen, and the usual drift gas temperature in degrees.
CCS_CONSTANT = 18509.8632163405
MASS_N2 = 28.013
GAS_TEMPERATURE = 31.85
KELVIN = 273.15
# Coefficients of the rational approximation of the error function, lowest power first.
ERF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# Slope and intercept of the averagine Poisson rate.
AVERAGINE = (0.000594, -0.03091)


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def mz_of_mass(mass: Column, charge: Column) -> Column:
    return (mass + charge * MASS_PROTON) / charge


def mass_of_mz(mz: Column, charge: Column) -> Column:
    return mz * charge - charge * MASS_PROTON


def _reduced_mass(mz: Column, charge: Column, gas: float) -> Column:
    return mz * charge * gas / (mz * charge + gas)


def ccs(one_over_k0: Column, mz: Column, charge: Column, gas: float = MASS_N2, temperature: float = GAS_TEMPERATURE) -> Column:
    """Collision cross-section of an inverse reduced mobility."""
    return CCS_CONSTANT * charge / F.sqrt(_reduced_mass(mz, charge, gas) * (temperature + KELVIN)) * one_over_k0


def one_over_k0(section: Column, mz: Column, charge: Column, gas: float = MASS_N2, temperature: float = GAS_TEMPERATURE) -> Column:
    return F.sqrt(_reduced_mass(mz, charge, gas) * (temperature + KELVIN)) * section / (CCS_CONSTANT * charge)


def ccs_in(one_over_k0_: Column, mz: Column, charge: Column, gas: float, temperature: float) -> Column:
    """Cross-section under given conditions; charges below one count as one."""
    return ccs(one_over_k0_, mz, F.greatest(charge, F.lit(1)), gas, temperature)


def tof_to_mz(tof: Column, timebase: float, delay: float, c0: float, b: float, c2: float = 0.0, c3: float = 0.0, c4: float = 0.0) -> Column:
    """Flight time ``c0 + b s + c2 s² + c3 s³`` solved for ``s = sqrt(m/z + c4)``: linear, by the stable root, or by eight Newton steps."""
    t = tof * timebase + delay
    s = (t - c0) / b
    if c3:
        newton = lambda a, _: a - (c0 + b * a + c2 * a * a + c3 * a * a * a - t) / (b + 2 * c2 * a + 3 * c3 * a * a)
        s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), s, newton)
    elif c2:
        s = 2 * (t - c0) / (b + F.sqrt(F.greatest(b * b + 4 * c2 * (t - c0), F.lit(0.0))))
    return s * s - c4


def mz_to_tof(mz: Column, timebase: float, delay: float, c0: float, b: float, c2: float = 0.0, c3: float = 0.0, c4: float = 0.0) -> Column:
    s = F.sqrt(mz + c4)
    return F.round((c0 + b * s + c2 * s * s + c3 * s * s * s - delay) / timebase).cast("long")


def boundary_tof_to_mz(tof: Column, mz_min: float, mz_max: float, tof_max: int) -> Column:
    """Two-point calibration: square roots of m/z are linear in the index."""
    lo, hi = math.sqrt(mz_min), math.sqrt(mz_max)
    s = lo + (hi - lo) / tof_max * tof
    return s * s


def scan_to_one_over_k0(scan: Column, dv_start: float, slope: float, ttrans: float, ndelay: float, vmin: float, vmax: float, c0: float, c1: float) -> Column:
    """Clamped voltage ramp to inverse mobility."""
    v = F.least(F.greatest(dv_start + slope * (scan - ttrans - ndelay), F.lit(vmin)), F.lit(vmax))
    return 1.0 / (c0 + c1 / v)


def one_over_k0_to_scan(k0: Column, dv_start: float, slope: float, ttrans: float, ndelay: float, c0: float, c1: float) -> Column:
    v = c1 / (1.0 / k0 - c0)
    return F.greatest(F.round((v - dv_start) / slope + ttrans + ndelay), F.lit(0.0)).cast("long")


def _erf_tail(x: Column) -> tuple[Column, Column]:
    """``t`` and the polynomial of the approximation: for positive x, erfc(x) is ``t exp(p - x²)``."""
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    p = F.lit(ERF[-1])
    for c in reversed(ERF[:-1]):
        p = c + t * p
    return t, p


def erf(x: Column) -> Column:
    """Error function by a rational approximation with an error of about 1e-7."""
    t, p = _erf_tail(x)
    tau = t * F.exp(-x * x + p)
    return F.when(x >= 0, 1.0 - tau).otherwise(tau - 1.0)


def erfc(x: Column) -> Column:
    """Complement of ``erf``, without cancellation where it is small."""
    t, p = _erf_tail(x)
    tau = t * F.exp(-x * x + p)
    return F.when(x >= 0, tau).otherwise(2.0 - tau)


def erfcx(x: Column) -> Column:
    """``exp(x²) erfc(x)``; of moderate size for any positive x."""
    t, p = _erf_tail(x)
    tau = t * F.exp(p)
    return F.when(x >= 0, tau).otherwise(2.0 * F.exp(x * x) - tau)


def normal_cdf(x: Column, mean: Column | float, std: Column | float) -> Column:
    return 0.5 * (1.0 + erf((x - mean) / std / math.sqrt(2.0)))


def normal_mass(lo: Column, hi: Column, mean: Column | float, std: Column | float) -> Column:
    return normal_cdf(hi, mean, std) - normal_cdf(lo, mean, std)


def normal_pdf(x: Column, mean: Column | float, std: Column | float) -> Column:
    z = (x - mean) / std
    return F.exp(-0.5 * z * z) / (std * math.sqrt(2 * math.pi))


def exponential_pdf(x: Column, rate: Column | float) -> Column:
    return F.when(x >= 0, rate * F.exp(-rate * x)).otherwise(0.0)


def emg_pdf(x: Column, mu: Column | float, sigma: Column | float, lam: Column | float) -> Column:
    """Exponentially modified Gaussian."""
    mu, sigma, lam = lit(mu), lit(sigma), lit(lam)
    return lam / 2 * F.exp(lam / 2 * (2 * mu + lam * sigma * sigma - 2 * x)) * erfc((mu + lam * sigma * sigma - x) / (math.sqrt(2.0) * sigma))


def emg_mass(lo: Column, hi: Column, mu: Column, sigma: Column, lam: Column, steps: int = 1000) -> Column:
    """Left Riemann sum of the density, term by term inside the JVM."""
    h = (hi - lo) / steps
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda a, i: a + emg_pdf(lo + i * h, mu, sigma, lam)) * h


def logistic(x: Column, at: Column | float, k: float) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (x - at)))


def lambda_of(mass: Column) -> Column:
    return AVERAGINE[0] * mass + AVERAGINE[1]


def averagine_weights(mass: Column, k: int, normalise: bool = True) -> Column:
    """Poisson weights of the first k isotopes of an average peptide."""
    lam = lambda_of(mass)
    w = F.array(*[F.exp(-lam) * F.pow(lam, F.lit(float(i))) / math.factorial(i) for i in range(k)])
    return F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y)) if normalise else w


def binomial_pmf(n: Column, k: int, p: float) -> Column:
    """0 where k exceeds n."""
    return F.when(n >= k, F.factorial(n) / (math.factorial(k) * F.factorial(F.greatest(n - k, F.lit(0)))) * F.pow(F.lit(p), F.lit(float(k))) * F.pow(F.lit(1 - p), (n - k).cast("double"))).otherwise(0.0)


def isotope_tolerance(mz: Column, ppm: float, absolute: float) -> Column:
    return F.greatest(mz * ppm * 1e-6, F.lit(absolute))


def collision_energy(mz: Column, policy: str, a: float = 0.0, b: float = 0.0) -> Column:
    """``value``: a; ``linear``: a + b m/z; anything else: null."""
    return {"value": F.lit(float(a)), "linear": a + b * mz}.get(policy, F.lit(None).cast("double"))


def axis_to_unit(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """Range to [-1, 1]; a range of no width gives 0."""
    lo, hi = lit(lo), lit(hi)
    return F.when(hi > lo, 2 * (x - lo) / F.nullif(hi - lo, F.lit(0.0)) - 1).otherwise(0.0)


def unit_to_axis(u: Column, lo: float, hi: float) -> Column:
    return lo + (u + 1) / 2 * (hi - lo)


def linear_map(x: Column, old_min: Column, old_max: Column, new_min: float, new_max: float) -> Column:
    return (x - old_min) / F.nullif(old_max - old_min, F.lit(0.0)) * (new_max - new_min) + new_min


def log_mz(mz: Column, base: float, resolution: float) -> Column:
    """Constant-resolution index of an m/z."""
    return (F.ln(mz) - math.log(base)) / math.log1p(1.0 / resolution)


def exp_decay(delta: Column, scale: float) -> Column:
    return F.exp(-F.abs(delta) / scale)


def pooled_sigma(a: Column, b: Column) -> Column:
    return F.sqrt(0.5 * (a * a + b * b))
