"""Scalar physics: arc sources, birth thickness, backtracking, bounded sources."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import as_column

# Prior defaults and the applicability floor.
BIRTH_MEAN_KM = 7.0
BIRTH_SCALE_KM = 2.0
MIN_FULL_RATE_KM_PER_MYR = 5.0
REFERENCE_THICKNESS_KM = 35.0
REFERENCE_AREA_KM2 = (111.0**2) * 100.0


def gaussian_kernel(distance_km, width_km) -> Column:
    """Across-arc kernel, 1/km, integrating to one over the real line."""
    d, w = as_column(distance_km), as_column(width_km)
    return F.exp(-0.5 * F.pow(d / w, 2)) / (w * math.sqrt(2.0 * math.pi))


def arc_source(distance_km, production_km2_per_myr, width_km=100.0) -> Column:
    """Areal source in km/Myr at a distance from the trench."""
    return as_column(production_km2_per_myr) * gaussian_kernel(distance_km, width_km)


def uniform_width_rate(production_km2_per_myr, width_km) -> Column:
    return as_column(production_km2_per_myr) / as_column(width_km)


def birth_thickness(production_km2_per_myr, full_rate_km_per_myr) -> Column:
    """Q/u, null below the spreading rate where the ratio stops being meaningful."""
    u = as_column(full_rate_km_per_myr)
    return F.when(u >= MIN_FULL_RATE_KM_PER_MYR, as_column(production_km2_per_myr) / u)


def normal_nll(x, mu=BIRTH_MEAN_KM, scale=BIRTH_SCALE_KM) -> Column:
    s = as_column(scale)
    z = (as_column(x) - as_column(mu)) / s
    return 0.5 * z * z + F.log(s) + 0.5 * math.log(2.0 * math.pi)


def backtracked_thickness(present_km, jacobian_from, jacobian_to) -> Column:
    """Thickness carried back by the ratio of cumulative Jacobians; null if not positive."""
    j0, j1 = as_column(jacobian_from), as_column(jacobian_to)
    return F.when((j0 > 0) & (j1 > 0), as_column(present_km) * j1 / j0)


def bounded_source(raw, lower, upper) -> Column:
    """Unbounded coefficient mapped into (lower, upper)."""
    lo, hi = as_column(lower), as_column(upper)
    return lo + (hi - lo) * (F.tanh(as_column(raw)) + 1.0) / 2.0


def normalised_residual(
    residual_km3, thickness_km=REFERENCE_THICKNESS_KM, area_km2=REFERENCE_AREA_KM2
) -> Column:
    return as_column(residual_km3) / (thickness_km * area_km2)


def softplus(x) -> Column:
    x = as_column(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def huber(error, beta) -> Column:
    """Smooth absolute error: quadratic inside beta, linear outside."""
    e, b = F.abs(as_column(error)), as_column(beta)
    return F.when(e < b, 0.5 * e * e / b).otherwise(e - 0.5 * b)
