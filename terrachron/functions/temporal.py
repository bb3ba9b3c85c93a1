"""Anchor weights and the Gaussian-process tables over a short list of ages."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import as_column

MAX_AGES = 256


def anchor_weights(age, step: float, n_anchors: int) -> Column:
    """``array<struct<anchor, w>>`` of the one or two anchors around an age.

    Weights sum to one; an age outside the anchors gives null.
    """
    at = as_column(age) / step
    low = F.floor(at).cast("int")
    f = at - low

    def entry(anchor: Column, w: Column) -> Column:
        return F.struct(anchor.cast("int").alias("anchor"), w.cast("double").alias("w"))

    inner = F.array(entry(low, 1.0 - f), entry(low + 1, f))
    last = F.array(entry(low, F.lit(1.0)))
    return F.when((low >= 0) & (low + 1 < n_anchors), inner).when(low == n_anchors - 1, last)


def gp_cholesky(
    ages: Sequence[float], lengthscale: float, amplitude: float = 1.0, jitter: float = 1e-5
) -> np.ndarray:
    """Lower Cholesky factor of the squared-exponential covariance over the age list.

    The list is the anchor ages (at most 61 in the domain), so the matrix is a
    driver-side constant, like the quadrature nodes of a grid.
    """
    a = np.asarray(ages, dtype=float)
    if a.ndim != 1 or not 2 <= len(a) <= MAX_AGES or not (np.diff(a) > 0).all():
        raise ValueError("ages must be a short, strictly increasing list")
    if min(lengthscale, amplitude, jitter) <= 0 or not np.isfinite(a).all():
        raise ValueError("length scale, amplitude and jitter must be positive")
    distance = (a[:, None] - a[None, :]) / lengthscale
    covariance = np.exp(-0.5 * distance**2) + jitter * np.eye(len(a))
    return np.linalg.cholesky(amplitude**2 * covariance)


def whitening_matrix(
    ages: Sequence[float], lengthscale: float, amplitude: float = 1.0, jitter: float = 1e-5
) -> np.ndarray:
    return np.linalg.inv(gp_cholesky(ages, lengthscale, amplitude, jitter))


def matrix_literal(matrix: np.ndarray) -> Column:
    return F.lit([[float(v) for v in row] for row in matrix])


def rbf_covariance(age_a, age_b, lengthscale: float, amplitude: float = 1.0) -> Column:
    d = (as_column(age_a) - as_column(age_b)) / lengthscale
    return F.exp(-0.5 * d * d) * float(amplitude) ** 2


def latent_scale(scale_km: float, spatial_rank: int, context_rank: int) -> float:
    return scale_km / math.sqrt(spatial_rank * context_rank)
