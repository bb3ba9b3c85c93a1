"""Real orthonormal spherical harmonics as expressions.

Every associated Legendre function is (cos lat)^m times a polynomial in sin lat.
The polynomial is worked out once on the driver with exact integers and becomes a
Horner expression, so its size grows with the degree and not with a recursion.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import as_column

MAX_EXPRESSION_DEGREE = 8


def terms(lmax: int) -> list[tuple[int, int, str]]:
    """(degree, order, kind) of the (lmax + 1)^2 terms, in storage order."""
    out = []
    for degree in range(lmax + 1):
        out.append((degree, 0, "cos"))
        for m in range(1, degree + 1):
            out += [(degree, m, "cos"), (degree, m, "sin")]
    return out


def coefficient_count(lmax: int) -> int:
    return (lmax + 1) ** 2


def normaliser(degree: int, order: int) -> float:
    ratio = math.factorial(degree - order) / math.factorial(degree + order)
    pair = 2.0 if order > 0 else 1.0
    return math.sqrt((2 * degree + 1) / (4.0 * math.pi) * ratio * pair)


@lru_cache(maxsize=None)
def legendre_polynomial(degree: int, order: int) -> tuple[float, ...]:
    """Coefficients c_k of sum c_k x^k in P = (-1)^m (1 - x^2)^(m/2) d^m P_l / dx^m."""
    # P_l(x) = 2^-l sum_k (-1)^k C(l,k) C(2l-2k,l) x^(l-2k), differentiated m times.
    c = [Fraction(0)] * (degree + 1)
    for k in range(degree // 2 + 1):
        c[degree - 2 * k] = Fraction(
            (-1) ** k * math.comb(degree, k) * math.comb(2 * degree - 2 * k, degree), 2**degree
        )
    for _ in range(order):
        c = [n * c[n] for n in range(1, len(c))]
    return tuple(float((-1) ** order * v) for v in c)


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = total * x + float(c)
    return total


def term(degree: int, order: int, kind: str, lon, lat) -> Column:
    """One real harmonic at a point."""
    phi, lam = F.radians(as_column(lat)), F.radians(as_column(lon))
    value = _horner(legendre_polynomial(degree, order), F.sin(phi)) * normaliser(degree, order)
    if order == 0:
        return value
    wave = F.cos(lam * order) if kind == "cos" else F.sin(lam * order)
    return value * F.pow(F.cos(phi), order) * wave


def basis(lmax: int, lon="lon", lat="lat") -> Column:
    """``array<double>`` of all terms; degrees above the expression limit use Arrow batches."""
    if lmax <= MAX_EXPRESSION_DEGREE:
        return F.array(*[term(*t, lon, lat) for t in terms(lmax)])
    return _basis_udf(lmax)(as_column(lon), as_column(lat))


def basis_matrix(lmax: int, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Rows of all terms for numpy batches, by a recursion on normalised functions."""
    x, lam = np.sin(np.radians(lat)), np.radians(lon)
    s = np.sqrt(np.maximum(0.0, 1.0 - x * x))
    values: dict[tuple[int, int], np.ndarray] = {(0, 0): np.full_like(x, math.sqrt(0.25 / math.pi))}
    for m in range(lmax + 1):
        if m > 0:
            values[m, m] = -math.sqrt((2 * m + 1) / (2.0 * m)) * s * values[m - 1, m - 1]
        if m < lmax:
            values[m + 1, m] = math.sqrt(2 * m + 3.0) * x * values[m, m]
        for n in range(m + 2, lmax + 1):
            up = math.sqrt((4.0 * n * n - 1) / (n * n - m * m))
            down = math.sqrt(((n - 1.0) ** 2 - m * m) / (4.0 * (n - 1) ** 2 - 1))
            values[n, m] = up * (x * values[n - 1, m] - down * values[n - 2, m])
    columns = []
    for degree, m, kind in terms(lmax):
        wave = np.cos(m * lam) if kind == "cos" else np.sin(m * lam)
        columns.append(values[degree, m] * wave * (math.sqrt(2.0) if m else 1.0))
    return np.stack(columns, axis=1)


def _basis_udf(lmax: int):
    @F.pandas_udf("array<double>")
    def evaluate(lon: pd.Series, lat: pd.Series) -> pd.Series:
        rows = basis_matrix(lmax, lon.to_numpy(float), lat.to_numpy(float))
        return pd.Series(list(rows))

    return evaluate


def synthesis(basis_array, coefficients) -> Column:
    """Inner product of a basis array and a coefficient array."""
    products = F.zip_with(basis_array, coefficients, lambda y, c: y * c)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def inverse_laplacian(degree, coefficient) -> Column:
    """Spectral solution of Laplacian(psi) = field; the mean has no solution and gives 0."""
    n = as_column(degree)
    return F.when(n > 0, as_column(coefficient) / (-(n * (n + 1.0)))).otherwise(0.0)
