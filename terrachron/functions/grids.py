"""Latitude-longitude and Gauss grids.

A Gauss grid of ``nlat`` rows is described by at most a few hundred latitudes;
those are literals inside expressions, never a join. Rows are numbered from
north to south and longitudes start at zero, as stored fields are.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sphere import clip, wrap360
from .units import EARTH_RADIUS_KM, as_column

NATIVE_NLAT, NATIVE_NLON = 180, 360
MAX_GRID_ROWS = 2048


class GridShape(NamedTuple):
    nlat: int
    nlon: int

    def check(self) -> "GridShape":
        if not (4 <= self.nlat <= MAX_GRID_ROWS and 8 <= self.nlon <= 2 * MAX_GRID_ROWS):
            raise ValueError(f"grid must have at least 4x8 and at most {MAX_GRID_ROWS} rows")
        return self


@lru_cache(maxsize=32)
def gauss_latitudes(nlat: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(latitudes, quadrature weights), south to north."""
    x, w = np.polynomial.legendre.leggauss(nlat)
    return tuple(np.degrees(np.arcsin(x)).tolist()), tuple(w.tolist())


@lru_cache(maxsize=32)
def gauss_edges(nlat: int) -> tuple[float, ...]:
    """Sines of the row edges, south to north; row areas equal the quadrature weights."""
    _, w = gauss_latitudes(nlat)
    return tuple(np.clip(np.concatenate([[-1.0], -1.0 + np.cumsum(w)]), -1.0, 1.0).tolist())


def _pick(values, index: Column) -> Column:
    """values[index] for a short literal list and a zero-based index column."""
    return F.get(F.lit([float(v) for v in values]), index.cast("int"))


def native_latitude(i) -> Column:
    return as_column(i) - 89.5


def native_longitude(j) -> Column:
    return as_column(j) + 0.5


def native_cell_area(i) -> Column:
    """Area of a one-degree cell in row i, counted from the south."""
    south = as_column(i) - 90.0
    band = F.sin(F.radians(south + 1.0)) - F.sin(F.radians(south))
    return band * (EARTH_RADIUS_KM**2 * math.pi / 180.0)


def native_grid(spark: SparkSession) -> DataFrame:
    """One row per one-degree cell, rows counted from the south."""
    cells = spark.range(NATIVE_NLAT * NATIVE_NLON)
    i = F.floor(F.col("id") / NATIVE_NLON).cast("int")
    j = (F.col("id") % NATIVE_NLON).cast("int")
    return cells.select(i.alias("i"), j.alias("j")).select(
        "i",
        "j",
        native_latitude("i").alias("lat"),
        native_longitude("j").alias("lon"),
        native_cell_area("i").alias("area_km2"),
    )


def gauss_latitude(i, nlat: int) -> Column:
    """Latitude of row i counted from the north."""
    return _pick(gauss_latitudes(nlat)[0][::-1], as_column(i))


def gauss_weight(i, nlat: int) -> Column:
    return _pick(gauss_latitudes(nlat)[1][::-1], as_column(i))


def gauss_longitude(j, nlon: int) -> Column:
    return as_column(j) * (360.0 / nlon)


def gauss_cell_area(i, nlat: int, nlon: int) -> Column:
    return gauss_weight(i, nlat) * (EARTH_RADIUS_KM**2 * 2.0 * math.pi / nlon)


def gauss_grid(spark: SparkSession, nlat: int, nlon: int) -> DataFrame:
    """Cells of a Gauss grid with centres, bounds and areas."""
    GridShape(nlat, nlon).check()
    edges = gauss_edges(nlat)[::-1]
    i = F.floor(F.col("id") / nlon).cast("int")
    j = (F.col("id") % nlon).cast("int")
    step = 360.0 / nlon
    return (
        spark.range(nlat * nlon)
        .select(i.alias("i"), j.alias("j"))
        .select(
            "i",
            "j",
            gauss_latitude("i", nlat).alias("lat"),
            gauss_longitude("j", nlon).alias("lon"),
            gauss_cell_area("i", nlat, nlon).alias("area_km2"),
            F.degrees(F.asin(_pick(edges, F.col("i") + 1))).alias("lat_lo"),
            F.degrees(F.asin(_pick(edges, F.col("i")))).alias("lat_hi"),
            (gauss_longitude("j", nlon) - step / 2).alias("lon_lo"),
            (gauss_longitude("j", nlon) + step / 2).alias("lon_hi"),
        )
    )


class RowPosition(NamedTuple):
    """Lower row index and the fraction toward the next row."""

    index: Column
    fraction: Column


def gauss_row(lat, nlat: int) -> RowPosition:
    """Position of a latitude between Gauss rows, clamped at the outermost rows.

    Gauss colatitudes are close to 180 (r + 3/4) / (n + 1/2), so one guess and a
    comparison with the two literal neighbours finds the row in constant time.
    """
    lat = as_column(lat)
    north_first = gauss_latitudes(nlat)[0][::-1]
    guess = clip(F.floor((90.0 - lat) / 180.0 * (nlat + 0.5) - 0.75), 0, nlat - 2).cast("int")
    row = (
        F.when(lat > _pick(north_first, guess), guess - 1)
        .when(lat <= _pick(north_first, guess + 1), guess + 1)
        .otherwise(guess)
    )
    index = clip(row, 0, nlat - 2).cast("int")
    top, bottom = _pick(north_first, index), _pick(north_first, index + 1)
    return RowPosition(index, clip((top - lat) / (top - bottom), 0.0, 1.0))


def native_row(lat) -> RowPosition:
    """Position between one-degree rows, rows counted from the south."""
    at = clip(as_column(lat) + 89.5, 0.0, NATIVE_NLAT - 1.0)
    index = clip(F.floor(at), 0, NATIVE_NLAT - 2).cast("int")
    return RowPosition(index, at - index)


def periodic_column(lon, nlon: int, first_lon: float = 0.0) -> RowPosition:
    """Position between meridians on the full circle."""
    at = wrap360(as_column(lon) - first_lon) / (360.0 / nlon)
    index = F.floor(at)
    return RowPosition(F.pmod(index, F.lit(nlon)).cast("int"), at - index)


def anchor_position(age, step: float, n_anchors: int) -> RowPosition:
    """Lower anchor and fraction; ages outside the anchors give null."""
    age = as_column(age)
    inside = (age >= 0) & (age <= step * (n_anchors - 1))
    at = age / step
    index = clip(F.floor(at), 0, n_anchors - 2).cast("int")
    return RowPosition(F.when(inside, index), F.when(inside, at - index))
