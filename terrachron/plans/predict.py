"""Prediction at points or on the native grid, and its export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import checks, fields
from ..sources import tables, text


def predict_points(
    points: DataFrame, field: DataFrame, nlat: int, nlon: int, step: float, n_anchors: int
) -> DataFrame:
    """Add ``thickness_km`` to (longitude, latitude, age_ma) rows.

    Coordinates are positions at the queried age. Rows that cannot be queried get null.
    """
    return fields.sample_fields(
        points, field, nlat, nlon, step, n_anchors,
        lon="longitude", lat="latitude", age="age_ma",
    ).withColumnRenamed("value", "thickness_km")


def predict_csv(
    spark: SparkSession, source: str, target: str, field: DataFrame, nlat: int, nlon: int,
    step: float, n_anchors: int,
) -> None:
    points = tables.read_point_queries(spark, source)
    tables.write_csv(predict_points(points, field, nlat, nlon, step, n_anchors), target)


def predict_grid(
    spark: SparkSession, ages: Sequence[float], field: DataFrame, features: DataFrame | None,
    nlat: int, nlon: int, step: float, n_anchors: int,
) -> DataFrame:
    """Every native cell at every requested age, with geometry when features are given."""
    top = step * (n_anchors - 1)
    if not ages or any(not 0 <= a <= top for a in ages):
        raise ValueError(f"ages must lie in [0, {top}]")
    cells = grids.native_grid(spark).select("i", "j", "lat", "lon")
    wanted = cells.withColumn("age", F.explode(F.lit([float(a) for a in ages])))
    out = fields.sample_fields(wanted, field, nlat, nlon, step, n_anchors)
    if features is not None:
        out = fields.predict_geometry(out, features, nlat, nlon, step, n_anchors)
    return out


def export_grid(grid: DataFrame, path: str) -> None:
    """Text lines per age; refuses fields with missing or nonpositive values."""
    bad = grid.where(~F.coalesce((F.col("value") > 0) & ~F.isnan("value"), F.lit(False)))
    checks.must_be_empty(bad, "prediction has unusable values")
    text.write_grid_text(grid, path)
