"""Manufactured observations with a known analytic truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chronology import hash_uniform, t4_quantile
from ..functions.units import as_column


def truth(lon, lat, age) -> Column:
    """Analytic thickness in km; smooth in space, linear in age."""
    phi, lam = F.radians(as_column(lat)), F.radians(as_column(lon))
    return 7.0 + 0.8 * F.cos(phi) * F.cos(lam) + 0.02 * (60.0 - as_column(age))


def observations(spark: SparkSession, n: int, seed: int = 123, noise_km: float = 0.15) -> DataFrame:
    """``n`` observations; every value is a hash of (seed, row), so any task can make it."""
    u = lambda name: hash_uniform(seed, F.lit(name), F.col("id"))
    width = F.get(F.lit([0.0, 2.0, 8.0]), F.floor(u("width") * 3).cast("int"))
    centre = 2.0 + 56.0 * u("age")
    rows = spark.range(n).select(
        F.format_string("demo%04d", "id").alias("observation_id"),
        (u("lon") * 360.0 - 180.0).alias("present_lon"),
        (u("lat") * 130.0 - 65.0).alias("present_lat"),
        F.greatest(F.lit(0.0), centre - width / 2).alias("age_lower_ma"),
        F.least(F.lit(60.0), centre + width / 2).alias("age_upper_ma"),
        u("true").alias("_t"),
        u("noise").alias("_n"),
    )
    age = F.col("age_lower_ma") + F.col("_t") * (F.col("age_upper_ma") - F.col("age_lower_ma"))
    eps = F.lit(noise_km) * t4_quantile(F.col("_n") + 0.5 / 4294967296.0) / 2.0**0.5
    return rows.withColumn(
        "thickness_km", truth("present_lon", "present_lat", age) + eps
    ).drop("_t", "_n")


def modern_grid_lines(spark: SparkSession) -> DataFrame:
    """The modern grid of the same truth as text lines ``lon lat -thickness``."""
    from ..functions.grids import native_grid

    g = native_grid(spark)
    h = truth("lon", "lat", 0.0)
    return g.select("i", "j", F.format_string("%.7f %.7f %.7f", "lon", "lat", -h).alias("value"))
