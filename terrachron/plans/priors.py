"""Source-free rigid-interior priors from a frozen dataset and a rotation model."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import EARTH_RADIUS_KM
from ..operators import fields, physics, polygons, rotations, trajectories
from ..sources.storage import cut_lineage

# Fixed values of the support policy.
MIN_CONTINENTAL = 0.75
MAX_NETWORK = 0.01
MAX_ABS_LAT = 75.0
PATH_AGES = 7
PATCH_OFFSETS = ((-0.25, -0.25), (0.25, -0.25), (-0.25, 0.25), (0.25, 0.25))
REFERENCE_KM = 35.0


def rigid_priors(
    spark: SparkSession,
    features: DataFrame,
    modern: DataFrame,
    static_plates: DataFrame,
    entries: DataFrame,
    *,
    nlat: int,
    nlon: int,
    step: float,
    n_anchors: int,
    max_regions: int | None = None,
    min_edge_km: float = 500.0,
) -> Mapping[str, DataFrame]:
    """Trajectory and budget factors in supported plate interiors.

    ``features`` is the frozen feature table of all anchors. A region is kept only if
    every point of its path can be reconstructed and stays inside the support at
    every path age. Plates alternate between the two roles, so one plate's rotation
    is used once.
    """
    max_age = step * (n_anchors - 1)
    # Feature and candidate tables are grids that several joins below read again.
    features = cut_lineage(features)
    mask = modern.withColumn("value", (F.col("value") >= 20.0).cast("double"))
    continental = fields.conservative_remap(mask, nlat, nlon).withColumnRenamed("value", "m")
    inner = (
        features.where(F.col("age_idx") == 0)
        .join(continental, ["i", "j"])
        .where(
            (F.col("m") > MIN_CONTINENTAL)
            & (F.col("plate_boundary_distance_div3000") * 3000.0 >= min_edge_km)
            & (F.col("deformation_coverage") < MAX_NETWORK)
            & (F.abs("lat") < MAX_ABS_LAT)
        )
        .select("i", "j", "lon", "lat")
    )
    located = polygons.assign_plates(inner, static_plates).where(F.col("plate_id") >= 0)
    candidates = cut_lineage(located)
    chosen = cut_lineage(physics.balanced_regions(candidates, max_regions))
    region = F.col("i") * nlon + F.col("j")
    ages = [max_age * (1 - k / (PATH_AGES - 1)) for k in range(PATH_AGES)]
    corners = F.array(
        *[
            F.struct(F.lit(k).alias("point"), F.lit(a).alias("dx"), F.lit(b).alias("dy"))
            for k, (a, b) in enumerate(PATCH_OFFSETS)
        ]
    )
    centre = F.array(F.struct(F.lit(0).alias("point"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))
    paths = (
        chosen.withColumn(
            "o", F.explode(F.when(F.col("role") == "trajectory", centre).otherwise(corners))
        )
        .select(
            region.cast("long").alias("factor_id"),
            "plate_id",
            "role",
            F.col("lat").alias("centre_lat"),
            "o.point",
            (F.col("lon") + F.col("o.dx")).alias("lon"),
            (F.col("lat") + F.col("o.dy")).alias("lat"),
        )
    )
    # A patch must lie on one plate.
    own = polygons.assign_plates(paths, static_plates, out="_own").withColumn(
        "same", F.col("_own") == F.col("plate_id")
    )
    own = cut_lineage(own)  # else the plans of all that follows hold this search several times
    timed = own.withColumn("age", F.explode(F.lit(ages)))
    moved = rotations.reconstruct(timed, entries)
    support = fields.sample_fields(
        moved,
        features,
        nlat,
        nlon,
        step,
        n_anchors,
        values=["plate_boundary_distance_div3000", "deformation_coverage"],
        lon="rec_lon",
        lat="rec_lat",
    )
    good = (
        F.col("ok")
        & F.col("same")
        & (F.col("plate_boundary_distance_div3000") * 3000.0 >= min_edge_km)
        & (F.col("deformation_coverage") <= MAX_NETWORK)
    )
    kept = trajectories.drop_failed_records(
        cut_lineage(support.withColumn("_good", good)), "_good", "factor_id"
    )
    phi = F.radians("centre_lat")
    half = math.radians(0.5)
    area = (F.sin(phi + half) - F.sin(phi - half)) * (EARTH_RADIUS_KM**2 * math.radians(1.0))
    base = kept.select(
        "factor_id",
        F.concat(F.lit("rigid_plate_"), F.col("plate_id").cast("string")).alias("evidence_id"),
        "role",
        "age",
        "point",
        F.col("rec_lon").alias("lon"),
        F.col("rec_lat").alias("lat"),
        area.alias("_area"),
    )
    paths_out = base.where("role = 'trajectory'").select(
        "factor_id", "evidence_id", "age", "lon", "lat",
        F.lit(0.0).alias("divergence"), F.lit(0.0).alias("source"), F.lit(10.0).alias("sigma"),
        F.lit(True).alias("active"), F.lit(True).alias("source_known"),
    )
    interior = base.where("role = 'budget'").select(
        "factor_id", "evidence_id", "age", "point", "lon", "lat",
        (F.col("_area") / 4.0).alias("area_km2"), F.lit(0.0).alias("source"),
        (F.col("_area") * REFERENCE_KM).alias("reference_km3"), F.lit(0.2).alias("sigma"),
        F.lit(True).alias("active"), F.lit(True).alias("source_known"),
        F.lit(True).alias("flux_known"),
    )
    boundary = interior.select(
        "factor_id", "age", "point", "lon", "lat",
        F.lit(0.0).alias("rel_normal_velocity"), F.lit(1.0).alias("length_km"),
    )
    return {"trajectory": paths_out, "interior": interior, "boundary": boundary}
