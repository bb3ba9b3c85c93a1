"""Preparation: observations, modern grid and geometry to frozen tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chronology as chrono
from ..functions import grids
from ..operators import checks, fields, physics, polygons, records, rotations, splits
from ..operators import spherebins, trajectories
from ..functions import sphere
from ..functions.sphere import vec_columns, vec_of
from ..sources.storage import stored

CONTINENTAL_KM = 20.0
DISTANCE_SCALE_KM = 3000.0
REFERENCE_SCALE_KM = 40.0


def static_features(
    spark: SparkSession,
    modern: DataFrame,
    nlat: int,
    nlon: int,
    plates: DataFrame | None = None,
) -> DataFrame:
    """Feature columns on the Gauss nodes from the modern grid and optional plates.

    The thickness and the continental flag share one remap: both are averages with
    the same overlaps. With plates, the distance is to the nearest plate-edge cell.
    """
    mask = modern.withColumn(
        "value", (F.col("value") >= CONTINENTAL_KM).cast("double")
    )
    h = fields.conservative_remap(modern, nlat, nlon).withColumnRenamed("value", "h")
    m = fields.conservative_remap(mask, nlat, nlon).withColumnRenamed("value", "m")
    grid = grids.gauss_grid(spark, nlat, nlon).select("i", "j", "lat", "lon")
    cells = grid.join(h, ["i", "j"], "left").join(m, ["i", "j"], "left")
    if plates is None:
        cells = cells.withColumns({"edge_km": F.lit(0.0), "plate_id": F.lit(-1)})
    else:
        # Both tables have a row per cell and are read by every level of the search below.
        raster = stored(polygons.assign_plates(grid, plates)).withColumn("age_idx", F.lit(0))
        edged = stored(physics.plate_edges(raster))
        targets = edged.where("edge").select(
            F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat")
        )
        targets = targets.withColumns(vec_columns(sphere.unit_vector("t_lon", "t_lat"), "t_"))
        near = spherebins.nearest_distance(
            edged.select("i", "j", "lon", "lat", "plate_id"),
            targets,
            sphere.angle(vec_of("p_"), vec_of("t_")),
            point_keys=["i", "j"],
            cap_km=DISTANCE_SCALE_KM,
            out="edge_km",
        )
        cells = cells.join(near.select("i", "j", "edge_km", "plate_id"), ["i", "j"], "left")
    phi, lam = F.radians("lat"), F.radians("lon")
    return cells.select(
        "i",
        "j",
        "lat",
        "lon",
        F.sin(phi).alias("sin_lat"),
        (F.cos(phi) * F.cos(lam)).alias("cos_lat_cos_lon"),
        (F.cos(phi) * F.sin(lam)).alias("cos_lat_sin_lon"),
        (F.col("h") / REFERENCE_SCALE_KM).alias("modern_reference_div40"),
        (2.0 * F.col("m") - 1.0).alias("continental_mask"),
        F.least(F.col("edge_km") / DISTANCE_SCALE_KM, F.lit(1.0)).alias(
            "plate_boundary_distance_div3000"
        ),
        F.lit(0.0).alias("deformation_coverage"),
        F.pow(F.cos(phi), 2).alias("cos_lat_squared"),
        "plate_id",
    )


def repeat_over_ages(features: DataFrame, n_anchors: int) -> DataFrame:
    """The same features at every anchor (static geometry)."""
    return features.withColumn("age_idx", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))


def prepare(
    spark: SparkSession,
    obs: DataFrame,
    modern: DataFrame,
    *,
    nlat: int,
    nlon: int,
    step: float,
    max_age: float = 60.0,
    group: str | None = None,
    window: tuple[float, float] | None = None,
    max_width: float = 5.0,
    holdout: DataFrame | None = None,
    validation_fraction: float = 0.1,
    seed: int = 42,
    record_sigma: float = 4.0,
    continental_sigma: float = 3.0,
    thin_sigma: float = 3.0,
    modern_sigma: float = 3.0,
    include_flagged: bool = False,
    rotation_entries: DataFrame | None = None,
    static_plates: DataFrame | None = None,
    dynamic_features: DataFrame | None = None,
    registry: DataFrame | None = None,
) -> Mapping[str, DataFrame]:
    """Frozen tables ``records, nodes, features, modern``.

    With rotations and plates the nodes are moved to their past positions and a
    record with any node that cannot be moved is dropped whole. A held-out list with unknown or
    repeated ids or flags other than 0 and 1 is refused, and so is a test set without records.
    With a ``registry`` (source_id, source_sigma_km, source_bias_km) an unknown source is refused and
    every record carries its source's scale and bias; plates with rings of fewer than three vertices
    are refused.
    """
    paleo = rotation_entries is not None and static_plates is not None
    checks.checked_number("nlat", nlat, 4)
    checks.checked_number("nlon", nlon, 8)
    n_anchors = checks.anchor_count(max_age, step)
    if window is not None:
        checks.checked_window(window, max_age)
    checks.checked_number("validation_fraction", validation_fraction, 0, 1, open_high=True)
    checks.checked_number("max_width", max_width, 0)
    for name, sigma in (
        ("record_sigma", record_sigma),
        ("continental_sigma", continental_sigma),
        ("thin_sigma", thin_sigma),
        ("modern_sigma", modern_sigma),
    ):
        checks.checked_number(name, sigma, 0, open_low=True)
    flags = [c for c in records.DISQUALIFYING if c in obs.columns]
    checks.require_columns(obs, [*records.REQUIRED, *([group] if group else [])], flags)
    if holdout is not None:
        checks.must_be_empty(splits.holdout_problems(obs, holdout), "held-out list refused")
    if registry is not None:
        checks.must_be_empty(records.unregistered_sources(obs, registry), "unregistered sources")
    if paleo:
        checks.must_be_empty(polygons.short_rings(static_plates), "rings with fewer than three vertices")
    key = group
    rows = obs
    if group is None:
        rows = rows.withColumn("site", splits.site_key("present_lon", "present_lat"))
        key = "site"
    split = splits.assign_split(
        rows,
        key,
        window=window,
        max_width=max_width,
        holdout=holdout,
        validation_fraction=validation_fraction,
        seed=seed,
    )
    valid = split.where(records.valid_record(split.columns, include_flagged))
    if (window is not None or holdout is not None) and valid.where(F.col("split") == splits.TEST).isEmpty():
        raise checks.ContractError("no eligible record is left for the test set")
    sampled = fields.sample_one_field(
        valid,
        modern.select("i", "j", "value"),
        grids.NATIVE_NLAT,
        grids.NATIVE_NLON,
        grid="native",
        lon="present_lon",
        lat="present_lat",
        out="site_km",
    )
    source = F.when(F.col("site_km") >= CONTINENTAL_KM, continental_sigma).otherwise(thin_sigma)
    recs = sampled.withColumn("sigma", chrono.combined_scale(F.lit(record_sigma), source))
    if registry is not None:
        recs = records.register_sources(recs, registry, "sigma")
    domain = (0.0, float(max_age))
    nodes = records.explode_nodes(
        valid, ["observation_id", "present_lon", "present_lat"], domain=domain
    )
    if paleo:
        located = polygons.assign_plates(
            nodes.withColumnsRenamed({"present_lon": "lon", "present_lat": "lat"}), static_plates
        )
        moved = rotations.reconstruct(located, rotation_entries, age="node_age")
        nodes = trajectories.drop_failed_records(moved, "ok").withColumnsRenamed(
            {"rec_lon": "node_lon", "rec_lat": "node_lat"}
        )
    else:
        nodes = nodes.withColumnsRenamed({"present_lon": "node_lon", "present_lat": "node_lat"})
    nodes = nodes.select(
        "observation_id", "node_idx", "node_age", "node_weight", "node_lon", "node_lat"
    )
    kept = recs.join(nodes.select("observation_id").distinct(), "observation_id", "left_semi")
    features = dynamic_features
    if features is None:
        features = repeat_over_ages(
            static_features(spark, modern, nlat, nlon, static_plates), n_anchors
        )
    endpoint = modern.withColumns(
        {"sigma": F.lit(float(modern_sigma)), "block": splits.spatial_block("lon", "lat")}
    )
    return {"records": kept, "nodes": nodes, "features": features, "modern": endpoint}
