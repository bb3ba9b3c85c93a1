"""Per-age geometry features from resolved polygon snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, polygons, rotations
from ..sources.storage import stored
from .prepare import DISTANCE_SCALE_KM, REFERENCE_SCALE_KM


def dynamic_features(
    base: DataFrame,
    modern: DataFrame,
    plates: DataFrame,
    networks: DataFrame,
    continents: DataFrame,
    entries: DataFrame,
    *,
    step: float,
    n_anchors: int,
) -> DataFrame:
    """Feature rows for every anchor from same-age polygons.

    ``base`` is the static feature table; ``plates``, ``networks`` and ``continents``
    are polygon tables with ``age_idx`` (already in past coordinates), ``plate_id``
    and ``priority``. Networks override plates. The reference is the modern value
    found by rotating a cell back; it is zero where that is not supported. A ring with fewer than
    three vertices and an anchor without any outline are refused.
    """
    # Read by every check, join and search below; their rotations are worked out once.
    plates, networks, continents = (stored(t) for t in (plates, networks, continents))
    for name, polygon_table in (("plates", plates), ("networks", networks), ("continents", continents)):
        short = polygons.short_rings(polygon_table, [*polygons.RING, "age_idx"])
        checks.must_be_empty(short, f"{name}: rings with fewer than three vertices")
    outlined = plates.select("age_idx").unionByName(networks.select("age_idx"))
    checks.must_be_empty(require_boundaries(outlined, n_anchors), "anchors without any outline")
    cells = base.withColumn(
        "age_idx", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))
    ).drop("plate_id")
    by = ["age_idx"]
    places = cells.select("age_idx", "i", "j", "lon", "lat")
    located = polygons.override_ids(_covers(places, {"p": plates, "n": networks, "c": continents}), "n", "p").withColumn(
        "age", F.col("age_idx") * float(step)
    )
    shared = [c for c in polygons.RING] + ["role", "vertex", "lon", "lat", "age_idx"]
    # Network outlines are named apart, so a shared feature id stays two features.
    outlines = plates.select(*shared).unionByName(
        networks.select(*shared).withColumn("feature_id", F.concat(F.lit("n:"), "feature_id"))
    )
    distance = polygons.boundary_vertex_distance(
        places, outlines, point_keys=["i", "j"], by=by, cap_km=DISTANCE_SCALE_KM
    ).select(*by, "i", "j", "boundary_km")
    reference = rotations.material_reference(located, entries, modern).select(
        *by, "i", "j", "plate_id", "in_network", "c", "supported", "reference_km"
    )
    keys = ["age_idx", "i", "j"]
    joined = cells.join(distance, keys).join(reference, keys)
    return joined.withColumns(
        {
            "modern_reference_div40": F.coalesce("reference_km", F.lit(0.0)) / REFERENCE_SCALE_KM,
            "continental_mask": 2.0 * (F.col("c") >= 0).cast("double") - 1.0,
            "plate_boundary_distance_div3000": F.col("boundary_km") / DISTANCE_SCALE_KM,
            "deformation_coverage": F.col("in_network").cast("double"),
        }
    ).drop("boundary_km", "reference_km", "c", "in_network")


def _covers(places: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """``places`` with the plate of every layer of polygons at each, -1 if none.

    The layers are a key of one containment search, whose fixed cost is its many stages.
    """
    columns = [*polygons.RING, "role", "vertex", "lon", "lat", "plate_id", "priority", "age_idx"]
    stacked = None
    for name, table in layers.items():
        rows = table.select(*columns).withColumn("layer", F.lit(name))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    # Rings are told apart by their keys alone, and layers may share feature ids.
    stacked = stacked.withColumn("feature_id", F.concat_ws(":", "layer", F.col("feature_id").cast("string")))
    asked = places.withColumn("layer", F.explode(F.array(*[F.lit(name) for name in layers])))
    found = polygons.assign_plates(asked, stacked, by=["age_idx", "layer"], out="found")
    return found.groupBy(*places.columns).agg(
        *[F.max(F.when(F.col("layer") == name, F.col("found"))).alias(name) for name in layers]
    )


def require_boundaries(vertices: DataFrame, n_anchors: int) -> DataFrame:
    """Anchors without any outline (must be empty before distances are used)."""
    spark = vertices.sparkSession
    anchors = spark.range(n_anchors).select(F.col("id").cast("int").alias("age_idx"))
    return anchors.join(vertices.select("age_idx").distinct(), "age_idx", "left_anti")
