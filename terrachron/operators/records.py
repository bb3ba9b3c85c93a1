"""Observation records: standardising, flags, filters and age nodes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chronology as chrono
from ..functions.sphere import wrap180
from ..functions.units import AGE_DOMAIN_MA

# Flags that bar a record, and flags that are only counted.
DISQUALIFYING = (
    "qc_coords_out_of_range",
    "qc_negative_age",
    "qc_thickness_lt2",
    "qc_point_age_outside_domain",
)
COUNTED = ("qc_thickness_gt80", "qc_thickness_gt100")

REQUIRED = (
    "observation_id",
    "present_lon",
    "present_lat",
    "age_lower_ma",
    "age_upper_ma",
    "thickness_km",
)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Remove rows equal in every column."""
    return df.dropDuplicates()


def _number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def standardise(raw: DataFrame, headers: Mapping[str, str], domain=AGE_DOMAIN_MA) -> DataFrame:
    """Raw table -> observation table with ordered bounds, labels and flags.

    ``headers`` maps ``lat lon age_lo age_hi age_rep thickness`` (and optionally
    ``epoch``) to the raw column names. The id is a digest of the whole row, so
    it does not depend on row order or on partitioning.
    """
    rows = drop_exact_duplicates(raw)
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])), 256)
    paleo = [F.col(f"`{c}`") for c in raw.columns if c.startswith("paleo_lon")]
    has_paleo = F.coalesce(*[c.cast("string") for c in paleo]).isNotNull() if paleo else F.lit(False)
    epoch = F.col(headers["epoch"]).cast("string") if "epoch" in headers else F.lit("")
    a, b = _number(headers["age_lo"]), _number(headers["age_hi"])
    base = rows.select(
        F.concat(F.lit("obs"), F.substring(digest, 1, 16)).alias("observation_id"),
        F.lit(True).alias("source_unverified"),
        _number(headers["lon"]).alias("present_lon"),
        _number(headers["lat"]).alias("present_lat"),
        F.least(a, b).alias("age_lower_ma"),
        F.greatest(a, b).alias("age_upper_ma"),
        _number(headers["age_rep"]).alias("age_representative_ma"),
        epoch.alias("epoch_label"),
        _number(headers["thickness"]).alias("thickness_km"),
        has_paleo.alias("has_paleo_coordinates"),
    )
    return with_quality_flags(base, domain)


def with_quality_flags(obs: DataFrame, domain=AGE_DOMAIN_MA) -> DataFrame:
    """Interval label, width, node count, clipped mass and the quality flags."""
    lo, hi, rep = F.col("age_lower_ma"), F.col("age_upper_ma"), F.col("age_representative_ma")
    h = F.col("thickness_km")
    k = chrono.node_count(lo, hi)
    in_range = F.col("present_lon").between(-180, 360) & F.col("present_lat").between(-90, 90)

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    return obs.withColumns(
        {
            "age_width_myr": hi - lo,
            "age_semantics": chrono.age_semantics(lo, hi, domain),
            "qc_thickness_gt80": flag(h > 80),
            "qc_thickness_gt100": flag(h > 100),
            "qc_thickness_lt2": flag(h < 2),
            "qc_negative_age": flag(rep < 0),
            "qc_coords_out_of_range": ~flag(in_range),
            "qc_age_interval_covers_domain": flag((lo <= domain[0]) & (hi >= domain[1])),
            "qc_point_age_outside_domain": flag(
                chrono.age_semantics(lo, hi, domain) == "point_outside"
            ),
            "age_nodes_k": F.coalesce(F.size(chrono.age_nodes(lo, hi, k, domain)), F.lit(0)),
            "age_clipped_mass": F.coalesce(chrono.clipped_mass(lo, hi, domain), F.lit(0.0)),
        }
    )


def primary_evidence(max_flags: int = 0) -> Column:
    """Predicate: no disqualifying flag and at most ``max_flags`` counted flags."""
    barred = F.lit(False)
    for name in DISQUALIFYING:
        barred = barred | F.col(name)
    counted = sum((F.col(name).cast("int") for name in COUNTED), F.lit(0))
    return ~barred & (counted <= max_flags)


def valid_record(columns=(), include_flagged: bool = False) -> Column:
    """Predicate: finite numbers, a real latitude, positive thickness, no barred flag."""

    def finite(name: str) -> Column:
        c = F.col(name)
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    ok = F.lit(True)
    for name in REQUIRED[1:]:
        ok = ok & finite(name)
    ok = ok & (F.abs(F.col("present_lat")) <= 90) & (F.col("thickness_km") > 0)
    if not include_flagged:
        for name in DISQUALIFYING:
            if name in columns:
                ok = ok & ~F.col(name)
    return F.coalesce(ok, F.lit(False))


def explode_nodes(
    records: DataFrame,
    keep,
    count: Column | None = None,
    domain=AGE_DOMAIN_MA,
    distribution: str = "uniform",
) -> DataFrame:
    """One row per (record, quadrature node); narrow, no shuffle.

    Records outside the domain give no rows.
    """
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    k = chrono.node_count(lo, hi) if count is None else count
    nodes = chrono.age_nodes(lo, hi, k, domain, distribution)
    return records.select(*keep, F.posexplode(nodes).alias("node_idx", "node")).select(
        *keep,
        "node_idx",
        F.col("node.age").alias("node_age"),
        F.col("node.weight").alias("node_weight"),
    )


def comparison_features(obs: DataFrame, point_age: bool = False) -> DataFrame:
    """Feature rows of the point-age or the interval-midpoint variant."""
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    age = F.col("age_representative_ma") if point_age else (lo + hi) / 2.0
    return obs.select(
        "observation_id",
        F.col("present_lon").alias("lon"),
        F.col("present_lat").alias("lat"),
        F.sin(F.radians("present_lat")).alias("sin_lat"),
        age.alias("age"),
        (hi - lo).alias("age_width"),
        "thickness_km",
        F.lit("point_age" if point_age else "interval_midpoint").alias("variant"),
    )


def evidence_class(distance_km, width_myr, kinematic=1.0, process=0.0) -> Column:
    """Evidence tier of a point or a cell."""
    from ..functions.units import as_column as col

    near = (col(distance_km) <= 200.0) & (col(width_myr) <= 10.0)
    physical = (col(kinematic) >= 0.9) & (col(process) >= 0.5)
    return (
        F.when(near, "observation_supported")
        .when(physical, "physics_supported")
        .otherwise("prior_dominated")
    )


def register_sources(records: DataFrame, registry: DataFrame, record_sigma=4.0) -> DataFrame:
    """Attach source scale and bias by ``source_id``; ``effective_sigma_km`` is null if unknown."""
    sigma = F.col(record_sigma) if isinstance(record_sigma, str) else F.lit(float(record_sigma))
    return records.join(registry, "source_id", "left").withColumns(
        {
            "effective_sigma_km": chrono.combined_scale(sigma, "source_sigma_km"),
            "source_bias_km": F.coalesce("source_bias_km", F.lit(0.0)),
        }
    )


def unregistered_sources(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct source ids without a registered scale; must be empty before scoring."""
    return records.select("source_id").distinct().join(registry, "source_id", "left_anti")
