"""Leakage-safe splits: site clusters, spatial blocks, age windows, held-out ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sphere import clip, wrap180
from ..functions.units import EARTH_RADIUS_KM, as_column
from . import ordering

# Fixed value: kilometres in a degree of latitude for the site hash.
KM_PER_DEGREE = 111.32
BUFFER, TRAIN, VALIDATION, TEST = -1, 0, 1, 2


# --- site clusters and spatial blocks ----------------------------------------


def site_keys(lon, lat, min_sep_km: float = 100.0) -> tuple[Column, Column]:
    """(latitude key, longitude key) of the site cell; half values round to even."""
    step = max(float(min_sep_km) / KM_PER_DEGREE, 1e-6)
    return (
        F.rint(as_column(lat) / step).cast("long"),
        F.rint(wrap180(lon) / step).cast("long"),
    )


def site_key(lon, lat, min_sep_km: float = 100.0) -> Column:
    """One integer per site cell, ordered by latitude key and then longitude key."""
    a, b = site_keys(lon, lat, min_sep_km)
    return a * F.lit(2**32) + b


def with_site_cluster(obs: DataFrame, min_sep_km: float = 100.0) -> DataFrame:
    """Add a dense ``site_cluster`` id. Ids are ranked on the distinct cells only."""
    keyed = obs.withColumn("_site", site_key("present_lon", "present_lat", min_sep_km))
    ids = ordering.dense_ids(keyed, "_site", "site_cluster")
    return keyed.join(ids, "_site", "left").drop("_site")


def sector_counts(target_km: float = 1000.0, bands: int = 20) -> list[int]:
    """Longitude sectors of each latitude band, south to north."""
    counts = []
    for b in range(bands):
        centre = -90.0 + 180.0 / bands * (b + 0.5)
        circle = 2.0 * math.pi * EARTH_RADIUS_KM * math.cos(math.radians(centre))
        counts.append(max(1, int(round(circle / target_km))))
    return counts


def spatial_block(lon, lat, target_km: float = 1000.0, bands: int = 20) -> Column:
    """Block id of a point; the band table is a literal of ``bands`` entries."""
    counts = sector_counts(target_km, bands)
    bases = [sum(counts[:b]) for b in range(bands)]
    height = 180.0 / bands
    band = clip(F.ceil((as_column(lat) + 90.0) / height) - 1, 0, bands - 1).cast("int")
    n = F.get(F.lit(counts), band)
    base = F.get(F.lit(bases), band)
    sector = clip(F.floor((wrap180(lon) + 180.0) / 360.0 * n), 0, n - 1)
    return (base + sector).cast("long")


def in_blocks(obs: DataFrame, blocks: DataFrame, block: str = "spatial_block"):
    """(training rows, test rows) for a list of held-out blocks."""
    return obs.join(blocks, block, "left_anti"), obs.join(blocks, block, "left_semi")


def densest_blocks(obs: DataFrame, block: str = "spatial_block", n: int = 2) -> DataFrame:
    """The n blocks with most records; equal counts are ordered by block id."""
    counts = obs.groupBy(block).agg(F.count("*").alias("n_records"))
    return counts.orderBy(F.desc("n_records"), F.asc(block)).limit(n)


# --- age windows -------------------------------------------------------------


def overlaps_window(lower, upper, window) -> Column:
    return (as_column(upper) >= window[0]) & (as_column(lower) <= window[1])


def window_role(lower, upper, representative, window, max_width: float = 5.0) -> Column:
    """'test', 'buffer' or 'train' for one age window."""
    lo, hi, rep = as_column(lower), as_column(upper), as_column(representative)
    overlap = overlaps_window(lo, hi, window)
    narrow = (hi - lo <= max_width) & rep.between(window[0], window[1])
    return F.when(overlap & narrow, "test").when(overlap, "buffer").otherwise("train")


# --- held-out ids ------------------------------------------------------------


def holdout_problems(obs: DataFrame, holdout: DataFrame, flag: str = "held") -> DataFrame:
    """(observation_id, problem) of a held-out list: unknown or repeated ids, flags not 0 or 1.

    ``holdout`` has ``observation_id`` and may have a flag column.
    """
    counts = holdout.groupBy("observation_id").agg(
        F.count("*").alias("n"),
        *([F.count_if(~F.coalesce(F.col(flag).isin(0, 1), F.lit(False))).alias("odd")] if flag in holdout.columns else [F.lit(0).alias("odd")]),
    )
    known = obs.select("observation_id").distinct().withColumn("_known", F.lit(True))
    problem = (
        F.when(F.col("_known").isNull(), "unknown id").when(F.col("n") > 1, "repeated id").when(F.col("odd") > 0, "flag is not 0 or 1")
    )
    return (
        counts.join(known, "observation_id", "left")
        .select("observation_id", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def held_ids(holdout: DataFrame, flag: str = "held") -> DataFrame:
    """The ids that are held out: those with flag 1, or all where there is no flag."""
    return (holdout.where(F.col(flag) == 1) if flag in holdout.columns else holdout).select("observation_id").distinct()


def whole_group_holdout(obs: DataFrame, holdout: DataFrame, group: str) -> DataFrame:
    """Add ``held_out``: true for every row of a group that has a held-out id."""
    groups = (
        obs.select("observation_id", group)
        .join(held_ids(holdout), "observation_id", "left_semi")
        .select(group)
        .distinct()
        .withColumn("_held", F.lit(True))
    )
    return (
        obs.join(groups, group, "left")
        .withColumn("held_out", F.coalesce("_held", F.lit(False)))
        .drop("_held")
    )


def validation_groups(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Groups drawn for validation: first n in digest order.

    n is the rounded share of the groups, at least one and never all of them.
    """
    groups = df.select(F.col(group).cast("string").alias("_g")).distinct()
    if fraction <= 0:
        return groups.where(F.lit(False)).withColumnRenamed("_g", group)
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("_g")))
    ranked = ordering.hash_ranked(groups, digest, "_g", "_rank")
    total = F.col("total").cast("long")
    share = F.rint(total * F.lit(float(fraction))).cast("long")
    wanted = F.when(total > 1, F.least(total - 1, F.greatest(F.lit(1), share))).otherwise(share)
    n = groups.agg(F.count("*").alias("total")).select(wanted).scalar()
    return ranked.where(F.col("_rank") <= n).select(F.col("_g").alias(group))


def assign_split(
    obs: DataFrame,
    group: str,
    *,
    window=None,
    max_width: float = 5.0,
    holdout: DataFrame | None = None,
    validation_fraction: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: -1 buffer, 0 train, 1 validation, 2 test.

    Either an age window or a list of held-out ids decides the test rows.
    Validation takes whole groups, and only rows that were still training rows.
    """
    if window is not None and holdout is not None:
        raise ValueError("choose an age window or held-out ids, not both")
    lo = F.least("age_lower_ma", "age_upper_ma")
    hi = F.greatest("age_lower_ma", "age_upper_ma")
    if window is not None:
        role = window_role(lo, hi, (lo + hi) / 2.0, window, max_width)
        code = F.when(role == "test", TEST).when(role == "buffer", BUFFER).otherwise(TRAIN)
        marked = obs.withColumn("_split", code)
    elif holdout is not None:
        held = whole_group_holdout(obs, holdout, group)
        marked = held.withColumn("_split", F.when(F.col("held_out"), TEST).otherwise(TRAIN))
        marked = marked.drop("held_out")
    else:
        marked = obs.withColumn("_split", F.lit(TRAIN))
    chosen = validation_groups(
        marked.where(F.col("_split") == TRAIN), group, validation_fraction, seed
    ).select(F.col(group).alias("_vg"), F.lit(True).alias("_val"))
    joined = marked.join(chosen, F.col(group).cast("string") == F.col("_vg"), "left")
    split = F.when((F.col("_split") == TRAIN) & F.col("_val"), VALIDATION).otherwise(
        F.col("_split")
    )
    return joined.withColumn("split", split.cast("int")).drop("_split", "_vg", "_val")


# --- manifest ----------------------------------------------------------------


def window_manifest(obs: DataFrame, windows, max_width: float = 5.0) -> DataFrame:
    """Per window: role, site and total counts, and the leakage checks: sites on both sides are
    counted, ids on both sides fail the window.

    One pass over the records: every record is tagged with its role in each of
    the few windows, then counted with map-side combining.
    """
    lo = F.least("age_lower_ma", "age_upper_ma")
    hi = F.greatest("age_lower_ma", "age_upper_ma")
    rep = (lo + hi) / 2.0
    tags = F.array(
        *[
            F.struct(
                F.lit(f"{a:g}-{b:g}").alias("window"),
                window_role(lo, hi, rep, (a, b), max_width).alias("role"),
            )
            for a, b in windows
        ]
    )
    tagged = obs.select(
        "observation_id", site_key("present_lon", "present_lat").alias("site"), F.explode(tags).alias("t")
    ).select("observation_id", "site", "t.*")
    # Counts per (window, role, site) first: the distinct sites come for free.
    by_site = tagged.groupBy("window", "role", "site").agg(F.count("*").alias("n"))
    by_role = by_site.groupBy("window", "role").agg(
        F.sum("n").alias("n"), F.count("*").alias("sites")
    )

    def pick(role: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col(column))), F.lit(0))

    shared = (
        by_site.groupBy("window", "site")
        .agg(
            F.max((F.col("role") == "train").cast("int")).alias("tr"),
            F.max((F.col("role") == "test").cast("int")).alias("te"),
        )
        .groupBy("window")
        .agg(F.sum(F.col("tr") * F.col("te")).alias("shared_sites"))
    )
    report = by_role.groupBy("window").agg(
        pick("train", "n").alias("n_train"),
        pick("test", "n").alias("n_test"),
        pick("buffer", "n").alias("n_buffer"),
        pick("train", "sites").alias("train_sites"),
        pick("test", "sites").alias("test_sites"),
        F.sum("n").alias("n_records"),
    )
    totals = by_site.groupBy("window").agg(F.count_distinct("site").alias("n_sites"))
    ids = (
        tagged.groupBy("window", "observation_id")
        .agg(
            F.max((F.col("role") == "train").cast("int")).alias("tr"),
            F.max((F.col("role") == "test").cast("int")).alias("te"),
        )
        .groupBy("window")
        .agg(F.sum(F.col("tr") * F.col("te")).alias("shared_ids"))
    )
    return report.join(shared, "window").join(totals, "window").join(ids, "window").withColumn(
        "passed", (F.col("n_train") > 0) & (F.col("n_test") > 0) & (F.col("shared_ids") == 0)
    )


def shared_ids(train: DataFrame, test: DataFrame, key: str = "observation_id") -> DataFrame:
    """Ids on both sides of a split; must be empty."""
    return train.select(key).intersect(test.select(key))


def id_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids missing from, or unexpected in, ``actual``."""
    missing = expected.select(key).exceptAll(actual.select(key))
    extra = actual.select(key).exceptAll(expected.select(key))
    return missing.withColumn("problem", F.lit("missing")).unionByName(
        extra.withColumn("problem", F.lit("unexpected"))
    )
