"""Reconstructed trajectories: long form, reliable segments, positions, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sphere
from ..functions.units import AGE_DOMAIN_MA

# Slot spacing, gap rule and the support share of the primary set.
SLOTS = 13
SLOT_MYR = 5.0
MAX_GAP_MYR = 5.0
MIN_SUPPORT = 0.5
EPS = 1e-9


def _slot_name(base: str, k: int) -> str:
    return base if k == 0 else f"{base}.{k}"


def unpivot_slots(wide: DataFrame, key: str = "source_row") -> DataFrame:
    """Wide time slots -> (key, slot, time_ma, lon, lat, on_time).

    ``on_time`` is false where the slot's time differs from its expected time;
    such samples are counted, never reassigned. Incomplete slots give no row.
    """
    present = [k for k in range(SLOTS) if _slot_name("TIME", k) in wide.columns]

    def number(base: str, k: int) -> Column:
        return F.col(f"`{_slot_name(base, k)}`").try_cast("double")

    slots = F.array(
        *[
            F.struct(
                F.lit(k).alias("slot"),
                number("TIME", k).alias("time_ma"),
                number("paleo_lon", k).alias("lon"),
                number("paleo_lat", k).alias("lat"),
            )
            for k in present
        ]
    )
    rows = wide.select(key, F.explode(slots).alias("s")).select(key, "s.*")
    complete = F.lit(True)
    for c in ("time_ma", "lon", "lat"):
        complete = complete & F.col(c).isNotNull() & ~F.isnan(c)
    expected = F.col("slot") * SLOT_MYR
    return rows.where(complete).withColumn(
        "on_time", F.abs(F.col("time_ma") - expected) <= 1e-6
    )


def segments(samples: DataFrame, key: str = "source_row") -> DataFrame:
    """Every sample with its successor: (key, t0, lon0, lat0, t1, lon1, lat1).

    Rows are grouped by (key, time slot), so a key with very many samples is still
    many window partitions; the first sample of the next slot closes the last
    segment of a slot. A gap that spans a whole empty slot is longer than the gap
    rule and has no successor here, exactly as it has no reliable segment.
    The last sample of a run has null successors.
    """
    slot = F.floor(F.col("time_ma") / MAX_GAP_MYR)
    placed = samples.select(key, "time_ma", "lon", "lat", slot.alias("_slot"))
    here = F.struct("time_ma", "lon", "lat")
    firsts = placed.groupBy(key, (F.col("_slot") - 1).alias("_slot")).agg(
        F.min(here).alias("_next_slot")
    )
    inside = F.lead(here).over(Window.partitionBy(key, "_slot").orderBy("time_ma", "lon", "lat"))
    joined = placed.withColumn("_inside", inside).join(firsts, [key, "_slot"], "left")
    nxt = F.coalesce("_inside", "_next_slot")
    return joined.select(
        key,
        F.col("time_ma").alias("t0"),
        F.col("lon").alias("lon0"),
        F.col("lat").alias("lat0"),
        nxt["time_ma"].alias("t1"),
        nxt["lon"].alias("lon1"),
        nxt["lat"].alias("lat1"),
    )


def reliable_segments(samples: DataFrame, key: str = "source_row") -> DataFrame:
    """Consecutive-sample segments no longer than the gap rule."""
    return segments(samples, key).where(F.col("t1") - F.col("t0") <= MAX_GAP_MYR + EPS)


def reliable_runs(samples: DataFrame, key: str = "source_row") -> DataFrame:
    """Maximal stretches without a long gap: (key, start, end).

    Samples are reduced to (key, slot) ranges first; a slot is one gap long, so
    the samples inside it always belong together, and a key has at most
    domain / gap + 1 rows when its runs are numbered.
    """
    slot = F.floor(F.col("time_ma") / MAX_GAP_MYR)
    ranges = samples.groupBy(key, slot.alias("_slot")).agg(
        F.min("time_ma").alias("_a"), F.max("time_ma").alias("_b")
    )
    w = Window.partitionBy(key).orderBy("_slot")
    gap = F.col("_a") - F.lag("_b").over(w) > MAX_GAP_MYR + EPS
    numbered = ranges.withColumn(
        "_run",
        F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    return numbered.groupBy(key, "_run").agg(
        F.min("_a").alias("start"), F.max("_b").alias("end")
    ).drop("_run")


def support_mass(
    records: DataFrame, samples: DataFrame, key: str = "source_row", domain=AGE_DOMAIN_MA
) -> DataFrame:
    """Add ``trajectory_support_mass`` and ``primary_set`` to every record.

    The share of the age interval inside reliable stretches; 1 or 0 for a point
    age. A record meets at most domain / gap + 1 runs of its trajectory, and they
    travel as one array per key, so the join adds no rows. An interval that only
    touches the domain has no mass and gets 0.
    """
    runs = reliable_runs(samples, key).where(F.col("end") > F.col("start"))
    packed = runs.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    a, b = F.greatest(lo, F.lit(domain[0])), F.least(hi, F.lit(domain[1]))
    overlap = F.aggregate(
        "_runs",
        F.lit(0.0),
        lambda acc, r: acc
        + F.greatest(F.lit(0.0), F.least(b, r["end"]) - F.greatest(a, r["start"])),
    )
    bracketed = F.exists(
        "_runs", lambda r: (lo >= r["start"] - EPS) & (lo <= r["end"] + EPS)
    ).cast("double")
    mass = F.when(b < a, 0.0).when(lo == hi, bracketed).when(b > a, overlap / (b - a)).otherwise(0.0)
    joined = records.join(packed, key, "left")
    return joined.withColumn(
        "trajectory_support_mass", F.coalesce(mass, F.lit(0.0))
    ).withColumn("primary_set", F.col("trajectory_support_mass") >= MIN_SUPPORT).drop("_runs")


def positions_at(
    points: DataFrame,
    samples: DataFrame,
    key: str = "source_row",
    age: str = "age",
    point_id: str = "point_id",
) -> DataFrame:
    """Add ``traj_lon, traj_lat`` at each point's age, null where not locatable.

    Interpolates along the great circle between two consecutive samples at most
    one gap apart; no extrapolation. Segments join on (key, time slot): a segment
    is no longer than a slot, so it lies in at most two slots and a point meets
    only the segments of its own slot. A sample time itself is always locatable.
    """
    segs = reliable_segments(samples, key).withColumn(
        "_slot",
        F.explode(
            F.sequence(
                F.floor((F.col("t0") - EPS) / MAX_GAP_MYR),
                F.floor((F.col("t1") + EPS) / MAX_GAP_MYR),
            )
        ),
    )
    single = samples.select(
        key,
        F.col("time_ma").alias("t0"),
        F.col("lon").alias("lon0"),
        F.col("lat").alias("lat0"),
        F.col("time_ma").alias("t1"),
        F.col("lon").alias("lon1"),
        F.col("lat").alias("lat1"),
        F.floor(F.col("time_ma") / MAX_GAP_MYR).alias("_slot"),
    )
    at = F.col(age)
    asked = points.select(point_id, key, age).withColumn("_slot", F.floor(at / MAX_GAP_MYR))
    hits = asked.join(segs.unionByName(single), [key, "_slot"]).where(
        (at >= F.col("t0") - EPS) & (at <= F.col("t1") + EPS)
    )
    gap = F.col("t1") - F.col("t0")
    fraction = F.when(gap > 0, sphere.clip((at - F.col("t0")) / gap, 0.0, 1.0)).otherwise(0.0)
    staged = hits.withColumn("_f", fraction).withColumns(
        {
            **sphere.vec_columns(sphere.unit_vector("lon0", "lat0"), "_p"),
            **sphere.vec_columns(sphere.unit_vector("lon1", "lat1"), "_q"),
        }
    )
    staged = sphere.with_slerp(staged, "_p", "_q", "_f", "_v")
    lon, lat = sphere.to_lonlat(sphere.vec_of("_v"))
    # An exact sample wins over a blend; otherwise the bracketing segment is unique.
    lon = F.when(at == F.col("t0"), F.col("lon0")).otherwise(lon)
    lat = F.when(at == F.col("t0"), F.col("lat0")).otherwise(lat)
    best = staged.withColumns({"_lon": lon, "_lat": lat}).groupBy(point_id).agg(
        F.min_by(F.struct("_lon", "_lat"), F.struct(at != F.col("t0"), F.col("t0"))).alias("_pos")
    )
    return points.join(
        best.select(
            point_id, F.col("_pos._lon").alias("traj_lon"), F.col("_pos._lat").alias("traj_lat")
        ),
        point_id,
        "left",
    )


def node_positions(nodes: DataFrame) -> DataFrame:
    """Trajectory position where there is one, else the present position and a flag."""
    found = F.col("traj_lon").isNotNull()
    return nodes.withColumns(
        {
            "node_from_trajectory": found,
            "node_lon": F.coalesce("traj_lon", "present_lon"),
            "node_lat": F.coalesce("traj_lat", "present_lat"),
        }
    ).drop("traj_lon", "traj_lat")


def drop_failed_records(nodes: DataFrame, ok: str, key: str = "observation_id") -> DataFrame:
    """Drop every node of a record that has any failed node; weights are never rescaled."""
    failed = nodes.where(~F.coalesce(F.col(ok), F.lit(False))).select(key).distinct()
    return nodes.join(failed, key, "left_anti")
