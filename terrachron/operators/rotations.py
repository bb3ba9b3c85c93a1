"""Finite rotations: as-of brackets, plate circuits and reconstruction of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sphere
from ..functions.sphere import Quat, quat_columns, quat_of
from ..sources.storage import stored

# The anchor plate and the number of hops a circuit may take.
ANCHOR_PLATE = 0
MAX_HOPS = 11

# Ages per bucket of the circuit table, and the buckets that take all older and younger ages.
BUCKET_MYR = 10.0
FIRST_BUCKET, LAST_BUCKET = -1, 100

_IDENTITY = (1.0, 0.0, 0.0, 0.0)


def rotation_brackets(entries: DataFrame) -> DataFrame:
    """(plate_id, age_from, age_to, parent, two quaternions), open at both ends.

    Each rotation entry brackets the ages up to the next entry of its plate. Ages
    younger than the first or older than the last entry use that entry unchanged
    (``clamped``). The parent is the younger entry's. A plate has as many rows as
    its rotation file lists ages, so the window is bounded by the model.
    """
    q = sphere.rotation("lat", "lon", "angle")
    rows = entries.withColumns(quat_columns(q, "_"))
    w = Window.partitionBy("plate_id").orderBy("age")
    here = [F.col("_" + c).alias("a" + c) for c in "wxyz"]
    nxt = [F.coalesce(F.lead("_" + c).over(w), F.col("_" + c)).alias("b" + c) for c in "wxyz"]
    forward = rows.select(
        "plate_id",
        F.col("age").alias("age_from"),
        F.coalesce(F.lead("age").over(w), F.lit(float("inf"))).alias("age_to"),
        F.col("conjugate_id").alias("parent"),
        (F.lead("age").over(w).isNull()).alias("clamped"),
        *here,
        *nxt,
    )
    first = rows.groupBy("plate_id").agg(
        F.min_by(F.struct("age", "conjugate_id", "_w", "_x", "_y", "_z"), "age").alias("f")
    )
    before = first.select(
        "plate_id",
        F.lit(float("-inf")).alias("age_from"),
        F.col("f.age").alias("age_to"),
        F.col("f.conjugate_id").alias("parent"),
        F.lit(True).alias("clamped"),
        *[F.col("f._" + c).alias("a" + c) for c in "wxyz"],
        *[F.col("f._" + c).alias("b" + c) for c in "wxyz"],
    )
    return forward.unionByName(before)


def _as_of_step(columns: Sequence[str], plate: str, age: str):
    """The as-of join and its blend, with every expression built once."""
    at = F.col(f"p.{age}")
    hit = (
        (F.col(f"p.{plate}") == F.col("b.plate_id"))
        & (at >= F.col("b.age_from"))
        & (at < F.col("b.age_to"))
    )
    span = F.col("b.age_to") - F.col("b.age_from")
    open_end = F.col("b.clamped") | (span < 1e-9)
    fraction = F.when(open_end, 0.0).otherwise((at - F.col("b.age_from")) / span)
    qa, qb = quat_of("b.a"), quat_of("b.b")
    cosine = qa.w * qb.w + qa.x * qb.x + qa.y * qb.y + qa.z * qb.z
    located = [
        *[F.col(f"p.{c}") for c in columns],
        F.col("b.parent").alias("parent"),
        F.col("b.clamped").alias("clamped"),
        fraction.alias("_f"),
        cosine.alias("_cos"),
        *[F.col("b.a" + c).alias("_a" + c) for c in "wxyz"],
        *[F.col("b.b" + c).alias("_b" + c) for c in "wxyz"],
    ]
    wa, wb = sphere.blend_weights(F.acos(sphere.clip(F.abs("_cos"), 0.0, 1.0)), "_f")
    sign = F.when(F.col("_cos") < 0, -1.0).otherwise(1.0)
    weighted = {"_wa": wa, "_wb": wb * sign}
    blended = [
        *columns,
        "parent",
        "clamped",
        *[
            (x * F.col("_wa") + y * F.col("_wb")).alias("s_" + c)
            for c, x, y in zip("wxyz", quat_of("_a"), quat_of("_b"))
        ],
    ]

    def step(pairs: DataFrame, brackets: DataFrame) -> DataFrame:
        joined = pairs.alias("p").join(brackets.alias("b"), hit, "left").select(*located)
        return joined.withColumns(weighted).select(*blended)

    return step


def step_rotations(pairs: DataFrame, brackets: DataFrame, plate="plate_id", age="age") -> DataFrame:
    """As-of join: rotation of each (plate, age) against its parent, as ``s_w..s_z``.

    The blend between the two samples goes the shorter way round.
    """
    return _as_of_step(pairs.columns, plate, age)(pairs, brackets)


def _link() -> Column:
    """What one hop of a circuit needs at any age of its bracket; the second sample goes the shorter way."""
    qa, qb = quat_of("a"), quat_of("b")
    cosine = qa.w * qb.w + qa.x * qb.x + qa.y * qb.y + qa.z * qb.z
    sign = F.when(cosine < 0, -1.0).otherwise(1.0)
    still = F.col("clamped") | (F.col("age_to") - F.col("age_from") < 1e-9)
    return F.struct(
        F.col("age_from").alias("start"),
        F.when(~still, F.col("age_to") - F.col("age_from")).alias("span"),
        F.col("clamped").alias("clamped"),
        F.acos(sphere.clip(F.abs(cosine), 0.0, 1.0)).alias("omega"),
        *[q.alias("a" + c) for c, q in zip("wxyz", qa)],
        *[(q * sign).alias("b" + c) for c, q in zip("wxyz", qb)],
    )


def _twice_as_far(circuits: DataFrame, anchor: int) -> DataFrame:
    """Each unfinished piece of a circuit continued by the pieces of the plate it has reached.

    Their ages intersect, so a plate's ages are cut at every breakpoint along its chain.
    """
    finished = F.col("at").isNull() | (F.col("at") == anchor)
    rest = circuits.select(
        F.col("plate_id").alias("n_plate"),
        F.col("age_from").alias("n_from"),
        F.col("age_to").alias("n_to"),
        F.col("at").alias("n_at"),
        F.col("chain").alias("n_chain"),
    )
    meets = (
        (F.col("at") == F.col("n_plate"))
        & (F.col("age_from") < F.col("n_to"))
        & (F.col("n_from") < F.col("age_to"))
    )
    longer = circuits.where(~finished).join(rest, meets, "left").select(
        "plate_id",
        F.greatest("age_from", "n_from").alias("age_from"),
        F.least("age_to", "n_to").alias("age_to"),
        F.col("n_at").alias("at"),
        F.coalesce(F.concat("chain", "n_chain"), F.col("chain")).alias("chain"),
    )
    return circuits.where(finished).unionByName(longer)


def circuit_table(
    entries: DataFrame, anchor: int = ANCHOR_PLATE, max_hops: int = MAX_HOPS
) -> DataFrame:
    """(plate_id, age_from, age_to, ok, clamped, chain): every circuit of a rotation model.

    A row holds the brackets from a plate to the anchor, child first, for ages between two
    breakpoints of that chain. Rows are made from the model alone, by doubling: pieces of
    1, 2, 4, ... hops are joined on the plate that they reach, so the number of joins is
    logarithmic in ``max_hops`` and independent of the points. The table is stored, since
    its size then tells the planner how to join it. A missing plate, a plate that is its own
    parent or a circuit longer than ``max_hops`` has ``ok`` false.
    """
    parent = F.when(F.col("parent") != F.col("plate_id"), F.col("parent"))
    pieces = (
        rotation_brackets(entries)
        .where(F.col("plate_id") != anchor)
        .select("plate_id", "age_from", "age_to", parent.alias("at"), F.array(_link()).alias("chain"))
    )
    start = entries.sparkSession.range(1).select(
        F.lit(anchor).cast(pieces.schema["plate_id"].dataType).alias("plate_id"),
        F.lit(float("-inf")).alias("age_from"),
        F.lit(float("inf")).alias("age_to"),
        F.lit(anchor).cast(pieces.schema["at"].dataType).alias("at"),
        F.array().cast(pieces.schema["chain"].dataType).alias("chain"),
    )
    circuits, reach, kept = stored(pieces.unionByName(start)), 1, 1
    while reach < max_hops:
        circuits, reach = _twice_as_far(circuits, anchor), 2 * reach
        if reach >= 4 * kept:  # two doublings a table: each names its input twice
            circuits, kept = stored(circuits), reach
    arrived = F.coalesce(F.col("at") == anchor, F.lit(False)) & (F.size("chain") <= max_hops)
    return circuits.select(
        "plate_id",
        "age_from",
        "age_to",
        arrived.alias("ok"),
        F.exists(F.slice("chain", 1, max_hops), lambda link: link["clamped"]).alias("clamped"),
        F.when(arrived, F.col("chain")).alias("chain"),
    )


def _bucket(age) -> Column:
    return sphere.clip(F.floor(F.col(age) / BUCKET_MYR), FIRST_BUCKET, LAST_BUCKET).cast("int")


def _composed(chain: str, age: str) -> Column:
    """Quaternion of a whole chain at an age, as a struct ``w, x, y, z``."""
    at = F.col(age)
    fractions = F.transform(
        chain,
        lambda k: F.struct(
            k.alias("k"), F.coalesce((at - k["start"]) / k["span"], F.lit(0.0)).alias("f")
        ),
    )

    def weighted(p: Column) -> Column:
        wa, wb = sphere.blend_weights(p["k"]["omega"], p["f"])
        return F.struct(p["k"].alias("k"), wa.alias("a"), wb.alias("b"))

    def blended(p: Column) -> Column:
        k = p["k"]
        return F.struct(*[(k["a" + c] * p["a"] + k["b" + c] * p["b"]).alias(c) for c in "wxyz"])

    steps = F.transform(F.transform(fractions, weighted), blended)
    identity = F.struct(*[F.lit(v).alias(c) for c, v in zip("wxyz", _IDENTITY)])

    def then(sofar: Column, step: Column) -> Column:
        q = sphere.compose(Quat(*[step[c] for c in "wxyz"]), Quat(*[sofar[c] for c in "wxyz"]))
        return F.struct(*[v.alias(c) for c, v in zip("wxyz", q)])

    return F.aggregate(steps, identity, then)


def total_rotations(
    pairs: DataFrame,
    entries: DataFrame,
    anchor: int = ANCHOR_PLATE,
    max_hops: int = MAX_HOPS,
    circuits: DataFrame | None = None,
) -> DataFrame:
    """Rotation of each distinct (plate_id, age) to the anchor: ``r_w..r_z, ok, clamped``.

    One join on (plate, bucket of ages) finds the interval of the circuit table that holds
    the age; the row's chain is then blended and folded in place. Rows without a whole
    circuit have null components and ``ok`` false. ``circuits`` may be passed when several
    calls use one model.
    """
    if circuits is None:
        circuits = circuit_table(entries, anchor, max_hops)
    dealt = circuits.select(
        F.col("plate_id").alias("_plate"),
        "age_from",
        "age_to",
        F.col("ok").alias("_ok"),
        F.col("clamped").alias("_clamped"),
        "chain",
        F.explode(F.sequence(_bucket("age_from"), _bucket("age_to"))).alias("_bucket"),
    )
    asked = pairs.select("plate_id", "age").distinct().withColumn("_at", _bucket("age"))
    holds = (
        (F.col("plate_id") == F.col("_plate"))
        & (F.col("_at") == F.col("_bucket"))
        & (F.col("age") >= F.col("age_from"))
        & (F.col("age") < F.col("age_to"))
    )
    found = asked.join(dealt, holds, "left").withColumn("_r", _composed("chain", "age"))
    sign = F.when(F.col("_r.w") < 0, -1.0).otherwise(1.0)
    return found.select(
        "plate_id",
        "age",
        F.coalesce("_ok", F.lit(False)).alias("ok"),
        F.coalesce("_clamped", F.lit(False)).alias("clamped"),
        *[(F.col(f"_r.{c}") * sign).alias("r_" + c) for c in "wxyz"],
    )


def reconstruct(
    points: DataFrame,
    entries: DataFrame,
    *,
    lon: str = "lon",
    lat: str = "lat",
    plate: str = "plate_id",
    age: str = "age",
    backward: bool = False,
) -> DataFrame:
    """Add ``rec_lon, rec_lat, ok``: position at the age (or back to the present).

    Points that cannot be rotated keep their coordinates and are flagged. The
    rotation is computed once per distinct (plate, age).
    """
    keys = points.select(F.col(plate).alias("plate_id"), F.col(age).alias("age")).where(
        F.col("plate_id") >= 0
    )
    total = total_rotations(keys, entries).select(
        F.col("plate_id").alias("_plate"),
        F.col("age").alias("_age"),
        F.col("ok").alias("_ok"),
        *["r_" + c for c in "wxyz"],
    )
    joined = points.join(
        total, (F.col(plate) == F.col("_plate")) & (F.col(age) == F.col("_age")), "left"
    )
    ok = F.coalesce("_ok", F.lit(False))
    q = quat_of("r_")
    q = sphere.inverse(q) if backward else q
    here = joined.withColumns(sphere.vec_columns(sphere.unit_vector(lon, lat), "_u"))
    rotated = here.withColumns(
        sphere.vec_columns(sphere.rotate(q, sphere.vec_of("_u")), "_v")
    )
    new_lon, new_lat = sphere.to_lonlat(sphere.vec_of("_v"))
    return rotated.select(
        *points.columns,
        F.when(ok, new_lon).otherwise(F.col(lon)).alias("rec_lon"),
        F.when(ok, new_lat).otherwise(F.col(lat)).alias("rec_lat"),
        ok.alias("ok"),
    )


def material_reference(
    cells: DataFrame, entries: DataFrame, modern: DataFrame, *, network: str = "in_network"
) -> DataFrame:
    """Modern value found at each cell's back-rotated position.

    ``cells`` has ``lon, lat, age, plate_id`` and a network flag; ``modern`` is the
    native field (i, j, value). Unassigned cells, cells without a rotation, and
    network cells at a nonzero age are unsupported: value null, ``supported`` false.
    """
    from .fields import sample_one_field

    back = reconstruct(cells, entries, backward=True)
    allowed = F.col("ok") & ((F.col("age") == 0) | ~F.col(network))
    sampled = sample_one_field(
        back, modern, 180, 360, grid="native", lon="rec_lon", lat="rec_lat", out="_value"
    )
    return sampled.select(
        *cells.columns,
        allowed.alias("supported"),
        F.when(allowed, F.col("_value")).alias("reference_km"),
    )
