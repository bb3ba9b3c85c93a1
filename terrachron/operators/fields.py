"""Sampling gridded fields at points and ages.

A field table has one row per (age_idx, i, j). Instead of sending eight corner
rows per point through a join and an aggregation, the (small) field is turned
into a stencil table: one row per grid cell holding its corner values. Every
point then needs exactly one equi join on its cell and no aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.sphere import clip
from ..functions.units import as_column

# A stencil table is broadcast only when its arguments prove it is this small.
MAX_BROADCAST_CELLS = 500_000

# Corner order within a stencil: (age, row, column) offsets.
_SPACE = [(0, 0), (0, 1), (1, 0), (1, 1)]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count is known from the arguments to be small."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_CELLS else df


def stencils(
    field: DataFrame, values: Sequence[str], nlat: int, nlon: int, n_anchors: int | None
) -> DataFrame:
    """One row per cell: arrays ``<value>`` of its 4 (one age) or 8 (two ages) corners.

    Each field row is copied to the cells it is a corner of and the copies are
    merged by cell: one shuffle of the field, none of the points.
    """
    ages = [0] if n_anchors is None else [0, 1]
    offsets = [(a, di, dj) for a in ages for di, dj in _SPACE]
    copies = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.col("age_idx") - a if n_anchors is not None else F.lit(0)).alias("a"),
                (F.col("i") - di).alias("ci"),
                F.pmod(F.col("j") - dj, F.lit(nlon)).alias("cj"),
            )
            for k, (a, di, dj) in enumerate(offsets)
        ]
    )
    last_age = 0 if n_anchors is None else n_anchors - 2
    spread = (
        field.select(*values, F.explode(copies).alias("c"))
        .select(*values, "c.*")
        .where(F.col("ci").between(0, nlat - 2) & F.col("a").between(0, last_age))
    )
    corners = [
        F.array(
            *[F.max(F.when(F.col("k") == k, F.col(v))) for k in range(len(offsets))]
        ).alias(v)
        for v in values
    ]
    return spread.groupBy("a", "ci", "cj").agg(*corners)


def locate(
    points: DataFrame, lon, lat, age, nlat: int, nlon: int, step: float, n_anchors: int
) -> DataFrame:
    """Add the cell (``a, ci, cj``) and fractions (``fa, fi, fj``) of every point.

    Points that cannot be queried (latitude or age out of range, missing numbers)
    get a null cell, so they stay in the result with a null value.
    """
    row = grids.gauss_row(lat, nlat)
    col = grids.periodic_column(lon, nlon)
    anchor = grids.anchor_position(age, step, n_anchors)
    ok = (F.abs(as_column(lat)) <= 90) & as_column(lon).isNotNull()
    return points.withColumns(
        {
            "a": F.when(ok, anchor.index).cast("int"),
            "ci": F.when(ok, row.index).cast("int"),
            "cj": F.when(ok, col.index).cast("int"),
            "fa": anchor.fraction,
            "fi": row.fraction,
            "fj": col.fraction,
        }
    )


def _space_weights() -> list[Column]:
    fi, fj = F.col("fi"), F.col("fj")
    return [(1 - fi) * (1 - fj), (1 - fi) * fj, fi * (1 - fj), fi * fj]


def _blend(corners: Column, first: int) -> Column:
    """Weighted corner sum; a zero-weight corner may be missing."""
    total = None
    for k, w in enumerate(_space_weights()):
        term = F.when(w == 0, F.lit(0.0)).otherwise(w * F.get(corners, F.lit(first + k)))
        total = term if total is None else total + term
    return total


def _interpolated(value: str, with_age: bool) -> Column:
    lower = _blend(F.col(f"s.{value}"), 0)
    if not with_age:
        return lower
    upper = _blend(F.col(f"s.{value}"), 4)
    fa = F.col("fa")
    return F.when(fa == 0, lower).when(fa == 1, upper).otherwise(lower + fa * (upper - lower))


def sample_fields(
    points: DataFrame,
    field: DataFrame,
    nlat: int,
    nlon: int,
    step: float,
    n_anchors: int,
    *,
    values: Sequence[str] = ("value",),
    lon: str = "lon",
    lat: str = "lat",
    age: str = "age",
) -> DataFrame:
    """Value of stored anchor fields at (lon, lat, age): bilinear in space, linear in age.

    ``field`` rows are (age_idx, i, j, <values>), i counted from the north.
    There is no extrapolation in age.
    """
    cells = bounded(
        stencils(field, values, nlat, nlon, n_anchors), (n_anchors - 1) * (nlat - 1) * nlon
    )
    at = locate(points, lon, lat, age, nlat, nlon, step, n_anchors).alias("p")
    s = cells.alias("s")
    joined = at.join(
        s,
        (F.col("p.a") == F.col("s.a"))
        & (F.col("p.ci") == F.col("s.ci"))
        & (F.col("p.cj") == F.col("s.cj")),
        "left",
    )
    return joined.select(
        *[f"p.{c}" for c in points.columns],
        *[_interpolated(v, True).alias(v) for v in values],
    )


def sample_one_field(
    points: DataFrame,
    field: DataFrame,
    nlat: int,
    nlon: int,
    *,
    grid: str = "gauss",
    value: str = "value",
    lon: str = "lon",
    lat: str = "lat",
    out: str | None = None,
) -> DataFrame:
    """Bilinear value of one field on the native (i from the south) or Gauss grid."""
    if grid == "native":
        row, col = grids.native_row(lat), grids.periodic_column(lon, nlon, 0.5)
    else:
        row, col = grids.gauss_row(lat, nlat), grids.periodic_column(lon, nlon)
    cells = bounded(stencils(field, [value], nlat, nlon, None), (nlat - 1) * nlon).alias("s")
    at = points.withColumns(
        {"ci": row.index, "cj": col.index, "fi": row.fraction, "fj": col.fraction}
    ).alias("p")
    joined = at.join(
        cells, (F.col("p.ci") == F.col("s.ci")) & (F.col("p.cj") == F.col("s.cj")), "left"
    )
    return joined.select(
        *[f"p.{c}" for c in points.columns], _interpolated(value, False).alias(out or value)
    )


def export_to_native(
    spark: SparkSession, field: DataFrame, nlat: int, nlon: int, step: float, n_anchors: int
) -> DataFrame:
    """Every anchor's Gauss field sampled at the 64,800 one-degree cell centres, with ``age_idx`` and ``age``."""
    anchors = F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))
    cells = grids.native_grid(spark).withColumn("age_idx", anchors)
    at = cells.withColumn("age", F.col("age_idx") * F.lit(float(step)))
    return sample_fields(at, field, nlat, nlon, step, n_anchors)


def nearest_category(
    points: DataFrame,
    field: DataFrame,
    nlat: int,
    nlon: int,
    step: float,
    n_anchors: int,
    *,
    value: str = "plate_id",
    lon: str = "lon",
    lat: str = "lat",
    age: str = "age",
) -> DataFrame:
    """Category of the nearest anchor and the heaviest corner; never interpolated."""
    at = locate(points, lon, lat, age, nlat, nlon, step, n_anchors)
    w = _space_weights()
    best = F.greatest(*w)
    # The first corner wins a tie, in the order (0,0) (0,1) (1,0) (1,1).
    k = F.when(w[0] == best, 0).when(w[1] == best, 1).when(w[2] == best, 2).otherwise(3)
    at = at.withColumns(
        {
            "_a": (F.col("a") + (F.col("fa") >= 0.5).cast("int")).cast("int"),
            "_i": (F.col("ci") + (k >= 2).cast("int")).cast("int"),
            "_j": F.pmod(F.col("cj") + (k % 2), F.lit(nlon)).cast("int"),
        }
    ).alias("p")
    f = bounded(field.select("age_idx", "i", "j", value), n_anchors * nlat * nlon).alias("f")
    joined = at.join(
        f,
        (F.col("p._a") == F.col("f.age_idx"))
        & (F.col("p._i") == F.col("f.i"))
        & (F.col("p._j") == F.col("f.j")),
        "left",
    )
    return joined.select(*[f"p.{c}" for c in points.columns], f"f.{value}")


def predict_geometry(
    points: DataFrame, features: DataFrame, nlat: int, nlon: int, step: float, n_anchors: int
) -> DataFrame:
    """Continental fraction, boundary distance, deformation coverage and plate id.

    ``features`` has the stored channels ``continental_mask``,
    ``plate_boundary_distance_div3000``, ``deformation_coverage`` and ``plate_id``.
    """
    channels = features.select(
        "age_idx",
        "i",
        "j",
        ((F.col("continental_mask") + 1) / 2).alias("continental_fraction"),
        (F.col("plate_boundary_distance_div3000") * 3000).alias("plate_boundary_distance_km"),
        "deformation_coverage",
    )
    names = ["continental_fraction", "plate_boundary_distance_km", "deformation_coverage"]
    smooth = sample_fields(points, channels, nlat, nlon, step, n_anchors, values=names)
    smooth = smooth.withColumns(
        {
            n: clip(n, 0.0, 3000.0 if n == "plate_boundary_distance_km" else 1.0)
            for n in names
        }
    )
    return nearest_category(smooth, features, nlat, nlon, step, n_anchors)


def query_support(
    points: DataFrame,
    nlat: int,
    nlon: int,
    step: float,
    n_anchors: int,
    *,
    lon: str = "lon",
    lat: str = "lat",
    age: str = "age",
) -> DataFrame:
    """Distinct (age_idx, i, j) that carry a positive weight in some query.

    Cells are de-duplicated before their corners are spread; the corner flags
    (which of the three fractions are strictly inside) are part of that key, so
    the second shuffle is bounded by the grid, not by the points.
    """
    at = locate(points, lon, lat, age, nlat, nlon, step, n_anchors).where(
        F.col("a").isNotNull() & F.col("ci").isNotNull()
    )

    def sides(f: str) -> Column:
        # 0: only the lower side counts, 1: only the upper side, 2: both.
        c = F.col(f)
        return F.when(c <= 0, 0).when(c >= 1, 1).otherwise(2)

    cells = at.select(
        "a", "ci", "cj", sides("fa").alias("sa"), sides("fi").alias("si"), sides("fj").alias("sj")
    ).distinct()

    def options(base: str, side: str) -> Column:
        b, s = F.col(base), F.col(side)
        return (
            F.when(s == 0, F.array(b)).when(s == 1, F.array(b + 1)).otherwise(F.array(b, b + 1))
        )

    return (
        cells.withColumn("age_idx", F.explode(options("a", "sa")))
        .withColumn("i", F.explode(options("ci", "si")))
        .withColumn("j", F.explode(options("cj", "sj")))
        .select(
            "age_idx",
            "i",
            F.pmod(F.col("j"), F.lit(nlon)).cast("int").alias("j"),
        )
        .distinct()
    )


def missing_scores(
    truth: DataFrame, prediction: DataFrame, support: DataFrame, area: Column
) -> DataFrame:
    """Area-weighted errors on the cells outside ``support`` (one row)."""
    keys = ["age_idx", "i", "j"]
    rows = (
        truth.select(*keys, F.col("value").alias("_t"))
        .join(prediction.select(*keys, F.col("value").alias("_p")), keys)
        .join(support.select(*keys), keys, "left_anti")
        .withColumn("_w", area)
    )
    e = F.col("_p") - F.col("_t")
    w = F.col("_w")
    return rows.agg(
        F.count("*").alias("n_cells"),
        F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("area_rmse_km"),
        (F.sum(w * F.abs(e)) / F.sum(w)).alias("area_mae_km"),
    )


def conservative_remap(
    native: DataFrame, nlat: int, nlon: int, value: str = "value", valid: str | None = None
) -> DataFrame:
    """Area-conserving remap from one-degree cells to a Gauss grid.

    Both axes are separable, so each is a projection and a sum: a native row
    overlaps a handful of Gauss rows (literal edges), a native column a handful of
    Gauss columns. Latitude goes first because it shrinks the table. With a
    validity mask the result is the masked mean, null where nothing is covered.
    """
    import math

    edges = grids.gauss_edges(nlat)  # sines, south to north
    ok = F.col(valid) if valid else F.lit(True)
    # Overlaps of every native row, as literals: (gauss row from the north, length).
    table = []
    for k in range(grids.NATIVE_NLAT):
        a, b = (math.sin(math.radians(-90.0 + k + d)) for d in (0, 1))
        row = []
        for g in range(nlat):
            length = min(b, edges[g + 1]) - max(a, edges[g])
            if length > 0:
                row.append((nlat - 1 - g, length))
        table.append(row)
    lat_overlap = F.get(F.lit([[float(g) for g, _ in r] for r in table]), F.col("i").cast("int"))
    lat_length = F.get(F.lit([[w for _, w in r] for r in table]), F.col("i").cast("int"))
    known = ok & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    by_lat = (
        native.select("j", F.when(known, F.col(value)).alias("_v"),
                      F.explode(F.arrays_zip(lat_overlap.alias("g"), lat_length.alias("w")))
                      .alias("o"))
        .groupBy("j", F.col("o.g").cast("int").alias("gi"))
        .agg(
            F.sum(F.col("_v") * F.col("o.w")).alias("_num"),
            F.sum(F.when(F.col("_v").isNotNull(), F.col("o.w"))).alias("_den"),
        )
    )
    # Native column [j, j+1] against Gauss column centred on g * step: shift by half
    # a step so that columns start at zero, then wrap.
    step = 360.0 / nlon
    left = F.col("j") + step / 2.0
    right = left + 1.0
    first, last = F.floor(left / step), F.ceil(right / step) - 1
    pieces = F.transform(
        F.sequence(first, last),
        lambda g: F.struct(
            F.pmod(g, F.lit(nlon)).cast("int").alias("gj"),
            (F.least(right, (g + 1) * step) - F.greatest(left, g * step)).alias("w"),
        ),
    )
    return (
        by_lat.select("gi", "_num", "_den", F.explode(pieces).alias("o"))
        .where(F.col("o.w") > 0)
        .groupBy(F.col("gi").alias("i"), F.col("o.gj").alias("j"))
        .agg(
            F.sum(F.col("_num") * F.col("o.w")).alias("_n"),
            F.sum(F.col("_den") * F.col("o.w")).alias("_d"),
        )
        .select("i", "j", F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")).alias(value))
    )
