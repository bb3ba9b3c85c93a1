"""Budgets, fluxes, divergence and constraint residuals on long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import physics
from ..functions.units import EARTH_RADIUS_KM

# --- grid neighbours ---------------------------------------------------------


def ring_neighbours(
    df: DataFrame, value: str, before: str, after: str, keys: Sequence[str] = ("age_idx", "i")
) -> DataFrame:
    """Values of the previous and next column on the periodic longitude axis."""
    w = Window.partitionBy(*keys).orderBy("j")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {
            before: F.coalesce(F.lag(value).over(w), F.last(value).over(whole)),
            after: F.coalesce(F.lead(value).over(w), F.first(value).over(whole)),
        }
    )


def meridian_neighbours(
    df: DataFrame, value: str, before: str, after: str, keys: Sequence[str] = ("age_idx", "j")
) -> DataFrame:
    """Values of the previous and next row on the closed latitude axis; null at the ends."""
    w = Window.partitionBy(*keys).orderBy("i")
    return df.withColumns({before: F.lag(value).over(w), after: F.lead(value).over(w)})


def plate_edges(raster: DataFrame, two_sided: bool = True) -> DataFrame:
    """Add ``edge`` to a plate-id raster (age_idx, i, j, plate_id).

    Two-sided: the id differs from any of the four neighbours, unassigned included.
    One-sided: it differs from the previous cell of either axis and neither id is -1.
    """
    r = ring_neighbours(raster, "plate_id", "_w", "_e")
    r = meridian_neighbours(r, "plate_id", "_n", "_s")
    here = F.col("plate_id")
    if two_sided:
        test = (here != F.col("_w")) | (here != F.col("_e"))
        for c in ("_n", "_s"):
            test = test | F.coalesce(here != F.col(c), F.lit(False))
    else:

        def differs(c: str) -> Column:
            other = F.col(c)
            return F.coalesce((here != other) & (here >= 0) & (other >= 0), F.lit(False))

        test = differs("_w") | differs("_n")
    return r.withColumn("edge", test).drop("_w", "_e", "_n", "_s")


# --- finite-volume budgets ---------------------------------------------------
# Control cells (i from the south, j eastward): latitude edges -90 + i * 180 / nlat.


def control_area(i, nlat: int, nlon: int) -> Column:
    i = F.col(i) if isinstance(i, str) else i
    south = -90.0 + 180.0 / nlat * i
    band = F.sin(F.radians(south + 180.0 / nlat)) - F.sin(F.radians(south))
    return band * (EARTH_RADIUS_KM**2 * math.radians(360.0 / nlon))


def net_outflux(
    cells: DataFrame, nlat: int, nlon: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``outflux`` (km3/Myr) from cell-centre ``u`` (east) and ``v`` (north).

    Centre velocities and thicknesses are averaged onto the shared edges; the pole
    edges have zero length. Fluxes cancel between neighbours, so the global sum is 0.
    """
    keys = list(keys)
    r = cells
    for c in ("h", "u"):
        r = ring_neighbours(r, c, f"_{c}w", f"_{c}e", [*keys, "i"])
    for c in ("h", "v"):
        r = meridian_neighbours(r, c, f"_{c}s", f"_{c}n", [*keys, "j"])
    side = EARTH_RADIUS_KM * math.radians(180.0 / nlat)
    south_lat = -90.0 + 180.0 / nlat * F.col("i")
    width = EARTH_RADIUS_KM * math.radians(360.0 / nlon)

    def across(c: str) -> Column:
        return 0.25 * (F.col("h") + F.col(f"_h{c}")) * (F.col("u") + F.col(f"_u{c}"))

    def along(c: str, edge_lat: Column) -> Column:
        flow = 0.25 * (F.col("h") + F.col(f"_h{c}")) * (F.col("v") + F.col(f"_v{c}"))
        return F.coalesce(flow * F.cos(F.radians(edge_lat)), F.lit(0.0))

    flux = side * (across("e") - across("w")) + width * (
        along("n", south_lat + 180.0 / nlat) - along("s", south_lat)
    )
    return r.withColumn("outflux", flux).drop(
        *[f"_h{c}" for c in "wesn"], "_uw", "_ue", "_vs", "_vn"
    )


def regional_budget(
    cells: DataFrame, nlat: int, nlon: int, dtau: float, region: str = "region"
) -> DataFrame:
    """Unexplained volume change per region over one step.

    ``cells`` has ``i, j, h_start, h_end, u, v, q, active`` and a region. The flux
    uses the mean thickness; sources count only where ``active``.
    """
    staged = cells.withColumn("h", (F.col("h_start") + F.col("h_end")) / 2.0)
    flux = net_outflux(staged, nlat, nlon)
    area = control_area("i", nlat, nlon)
    source = F.when(F.col("active"), F.col("q")).otherwise(0.0)
    out = flux.groupBy(region).agg(
        F.sum(area * (F.col("h_end") - F.col("h_start"))).alias("volume_change"),
        F.sum("outflux").alias("flux_out"),
        F.sum(area * source).alias("source_in"),
        F.sum(area).alias("area_km2"),
        F.sum(F.when(F.col("active"), area).otherwise(0.0)).alias("active_area_km2"),
        F.count_if("active").alias("active_cells"),
        F.count("*").alias("cells"),
    )
    residual = F.col("volume_change") + dtau * (F.col("flux_out") - F.col("source_in"))
    return out.withColumn("residual_km3", residual).withColumn(
        "residual_normalised", physics.normalised_residual("residual_km3")
    )


def budget_loss(
    residuals: DataFrame, tolerance: float | None = None, max_total: float | None = None
) -> DataFrame:
    """Mean squared normalised residual over active domains (one row), optionally capped."""
    r = physics.normalised_residual("residual_km3")
    active = residuals.where("active").withColumn("_r", r)
    aggs = [
        F.count("*").alias("active_domains"),
        F.coalesce(F.avg(F.col("_r") * F.col("_r")), F.lit(0.0)).alias("quad"),
    ]
    if tolerance is not None:
        aggs.append(F.bool_and(F.abs("_r") <= tolerance).alias("within_tolerance"))
    row = active.agg(*aggs).withColumn("rms_normalised", F.sqrt("quad"))
    loss = F.col("quad") if max_total is None else F.least("quad", F.lit(float(max_total)))
    row = row.withColumn("loss", loss)
    if max_total is not None:
        row = row.withColumn("capped", F.col("quad") > max_total)
    return row.drop("quad")


def volume_change(early: DataFrame, late: DataFrame, area: Column, mask: Column | None = None):
    """Sum of (late - early) x area over the mask (one row)."""
    keys = ["i", "j"]
    both = early.select(*keys, F.col("value").alias("_e")).join(
        late.select(*keys, F.col("value").alias("_l")), keys
    )
    rows = both if mask is None else both.where(mask)
    return rows.agg(F.sum((F.col("_l") - F.col("_e")) * area).alias("volume_change_km3"))


# --- divergence --------------------------------------------------------------


def surface_divergence(
    cells: DataFrame, dlat: float, dlon: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``divergence`` (1/Myr) of cell-centre ``u, v`` by centred differences.

    ``i`` counts from the south and ``lat`` is the cell latitude. The first and last
    rows have no centred latitude difference and give null.
    """
    keys = list(keys)
    cos = F.cos(F.radians("lat"))
    r = cells.withColumn("_vc", F.col("v") * cos)
    r = ring_neighbours(r, "u", "_uw", "_ue", [*keys, "i"])
    r = meridian_neighbours(r, "_vc", "_vs", "_vn", [*keys, "j"])
    east = (F.col("_ue") - F.col("_uw")) / (2.0 * math.radians(dlon))
    north = (F.col("_vn") - F.col("_vs")) / (2.0 * math.radians(dlat))
    out = (east + north) / (EARTH_RADIUS_KM * F.greatest(cos, F.lit(1e-3)))
    return r.withColumn("divergence", out).drop("_vc", "_uw", "_ue", "_vs", "_vn")


# --- constraint factors ------------------------------------------------------


def usable_factors(df: DataFrame) -> DataFrame:
    """Active factors whose source and flux are both known; unknown is never zero."""
    known = F.lit(True)
    for c in ("source_known", "flux_known"):
        if c in df.columns:
            known = known & F.col(c)
    return df.where(F.coalesce(F.col("active") & known, F.lit(False)))


def path_integral(
    df: DataFrame, rate: str, factor: str = "factor_id", age: str = "age"
) -> DataFrame:
    """Add ``piece``: trapezoid of the rate between a step and the one before it.

    Time runs with decreasing age. A factor has as many steps as its age list.
    """
    w = Window.partitionBy(factor).orderBy(F.col(age).desc())
    before, rate_before = F.lag(age).over(w), F.lag(rate).over(w)
    piece = 0.5 * (F.col(rate) + rate_before) * (before - F.col(age))
    return df.withColumn("piece", F.coalesce(piece, F.lit(0.0)))


def _first_last(value: str, age: str = "age") -> Column:
    """Youngest minus oldest value of a factor."""
    return F.min_by(value, age) - F.max_by(value, age)


def trajectory_residuals(steps: DataFrame) -> DataFrame:
    """Material-path residuals: dh - integral of (source - h x divergence), over sigma.

    ``steps`` has ``factor_id, evidence_id, age, h, divergence, source, sigma``.
    """
    rated = steps.withColumn("_rate", F.col("source") - F.col("h") * F.col("divergence"))
    return (
        path_integral(rated, "_rate")
        .groupBy("factor_id", "evidence_id")
        .agg(
            ((_first_last("h") - F.sum("piece")) / F.first("sigma")).alias("residual")
        )
    )


def budget_residuals(interior: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Moving-region residuals: dV + integral of (boundary flux - source), normalised.

    Interior points ``factor_id, evidence_id, age, h, source, area_km2, reference_km3,
    sigma``; boundary points ``factor_id, age, h, rel_normal_velocity, length_km``.
    Both are summed per (factor, age) before they meet. Without a boundary table every interior
    row is a boundary point too; such rows are read once and nothing is joined.
    """
    flux = F.col("h") * F.col("rel_normal_velocity") * F.col("length_km")
    parts = [
        F.sum(F.col("h") * F.col("area_km2")).alias("volume"),
        F.sum(F.col("source") * F.col("area_km2")).alias("gain"),
        F.first("reference_km3").alias("reference_km3"),
        F.first("sigma").alias("sigma"),
    ]
    if boundary is None:
        rows = interior.where(F.col("factor_id").isNotNull() & F.col("age").isNotNull())
        inside = rows.groupBy("factor_id", "evidence_id", "age").agg(*parts, F.sum(flux).alias("_flux"))
        # The flux is that of the (factor, age), also where several evidence ids share it.
        step = Window.partitionBy("factor_id").orderBy(F.col("age").desc()).rangeBetween(0, 0)
        steps = inside.withColumn("flux", F.sum("_flux").over(step))
    else:
        inside = interior.groupBy("factor_id", "evidence_id", "age").agg(*parts)
        outside = boundary.groupBy("factor_id", "age").agg(F.sum(flux).alias("flux"))
        steps = inside.join(outside, ["factor_id", "age"])
    return (
        path_integral(steps.withColumn("_net", F.col("flux") - F.col("gain")), "_net")
        .groupBy("factor_id", "evidence_id")
        .agg(
            (
                (_first_last("volume") + F.sum("piece"))
                / F.first("reference_km3")
                / F.first("sigma")
            ).alias("residual")
        )
    )


def birth_residuals(births: DataFrame) -> DataFrame:
    """(sampled thickness - production / spreading rate) over sigma."""
    target = F.col("retained_production") / F.col("full_spreading")
    return births.select(
        "factor_id", "evidence_id", ((F.col("h") - target) / F.col("sigma")).alias("residual")
    )


def source_rate(basis: DataFrame, coefficients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of basis value x coefficient per key; ``basis`` has (keys, basis_idx, weight)."""
    return (
        basis.join(coefficients, "basis_idx")
        .groupBy(*keys)
        .agg(F.sum(F.col("weight") * F.col("coefficient")).alias("source"))
    )


def with_source_rate(rows: DataFrame, columns: Sequence[str], coefficients: DataFrame) -> DataFrame:
    """``rows`` with ``source``, the sum of basis columns x coefficient, worked out in place.

    ``columns`` are the basis values in the order of ``basis_idx``; the coefficients, one per column,
    are laid out as one broadcast row. A basis without a coefficient adds nothing; without any the source is null.
    """
    names = [f"_k{n}" for n in range(len(columns))]
    wide = coefficients.agg(
        *[F.sum(F.when(F.col("basis_idx") == n, F.col("coefficient"))).alias(k) for n, k in enumerate(names)]
    )
    terms = [F.col(c) * F.col(k) for c, k in zip(columns, names)]
    known = F.coalesce(*terms).isNotNull()  # without any term the sum is null
    total = None
    for term in terms:
        part = F.coalesce(term, F.lit(0.0))
        total = part if total is None else total + part
    return rows.crossJoin(F.broadcast(wide)).withColumn("source", F.when(known, total)).drop(*names)


def evidence_mean(residuals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half the mean over evidence ids of the mean square inside an id.

    Repeating a factor under the same evidence id adds no weight.
    """
    inner = residuals.groupBy(*by, "evidence_id").agg(
        F.avg(F.col("residual") * F.col("residual")).alias("_m")
    )
    grouped = inner.groupBy(*by) if by else inner
    return grouped.agg(
        (0.5 * F.avg("_m")).alias("loss"), F.count("*").alias("n_evidence")
    )


# --- evidence priors ---------------------------------------------------------


def prior_nll(statistics: DataFrame, precision: DataFrame) -> DataFrame:
    """Correlated Gaussian NLL per group.

    ``statistics`` rows (group_id, r, x, mean); ``precision`` rows (group_id, r, c, p)
    and a ``logdet`` of the covariance on every row. Groups are small by design.
    """
    d = statistics.select("group_id", "r", (F.col("x") - F.col("mean")).alias("d"))
    left = precision.join(d, ["group_id", "r"])
    right = d.select("group_id", F.col("r").alias("c"), F.col("d").alias("e"))
    size = statistics.groupBy("group_id").agg(F.count("*").alias("n"))
    quad = left.join(right, ["group_id", "c"]).groupBy("group_id").agg(
        F.sum(F.col("d") * F.col("p") * F.col("e")).alias("quad"),
        F.first("logdet").alias("logdet"),
    )
    value = 0.5 * F.col("quad") + 0.5 * F.col("logdet") + F.col("n") * (
        0.5 * math.log(2.0 * math.pi)
    )
    return quad.join(size, "group_id").select("group_id", value.alias("nll"))


def shared_offset_information(df: DataFrame, group: str, local: str, shared: str) -> DataFrame:
    """Information of n observations with a common offset: n / (s_l^2 + n s_s^2)."""
    n = F.col("n")
    return (
        df.groupBy(group)
        .agg(F.count("*").alias("n"), F.first(local).alias("_l"), F.first(shared).alias("_s"))
        .select(
            group,
            "n",
            (n / (F.col("_l") * F.col("_l") + n * F.col("_s") * F.col("_s"))).alias("information"),
        )
    )


def merge_evidence(groups: DataFrame, order: str = "group_id") -> DataFrame:
    """One canonical row per (kind, set of parent ids); the first in ``order`` wins.

    ``min_by`` combines on the map side, so many copies of one factor stay cheap.
    """
    key = F.array_join(F.array_sort("parents"), "|")
    others = [c for c in groups.columns if c not in ("kind",)]
    return (
        groups.withColumn("_key", key)
        .groupBy("kind", "_key")
        .agg(
            F.min_by(F.struct(*others), order).alias("_g"),
            F.count("*").alias("merged"),
        )
        .select("kind", "_g.*", "merged")
    )


def loss_roles(domains: DataFrame, policy: str = "fixed_per_domain") -> DataFrame:
    """One role per domain when trajectory and budget both claim it, else the domain's first kind.

    ``domains`` rows are (domain_id, kind). Two flags per domain are enough, so no
    list of kinds is gathered.
    """
    both = "budget" if policy == "fixed_per_domain" else "trajectory"
    flags = domains.groupBy("domain_id").agg(
        F.bool_or(F.col("kind") == "trajectory").alias("t"),
        F.bool_or(F.col("kind") == "budget").alias("b"),
        F.min("kind").alias("other"),
    )
    return flags.select(
        "domain_id",
        F.when(F.col("t") & F.col("b"), both).otherwise(F.col("other")).alias("role"),
    )


def spline_rate(queries: DataFrame, knots: DataFrame, key: str = "segment_id") -> DataFrame:
    """Piecewise-linear rate at ``tau`` from knots (key, t, c), clamped at the ends."""
    w = Window.partitionBy(key).orderBy("t")
    span = knots.select(
        key,
        F.col("t").alias("t0"),
        F.col("c").alias("c0"),
        F.lead("t").over(w).alias("t1"),
        F.lead("c").over(w).alias("c1"),
        F.lag("t").over(w).isNull().alias("first"),
    )
    tau = F.col("tau")
    inside = (tau >= F.col("t0")) & (F.col("t1").isNull() | (tau < F.col("t1")))
    joined = queries.join(span, key).where(inside | (F.col("first") & (tau < F.col("t0"))))
    f = F.when((tau <= F.col("t0")) | F.col("t1").isNull(), 0.0).otherwise(
        (tau - F.col("t0")) / (F.col("t1") - F.col("t0"))
    )
    rate = F.when(f == 0, F.col("c0")).otherwise(F.col("c0") + f * (F.col("c1") - F.col("c0")))
    return joined.select(*queries.columns, rate.alias("rate"))


# --- region selection --------------------------------------------------------


def balanced_regions(candidates: DataFrame, max_regions: int | None = None) -> DataFrame:
    """Cells per plate with alternating roles and ``left_out``, the plate's cells not chosen.

    ``candidates`` rows are grid cells (plate_id, i, j); the grid bounds a plate's
    rows. Plates take turns: first trajectory, next budget. Without ``max_regions`` all cells
    are chosen; with it, cells are taken at even strides under an equal quota per plate.
    """
    from . import ordering

    located = candidates.where(F.col("plate_id") >= 0)
    plates = ordering.dense_ids(located, "plate_id", "plate_rank")
    role = F.when(F.col("plate_rank") % 2 == 0, "trajectory").otherwise("budget")
    ranked = located.join(plates, "plate_id").withColumn("role", role)
    if max_regions is None:
        return ranked.withColumn("left_out", F.lit(0).cast("long"))
    total = plates.agg(F.count("*").alias("m")).select("m").scalar()
    counts = located.groupBy("plate_id").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("plate_id").orderBy("i", "j")
    quota = F.greatest(F.lit(1), F.floor(F.lit(max_regions) / total))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("_quota")))
    # With more plates than regions the quota is one each: the first plates win.
    chosen = (
        (F.col("_k") % stride == 0)
        & (F.floor(F.col("_k") / stride) < F.col("_quota"))
        & (F.col("plate_rank") < max_regions)
    )
    marked = ranked.join(counts, "plate_id").withColumns({"_k": F.row_number().over(w) - 1, "_quota": quota})
    taken = F.least(F.col("_quota"), F.ceil(F.col("_n") / stride))
    return marked.where(chosen).withColumn("left_out", (F.col("_n") - taken).cast("long")).drop("_n", "_k", "_quota")
