"""Polygons on the sphere as edge tables: containment, distance, coverage.

A polygon table has one row per ring vertex:
``feature_id, part, ring, role, vertex, lon, lat``. ``role`` is 'exterior' or
'hole'; ``part`` groups an exterior with its holes. Rings are never gathered into
one row, so a ring may have any number of vertices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sphere
from ..functions.sphere import vec_columns, vec_of
from ..sources.storage import stored
from . import spherebins

RING = ("feature_id", "part", "ring")
_HEMISPHERE_TOLERANCE = 1e-6


def unwrap_longitudes(vertices: DataFrame, ring: Sequence[str] = RING) -> DataFrame:
    """Add ``unwrapped_lon``: consecutive differences never exceed half a turn."""
    w = Window.partitionBy(*ring).orderBy("vertex")
    d = F.col("lon") - F.lag("lon").over(w)
    # Whole turns to take off each raw step, summed along the ring.
    turns = F.when(d > 180, -F.ceil((d - 180) / 360)).when(d < -180, F.ceil((-d - 180) / 360))
    marked = vertices.withColumn("_turn", F.coalesce(turns, F.lit(0)))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(
        "unwrapped_lon", F.col("lon") + 360.0 * F.sum("_turn").over(running)
    ).drop("_turn")


def clean_rings(vertices: DataFrame, ring: Sequence[str] = RING) -> DataFrame:
    """Drop repeated consecutive vertices and a closing vertex equal to the first."""
    w = Window.partitionBy(*ring).orderBy("vertex")
    here = F.struct("lon", "lat")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = (
        vertices.withColumn("_prev", F.lag(here).over(w))
        .where(F.col("_prev").isNull() | (F.col("_prev") != here))
        .drop("_prev")
    )
    marked = kept.withColumns(
        {
            "_first": F.first(here).over(whole),
            "_is_last": F.lead("vertex").over(w).isNull(),
            "_is_first": F.lag("vertex").over(w).isNull(),
        }
    )
    closing = F.col("_is_last") & ~F.col("_is_first") & (here == F.col("_first"))
    return marked.where(~closing).drop("_first", "_is_last", "_is_first")


def short_rings(vertices: DataFrame, ring: Sequence[str] = RING) -> DataFrame:
    """Rings with fewer than three vertices (rejects)."""
    return vertices.groupBy(*ring).agg(F.count("*").alias("n")).where(F.col("n") < 3)


def edges(vertices: DataFrame, ring: Sequence[str] = RING, carry: Sequence[str] = ()) -> DataFrame:
    """Directed edges ``a -> b`` of every ring, closed: vectors and end longitudes."""
    w = Window.partitionBy(*ring).orderBy("vertex")
    first = F.first(F.struct("lon", "lat")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    nxt = F.coalesce(F.lead(F.struct("lon", "lat")).over(w), first)
    rows = vertices.select(
        *ring,
        *carry,
        "vertex",
        F.col("lon").alias("a_lon"),
        F.col("lat").alias("a_lat"),
        nxt["lon"].alias("b_lon"),
        nxt["lat"].alias("b_lat"),
        first["lon"].alias("f_lon"),
        first["lat"].alias("f_lat"),
    )
    return rows.withColumns(
        {
            **vec_columns(sphere.unit_vector("a_lon", "a_lat"), "a_"),
            **vec_columns(sphere.unit_vector("b_lon", "b_lat"), "b_"),
        }
    )


def _lon_step() -> Column:
    """Signed longitude step of an edge, the short way round."""
    return sphere.wrap180(F.col("b_lon") - F.col("a_lon"))


def ring_summary(edge_rows: DataFrame, ring: Sequence[str] = RING) -> DataFrame:
    """Per ring: signed area (steradian), turns around the north pole, vertex count.

    The area is a sum of signed triangles from the ring's first vertex. No point of the
    ring lies south of ``lat_floor``: an arc leaves the latitudes of its ends by at most
    half its length.
    """
    f = sphere.unit_vector("f_lon", "f_lat")
    excess = sphere.triangle_excess(f, vec_of("a_"), vec_of("b_"))
    return edge_rows.groupBy(*ring).agg(
        F.sum(excess).alias("signed_area_sr"),
        (F.sum(_lon_step()) / 360.0).alias("pole_turns"),
        (
            F.min("a_lat") - F.degrees(F.max(sphere.angle(vec_of("a_"), vec_of("b_")))) / 2.0
        ).alias("lat_floor"),
        F.count("*").alias("n_vertices"),
    )


def ring_report(vertices: DataFrame, ring: Sequence[str] = RING) -> DataFrame:
    """Sanity row per ring: area within a sphere, at least three vertices."""
    s = ring_summary(edges(vertices, ring), ring)
    ok = (F.abs("signed_area_sr") <= 4 * math.pi + 1e-6) & (F.col("n_vertices") >= 3)
    return s.withColumn("valid", ok)


def hemisphere_rings(vertices: DataFrame, ring: Sequence[str] = RING) -> DataFrame:
    """Rings whose inside is ambiguous because they bound half the sphere (rejects).

    Containment refuses them; list them first to take them out.
    """
    s = ring_summary(edges(vertices, ring), ring)
    return s.where(F.abs(F.abs("signed_area_sr") - 2 * math.pi) < _HEMISPHERE_TOLERANCE)


def _strips(edge_rows: DataFrame, ring: Sequence[str], carry: Sequence[str], cell: float) -> DataFrame:
    """Edges spread over the longitude strips that they span, with the part of a strip they cover.

    An edge covers ``from <= lon < to``. Vertex longitudes are wrapped once, so two edges that
    share a vertex always agree on which side of a meridian it lies.
    """
    strips = int(round(360.0 / cell))
    west, east = F.least("a", "b"), F.greatest("a", "b")
    seam = east - west > 180.0  # covers from the eastern vertex over the seam to the western one
    first, last = F.floor(west / cell), F.floor(east / cell)
    n = sphere.cross(vec_of("a_"), vec_of("b_"))
    spread = (
        edge_rows.withColumns({"a": sphere.wrap360("a_lon"), "b": sphere.wrap360("b_lon")})
        .where(F.col("a") != F.col("b"))
        .select(
            *ring,
            *carry,
            west.alias("west"),
            east.alias("east"),
            F.when(F.col("a") < F.col("b"), F.col("a_lat")).otherwise(F.col("b_lat")).alias("west_lat"),
            F.when(F.col("a") < F.col("b"), F.col("b_lat")).otherwise(F.col("a_lat")).alias("east_lat"),
            seam.alias("seam"),
            # The crossing of a meridian is at tan(lat) = (mx cos(lon) + my sin(lon)) / mz.
            (-n.x * F.signum(n.z)).alias("mx"),
            (-n.y * F.signum(n.z)).alias("my"),
            F.abs(n.z).alias("mz"),
            F.explode(
                F.when(seam, F.sequence(last, first + strips)).otherwise(F.sequence(first, last))
            ).alias("_raw"),
        )
    )
    after = F.col("_raw") >= strips  # the part of a seam edge that begins at longitude 0
    low = F.when(~F.col("seam"), F.col("west")).when(after, -1.0).otherwise(F.col("east"))
    high = F.when(~F.col("seam"), F.col("east")).when(after, F.col("west")).otherwise(361.0)
    strip = F.pmod(F.col("_raw"), F.lit(strips)).cast("int")
    return spread.select(
        *ring,
        *carry,
        "mx",
        "my",
        "mz",
        low.alias("from"),
        high.alias("to"),
        F.when(F.col("seam"), F.col("east_lat")).otherwise(F.col("west_lat")).alias("from_lat"),
        F.when(F.col("seam"), F.col("west_lat")).otherwise(F.col("east_lat")).alias("to_lat"),
        strip.alias("strip"),
        (strip * cell).alias("lon0"),
    )


def _reach(lon) -> Column:
    """mz tan(lat) of an edge at a longitude in degrees."""
    return F.col("mx") * F.cos(F.radians(lon)) + F.col("my") * F.sin(F.radians(lon))


def _above(reach, lat) -> Column:
    """Whether an edge runs north of a latitude where it has this ``reach``; divides by nothing."""
    return reach * F.cos(F.radians(lat)) > F.col("mz") * F.sin(F.radians(lat))


def _inside_cells(
    strips: DataFrame, rings: DataFrame, ring: Sequence[str], carry: Sequence[str], cell: float
) -> DataFrame:
    """(ring, carry, strip, band): cells whose north-western corner lies in the ring.

    Along the western meridian of a strip a ring's crossings, sorted from the north, bound the
    bands that are inside in turn. The sort holds one ring's crossings of one meridian.
    """
    bands = int(round(180.0 / cell))
    top = lambda band: (band + 1) * cell - 90.0
    here = strips.where((F.col("from") <= F.col("lon0")) & (F.col("lon0") < F.col("to")))
    reach = _reach(F.col("lon0"))
    near = F.floor((F.degrees(F.atan2(reach, F.col("mz"))) + 90.0) / cell).cast("int")
    # Bands below the crossing, by the same comparison that points make with this edge.
    below = near - 1 + _above(reach, top(near - 1)).cast("int") + _above(reach, top(near)).cast("int")
    crossings = here.select(*ring, *carry, "strip", sphere.clip(below, 0, bands).cast("int").alias("below"))
    order = Window.partitionBy(*ring, *carry, "strip").orderBy(F.desc("below"))
    ranked = crossings.withColumns(
        {
            "rank": F.row_number().over(order),
            "next": F.coalesce(F.lead("below").over(order), F.lit(0)),
        }
    ).join(rings, list(ring))
    between = F.when((F.col("rank") % 2 == 1) != F.col("holds_north"), F.struct(F.col("next").alias("lo"), F.col("below").alias("hi")))
    capped = F.when(
        F.col("holds_north") & (F.col("rank") == 1),
        F.struct(F.col("below").alias("lo"), F.lit(bands).alias("hi")),
    )
    return (
        ranked.withColumn("_r", F.coalesce(capped, between))
        .where(F.col("_r.lo") < F.col("_r.hi"))
        .select(*ring, *carry, "strip", F.explode(F.sequence(F.col("_r.lo"), F.col("_r.hi") - 1)).alias("band"))
    )


def _cell_edges(strips: DataFrame, ring: Sequence[str], carry: Sequence[str], cell: float) -> DataFrame:
    """Edges once for each cell that they may touch, with their side of the cell's northern border."""
    bands = int(round(180.0 / cell))
    start = F.greatest("from", "lon0")
    end = F.least(F.col("to"), F.col("lon0") + cell)
    lat_at = lambda lon: F.degrees(F.atan2(_reach(lon), F.col("mz")))
    # A great circle is farthest north at the longitude of (mx, my), farthest south opposite.
    crest = sphere.wrap360(F.degrees(F.atan2("my", "mx")))
    peak = F.degrees(F.atan2(F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2), F.col("mz")))
    within = lambda lon: (lon >= F.col("_s") - 1e-9) & (lon <= F.col("_e") + 1e-9)
    covered = strips.withColumns({"_s": start, "_e": end}).where(F.col("_s") < F.col("_e"))
    ends = covered.withColumns({"_p": lat_at(F.col("_s")), "_q": lat_at(F.col("_e")), "_crest": crest})
    low = F.least("_p", "_q", F.when(within(sphere.wrap360(F.col("_crest") + 180.0)), -peak))
    high = F.greatest("_p", "_q", F.when(within(F.col("_crest")), peak))
    band = lambda lat: sphere.clip(F.floor((lat + 90.0) / cell), 0, bands - 1).cast("int")
    spread = ends.withColumn("band", F.explode(F.sequence(band(low - 1e-9), band(high + 1e-9))))
    top = (F.col("band") + 1) * cell - 90.0
    first_side = F.when(F.col("from") > F.col("lon0"), F.col("from_lat") > top).otherwise(
        _above(_reach(F.col("lon0")), top)
    )
    return spread.select(
        *ring,
        *carry,
        "strip",
        "band",
        "mx",
        "my",
        "mz",
        "from",
        "to",
        start.alias("start"),
        first_side.alias("start_above"),
        (F.col("to_lat") > top).alias("end_above"),
        F.cos(F.radians(top)).alias("_ct"),
        F.sin(F.radians(top)).alias("_st"),
    )


def _cell_tables(
    points: DataFrame,
    vertices: DataFrame,
    point_keys: Sequence[str],
    ring: Sequence[str],
    carry: Sequence[str],
    by: Sequence[str],
    cell: float,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points with their cells, and the rings in these cells: whole, at the corner only, and their edges.

    Cells without a point are left out before any ring is spread over them. Both tables of rings
    are stored, since each is read several times.
    """
    extra = [c for c in by if c not in ring]
    carried = [*carry, *extra]
    edge_rows = edges(vertices, ring, carried)
    summary = ring_summary(edge_rows, ring)
    # A ring that bounds half the sphere has two insides: the job stops and names it.
    halved = F.abs(F.abs("signed_area_sr") - 2 * math.pi) < _HEMISPHERE_TOLERANCE
    refusal = F.raise_error(F.concat_ws(" ", F.lit("ring bounds half the sphere:"), *ring))
    north = F.col("pole_turns") * F.signum("signed_area_sr") > 0.5
    rings = summary.select(
        *ring, F.when(halved, refusal.cast("boolean")).otherwise(north).alias("holds_north")
    )
    lon, lat = sphere.wrap360("lon"), F.col("lat")
    bands = int(round(180.0 / cell))
    at = points.select(
        *point_keys,
        *[c for c in by if c not in point_keys],
        lon.alias("_lon"),
        F.cos(F.radians("lon")).alias("_cl"),
        F.sin(F.radians("lon")).alias("_sl"),
        F.cos(F.radians("lat")).alias("_cp"),
        F.sin(F.radians("lat")).alias("_sp"),
        F.pmod(F.floor(lon / cell), F.lit(int(round(360.0 / cell)))).cast("int").alias("strip"),
        sphere.clip(F.floor((lat + 90.0) / cell), 0, bands - 1).cast("int").alias("band"),
    )
    place = [*by, "strip", "band"]
    occupied = at.select(*place).distinct()
    strips = _strips(edge_rows, ring, carried, cell).join(
        occupied.select(*by, "strip").distinct(), [*by, "strip"], "left_semi"
    )
    inner = stored(_inside_cells(strips, rings, ring, carried, cell).join(occupied, place, "left_semi"))
    upright = _meridian_edges(edge_rows, ring, carried, cell)
    near = stored(_cell_edges(strips, ring, carried, cell).unionByName(upright).join(occupied, place, "left_semi"))
    # A cell that no edge of a ring touches is inside as a whole; its points need no counting.
    # These joins are merged: plans expect far fewer rows of rings than there are, and would have
    # the driver gather them for a broadcast.
    touched = near.select(*ring, *extra, "strip", "band").distinct().hint("merge")
    same = [*ring, *extra, "strip", "band"]
    return at, inner.join(touched, same, "left_anti"), inner.join(touched, same, "left_semi"), near


def _settled_and_counted(
    at: DataFrame, whole: DataFrame, corners: DataFrame, near: DataFrame, place: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """``keys`` of every point and ring around it, from the tables of cells.

    Merged, as in ``_cell_tables``, so that no table of rings is gathered on the driver.
    """
    settled = at.join(whole.hint("merge"), place).select(*keys)
    at_corner = at.join(corners.hint("merge"), place).select(*keys)
    met = at.join(near.hint("merge"), place)
    reach = F.col("mx") * F.col("_cl") + F.col("my") * F.col("_sl")
    above = reach * F.col("_cp") > F.col("mz") * F.col("_sp")
    above_top = reach * F.col("_ct") > F.col("mz") * F.col("_st")
    # North along the point's meridian, half-open in longitude; then west along the border.
    up = (F.col("from") <= F.col("_lon")) & (F.col("_lon") < F.col("to")) & (above != above_top)
    reached = F.when(F.col("to") <= F.col("_lon"), F.col("end_above")).otherwise(above_top)
    upright = (F.col("from") == F.col("to")) & (F.col("to") <= F.col("_lon"))
    along = ((F.col("start") < F.least("to", "_lon")) | upright) & (F.col("start_above") != reached)
    crossed = met.where(up != along).select(*keys)
    counted = (
        at_corner.unionByName(crossed)
        .groupBy(*keys)
        .agg(F.count("*").alias("_crossings"))
        .where(F.col("_crossings") % 2 == 1)
        .drop("_crossings")
    )
    return settled.unionByName(counted)


def _meridian_edges(edge_rows: DataFrame, ring: Sequence[str], carry: Sequence[str], cell: float) -> DataFrame:
    """Edges along a meridian inside a strip, once for each cell they touch, shaped like ``_cell_edges``.

    No way north crosses them, but the way west along a cell's border may. On a strip's own
    western border they lie beyond the corner, as points on a meridian count as just east of it.
    """
    bands = int(round(180.0 / cell))
    m = F.col("from")
    band = lambda lat: sphere.clip(F.floor((lat + 90.0) / cell), 0, bands - 1).cast("int")
    rows = (
        edge_rows.withColumns({"from": sphere.wrap360("a_lon"), "to": sphere.wrap360("b_lon")})
        .where(F.col("from") == F.col("to"))
        .withColumn("strip", F.pmod(F.floor(m / cell), F.lit(int(round(360.0 / cell)))).cast("int"))
        .where(m > F.col("strip") * cell)
        .withColumn(
            "band",
            F.explode(F.sequence(band(F.least("a_lat", "b_lat")), band(F.greatest("a_lat", "b_lat")))),
        )
    )
    top = (F.col("band") + 1) * cell - 90.0
    return rows.select(
        *ring,
        *carry,
        "strip",
        "band",
        *[F.lit(0.0).alias(c) for c in ("mx", "my", "mz")],
        "from",
        "to",
        m.alias("start"),
        (F.col("a_lat") > top).alias("start_above"),
        (F.col("b_lat") > top).alias("end_above"),
        F.cos(F.radians(top)).alias("_ct"),
        F.sin(F.radians(top)).alias("_st"),
    )


def ring_hits(
    points: DataFrame,
    vertices: DataFrame,
    *,
    point_keys: Sequence[str],
    ring: Sequence[str] = RING,
    carry: Sequence[str] = (),
    by: Sequence[str] = (),
    cell: float = 1.0,
) -> DataFrame:
    """(point keys, ring keys) for every ring that contains the point.

    The sphere is cut into cells of ``cell`` degrees, numbered by strip of longitude and band of
    latitude. The way from a point north to the border of its cell and then west to the
    corner stays in the cell, so only edges of that cell can be crossed; whether the corner is
    inside was settled once for each cell and ring. A point is inside if the corner's state and the
    number of edges crossed are odd together. A point thus meets the edges of one cell and one row for
    each ring around it, both by an equi join on the cell; map-side counting leaves one
    row per (point, ring) to shuffle. Distinct positions should be passed in, not every record
    (see ``assign_plates``).
    """
    by = list(by)
    tables = _cell_tables(points, vertices, point_keys, ring, carry, by, cell)
    keys = list(dict.fromkeys([*point_keys, *by, *ring, *carry]))
    return _settled_and_counted(*tables, [*by, "strip", "band"], keys)


def _covering(whole: DataFrame, corners: DataFrame, near: DataFrame, place: Sequence[str]) -> DataFrame:
    """Exteriors that fill a cell in which their part has no hole: they hold every point of the cell."""
    part = [*dict.fromkeys([*place, "feature_id", "part"])]
    holes = [t.where("role = 'hole'").select(*part) for t in (whole, corners, near)]
    dented = holes[0].unionByName(holes[1]).unionByName(holes[2]).distinct().hint("merge")
    return whole.where("role = 'exterior'").join(dented, part, "left_anti")


def containing_features(
    points: DataFrame,
    vertices: DataFrame,
    *,
    point_keys: Sequence[str],
    carry: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """(point keys, feature_id, carry) of every feature that contains the point.

    A part holds the point when its exterior does and none of its holes does; a
    feature holds it when any part does.
    """
    return _holding_parts(points, vertices, point_keys, carry, list(by)).distinct()


def _holding_parts(
    points: DataFrame, vertices: DataFrame, point_keys: Sequence[str], carry: Sequence[str], by: list[str]
) -> DataFrame:
    """(point keys, feature_id, carry), once for every part that holds the point."""
    hits = ring_hits(points, vertices, point_keys=point_keys, carry=["role", *carry], by=by)
    return _parts_of(hits, list(dict.fromkeys([*point_keys, *by])), carry)


def _parts_of(hits: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    parts = hits.groupBy(*dict.fromkeys([*keys, "feature_id", *carry, "part"])).agg(
        F.bool_or(F.col("role") == "exterior").alias("_in"),
        F.bool_or(F.col("role") == "hole").alias("_hole"),
    )
    return parts.where(F.col("_in") & ~F.col("_hole")).select(*dict.fromkeys([*keys, "feature_id", *carry]))


def assign_plates(
    points: DataFrame, vertices: DataFrame, *, by: Sequence[str] = (), out: str = "plate_id"
) -> DataFrame:
    """Plate of the first polygon (lowest ``priority``) containing each point, else -1.

    ``vertices`` carries ``plate_id`` and ``priority``; of equal priorities the lowest plate
    counts. Equal positions are resolved once and joined back. A polygon that fills a whole cell
    hides all later ones there, so a cell keeps only rings that come no later than its first
    such polygon, however many polygons lie on top of each other.
    """
    by = list(by)
    position, place = [*by, "lon", "lat"], [*by, "strip", "band"]
    unique = points.select(*position).distinct()
    carry = ["role", "plate_id", "priority"]
    at, *tables = _cell_tables(unique, vertices, position, RING, carry, by, 1.0)
    best = _covering(*tables, place).groupBy(*place).agg(F.min("priority").alias("_best")).hint("merge")
    early = [
        t.join(best, place, "left").where(F.col("_best").isNull() | (F.col("priority") <= F.col("_best"))).drop("_best")
        for t in tables
    ]
    keys = list(dict.fromkeys([*position, *RING, *carry]))
    hits = _settled_and_counted(at, *early, place, keys)
    inside = _parts_of(hits, position, carry[1:]).where(F.col("priority").isNotNull())
    first = inside.groupBy(*position).agg(F.min_by("plate_id", F.struct("priority", "plate_id")).alias("_plate"))
    joined = points.join(first, position, "left")
    return joined.withColumn(out, F.coalesce("_plate", F.lit(-1)).cast("int")).drop("_plate")


def override_ids(assigned: DataFrame, network: str, plate: str, out: str = "plate_id") -> DataFrame:
    """Network ids replace plate ids where a network covers the point."""
    covered = F.col(network) >= 0
    return assigned.withColumns(
        {"in_network": covered, out: F.when(covered, F.col(network)).otherwise(F.col(plate))}
    )


# --- boundaries --------------------------------------------------------------


def densified_edges(
    edge_rows: DataFrame, step_deg: float, keep: Sequence[str], offset: float = 0.0
) -> DataFrame:
    """Samples along every arc no farther apart than ``step_deg``: ``t_lon, t_lat``.

    They begin ``offset`` steps from the arc's start: 0 at its vertex; with 0.5 every
    point of an arc lies within half a step of a sample of that arc. Edge vectors stay on the row for exact arc distances.
    """
    pieces = F.greatest(F.ceil(F.degrees("arc") / step_deg), F.lit(1)).cast("int")
    vectors = [f"{p}_{c}" for p in "ab" for c in "xyz"]
    rows = edge_rows.select(
        *keep, *vectors, sphere.angle(vec_of("a_"), vec_of("b_")).alias("arc")
    ).withColumn("_n", pieces)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = sphere.with_slerp(rows, "a_", "b_", (F.col("_k") + offset) / F.col("_n"), "t_", omega="arc")
    lon, lat = sphere.to_lonlat(vec_of("t_"))
    return rows.withColumns({"t_lon": lon, "t_lat": lat}).drop("_n", "_k", "arc")


def _arcs(vertices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every arc of the outlines once per key, with its end vectors.

    Polygons that repeat or share an arc bring nobody nearer, so copies end before arcs are cut into samples.
    """
    ends = ("a_lon", "a_lat", "b_lon", "b_lat")
    extra = [c for c in by if c not in RING]
    rows = edges(vertices, RING, extra).select(*by, *ends).distinct()
    return rows.withColumns(
        {
            **vec_columns(sphere.unit_vector("a_lon", "a_lat"), "a_"),
            **vec_columns(sphere.unit_vector("b_lon", "b_lat"), "b_"),
        }
    )


def boundary_vertex_distance(
    points: DataFrame,
    vertices: DataFrame,
    *,
    point_keys: Sequence[str],
    by: Sequence[str] = (),
    tessellation_deg: float = 0.5,
    cap_km: float | None = 3000.0,
) -> DataFrame:
    """Distance to the nearest tessellated boundary vertex, capped."""
    by = list(by)
    samples = densified_edges(_arcs(vertices, by), tessellation_deg, by)
    targets = samples.select(*by, "t_lon", "t_lat", "t_x", "t_y", "t_z")
    return spherebins.nearest_distance(
        points,
        targets,
        sphere.angle(vec_of("p_"), vec_of("t_")),
        point_keys=point_keys,
        by=by,
        cap_km=cap_km,
        out="boundary_km",
    )


def outline_distance(
    points: DataFrame,
    vertices: DataFrame,
    *,
    point_keys: Sequence[str],
    by: Sequence[str] = (),
    sample_deg: float = 1.0,
    cap_km: float | None = None,
) -> DataFrame:
    """Exact distance to the nearest outline arc, optionally capped.

    Arcs are found through samples no farther than ``sample_deg / 2`` from any of their points; the distance itself
    is to the whole arc.
    """
    by = list(by)
    targets = densified_edges(_arcs(vertices, by), sample_deg, by, 0.5).withColumns(
        vec_columns(sphere.arc_normal(vec_of("a_"), vec_of("b_")), "n_")
    ).drop("t_x", "t_y", "t_z")
    return spherebins.nearest_distance(
        points,
        targets,
        sphere.arc_distance(vec_of("p_"), vec_of("a_"), vec_of("b_"), vec_of("n_")),
        point_keys=point_keys,
        by=by,
        cap_km=cap_km,
        slack=math.radians(sample_deg) / 2,
        out="outline_km",
    )


def coverage_fraction(
    cells: DataFrame, vertices: DataFrame, dlat: float, dlon: float, subsample: int = 2
) -> DataFrame:
    """Share of sub-cell probes of each cell inside the union of the polygons.

    ``cells`` has ``i, j, lat, lon``.
    """
    if subsample < 1:
        raise ValueError("subsample must be at least 1")
    offsets = [(k + 0.5) / subsample - 0.5 for k in range(subsample)]
    probe = F.explode(
        F.array(
            *[
                F.struct(F.lit(a * dlat).alias("da"), F.lit(b * dlon).alias("db"))
                for a in offsets
                for b in offsets
            ]
        )
    )
    probes = cells.select("i", "j", "lat", "lon", probe.alias("o")).select(
        "i",
        "j",
        (F.col("lon") + F.col("o.db")).alias("lon"),
        sphere.clip(F.col("lat") + F.col("o.da"), -90.0, 90.0).alias("lat"),
        F.col("o.da").alias("da"),
        F.col("o.db").alias("db"),
    )
    keys = ["i", "j", "da", "db"]
    place = ["strip", "band"]
    at, *tables = _cell_tables(probes, vertices, keys, RING, ["role"], [], 1.0)
    # Probes of a cell that one polygon fills are inside; rings are met only in the other cells.
    filled = _covering(*tables, place).select(*place).distinct()
    open_cells = [t.join(filled.hint("merge"), place, "left_anti") for t in tables]
    hits = _settled_and_counted(at, *open_cells, place, [*keys, *RING, "role"])
    surely = at.join(filled, place, "left_semi").select(*keys)
    inside = surely.unionByName(_parts_of(hits, keys, []).select(*keys)).distinct()
    counted = inside.groupBy("i", "j").agg(F.count("*").alias("_n"))
    return cells.join(counted, ["i", "j"], "left").withColumn(
        "coverage", F.coalesce(F.col("_n"), F.lit(0)) / float(subsample**2)
    ).drop("_n")


# --- frame registration ------------------------------------------------------


def registration_report(
    exported: DataFrame, source: DataFrame, tolerance_km: float = 0.001
) -> DataFrame:
    """One row per feature: is an exported outline the same geometry as its source?

    Both inputs are vertex tables. Compares the feature sets, the plate ids, the
    largest vertex-to-nearest-vertex distance in both directions, and the largest
    distance of an exported edge's midpoint from the source outline.
    """
    arc = [f"{p}_{c}" for p in "abn" for c in "xyz"]

    def corners(df: DataFrame, check: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "feature_id", "lon", "lat").distinct()

    def corner_targets(df: DataFrame, check: str) -> DataFrame:
        # A vertex is an arc without length: its normal is null and only its ends count.
        v = sphere.unit_vector("t_lon", "t_lat")
        named = corners(df, check).select("check", "feature_id", F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
        none = {f"n_{c}": F.lit(None).cast("double") for c in "xyz"}
        return named.withColumns({**vec_columns(v, "a_"), **vec_columns(v, "b_"), **none})

    mid = edges(exported)
    middle = sphere.add(vec_of("a_"), vec_of("b_"))
    lon, lat = sphere.to_lonlat(middle)
    midpoints = mid.where(sphere.norm(middle) >= 1e-12).select(
        F.lit("edge").alias("check"), "feature_id", lon.alias("lon"), lat.alias("lat")
    ).distinct()
    antipodal = mid.where(sphere.norm(middle) < 1e-12).groupBy("feature_id").agg(
        F.count("*").alias("antipodal_edges")
    )
    sample_deg = 1.0
    arcs = densified_edges(edges(source), sample_deg, ["feature_id"], 0.5).withColumns(
        {**vec_columns(sphere.arc_normal(vec_of("a_"), vec_of("b_")), "n_"), "check": F.lit("edge")}
    )
    columns = ["check", "feature_id", "t_lon", "t_lat", *arc]
    # Both directions and the midpoints in one search, keyed by check and feature.
    worst = spherebins.nearest_distance(
        corners(exported, "forward").unionByName(corners(source, "backward")).unionByName(midpoints),
        corner_targets(source, "forward")
        .unionByName(corner_targets(exported, "backward"))
        .select(*columns)
        .unionByName(arcs.select(*columns)),
        sphere.arc_distance(vec_of("p_"), vec_of("a_"), vec_of("b_"), vec_of("n_")),
        point_keys=["feature_id", "lon", "lat"],
        by=["check", "feature_id"],
        cap_km=None,
        slack=math.radians(sample_deg) / 2,
    )
    of = lambda check: F.max(F.when(F.col("check") == check, F.col("distance_km"))).alias(f"{check}_km")
    gaps = worst.groupBy("feature_id").agg(of("forward"), of("backward"), of("edge"))
    left = exported.groupBy("feature_id").agg(F.min("plate_id").alias("export_plate"))
    right = source.groupBy("feature_id").agg(F.min("plate_id").alias("source_plate"))
    rows = left.join(right, "feature_id", "full_outer")
    for part in (gaps, antipodal):
        rows = rows.join(part, "feature_id", "left")
    present = F.col("export_plate").isNotNull() & F.col("source_plate").isNotNull()
    close = F.greatest("forward_km", "backward_km", "edge_km") <= tolerance_km
    problem = (
        F.when(F.col("export_plate").isNull(), "missing")
        .when(F.col("source_plate").isNull(), "unexpected")
        .when(F.col("export_plate") != F.col("source_plate"), "plate_id")
        .when(F.coalesce("antipodal_edges", F.lit(0)) > 0, "antipodal_edge")
        .when(~close, "geometry")
    )
    return rows.withColumn("problem", problem).withColumn(
        "passed", F.coalesce(present & F.col("problem").isNull(), F.lit(False))
    )
