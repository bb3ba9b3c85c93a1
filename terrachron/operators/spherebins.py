"""Nearest-neighbour and cutoff joins on the sphere without a cross join.

Both sides fall into cells of several widths. How far two cells can be from each other
follows from their centres and radii alone, so the cells worth comparing are found on tables
of occupied cells: wide cells first, and narrower ones only below pairs that may still hold a
nearest target. Points then meet only the targets in the narrowest of those, by equi join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.sphere import clip, vec_columns, vec_of
from ..functions.units import EARTH_RADIUS_KM, as_column
from ..sources.storage import stored


class CellScheme:
    """Latitude bands of ``width`` degrees cut into near-square sectors."""

    def __init__(self, width: float):
        if not 0.001 <= width <= 30:
            raise ValueError("cell width must be between 0.001 and 30 degrees")
        self.bands = int(math.ceil(180.0 / width))
        self.width = 180.0 / self.bands
        # The half diagonal of a width x width cell, 0.711 width at most for widths
        # up to 30 degrees, bounds the distance of its points to its centre. The rest
        # of the factor covers the rounding of an arc cosine.
        self.radius = math.radians(self.width) * 0.72
        self.max_sectors = int(math.ceil(360.0 / self.width)) + 1

    def _sectors(self, band: Column) -> Column:
        """Sectors of a band, from the widest parallel in it."""
        low = -90.0 + band * self.width
        high = low + self.width
        widest = F.when((low < 0) & (high > 0), 1.0).otherwise(
            F.greatest(F.cos(F.radians(low)), F.cos(F.radians(high)))
        )
        return F.greatest(F.ceil(360.0 / self.width * widest), F.lit(1))

    def band(self, lat) -> Column:
        return clip(F.floor((as_column(lat) + 90.0) / self.width), 0, self.bands - 1).cast("int")

    def cell(self, lon, lat) -> Column:
        """Integer cell id: band x (largest sector count) + sector; -1 without a position.

        Never null, so a join on it needs no inferred null filter, which Catalyst would
        push down as one huge inlined expression.
        """
        band = self.band(lat)
        return self._numbered(band, self._sectors(band), sphere.wrap360(lon))

    def _numbered(self, band: Column, n: Column, lon: Column) -> Column:
        sector = F.least(F.floor(lon / 360.0 * n), n - 1)
        return F.coalesce((band * F.lit(self.max_sectors).cast("long") + sector).cast("long"), F.lit(-1).cast("long"))

    def centre(self, cell: Column) -> tuple[Column, Column]:
        """(lon, lat) of a cell's centre."""
        band = F.floor(cell / self.max_sectors)
        sector = cell % self.max_sectors
        n = self._sectors(band)
        return (sector + 0.5) * 360.0 / n, -90.0 + (band + 0.5) * self.width

    def around(self, cell: Column, reach: float) -> Column:
        """Array of all cells whose centre may lie within ``reach`` radians of a centre."""
        band = F.floor(cell / self.max_sectors).cast("int")
        lon, lat = self.centre(cell)
        span = int(math.ceil(math.degrees(reach) / self.width))
        low = F.greatest(band - span, F.lit(0))
        high = F.least(band + span, F.lit(self.bands - 1))

        def in_band(b: Column) -> Column:
            n = self._sectors(b)
            top = F.greatest(F.abs(lat), F.abs(-90.0 + (b + 0.5) * self.width))
            # Half width in longitude of a cap of radius ``reach`` (full circle near a pole).
            ratio = math.sin(min(reach, math.pi / 2)) / F.cos(F.radians(top))
            whole = (F.radians(top) + reach >= math.pi / 2) | (ratio >= 1)
            half = F.when(whole, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
            first = F.floor((lon - half) / 360.0 * n) - 1
            last = F.floor((lon + half) / 360.0 * n) + 1
            last = F.least(last, first + n - 1)
            return F.transform(
                F.sequence(first, last),
                lambda s: (b * F.lit(self.max_sectors).cast("long") + F.pmod(s, n)).cast("long"),
            )

        return F.flatten(F.transform(F.sequence(low, high), in_band))


def _with_cells(df: DataFrame, lon: str, lat: str, schemes: dict[str, CellScheme]) -> DataFrame:
    """``df`` with the cell of every named scheme.

    Bands and sectors are columns of their own: one expression would work each out a dozen times.
    """
    bands = {f"_{c}_band": s.band(lat) for c, s in schemes.items()}
    sectors = {f"_{c}_n": s._sectors(F.col(f"_{c}_band")) for c, s in schemes.items()}
    cells = {c: s._numbered(F.col(f"_{c}_band"), F.col(f"_{c}_n"), F.col("_lon")) for c, s in schemes.items()}
    placed = df.withColumns({"_lon": sphere.wrap360(lon), **bands}).withColumns(sectors)
    return placed.withColumns(cells).drop("_lon", *bands, *sectors)


#: Widest cells of a search, in degrees, and how often they may be halved where targets are dense.
COARSEST = 12.0
LEVELS = 13
#: Targets that share a cell, on average over the targets, at which a search stops to descend.
FEW_TARGETS = 24.0
#: Levels whose targets are counted in one pass.
LEVELS_AT_ONCE = 4


def _centre(cell: str, scheme: CellScheme, prefix: str) -> dict[str, Column]:
    """Vector of a cell's centre, as columns that are never null."""
    v = vec_columns(sphere.unit_vector(*scheme.centre(F.col(cell))), prefix)
    return {k: F.coalesce(c, F.lit(0.0)) for k, c in v.items()}


def _useful(pairs: DataFrame, radii: float, by: Sequence[str], reach: float, slack: float) -> DataFrame:
    """Pairs of cells that may hold a point and its nearest target; ``radii`` is the sum of both radii.

    The nearest target of any point is at most the smallest ``angle + radii`` of its cell
    away, and a pair's targets are at least ``angle - radii`` away.
    """
    angle = F.acos(clip(sphere.dot(vec_of("c_"), vec_of("g_")), -1.0, 1.0))
    measured = pairs.withColumn("angle", angle)
    bound = measured.groupBy(*by, "cell").agg((F.min("angle") + radii).alias("best"))
    nearest = F.least(F.col("best") + slack, F.lit(reach))
    return (
        measured.join(bound.hint("merge"), [*by, "cell"])
        .where(F.col("angle") - radii <= nearest)
        .drop("angle", "best")
    )


def _depth(targets: DataFrame, schemes: Sequence[CellScheme], by: Sequence[str]) -> int:
    """Halvings of the widest cells after which targets share their cell with few others.

    The driver reads a number a level. A few levels are counted at a time, wide cells first, as their
    counts shrink to few rows before they are shuffled and most searches end among them.
    """
    for first in range(0, LEVELS, LEVELS_AT_ONCE):
        wanted = range(first, min(first + LEVELS_AT_ONCE, LEVELS))
        cells = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"c{k}").alias("cell")) for k in wanted])
        counts = (
            _with_cells(targets.select(*by, "t_lon", "t_lat"), "t_lon", "t_lat", {f"c{k}": schemes[k] for k in wanted})
            .select(*by, F.explode(cells).alias("c"))
            .groupBy(*by, "c.level", "c.cell")
            .agg(F.count("*").alias("n"))
        )
        found = dict(counts.groupBy("level").agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).collect())
        for k in wanted:
            if found.get(k, 0.0) <= FEW_TARGETS:
                return k
    return LEVELS - 1


def nearest_distance(
    points: DataFrame,
    targets: DataFrame,
    distance: Column,
    *,
    point_keys: Sequence[str],
    by: Sequence[str] = (),
    cap_km: float | None = 3000.0,
    width: float = COARSEST,
    slack: float = 0.0,
    out: str = "distance_km",
) -> DataFrame:
    """Smallest ``distance`` (radians) from each point to a target, in km.

    ``points`` has ``lon, lat`` and the point keys, which only name a point: each row gets the
    distance of its own position. ``targets`` has ``t_lon, t_lat``
    and whatever columns ``distance`` reads (point vector ``p_x..p_z``). ``by``
    columns must match on both sides. ``slack`` is how much closer, in radians, the
    true target may be than its sample position (half a sampling step for arcs).
    Points farther than ``cap_km`` get ``cap_km``; without a cap every point gets
    its true distance.

    Branch and bound: pairs of occupied cells of ``width`` degrees are bounded first; a pair that
    can't hold a nearest target is dropped with all that lies below it, the others are replaced by
    the pairs of the occupied narrower cells in them, until a cell holds few targets.
    Each level is a stored table of cells, so plans stay short; its number of rows follows the
    occupied cells, not points times targets. Its files are far smaller than its rows, so the joins are
    merged and never broadcast by the driver. Targets are stored too, as they are read for each group of
    levels; points that share a position (and ``by``) are searched for once.
    """
    by = list(by)
    reach = math.pi if cap_km is None else min(math.pi, cap_km / EARTH_RADIUS_KM + slack)
    schemes = [CellScheme(width / 2.0**k) for k in range(LEVELS)]
    top = schemes[0]

    targets = stored(targets)
    depth = _depth(targets, schemes, by)
    path = sorted({0, *range(depth, 0, -2)})

    def levels(df: DataFrame, lon: str, lat: str) -> DataFrame:
        wanted = {f"c{k}": schemes[k] for k in path}
        return stored(_with_cells(df.select(*by, lon, lat), lon, lat, wanted).select(*by, *wanted).distinct())

    there, here = levels(targets, "t_lon", "t_lat"), levels(points, "lon", "lat")

    def occupied(df: DataFrame, level: int, name: str, above: int | None = None) -> DataFrame:
        """Cells of a level, each with the cells of the level above that share a row with it."""
        wider = [] if above is None else [F.col(f"c{above}").alias(f"wide_{name}")]
        return df.select(*by, *wider, F.col(f"c{level}").alias(name)).distinct()

    mine = occupied(here, 0, "cell").withColumns(_centre("cell", top, "c_"))
    goals = occupied(there, 0, "target_cell").withColumns(_centre("target_cell", top, "g_"))
    if by:  # a key has a few hundred of the widest cells at most
        first = mine.join(goals.hint("merge"), by)
    else:
        around = F.explode(top.around(F.col("cell"), min(reach + 2 * top.radius, math.pi)))
        first = mine.withColumn("target_cell", around).join(goals, "target_cell")
    keep = [*by, "cell", "target_cell"]
    pairs = stored(_useful(first, 2 * top.radius, by, reach, slack).select(*keep))
    for above, level in zip(path, path[1:]):
        wide, scheme = schemes[above], schemes[level]
        # The points' side goes down first, so fewer targets' cells have to be opened.
        mine = occupied(here, level, "cell", above).withColumns(_centre("cell", scheme, "c_"))
        goals = occupied(there, level, "target_cell", above).withColumns(_centre("target_cell", scheme, "g_"))
        half = (
            pairs.withColumnsRenamed({"cell": "wide_cell", "target_cell": "wide_target_cell"})
            .withColumns(_centre("wide_target_cell", wide, "g_"))
            .join(mine.hint("merge"), [*by, "wide_cell"])
        )
        half = _useful(half, wide.radius + scheme.radius, by, reach, slack).drop("g_x", "g_y", "g_z")
        whole = half.join(goals.hint("merge"), [*by, "wide_target_cell"])
        # A cell that lies in two wider ones has the pairs of both.
        pairs = stored(_useful(whole, 2 * scheme.radius, by, reach, slack).select(*keep).distinct())

    last = schemes[depth]
    position = list(dict.fromkeys([*by, "lon", "lat"]))
    place = _with_cells(points.select(*position).distinct(), "lon", "lat", {"cell": last}).withColumns(
        sphere.vec_columns(sphere.unit_vector("lon", "lat"), "p_")
    )
    goals = _with_cells(targets, "t_lon", "t_lat", {"target_cell": last})
    near = (
        place.join(pairs.hint("merge"), [*by, "cell"])
        .join(goals.hint("merge"), [*by, "target_cell"])
        .groupBy(*position)
        .agg(F.min(distance).alias("_d"))
    )
    km = F.col("_d") * EARTH_RADIUS_KM
    joined = points.join(near, position, "left").select(*points.columns, "_d")
    if cap_km is not None:
        km = F.least(F.coalesce(km, F.lit(float(cap_km))), F.lit(float(cap_km)))
    return joined.withColumn(out, km).drop("_d")


def rbf_sums(points: DataFrame, centres: Sequence[tuple[float, float, float]], length_km: float = 800.0) -> DataFrame:
    """``points`` with ``weight`` and ``weighted_value``: Gaussian kernel sums over all centres.

    ``centres`` are (lon, lat, value) of a basis that is fixed by design. Each is one compiled
    expression per row, so no table of pairs is made and no centre is left out.
    """
    p = sphere.unit_vector("lon", "lat")
    here = points.withColumns({"_px": p.x, "_py": p.y, "_pz": p.z})

    def kernel(lon: float, lat: float) -> Column:
        lam, phi = math.radians(lon), math.radians(lat)
        centre = (math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi))
        dx, dy, dz = (F.col("_p" + c) - v for c, v in zip("xyz", centre))
        # The chord keeps its digits for near centres, where a dot product has lost them.
        d = 2.0 * EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(dx * dx + dy * dy + dz * dz) / 2.0, F.lit(1.0)))
        return F.exp(d * d * (-0.5 / length_km**2))

    kernels = here.withColumn("_k", F.array(*[kernel(lon, lat) for lon, lat, _ in centres]))
    weight, weighted = F.lit(0.0), F.lit(0.0)
    for n, (_, _, value) in enumerate(centres):
        weight = weight + F.get("_k", F.lit(n))
        weighted = weighted + F.get("_k", F.lit(n)) * float(value)
    return kernels.select(*points.columns, weight.alias("weight"), weighted.alias("weighted_value"))
