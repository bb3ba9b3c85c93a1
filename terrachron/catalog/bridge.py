"""Inputs of the registered queries, derived from the driver's tables.

Each input is defined once as SQL expressions. Spark evaluates them with
``selectExpr``; the oracle gets the same text inside a ``WITH`` clause.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import ordering, records
from ..sources import synthetic

NLAT, NLON, STEP, ANCHORS = 8, 16, 10.0, 7
WINDOW = (15.0, 25.0)
SIGMA_KM = 4.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def select_text(columns: dict[str, str], source: str, tail: str = "") -> str:
    body = ",\n  ".join(f"{e} as {c}" for c, e in columns.items())
    return f"select {body}\nfrom {source} {tail}"


def with_(*parts: tuple[str, str]) -> str:
    """``WITH`` clause of named parts."""
    return "with " + ",\n".join(f"{n} as ({t})" for n, t in parts) + "\n"


def apply(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


# --- observations ------------------------------------------------------------

OBS_COLUMNS = {
    "observation_id": "o_orderkey",
    "present_lon": "((o_orderkey*7919) % 360000)/1e3-180",
    "present_lat": "((o_orderkey*104729) % 170000)/1e3-85",
    "age_lower_ma": "((o_orderkey*31) % 5000)/1e2",
    "age_upper_ma": "((o_orderkey*31) % 5000)/1e2 + case o_orderkey % 5 when 0 then 0e0 "
    "when 1 then 2e0 when 2 then 8e0 when 3 then 35e0 else 5e0 end",
    "thickness_km": "5 + ((o_orderkey*37) % 6000)/1e2",
    "group_id": "o_custkey",
}
OBS = ("obs", select_text(OBS_COLUMNS, "orders"))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "orders"), OBS_COLUMNS)


# --- quadrature nodes --------------------------------------------------------

NODES = (
    "nodes",
    """select *, greatest(age_lower_ma, 0e0) as na, least(age_upper_ma, 60e0) as nb
  from (select *, case when age_upper_ma - age_lower_ma <= 0 then 1
                       when age_upper_ma - age_lower_ma <= 5 then 3 else 8 end as k from obs)""",
)
NODE_ROWS = (
    "node_rows",
    """select observation_id, present_lon, present_lat, age_lower_ma, age_upper_ma,
       thickness_km, group_id, node_idx,
       case when age_lower_ma = age_upper_ma then age_lower_ma
            else na + (node_idx + 0.5e0) * (nb - na) / k end as node_age,
       1e0 / k as node_weight
  from (select *, unnest(range(k)) as node_idx from nodes)
  where (age_lower_ma = age_upper_ma and age_lower_ma between 0 and 60) or nb > na""",
)
OBS_KEEP = [
    "observation_id", "present_lon", "present_lat", "age_lower_ma", "age_upper_ma",
    "thickness_km", "group_id",
]


def nodes(spark: SparkSession, sf: str, laid_out: bool = False) -> DataFrame:
    """Node rows; ``laid_out``: those of a record follow each other in one partition."""
    rows = obs(spark, sf)
    return records.explode_nodes(ordering.laid_out(rows, "observation_id") if laid_out else rows, OBS_KEEP)


def truth_text(lon: str, lat: str, age: str) -> str:
    return (
        f"(7 + 0.8e0*cos(radians({lat}))*cos(radians({lon})) + 0.02e0*(60 - ({age})))"
    )


SCORED = (
    "scored",
    "select observation_id, node_idx, node_age, node_weight, thickness_km as y, "
    + f"{SIGMA_KM:g}e0 as sigma, age_lower_ma, age_upper_ma, group_id, "
    + truth_text("present_lon", "present_lat", "node_age")
    + " as mu from node_rows",
)


def scored_nodes(spark: SparkSession, sf: str, laid_out: bool = False) -> DataFrame:
    """Nodes with the analytic truth as prediction."""
    return nodes(spark, sf, laid_out).select(
        "observation_id",
        "node_idx",
        "node_age",
        "node_weight",
        F.col("thickness_km").alias("y"),
        F.lit(SIGMA_KM).alias("sigma"),
        "age_lower_ma",
        "age_upper_ma",
        "group_id",
        synthetic.truth("present_lon", "present_lat", "node_age").alias("mu"),
    )


T4_TEXT = "(0.375e0 / sigma * pow(1 + ((y-mu)/sigma)*((y-mu)/sigma)/4, -2.5e0))"
T4_LOG_TEXT = "(ln(0.375e0) - ln(sigma) - 2.5e0*ln(1 + ((y-mu)/sigma)*((y-mu)/sigma)/4))"
RECORD_NLL = (
    "record_nll",
    f"""select observation_id, -ln(sum(node_weight*{T4_TEXT})) as nll,
     sum(node_weight*mu) as expected, any_value(y) as y,
     any_value(age_lower_ma) as age_lower_ma, any_value(age_upper_ma) as age_upper_ma,
     any_value(group_id) as group_id
  from scored group by observation_id""",
)
SCORE_CTES = (OBS, NODES, NODE_ROWS, SCORED, RECORD_NLL)

ROLE_TEXT = f"""case when age_upper_ma >= {WINDOW[0]:g} and age_lower_ma <= {WINDOW[1]:g} then
    case when age_upper_ma - age_lower_ma <= 5
          and (age_lower_ma + age_upper_ma)/2e0 between {WINDOW[0]:g} and {WINDOW[1]:g}
         then 'test' else 'buffer' end else 'train' end"""


# --- two predictors, one prediction table ------------------------------------

PREDICTIONS = (
    "predictions",
    "select observation_id, group_id, thickness_km as y, "
    "thickness_km + sin(observation_id * 0.37e0) * 3 as a, "
    "thickness_km + cos(observation_id * 0.11e0) * 2 + 0.5e0 as b from obs",
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).selectExpr(
        "observation_id",
        "group_id",
        "thickness_km as y",
        "thickness_km + sin(observation_id * 0.37e0) * 3 as a",
        "thickness_km + cos(observation_id * 0.11e0) * 2 + 0.5e0 as b",
    )


# --- fields ------------------------------------------------------------------
# Anchor field on an 8x16 Gauss grid: analytic truth plus a hundredth of the mean
# thickness of the observations that fall into the cell's box.

_NORTH_FIRST = grids.gauss_latitudes(NLAT)[0][::-1]
_WEIGHT_NORTH_FIRST = grids.gauss_latitudes(NLAT)[1][::-1]


def values_text(columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(repr(v) if isinstance(v, int) else f"{v!r}::double" for v in r) + ")" for r in rows)
    return f"select * from (values {body}) as t({columns})"


GLAT = (
    "glat",
    values_text(
        "i, lat, w", [(i, a, w) for i, (a, w) in enumerate(zip(_NORTH_FIRST, _WEIGHT_NORTH_FIRST))]
    ),
)
CELL_COLUMNS = {
    "age_idx": "cast(least(floor((age_lower_ma + age_upper_ma)/2e0/1e1), 6) as int)",
    "i": "cast(least(floor((90 - present_lat)/18e1*8), 7) as int)",
    "j": "cast(floor((present_lon + 180)/36e1*16) as int)",
}
CELL_MEANS = (
    "cell_means",
    "select age_idx, i, j, avg(thickness_km) as m, count(*) as n from (select thickness_km, "
    + ", ".join(f"{e} as {c}" for c, e in CELL_COLUMNS.items())
    + " from obs) group by age_idx, i, j",
)
FIELD = (
    "field",
    "select g.age_idx, g.i, g.j, g.lat, g.lon, g.w, "
    + truth_text("g.lon", "g.lat", "g.age_idx*1e1")
    + """ + coalesce(c.m, 0e0)/1e2 as value, coalesce(c.n, 0) as n
  from (select a.age_idx, glat.i, b.j, glat.lat, b.j * 22.5e0 as lon, glat.w
        from glat, (select unnest(range(7)) as age_idx) a, (select unnest(range(16)) as j) b) g
  left join cell_means c on g.age_idx = c.age_idx and g.i = c.i and g.j = c.j""",
)
FIELD_CTES = (OBS, GLAT, CELL_MEANS, FIELD)


def cell_means(spark: SparkSession, sf: str) -> DataFrame:
    cells = obs(spark, sf).selectExpr(
        "thickness_km", *[f"{e} as {c}" for c, e in CELL_COLUMNS.items()]
    )
    return cells.groupBy("age_idx", "i", "j").agg(
        F.avg("thickness_km").alias("m"), F.count("*").alias("n")
    )


def field(spark: SparkSession, sf: str) -> DataFrame:
    """(age_idx, i, j, lat, lon, value, n) of every anchor cell."""
    grid = grids.gauss_grid(spark, NLAT, NLON).select("i", "j", "lat", "lon")
    dense = grid.withColumn("age_idx", F.explode(F.sequence(F.lit(0), F.lit(ANCHORS - 1))))
    joined = dense.join(cell_means(spark, sf), ["age_idx", "i", "j"], "left")
    value = synthetic.truth("lon", "lat", F.col("age_idx") * 10.0) + F.coalesce(
        "m", F.lit(0.0)
    ) / 100.0
    return joined.select(
        "age_idx", "i", "j", "lat", "lon", value.alias("value"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def nested_interpolation_text(source: str, lon: str, lat: str, age: str, keep: str,
                              fields: str = "field", value: str = "value") -> str:
    """Oracle text of the bilinear x linear query, independent of the stencil join.

    The bracket rows are found by comparing with the latitude table, the corners by
    eight joins' worth of (age, row, column) combinations and one weighted sum.
    """
    return f"""select {keep}, sum(p.w * f.{value}) as {value} from (
    select {keep}, unnest([
      {{'a': a0, 'i': i0, 'j': j0, 'w': (1-fa)*(1-fi)*(1-fj)}},
      {{'a': a0, 'i': i0, 'j': (j0+1)%16, 'w': (1-fa)*(1-fi)*fj}},
      {{'a': a0, 'i': i0+1, 'j': j0, 'w': (1-fa)*fi*(1-fj)}},
      {{'a': a0, 'i': i0+1, 'j': (j0+1)%16, 'w': (1-fa)*fi*fj}},
      {{'a': a0+1, 'i': i0, 'j': j0, 'w': fa*(1-fi)*(1-fj)}},
      {{'a': a0+1, 'i': i0, 'j': (j0+1)%16, 'w': fa*(1-fi)*fj}},
      {{'a': a0+1, 'i': i0+1, 'j': j0, 'w': fa*fi*(1-fj)}},
      {{'a': a0+1, 'i': i0+1, 'j': (j0+1)%16, 'w': fa*fi*fj}}], recursive := true)
    from (
      select {keep},
        cast(least(floor(({age})/1e1), 5) as int) as a0,
        ({age})/1e1 - least(floor(({age})/1e1), 5) as fa,
        gi as i0,
        least(greatest((gl - ({lat}))/(gl - hl), 0e0), 1e0) as fi,
        cast(floor((({lon}) - floor(({lon})/36e1)*36e1)/22.5e0) as int) % 16 as j0,
        (({lon}) - floor(({lon})/36e1)*36e1)/22.5e0
          - floor((({lon}) - floor(({lon})/36e1)*36e1)/22.5e0) as fj
      from {source} q
      join (select i as gi, lat as gl from glat) g on gi < 7 and (({lat}) <= gl or gi = 0)
      join (select i as hi, lat as hl from glat) h on hi = gi + 1 and (({lat}) > hl or hi = 7))
    ) p join {fields} f on f.age_idx = p.a and f.i = p.i and f.j = p.j
  group by {keep}"""


# --- modern one-degree field -------------------------------------------------

MODERN_CELL = {
    "i": "cast(floor(present_lat + 90) as int)",
    "j": "cast(floor(present_lon + 36e1) as int) % 360",
}
MODERN = (
    "modern",
    """select g.i, g.j, g.i - 89.5e0 as lat, g.j + 0.5e0 as lon, """
    + truth_text("g.j + 0.5e0", "g.i - 89.5e0", "0")
    + """ * 3 + coalesce(c.m, 0e0)/1e1 as value,
     (sin(radians(g.i - 89e0)) - sin(radians(g.i - 9e1))) * 6371e0*6371e0*pi()/18e1 as area_km2
  from (select a.i, b.j from (select unnest(range(180)) as i) a, (select unnest(range(360)) as j) b) g
  left join (select i, j, avg(thickness_km) as m from (select thickness_km, """
    + ", ".join(f"{e} as {c}" for c, e in MODERN_CELL.items())
    + """ from obs) group by i, j) c on g.i = c.i and g.j = c.j""",
)


def modern(spark: SparkSession, sf: str) -> DataFrame:
    """(i, j, lat, lon, value, area_km2) of every one-degree cell, i from the south."""
    means = (
        obs(spark, sf)
        .selectExpr("thickness_km", *[f"{e} as {c}" for c, e in MODERN_CELL.items()])
        .groupBy("i", "j")
        .agg(F.avg("thickness_km").alias("m"))
    )
    value = synthetic.truth("lon", "lat", 0.0) * 3 + F.coalesce("m", F.lit(0.0)) / 10.0
    return (
        grids.native_grid(spark)
        .join(means, ["i", "j"], "left")
        .select("i", "j", "lat", "lon", value.alias("value"), "area_km2")
    )


def block_text(lon: str, lat: str) -> str:
    """Oracle text of the spatial block of a point in [-180, 180)."""
    from ..operators.splits import sector_counts

    counts = sector_counts()
    bases = [sum(counts[:b]) for b in range(len(counts))]
    band = f"cast(least(greatest(ceil((({lat})+90)/9e0)-1, 0), 19) as int)"
    n = f"list_extract({counts}, {band}+1)"
    base = f"list_extract({bases}, {band}+1)"
    return f"cast({base} + least(floor((({lon})+180)/36e1*{n}), {n}-1) as bigint)"


# --- trajectories ------------------------------------------------------------
# One user is one source row; one sample per hour of the month, 12 hours = 1 Myr.

SAMPLES = (
    "samples",
    """select source_row, h/12e0 as time_ma, ((e*7919) % 360000)/1e3-180 as lon,
     ((e*104729) % 170000)/1e3-85 as lat
  from (select user_id as source_row, (day(ts)-1)*24 + hour(ts) as h, min(event_id) as e
        from events group by user_id, (day(ts)-1)*24 + hour(ts))""",
)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    hours = F.expr("(day(ts)-1)*24 + hour(ts)")
    per_hour = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("source_row"), hours.alias("h"))
        .agg(F.min("event_id").alias("e"))
    )
    return per_hour.selectExpr(
        "source_row",
        "h/12e0 as time_ma",
        "((e*7919) % 360000)/1e3-180 as lon",
        "((e*104729) % 170000)/1e3-85 as lat",
    )


# --- rotations and polygons --------------------------------------------------
# Plates are nations: 25 plates hang in chains below their region, regions below
# the anchor. Nation 24 has no parent entry, nation 23 is its own parent.

ROTATION_COLUMNS = {
    "plate_id": "n_nationkey + 100",
    "age": "s*1.5e1",
    "lat": "((n_nationkey*37 + s*11) % 160) - 8e1",
    "lon": "((n_nationkey*53 + s*29) % 360) - 18e1",
    "angle": "case when s = 0 then 0e0 else ((n_nationkey*7 + s*13) % 50) - 2e1 end",
    "conjugate_id": "case when n_nationkey = 24 then 999 when n_nationkey = 23 then 123 "
    "when n_nationkey % 4 = 0 then n_regionkey + 1 else n_nationkey + 99 end",
}
_REGION_COLUMNS = {
    "plate_id": "r_regionkey + 1",
    "age": "s*2e1",
    "lat": "((r_regionkey*17 + s*23) % 160) - 8e1",
    "lon": "((r_regionkey*71 + s*19) % 360) - 18e1",
    "angle": "case when s = 0 then 0e0 else ((r_regionkey*5 + s*9) % 30) - 1e1 end",
    "conjugate_id": "0",
}
ROTATIONS = (
    "rotations",
    select_text(ROTATION_COLUMNS, "nation, (select unnest(range(4)) as s)")
    + " union all "
    + select_text(_REGION_COLUMNS, "region, (select unnest(range(4)) as s)"),
)


def rotations(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.lit(3)))
    nations = apply(table(spark, sf, "nation").withColumn("s", steps), ROTATION_COLUMNS)
    regions = apply(table(spark, sf, "region").withColumn("s", steps), _REGION_COLUMNS)
    out = nations.unionByName(regions)
    return out.select(
        F.col("plate_id").cast("int"),
        *[F.col(c).cast("double") for c in ("age", "lat", "lon", "angle")],
        F.col("conjugate_id").cast("int"),
    )


# Rings: one 12-gon per supplier around a hashed centre, hexagonal hole for every third.
def rings(spark: SparkSession, sf: str, radius: str = "4e0 + (s_suppkey % 10)") -> DataFrame:
    """Vertex table of supplier rings (12 vertices, by default of radius 4-13 degrees)."""
    base = table(spark, sf, "supplier").selectExpr(
        "s_suppkey",
        "((s_suppkey*7919) % 3600)/1e1-180 as clon",
        "((s_suppkey*10477) % 1400)/1e1-70 as clat",
        f"{radius} as rad",
    )
    kinds = F.explode(
        F.when(
            F.col("s_suppkey") % 3 == 0,
            F.array(
                F.struct(F.lit(1).alias("ring"), F.lit("exterior").alias("role"), F.lit(1.0).alias("f")),
                F.struct(F.lit(2).alias("ring"), F.lit("hole").alias("role"), F.lit(0.4).alias("f")),
            ),
        ).otherwise(
            F.array(
                F.struct(F.lit(1).alias("ring"), F.lit("exterior").alias("role"), F.lit(1.0).alias("f"))
            )
        )
    )
    rows = base.withColumn("k", kinds).withColumn(
        "vertex", F.explode(F.sequence(F.lit(0), F.lit(11)))
    )
    from ..functions import sphere

    # Vertex at angular radius f*rad and bearing 30 degrees x vertex from the centre.
    theta = F.radians(F.col("rad") * F.col("k.f"))
    bearing = F.radians(F.col("vertex") * 30.0)
    c = sphere.unit_vector("clon", "clat")
    lam, phi = F.radians("clon"), F.radians("clat")
    east = sphere.Vec(-F.sin(lam), F.cos(lam), F.lit(0.0))
    north = sphere.Vec(-F.sin(phi) * F.cos(lam), -F.sin(phi) * F.sin(lam), F.cos(phi))
    tangent = sphere.add(sphere.scale(east, F.cos(bearing)), sphere.scale(north, F.sin(bearing)))
    v = sphere.add(sphere.scale(c, F.cos(theta)), sphere.scale(tangent, F.sin(theta)))
    lon, lat = sphere.to_lonlat(v)
    return rows.select(
        F.concat(F.lit("ring"), F.col("s_suppkey").cast("string")).alias("feature_id"),
        F.lit(1).alias("part"),
        F.col("k.ring").alias("ring"),
        F.col("k.role").alias("role"),
        "vertex",
        lon.alias("lon"),
        lat.alias("lat"),
        (F.col("s_suppkey") + 100).cast("int").alias("plate_id"),
        F.col("s_suppkey").alias("priority"),
    )


RINGS = (
    "rings",
    """select 'ring' || s_suppkey as feature_id, 1 as part, ring, role, vertex,
     degrees(atan2(vy, vx)) as lon, degrees(atan2(vz, sqrt(vx*vx+vy*vy))) as lat,
     cast(s_suppkey + 100 as int) as plate_id, s_suppkey as priority
  from (select *,
     cos(th)*cos(ph)*cos(lm) + sin(th)*(cos(bg)*(-sin(lm)) + sin(bg)*(-sin(ph)*cos(lm))) as vx,
     cos(th)*cos(ph)*sin(lm) + sin(th)*(cos(bg)*cos(lm) + sin(bg)*(-sin(ph)*sin(lm))) as vy,
     cos(th)*sin(ph) + sin(th)*sin(bg)*cos(ph) as vz
   from (select s_suppkey, ring, role, vertex, radians(rad*f) as th, radians(vertex*3e1) as bg,
          radians(clon) as lm, radians(clat) as ph
        from (select s_suppkey, ((s_suppkey*7919) % 3600)/1e1-180 as clon,
                 ((s_suppkey*10477) % 1400)/1e1-70 as clat, 4e0 + (s_suppkey % 10) as rad
              from supplier) s
        join (select 1 as ring, 'exterior' as role, 1e0 as f union all select 2, 'hole', 0.4e0) k
          on k.ring = 1 or s.s_suppkey % 3 = 0,
        (select unnest(range(12)) as vertex) v))""",
)


# --- draws -------------------------------------------------------------------

DRAWS = (
    "draws",
    """select vec_id % 4 as chain, vec_id // 4 as draw, d as dim,
     embedding[d+1]::double as value
  from embeddings, (select unnest(range(64)) as d)""",
)


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """(chain, draw, dim, value): four interleaved chains of the vectors."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4).alias("chain"),
        F.floor(F.col("vec_id") / 4).alias("draw"),
        F.posexplode("embedding").alias("dim", "v"),
    ).select("chain", "draw", "dim", F.col("v").cast("double").alias("value"))


TAU = 2.0 * math.pi
