"""Field-side queries: sampling, remapping, features, support and missing scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grids
from ..operators import fields as ops
from ..operators import physics as phys
from ..operators import scoring, splits
from ..sources import synthetic
from . import bridge as b
from .bridge import ANCHORS, FIELD_CTES, GLAT, MODERN, NLAT, NLON, OBS, STEP, with_
from .registry import query, r, rounded

_POINTS = (
    "points",
    "select observation_id as qid, present_lon as lon, present_lat as lat, "
    "(observation_id % 6001)/1e2 as age from obs",
)


def _points(spark, sf):
    return b.obs(spark, sf).selectExpr(
        "observation_id as qid", "present_lon as lon", "present_lat as lat",
        "(observation_id % 6001)/1e2 as age",
    )


@query(
    with_(*FIELD_CTES, _POINTS,
          ("v", b.nested_interpolation_text("points", "lon", "lat", "age", "qid")))
    + f"select qid, {r('value', 'value')} from v"
)
def field_at_points(spark, sf):
    """Bilinear in space, linear in age, at every observation."""
    out = ops.sample_fields(_points(spark, sf), b.field(spark, sf), NLAT, NLON, STEP, ANCHORS)
    return rounded(out.select("qid", "value"))


@query(
    with_(*FIELD_CTES, _POINTS,
          ("v", b.nested_interpolation_text("points", "lon", "lat", "age", "qid")))
    + f"select qid, {r('value', 'value')}, {r('value', 'turned')} from v"
)
def field_periodicity(spark, sf):
    """A longitude and the same longitude plus a turn give the same value."""
    f = b.field(spark, sf)
    a = ops.sample_fields(_points(spark, sf), f, NLAT, NLON, STEP, ANCHORS)
    turned = a.withColumns({"lon": F.col("lon") + 360, "first": F.col("value")}).drop("value")
    c = ops.sample_fields(turned, f, NLAT, NLON, STEP, ANCHORS)
    return rounded(c.select("qid", F.col("first").alias("value"), F.col("value").alias("turned")))


_GEOMETRY = (
    "geo",
    """select age_idx, i, j, value/2e1 as continental_fraction, value*4e2 as plate_boundary_distance_km,
      (n % 5)/4.1e0 as deformation_coverage, (i*16 + j + age_idx) % 11 - 1 as plate_id from field""",
)


def _features(spark, sf):
    f = b.field(spark, sf)
    return f.select(
        "age_idx", "i", "j",
        (F.col("value") / 20.0 * 2 - 1).alias("continental_mask"),
        (F.col("value") * 400.0 / 3000.0).alias("plate_boundary_distance_div3000"),
        (F.col("n") % 5 / 4.1).alias("deformation_coverage"),
        ((F.col("i") * 16 + F.col("j") + F.col("age_idx")) % 11 - 1).alias("plate_id"),
    )


def _three(source):
    names = ["continental_fraction", "plate_boundary_distance_km", "deformation_coverage"]
    return [
        ("v" + str(k), b.nested_interpolation_text(source, "lon", "lat", "age", "qid", "geo", n))
        for k, n in enumerate(names)
    ]


_NEAREST_TEXT = """select qid, f.plate_id from (
   select qid, cast(case when age/1e1 - least(floor(age/1e1),5) >= 0.5e0 then least(floor(age/1e1),5)+1
        else least(floor(age/1e1),5) end as int) as a,
     gi + case when least(greatest((gl-lat)/(gl-hl),0e0),1e0) > 0.5e0 then 1 else 0 end as i,
     cast(floor((lon - floor(lon/36e1)*36e1)/22.5e0
       + case when (lon - floor(lon/36e1)*36e1)/22.5e0
              - floor((lon - floor(lon/36e1)*36e1)/22.5e0) > 0.5e0 then 1 else 0 end) as int) % 16 as j
   from points join (select i as gi, lat as gl from glat) g on gi < 7 and (lat <= gl or gi = 0)
   join (select i as hi, lat as hl from glat) h on hi = gi + 1 and (lat > hl or hi = 7)) p
 join geo f on f.age_idx = p.a and f.i = p.i and f.j = p.j"""


@query(
    with_(*FIELD_CTES, _POINTS, _GEOMETRY, *_three("points"), ("near", _NEAREST_TEXT))
    + f"""select qid, {r('least(greatest(v0.continental_fraction,0e0),1e0)', 'continental_fraction')},
      {r('least(greatest(v1.plate_boundary_distance_km,0e0),3e3)', 'plate_boundary_distance_km')},
      {r('least(greatest(v2.deformation_coverage,0e0),1e0)', 'deformation_coverage')}, plate_id
    from v0 join v1 using (qid) join v2 using (qid) join near using (qid)"""
)
def geometry_at_points(spark, sf):
    """Clamped continuous channels and the nearest categorical plate id."""
    out = ops.predict_geometry(
        _points(spark, sf), _features(spark, sf), NLAT, NLON, STEP, ANCHORS
    )
    return rounded(out.drop("lon", "lat", "age"))


_NATIVE_SAMPLE = (
    "site",
    """select qid, sum(w * m.value) as site_h from (
     select qid, unnest([{'i': i0, 'j': j0, 'w': (1-fi)*(1-fj)},
        {'i': i0, 'j': (j0+1)%360, 'w': (1-fi)*fj}, {'i': i0+1, 'j': j0, 'w': fi*(1-fj)},
        {'i': i0+1, 'j': (j0+1)%360, 'w': fi*fj}], recursive := true)
     from (select observation_id as qid,
        cast(least(floor(least(greatest(present_lat+89.5e0,0e0),179e0)),178) as int) as i0,
        least(greatest(present_lat+89.5e0,0e0),179e0)
          - least(floor(least(greatest(present_lat+89.5e0,0e0),179e0)),178) as fi,
        cast(floor((present_lon-0.5e0) - floor((present_lon-0.5e0)/36e1)*36e1) as int) % 360 as j0,
        (present_lon-0.5e0) - floor(present_lon-0.5e0) as fj from obs)) p
   join modern m on m.i = p.i and m.j = p.j group by qid""",
)


@query(
    with_(OBS, MODERN, _NATIVE_SAMPLE)
    + f"""select qid, {r('site_h', 'site_h')},
      {r('sqrt(4e0*4e0 + case when site_h >= 20 then 3e0*3e0 else 2e0*2e0 end)', 'sigma')} from site"""
)
def native_sample_sigma(spark, sf):
    """Modern thickness at each record and the error class it implies."""
    from ..functions.chronology import combined_scale

    pts = b.obs(spark, sf).selectExpr(
        "observation_id as qid", "present_lon as lon", "present_lat as lat"
    )
    at = ops.sample_one_field(
        pts, b.modern(spark, sf).select("i", "j", "value"), 180, 360, grid="native", out="site_h"
    )
    source = F.when(F.col("site_h") >= 20, 3.0).otherwise(2.0)
    return rounded(at.select("qid", "site_h", combined_scale(F.lit(4.0), source).alias("sigma")))


_NATIVE_POINTS = (
    "npts",
    "select i*360+j as qid, lon, lat, 0e0 as age from modern",
)


_ANCHOR_POINTS = (
    "apts",
    f"select a*64800 + i*360+j as qid, lon, lat, a*1e1 as age from modern, (select unnest(range({ANCHORS})) as a)",
)


@query(
    with_(*FIELD_CTES, MODERN, _ANCHOR_POINTS,
          ("v", b.nested_interpolation_text("apts", "lon", "lat", "age", "qid")))
    + f"select qid // 64800 as age_idx, qid % 64800 as qid, {r('value', 'value')} from v"
)
def export_native_grid(spark, sf):
    """Every anchor's field sampled at every one-degree cell centre."""
    out = ops.export_to_native(spark, b.field(spark, sf), NLAT, NLON, STEP, ANCHORS)
    cell = (F.col("i") * 360 + F.col("j")).cast("long")
    return rounded(out.select(F.col("age_idx").cast("long"), cell.alias("qid"), "value"))


_MODERN_CELLS = (
    "cells",
    f"""select m.i, m.j, m.area_km2, m.value as observed, 3e0 as sigma, v.value as prediction,
      {b.block_text('case when m.lon >= 180 then m.lon - 360 else m.lon end', 'm.lat')} as block
    from modern m join v on v.qid = m.i*360+m.j""",
)
_MODERN_CTES = (
    *FIELD_CTES, MODERN, _NATIVE_POINTS,
    ("v", b.nested_interpolation_text("npts", "lon", "lat", "age", "qid")), _MODERN_CELLS,
)
_CELL_NLL = "(0.5e0*pow((prediction-observed)/sigma,2) + ln(sigma) + 0.5e0*ln(2*pi()))"


def modern_cells(spark, sf):
    m = b.modern(spark, sf).withColumn("age", F.lit(0.0)).withColumnRenamed("value", "observed")
    at = ops.sample_fields(m, b.field(spark, sf), NLAT, NLON, STEP, ANCHORS)
    return at.withColumnRenamed("value", "prediction").withColumns(
        {"sigma": F.lit(3.0), "block": splits.spatial_block("lon", "lat")}
    )


@query(
    with_(*_MODERN_CTES)
    + f"""select {r('avg(m)', 'modern_nll')}, {r('sqrt(sum(ea)/sum(a))', 'modern_area_rmse_km')} from (
      select block, avg({_CELL_NLL}) as m, sum(pow(prediction-observed,2)*area_km2) as ea,
        sum(area_km2) as a from cells group by block)"""
)
def modern_loss_block_mean(spark, sf):
    return rounded(scoring.modern_block_mean_loss(modern_cells(spark, sf)))


@query(
    with_(*_MODERN_CTES)
    + f"""select {r('avg(m)', 'modern_nll')}, (select {r(f'sum({_CELL_NLL}*area_km2)/sum(area_km2)', 'x')} from cells)
        as modern_nll_unblocked
    from (select block, sum({_CELL_NLL}*area_km2)/sum(area_km2) as m from cells group by block)"""
)
def modern_loss_area_weighted(spark, sf):
    cells = modern_cells(spark, sf)
    whole = scoring.modern_area_weighted_loss(cells, None).select("modern_nll").scalar()
    out = scoring.modern_area_weighted_loss(cells).withColumn("modern_nll_unblocked", whole)
    return rounded(out)


@query(
    with_(*FIELD_CTES)
    + f"""select {r('avg(pow((value-p)/1e1, 2))', 'smoothness')}, {r('sum(pow(value-p, 2))', 'roughness')}
    from (select value, lag(value) over (partition by i, j order by age_idx) as p from field)"""
)
def temporal_smoothness(spark, sf):
    f = b.field(spark, sf)
    rough = scoring.temporal_roughness(f).select("roughness").scalar()
    return rounded(scoring.temporal_roughness(f, step=10.0).withColumn("roughness", rough))


_FIELD_NODES = (
    "fnodes",
    "select observation_id*8 + node_idx as qid, present_lon as lon, present_lat as lat, "
    "node_age as age from node_rows",
)
_FIELD_SCORE_CTES = (
    *FIELD_CTES, b.NODES, b.NODE_ROWS, _FIELD_NODES,
    ("v", b.nested_interpolation_text("fnodes", "lon", "lat", "age", "qid")),
    (
        "scored",
        "select n.observation_id, n.node_idx, n.node_age, n.node_weight, n.thickness_km as y, 4e0 as sigma, "
        "n.age_lower_ma, n.age_upper_ma, n.group_id, v.value as mu from node_rows n "
        "join v on v.qid = n.observation_id*8 + n.node_idx",
    ),
    b.RECORD_NLL,
)


def field_scored_nodes(spark, sf):
    """Nodes with the anchor field as prediction."""
    at = ops.sample_fields(
        b.nodes(spark, sf), b.field(spark, sf), NLAT, NLON, STEP, ANCHORS,
        lon="present_lon", lat="present_lat", age="node_age",
    )
    return at.withColumnsRenamed({"value": "mu", "thickness_km": "y"}).withColumn(
        "sigma", F.lit(4.0)
    )


@query(
    with_(*_FIELD_SCORE_CTES)
    + f"""select {b.ROLE_TEXT} as split, {r('avg(nll)', 'nll')},
      {r('avg(abs(expected - y))', 'age_marginal_mean_mae_km')}, count(*) as n_records
    from record_nll group by 1"""
)
def field_score(spark, sf):
    """Fields and frozen nodes -> NLL and MAE per split."""
    scores = scoring.record_scores(
        field_scored_nodes(spark, sf), carry=["age_lower_ma", "age_upper_ma"]
    )
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    role = splits.window_role(lo, hi, (lo + hi) / 2.0, b.WINDOW)
    return rounded(scoring.split_scores(scores.withColumn("split", role)))


_OBJECTIVE_CTES = (*_FIELD_SCORE_CTES, MODERN, _NATIVE_POINTS,
    ("mv", b.nested_interpolation_text("npts", "lon", "lat", "age", "qid")),
    (_MODERN_CELLS[0], _MODERN_CELLS[1].replace("join v on v.qid", "join mv v on v.qid")),
    ("train", f"select * from record_nll where ({b.ROLE_TEXT}) = 'train'"),
    ("parts", f"""select (select avg(nll) from train) as observation_nll,
      (select avg(case when abs(expected-y) < 2 then 0.25e0*pow(expected-y,2) else abs(expected-y)-1 end)/2
         from train) as observation_huber,
      (select avg(m) from (select avg({_CELL_NLL}) as m from cells group by block)) as modern_nll,
      (select avg(pow((value-p)/1e1, 2)) from (select value,
          lag(value) over (partition by i, j order by age_idx) as p from field)) as temporal_smoothness"""),
)


@query(
    with_(*_OBJECTIVE_CTES)
    + f"""select {r('observation_nll', 'observation_nll')}, {r('observation_huber', 'observation_huber')},
      {r('modern_nll', 'modern_nll')}, {r('temporal_smoothness', 'temporal_smoothness')},
      {r('observation_nll + 0.2e0*observation_huber + 0.5e0*modern_nll + 0.1e0*temporal_smoothness', 'total')}
    from parts"""
)
def objective_total(spark, sf):
    """The reconstruction objective of a stored field, with its parts."""
    scores = scoring.record_scores(
        field_scored_nodes(spark, sf), carry=["age_lower_ma", "age_upper_ma"]
    )
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    train = scores.where(splits.window_role(lo, hi, (lo + hi) / 2.0, b.WINDOW) == "train")
    parts = {
        "observation_nll": (train.agg(F.avg("nll").alias("x")), "x"),
        "observation_huber": (scoring.huber_term(train, 2.0), "huber"),
        "modern_nll": (scoring.modern_block_mean_loss(modern_cells(spark, sf)), "modern_nll"),
        "temporal_smoothness": (
            scoring.temporal_roughness(b.field(spark, sf), step=10.0), "smoothness",
        ),
    }
    weights = {
        "observation_nll": 1.0, "observation_huber": 0.2, "modern_nll": 0.5,
        "temporal_smoothness": 0.1,
    }
    return rounded(scoring.combine_objective(parts, weights))


_SUPPORT = (
    "support",
    """select distinct a as age_idx, i, j from (
     select unnest([
      {'a': a0, 'i': i0, 'j': j0, 'w': (1-fa)*(1-fi)*(1-fj)}, {'a': a0, 'i': i0, 'j': (j0+1)%16, 'w': (1-fa)*(1-fi)*fj},
      {'a': a0, 'i': i0+1, 'j': j0, 'w': (1-fa)*fi*(1-fj)}, {'a': a0, 'i': i0+1, 'j': (j0+1)%16, 'w': (1-fa)*fi*fj},
      {'a': a0+1, 'i': i0, 'j': j0, 'w': fa*(1-fi)*(1-fj)}, {'a': a0+1, 'i': i0, 'j': (j0+1)%16, 'w': fa*(1-fi)*fj},
      {'a': a0+1, 'i': i0+1, 'j': j0, 'w': fa*fi*(1-fj)}, {'a': a0+1, 'i': i0+1, 'j': (j0+1)%16, 'w': fa*fi*fj}
      ], recursive := true)
     from (select cast(least(floor(age/1e1),5) as int) as a0, age/1e1 - least(floor(age/1e1),5) as fa,
        gi as i0, least(greatest((gl-lat)/(gl-hl),0e0),1e0) as fi,
        cast(floor((lon - floor(lon/36e1)*36e1)/22.5e0) as int) % 16 as j0,
        (lon - floor(lon/36e1)*36e1)/22.5e0 - floor((lon - floor(lon/36e1)*36e1)/22.5e0) as fj
      from sparse join (select i as gi, lat as gl from glat) g on gi < 7 and (lat <= gl or gi = 0)
      join (select i as hi, lat as hl from glat) h on hi = gi + 1 and (lat > hl or hi = 7))) where w > 0""",
)
# Two anchors of records only, so that part of the field stays outside the support.
_SPARSE = (
    "sparse",
    "select lon, lat, case when qid % 2 = 0 then 1e1 else 1e1 + (qid % 10)/1e0 end as age from points",
)


def _sparse(spark, sf):
    return _points(spark, sf).selectExpr(
        "lon", "lat", "case when qid % 2 = 0 then 1e1 else 1e1 + (qid % 10)/1e0 end as age"
    )


@query(with_(OBS, GLAT, _POINTS, _SPARSE, _SUPPORT) + "select age_idx, i, j from support")
def query_support(spark, sf):
    """Cells that carry a positive weight in some training query."""
    return ops.query_support(_sparse(spark, sf), NLAT, NLON, STEP, ANCHORS)


@query(
    with_(*FIELD_CTES, _POINTS, _SPARSE, _SUPPORT)
    + f"""select count(*) as n_cells, {r('sqrt(sum(w*e*e)/sum(w))', 'area_rmse_km')},
      {r('sum(w*abs(e))/sum(w)', 'area_mae_km')} from (
      select w, value - {b.truth_text('lon', 'lat', 'age_idx*1e1')} as e from field
      where (age_idx, i, j) not in (select (age_idx, i, j) from support))"""
)
def missing_field_scores(spark, sf):
    """Area-weighted errors on the cells outside the training support."""
    f = b.field(spark, sf)
    truth = f.select(
        "age_idx", "i", "j", synthetic.truth("lon", "lat", F.col("age_idx") * 10.0).alias("value")
    )
    support = ops.query_support(_sparse(spark, sf), NLAT, NLON, STEP, ANCHORS)
    return rounded(ops.missing_scores(truth, f, support, grids.gauss_cell_area("i", NLAT, NLON)))


_EDGE_TEXT = """select age_idx, i, j,
   p <> coalesce(lag(p) over r, last(p) over (partition by age_idx, i order by j
        rows between unbounded preceding and unbounded following))
   or p <> coalesce(lead(p) over r, first(p) over (partition by age_idx, i order by j
        rows between unbounded preceding and unbounded following))
   or coalesce(p <> lag(p) over c, false) or coalesce(p <> lead(p) over c, false) as edge,
   (p >= 0 and coalesce(lag(p) over r, last(p) over (partition by age_idx, i order by j
        rows between unbounded preceding and unbounded following)) >= 0
     and p <> coalesce(lag(p) over r, last(p) over (partition by age_idx, i order by j
        rows between unbounded preceding and unbounded following)))
   or coalesce(p >= 0 and lag(p) over c >= 0 and p <> lag(p) over c, false) as drawn
 from (select age_idx, i, j, cast(floor(value/4) as int) % 4 - 1 as p from field)
 window r as (partition by age_idx, i order by j), c as (partition by age_idx, j order by i)"""


@query(with_(*FIELD_CTES) + _EDGE_TEXT)
def plate_edges(spark, sf):
    """Raster plate edges in both variants."""
    raster = b.field(spark, sf).select(
        "age_idx", "i", "j", (F.floor(F.col("value") / 4).cast("int") % 4 - 1).alias("plate_id")
    )
    two = phys.plate_edges(raster)
    return phys.plate_edges(two.withColumnRenamed("edge", "_two"), two_sided=False).select(
        "age_idx", "i", "j", F.col("_two").alias("edge"), F.col("edge").alias("drawn")
    )


@query(
    with_(*FIELD_CTES)
    + f"""select a.age_idx, {r('sum((b.value - a.value)*a.w*6371e0*6371e0*2*pi()/16/1e9)', 'volume_change_mkm3')}
    from field a join field b on b.age_idx = 0 and a.i = b.i and a.j = b.j
    where a.age_idx > 0 and a.lat > 0 group by 1"""
)
def volume_change(spark, sf):
    """Change of northern-hemisphere volume from every anchor to the present."""
    f = b.field(spark, sf)
    young = f.where("age_idx = 0").select("i", "j", "value")
    area = grids.gauss_cell_area("i", NLAT, NLON) / 1e9
    out = None
    for k in range(1, ANCHORS):
        old = f.where(F.col("age_idx") == k).select("i", "j", "value")
        row = phys.volume_change(old, young, area, F.col("i") < NLAT // 2).select(
            F.lit(k).alias("age_idx"), F.col("volume_change_km3").alias("volume_change_mkm3")
        )
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query(
    with_(OBS, GLAT, b.CELL_MEANS)
    + f"""select g.i, g.j, {r('g.w*6371e0*6371e0*2*pi()/16/1e6', 'area_mkm2')},
      coalesce(sum(c.n), 0)::bigint as n, {r('coalesce(sum(c.n), 0)/(g.w*6371e0*6371e0*2*pi()/16/1e6)', 'density')}
    from (select i, j, w from glat, (select unnest(range(16)) as j)) g
    left join cell_means c on c.i = g.i and c.j = g.j group by g.i, g.j, g.w"""
)
def observation_density(spark, sf):
    """Observations per million square kilometres of every Gauss cell."""
    counts = b.cell_means(spark, sf).groupBy("i", "j").agg(F.sum("n").alias("n"))
    g = grids.gauss_grid(spark, NLAT, NLON).select("i", "j", (F.col("area_km2") / 1e6).alias("area_mkm2"))
    n = F.coalesce("n", F.lit(0))
    return rounded(
        g.join(counts, ["i", "j"], "left").select(
            "i", "j", "area_mkm2", n.alias("n"), (n / F.col("area_mkm2")).alias("density")
        )
    )


_GEDGE = (
    "gedge",
    b.values_text(
        "i, lo, hi",
        [
            (k, grids.gauss_edges(NLAT)[NLAT - 1 - k], grids.gauss_edges(NLAT)[NLAT - k])
            for k in range(NLAT)
        ],
    ),
)
_REMAP = (
    "remap",
    """select g.i, c.j, sum(m.value*a.w*o.w) filter (where (m.i*360+m.j) % 7 <> 0)
        / sum(a.w*o.w) filter (where (m.i*360+m.j) % 7 <> 0) as masked,
      sum(m.value*a.w*o.w)/sum(a.w*o.w) as value, sum(case when m.value >= 20 then a.w*o.w else 0 end)/sum(a.w*o.w) as continental
    from modern m
    join (select n.k as ni, gedge.i as gi,
             least(sin(radians(n.k-89e0)), hi) - greatest(sin(radians(n.k-9e1)), lo) as w
          from (select unnest(range(180)) as k) n, gedge) a on a.ni = m.i and a.w > 0
    join gedge g on g.i = a.gi
    join (select n.k as nj, s.k as gj, greatest(
             least(n.k+1e0, s.k*22.5e0+11.25e0) - greatest(n.k*1e0, s.k*22.5e0-11.25e0),
             least(n.k+1e0, s.k*22.5e0+371.25e0) - greatest(n.k*1e0, s.k*22.5e0+348.75e0), 0e0) as w
          from (select unnest(range(360)) as k) n, (select unnest(range(16)) as k) s) o
       on o.nj = m.j and o.w > 0
    join (select unnest(range(16)) as j) c on c.j = o.gj
    group by g.i, c.j""",
)


@query(
    with_(OBS, MODERN, _GEDGE, _REMAP)
    + f"select i, j, {r('value', 'value')}, {r('masked', 'masked')} from remap"
)
def conservative_remap(spark, sf):
    """One-degree cells to the Gauss grid, all cells and a masked six sevenths of them."""
    m = b.modern(spark, sf).withColumn("ok", (F.col("i") * 360 + F.col("j")) % 7 != 0)
    whole = ops.conservative_remap(m, NLAT, NLON)
    masked = ops.conservative_remap(m, NLAT, NLON, valid="ok").withColumnRenamed("value", "masked")
    return rounded(whole.join(masked, ["i", "j"]).select("i", "j", "value", "masked"))


@query(
    with_(OBS, MODERN, GLAT, _GEDGE, _REMAP)
    + f"""select remap.i, j, {r('sin(radians(lat))', 'sin_lat')},
      {r('cos(radians(lat))*cos(radians(j*22.5e0))', 'cos_lat_cos_lon')},
      {r('cos(radians(lat))*sin(radians(j*22.5e0))', 'cos_lat_sin_lon')},
      {r('value/40', 'modern_reference_div40')}, {r('2*continental - 1', 'continental_mask')},
      {r('pow(cos(radians(lat)), 2)', 'cos_lat_squared')} from remap join glat using (i)"""
)
def feature_columns(spark, sf):
    """Static feature columns on the Gauss nodes."""
    from ..plans.prepare import static_features

    f = static_features(spark, b.modern(spark, sf), NLAT, NLON)
    return rounded(
        f.select(
            "i", "j", "sin_lat", "cos_lat_cos_lon", "cos_lat_sin_lon", "modern_reference_div40",
            "continental_mask", "cos_lat_squared",
        )
    )


