"""Composite jobs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import dynamic, predict, prepare, priors, reports, score
from ..sources import synthetic, text
from . import bridge as b
from .bridge import ANCHORS, FIELD_CTES, MODERN, NLAT, NLON, STEP, with_
from .fields import _NATIVE_SAMPLE, _SUPPORT
from .registry import query, r, rounded


def frozen(spark, sf, **options):
    """The preparation job on the bridge inputs."""
    return prepare.prepare(
        spark, b.obs(spark, sf), b.modern(spark, sf), nlat=NLAT, nlon=NLON, step=STEP,
        group="group_id", window=b.WINDOW, continental_sigma=3.0, thin_sigma=2.0, **options,
    )


_SPLIT = (
    "split_rows",
    """select observation_id, case when role = 'test' then 2 when role = 'buffer' then -1
      when group_id::varchar in (select g from (select g, row_number() over (order by md5('42-' || g), g) as rk,
            count(*) over () as m from (select distinct group_id::varchar as g from roles where role = 'train'))
          where rk <= case when m > 1 then least(m - 1, greatest(1, round_even(m*0.1e0, 0)))
                           else round_even(m*0.1e0, 0) end) then 1 else 0 end as split from roles""",
)
_PREP = (
    *FIELD_CTES, MODERN, _NATIVE_SAMPLE, b.NODES, b.NODE_ROWS,
    ("roles", f"select *, {b.ROLE_TEXT} as role from obs"),
    _SPLIT,
    (
        "recs",
        """select observation_id, split, sqrt(16 + case when site_h >= 20 then 9e0 else 4e0 end) as sigma
       from split_rows join site on qid = observation_id
       where observation_id in (select observation_id from node_rows)""",
    ),
)


@query(
    with_(*_PREP)
    + f"""select split, count(*) as n_records, {r('sum(sigma)', 'total_sigma')},
      (select count(*) from node_rows n join recs q using (observation_id) where q.split = recs.split) as n_nodes
    from recs group by split"""
)
def job_prepare(spark, sf):
    """Observations and modern grid to frozen records and nodes, summarised by split."""
    t = frozen(spark, sf)
    nodes = t["nodes"].groupBy("observation_id").agg(F.count("*").alias("k"))
    rows = t["records"].select("observation_id", "split", "sigma").join(nodes, "observation_id")
    return rounded(
        rows.groupBy("split").agg(
            F.count("*").alias("n_records"),
            F.sum("sigma").alias("total_sigma"),
            F.sum("k").alias("n_nodes"),
        )
    )


_JOB_NODES = (
    "jnodes",
    "select observation_id*8 + node_idx as qid, present_lon as lon, present_lat as lat, node_age as age from node_rows",
)


def _job_scores(name, value):
    return [
        (f"v_{name}", b.nested_interpolation_text("jnodes", "lon", "lat", "age", "qid", name)),
        (
            f"s_{name}",
            f"""select observation_id, split, -ln(sum(node_weight*{b.T4_TEXT})) as nll, sum(node_weight*mu) as e, any_value(y) as y
          from (select n.observation_id, q.split, n.node_weight, n.thickness_km as y, q.sigma, v.value as mu
                from node_rows n join recs q using (observation_id) join v_{name} v on v.qid = n.observation_id*8 + n.node_idx)
          group by 1, 2""",
        ),
    ]


@query(
    with_(*_PREP, _JOB_NODES, *_job_scores("field", "value"))
    + f"""select split, {r('avg(nll)', 'nll')}, {r('avg(abs(e - y))', 'age_marginal_mean_mae_km')}, count(*) as n_records
    from s_field where split >= 0 group by 1"""
)
def job_score(spark, sf):
    """Prepare, then score the stored anchor fields by split."""
    return rounded(score.score(frozen(spark, sf), b.field(spark, sf), NLAT, NLON, STEP, ANCHORS))


def _truth_field(spark, sf):
    f = b.field(spark, sf)
    t = synthetic.truth("lon", "lat", F.col("age_idx") * 10.0)
    return f.select("age_idx", "i", "j", t.alias("value"))


_TRUTH = (
    "truthf",
    "select age_idx, i, j, " + b.truth_text("lon", "lat", "age_idx*1e1") + " as value from field",
)


_MISSING = {
    name: f"""select count(*) as n, sqrt(sum(w*e*e)/sum(w)) as rmse, sum(w*abs(e))/sum(w) as mae from (
        select g.w, x.value - t.value as e from {name} x join truthf t using (age_idx, i, j)
        join glat g using (i) where (x.age_idx, x.i, x.j) not in (select (age_idx, i, j) from support))"""
    for name in ("field", "flat")
}


@query(
    with_(
        *_PREP, _JOB_NODES, _TRUTH,
        ("flat", "select age_idx, i, j, 8e0 + age_idx/1e1 as value from field"),
        *_job_scores("field", "value"), *_job_scores("flat", "value"),
        (
            "sparse",
            """select present_lon as lon, present_lat as lat, node_age as age from node_rows
          where observation_id in (select observation_id from recs where split = 0)""",
        ),
        _SUPPORT,
        *[(f"m_{n}", t) for n, t in _MISSING.items()],
    )
    + " union all ".join(
        f"""select '{n}' as candidate, {r(f'(select avg(nll) from s_{n} where split = 1)', 'validation_nll')},
      {r(f'(select avg(abs(e-y)) from s_{n} where split = 1)', 'validation_mae_km')},
      {r(f'(select avg(nll) from s_{n} where split = 2)', 'test_nll')},
      {r(f'(select avg(abs(e-y)) from s_{n} where split = 2)', 'test_mae_km')},
      n as n_cells, {r('rmse', 'area_rmse_km')}, {r('mae', 'area_mae_km')} from m_{n}"""
        for n in ("field", "flat")
    )
)
def job_model_comparison(spark, sf):
    """Two stored fields compared by split scores and errors outside the support."""
    f = b.field(spark, sf).select("age_idx", "i", "j", "value")
    flat = f.withColumn("value", 8.0 + F.col("age_idx") / 10.0)
    out = score.compare_models(
        frozen(spark, sf), {"field": f, "flat": flat}, _truth_field(spark, sf),
        NLAT, NLON, STEP, ANCHORS,
    )
    return rounded(out)


@query(
    with_(*FIELD_CTES, MODERN,
          ("gpts", "select (i*360+j)*10 + k as qid, lon, lat, k*1.7e1 as age from modern, (select unnest(range(4)) as k)"),
          ("v", b.nested_interpolation_text("gpts", "lon", "lat", "age", "qid")))
    + f"select qid, {r('value', 'value')} from v"
)
def job_predict_grid(spark, sf):
    """The native grid at four ages between the anchors."""
    out = predict.predict_grid(
        spark, [0.0, 17.0, 34.0, 51.0], b.field(spark, sf), None, NLAT, NLON, STEP, ANCHORS
    )
    k = F.rint(F.col("age") / 17.0)
    return rounded(
        out.select(((F.col("i") * 360 + F.col("j")) * 10 + k).cast("long").alias("qid"), "value")
    )


@query(
    with_(*FIELD_CTES, MODERN,
          ("gpts", "select i*360+j as qid, lon, lat, 2.5e1 as age from modern"),
          ("v", b.nested_interpolation_text("gpts", "lon", "lat", "age", "qid")))
    + """select 2.5e1 as age, printf('%.6f %.6f %.6f', qid % 360 + 0.5e0, qid // 360 - 89.5e0, value) as value from v"""
)
def job_export_text(spark, sf):
    """Text lines of the exported grid at 25 Ma."""
    out = predict.predict_grid(
        spark, [25.0], b.field(spark, sf), None, NLAT, NLON, STEP, ANCHORS
    )
    return text.grid_lines(out).select("age", "value")


# Polygon snapshots per anchor: the supplier rings drifting east with age.


def _snapshots(spark, sf):
    v = b.rings(spark, sf).withColumn(
        "age_idx", F.explode(F.sequence(F.lit(0), F.lit(ANCHORS - 1)))
    )
    moved = v.withColumns(
        {
            "lon": F.col("lon") + F.col("age_idx") * 3.0,
            "feature_id": F.concat_ws("@", "feature_id", F.col("age_idx").cast("string")),
            "plate_id": (F.col("priority") % 30 + 95).cast("int"),
        }
    )
    return (
        moved.where("priority % 4 <> 0"),
        moved.where("priority % 4 = 0"),
        moved.where("priority % 3 = 1"),
    )


def _dynamic(spark, sf):
    plates, networks, continents = _snapshots(spark, sf)
    m = b.modern(spark, sf)
    base = prepare.static_features(spark, m, NLAT, NLON)
    return dynamic.dynamic_features(
        base, m.select("i", "j", "value"), plates, networks, continents, b.rotations(spark, sf),
        step=STEP, n_anchors=ANCHORS,
    )


@query()
def job_dynamic_geometry(spark, sf):
    """Feature channels of every anchor from same-age polygons (no SQL oracle)."""
    f = _dynamic(spark, sf)
    return rounded(
        f.select(
            "age_idx", "i", "j", "modern_reference_div40", "continental_mask",
            "plate_boundary_distance_div3000", "deformation_coverage", "plate_id", "supported",
        )
    )


@query()
def job_rigid_priors(spark, sf):
    """Points of the rigid-interior factors of both roles (no SQL oracle)."""
    m = b.modern(spark, sf)
    # Plates wide enough that some cells of the coarse grid lie 500 km from every plate edge.
    plates = b.rings(spark, sf, "5e1").withColumn("plate_id", (F.col("priority") % 23 + 100).cast("int"))
    features = prepare.repeat_over_ages(
        prepare.static_features(spark, m, NLAT, NLON, plates), ANCHORS
    )
    out = priors.rigid_priors(
        spark, features, m, plates, b.rotations(spark, sf), nlat=NLAT, nlon=NLON, step=STEP,
        n_anchors=ANCHORS,
    )
    keep = ["kind", "factor_id", "evidence_id", "age", "lon", "lat"]
    paths = out["trajectory"].withColumn("kind", F.lit("trajectory")).select(*keep)
    areas = out["interior"].withColumn("kind", F.lit("budget")).select(*keep)
    return rounded(paths.unionByName(areas))


_CORE_DRAWS = (
    "core_draws",
    """select vec_id % 10 as dr, least(d // 8, 6) as age_idx, (d % 8) // 4 as rr, d % 4 as ss, avg(embedding[d+1]::double) as value
   from embeddings, (select unnest(range(64)) as d) group by 1, 2, 3, 4""",
)
_CELL_DRAWS = (
    "cell_draws",
    """select c.dr, f.age_idx, f.i, f.j, greatest(x,0) + ln(1+exp(-abs(x))) + 0.05e0 as value from (
     select f.age_idx, f.i, f.j, c.dr, f.value/4 + 10/sqrt(8)*sum((case c.rr when 0 then sin(radians(f.lat)) else cos(radians(f.lat)) end)
        * cos(radians((c.ss + 1)*f.lon)) * c.value) as x
     from field f join core_draws c using (age_idx) group by f.age_idx, f.i, f.j, f.value, f.lat, f.lon, c.dr) f
   join (select distinct dr from core_draws) c using (dr)""",
)


def _field_draws(spark, sf):
    """Ten draws of 2x4 cores per anchor, averaged from all vectors, decoded on the grid."""
    e = b.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 10).alias("draw"), F.posexplode("embedding").alias("d", "v")
    )
    cores = e.groupBy(
        "draw",
        F.least(F.floor(F.col("d") / 8), F.lit(6)).cast("int").alias("age_idx"),
        F.floor(F.col("d") % 8 / 4).alias("r"),
        (F.col("d") % 4).alias("s"),
    ).agg(F.avg(F.col("v").cast("double")).alias("value")).withColumn("chain", F.lit(0))
    f = b.field(spark, sf)
    factors = f.select(
        "age_idx", "i", "j",
        F.array(F.sin(F.radians("lat")), F.cos(F.radians("lat"))).alias("spatial"),
        F.array(*[F.cos(F.radians((k + 1) * F.col("lon"))) for k in range(4)]).alias("context"),
        (F.col("value") / 4).alias("base"),
    )
    return reports.decode_draws(cores, factors, 2, 4, 10.0, 0.05)


@query(
    with_(*FIELD_CTES, _CORE_DRAWS, _CELL_DRAWS)
    + f"""select age_idx, i, j, {r('avg(value)', 'mean')}, count(*) as n, {r('quantile_cont(value, 0.05)', 'lower')},
      {r('quantile_cont(value, 0.95)', 'upper')} from cell_draws group by 1, 2, 3"""
)
def job_posterior_fields(spark, sf):
    """Core draws decoded on the grid, then mean and interval of every cell."""
    return rounded(reports.posterior_fields(_field_draws(spark, sf)))

