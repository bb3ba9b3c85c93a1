"""Evaluation queries: metrics, bootstrap, calibration, baselines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import grids
from ..operators import metrics, spherebins, splits
from . import bridge as b
from .bridge import OBS, PREDICTIONS, with_
from .registry import query, r, rounded

_CTES = (OBS, PREDICTIONS)
_METRICS = (
    f"{r('avg(abs(a-y))', 'mae')}, {r('sqrt(avg((a-y)*(a-y)))', 'rmse')}, "
    f"{r('quantile_cont(abs(a-y), 0.5)', 'median_ae')}, {r('avg(a-y)', 'bias')}"
)


@query(with_(*_CTES) + f"select {_METRICS}, count(*) as n from predictions")
def point_metrics(spark, sf):
    return rounded(metrics.point_metrics(b.predictions(spark, sf), "y", "a"))


@query(with_(*_CTES) + f"select group_id, {_METRICS}, count(*) as n from predictions group by 1")
def group_metrics(spark, sf):
    return rounded(metrics.point_metrics(b.predictions(spark, sf), "y", "a", ["group_id"]))


@query(
    with_(
        *_CTES,
        (
            "g",
            """select group_id, avg(abs(a-y)) as mae, sqrt(avg((a-y)*(a-y))) as rmse,
          quantile_cont(abs(a-y), 0.5) as median_ae, avg(a-y) as bias from predictions group by 1""",
        ),
    )
    + f"""select {r('avg(mae)', 'mae')}, {r('avg(rmse)', 'rmse')}, {r('avg(median_ae)', 'median_ae')},
      {r('avg(bias)', 'bias')}, count(*) as n_groups from g"""
)
def macro_metrics(spark, sf):
    per = metrics.point_metrics(b.predictions(spark, sf), "y", "a", ["group_id"])
    return rounded(metrics.macro_metrics(per))


_BOOT = 2000
# Cumulative shares of a Poisson variate of mean 1.
_SHARES = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(17)]
_TIMES = " + ".join(f"(x >= {c!r}::double)::int" for c in _SHARES)


@query(
    with_(
        *_CTES,
        (
            "units",
            """select group_id, count(*) as n, sum(abs(a-y)) as sa, sum(abs(b-y)) as sb
          from predictions group by group_id""",
        ),
        (
            "deltas",
            f"""select b, sum(t*sa)/sum(t*n) - sum(t*sb)/sum(t*n) as delta from (
          select b, {_TIMES} as t, n, sa, sb from (
            select r.b, n, sa, sb, ('0x' || substr(md5('3-' || r.b || '-' || u.group_id), 1, 8))::bigint / 4294967296e0 as x
            from (select unnest(range({_BOOT})) as b) r, units u))
        group by b""",
        ),
    )
    + f"""select {r('avg(delta)', 'delta_mae_mean')}, {r('quantile_cont(delta, 0.025)', 'ci_low')},
      {r('quantile_cont(delta, 0.975)', 'ci_high')},
      (select count(*) from units) as effective_clusters from deltas"""
)
def paired_bootstrap(spark, sf):
    """Unit bootstrap of the MAE difference of two predictors."""
    p = b.predictions(spark, sf)
    deltas = metrics.bootstrap_deltas(p, "y", "a", "b", "group_id", n_boot=_BOOT, seed=3)
    clusters = metrics.effective_clusters(p, "group_id").select("effective_clusters").scalar()
    return rounded(metrics.bootstrap_summary(deltas).withColumn("effective_clusters", clusters))


_INTERVALS = (
    "intervals",
    """select observation_id, y, a - 2 - (observation_id % 100)/4e1 as lower,
     a + 2 + (observation_id % 100)/4e1 as upper,
     4 + (observation_id % 100)/2e1 + observation_id/1e7 as width from predictions""",
)


def _intervals(spark, sf):
    return b.predictions(spark, sf).selectExpr(
        "observation_id",
        "y",
        "a - 2 - (observation_id % 100)/4e1 as lower",
        "a + 2 + (observation_id % 100)/4e1 as upper",
        "4 + (observation_id % 100)/2e1 + observation_id/1e7 as width",
    )


@query(
    with_(*_CTES, _INTERVALS)
    + f"""select {r('avg(case when y between lower and upper then 1e0 else 0e0 end)', 'coverage')},
      {r('avg(upper - lower)', 'mean_width')},
      {r('avg(upper - lower + 2/(1-0.9e0)*(case when y < lower then lower - y when y > upper then y - upper else 0 end))', 'interval_score')},
      count(*) as n from intervals"""
)
def interval_metrics(spark, sf):
    return rounded(metrics.interval_metrics(_intervals(spark, sf), 0.9))


@query(
    with_(
        *_CTES,
        _INTERVALS,
        (
            "cuts",
            "select quantile_cont(width, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from intervals",
        ),
    )
    + f"""select bin, {r('any_value(e[bin+1])', 'bin_lo')}, {r('any_value(e[bin+2])', 'bin_hi')},
      {r('avg(case when y between lower and upper then 1e0 else 0e0 end)', 'coverage')}, count(*) as n
    from (select *, case when width >= e[5] then 4 when width >= e[4] then 3 when width >= e[3] then 2
            when width >= e[2] then 1 else 0 end as bin from intervals, cuts) group by bin"""
)
def coverage_by_bin(spark, sf):
    return rounded(metrics.coverage_by_bin(_intervals(spark, sf), "width"))


_BLOCKED = (
    "blocked",
    f"""select p.*, {b.block_text('present_lon', 'present_lat')} as block
     from predictions p join obs using (observation_id)""",
)
_CAL = (
    "cal",
    """select block, row_number() over (order by md5('5-' || block), block)
      <= greatest(1, round_even((select count(distinct block) from blocked)*0.5e0, 0)) as calibration
    from (select distinct block from blocked)""",
)


def _blocked_predictions(spark, sf):
    o = b.obs(spark, sf).select(
        "observation_id", splits.spatial_block("present_lon", "present_lat").alias("block")
    )
    return b.predictions(spark, sf).join(o, "observation_id")


@query(with_(*_CTES, _BLOCKED, _CAL) + "select block, calibration from cal")
def calibration_blocks(spark, sf):
    return metrics.calibration_blocks(_blocked_predictions(spark, sf), "block", 0.5, 5)


@query(
    with_(
        *_CTES,
        _BLOCKED,
        _CAL,
        ("scores", "select abs(a-y) as s from blocked join cal using (block) where calibration"),
        ("lv", "select count(*) as n, least(1e0, ceil((count(*)+1)*0.9e0)/count(*)) as level from scores"),
        (
            "ranked",
            "select s, row_number() over (order by s) - 1 as k from scores",
        ),
        (
            "q",
            """select lo.s + (hi.s - lo.s)*(level*(n-1) - floor(level*(n-1))) as q, n from lv
         join ranked lo on lo.k = floor(level*(n-1)) join ranked hi on hi.k = ceil(level*(n-1))""",
        ),
    )
    + f"""select (select {r('q', 'x')} from q) as q, (select n from q) as n_calibration, count(*) as n_test,
      {r('avg(case when y between a - (select q from q) and a + (select q from q) then 1e0 else 0e0 end)', 'coverage')}
    from blocked join cal using (block) where not calibration"""
)
def conformal_coverage(spark, sf):
    """Split-conformal width from calibration blocks, its coverage on the others."""
    p = _blocked_predictions(spark, sf)
    marked = p.join(metrics.calibration_blocks(p, "block", 0.5, 5), "block")
    q = metrics.conformal_quantile(marked.where("calibration"), "y", "a", 0.1)
    test = metrics.conformal_intervals(marked.where("not calibration"), "a", q)
    report = test.agg(
        F.count("*").alias("n_test"),
        F.avg(metrics.covered().cast("double")).alias("coverage"),
    )
    return rounded(
        report.withColumns(
            {"q": q.select("q").scalar(), "n_calibration": q.select("n").scalar()}
        )
    )


@query(
    with_(*_CTES)
    + f"""select group_id % 5 as stratum, {r('(lo+hi)/2', 'centre')}, {r('greatest(hi-lo, 1e-6)/3.29e0', 'scale')}
    from (select group_id % 5 as group_id, quantile_cont(a, 0.05) as lo, quantile_cont(a, 0.95) as hi
          from predictions group by group_id % 5)"""
)
def robust_centre_scale(spark, sf):
    rows = b.predictions(spark, sf).withColumn("stratum", F.col("group_id") % 5)
    return rounded(metrics.robust_centre_scale(rows, "a", ["stratum"]))


@query(
    with_(
        OBS,
        (
            "roled",
            f"select observation_id, (age_lower_ma+age_upper_ma)/2 as age, thickness_km as y, {b.ROLE_TEXT} as role from obs",
        ),
        (
            "asked",
            "select distinct age as query_age from roled where role <> 'train'",
        ),
        (
            "med",
            """select query_age, quantile_cont(y, 0.5) as m from asked join roled
          on role = 'train' and abs(age - query_age) <= 5 group by query_age""",
        ),
    )
    + f"""select cast(observation_id as bigint) as observation_id, {r('age', 'query_age')},
       {r("coalesce(m, (select quantile_cont(y, 0.5) from roled where role = 'train'))", 'prediction')}
    from roled left join med on med.query_age = age where role <> 'train'"""
)
def rolling_age_median(spark, sf):
    """Median training thickness within 5 Myr of each record's own age."""
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    rows = b.obs(spark, sf).select(
        "observation_id",
        ((lo + hi) / 2.0).alias("age"),
        F.col("thickness_km").alias("y"),
        splits.window_role(lo, hi, (lo + hi) / 2.0, b.WINDOW).alias("role"),
    )
    queries = rows.where("role <> 'train'").select(
        "observation_id", F.col("age").alias("query_age")
    )
    out = metrics.rolling_age_median(rows.where("role = 'train'"), queries, 5.0)
    return rounded(out)


@query(
    with_(
        OBS,
        b.GLAT,
        (
            "centres",
            "select i, j, lat, j*22.5e0 as lon from glat, (select unnest(range(16)) as j)",
        ),
        (
            "pairs",
            """select observation_id, i*16 + j as value, 6371*2*asin(sqrt(least(1e0, pow(sin(radians(present_lat - lat)/2), 2)
          + cos(radians(present_lat))*cos(radians(lat))*pow(sin(radians(present_lon-lon)/2), 2)))) as d
        from obs, centres""",
        ),
    )
    + f"""select observation_id, {r('sum(k)', 'weight')}, {r('sum(k*value)', 'weighted_value')}
       from (select *, exp(-0.5e0*pow(d/800, 2)) as k from pairs) group by observation_id"""
)
def rbf_weights(spark, sf):
    """Kernel weights of all basis centres summed per point, plain and times a value."""
    lats = grids.gauss_latitudes(b.NLAT)[0][::-1]
    centres = [(22.5 * j, lat, 16 * i + j) for i, lat in enumerate(lats) for j in range(b.NLON)]
    pts = b.obs(spark, sf).selectExpr(
        "observation_id", "present_lon as lon", "present_lat as lat"
    )
    return rounded(
        spherebins.rbf_sums(pts, centres, 800.0).select("observation_id", "weight", "weighted_value")
    )
