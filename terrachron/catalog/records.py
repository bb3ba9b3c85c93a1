"""Record-side queries: labels, flags, nodes, likelihoods, trajectories, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chronology as chrono
from ..functions import sphere, units
from ..operators import ordering, records, scoring, splits, trajectories
from ..sources import synthetic, tables
from . import bridge as b
from .bridge import NODE_ROWS, NODES, OBS, SCORE_CTES, with_
from .registry import query, r, rounded

STEP_TEXT = "(100e0/111.32e0)"


# --- flagship ----------------------------------------------------------------


@query(
    with_(*SCORE_CTES)
    + f"""select {b.ROLE_TEXT} as split, {r('avg(nll)', 'nll')},
      {r('avg(abs(expected - y))', 'age_marginal_mean_mae_km')}, count(*) as n_records
    from record_nll group by 1"""
)
def age_mixture_score(spark, sf):
    """Mean age-mixture NLL, MAE and record count per chronological role."""
    scores = scoring.record_scores(
        b.scored_nodes(spark, sf), carry=["age_lower_ma", "age_upper_ma"]
    )
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    labelled = scores.withColumn("split", splits.window_role(lo, hi, (lo + hi) / 2.0, b.WINDOW))
    return rounded(scoring.split_scores(labelled))


# --- projections and filters -------------------------------------------------


@query(
    with_(OBS)
    + """select observation_id, case
        when age_upper_ma = age_lower_ma then
          case when age_lower_ma between 0 and 60 then 'point_inside' else 'point_outside' end
        when age_lower_ma <= 0 and age_upper_ma >= 60 then 'coarse_full_domain'
        when age_upper_ma - age_lower_ma >= 30 then 'wide_interval'
        when age_upper_ma - age_lower_ma <= 5 then 'narrow_interval'
        else 'interval' end as age_semantics,
      case when age_upper_ma - age_lower_ma <= 0 then 1
           when age_upper_ma - age_lower_ma <= 5 then 3 else 8 end as n_nodes
    from obs"""
)
def age_semantics(spark, sf):
    return b.obs(spark, sf).select(
        "observation_id",
        chrono.age_semantics("age_lower_ma", "age_upper_ma").alias("age_semantics"),
        chrono.node_count("age_lower_ma", "age_upper_ma").alias("n_nodes"),
    )


_FLAGGED = {
    "observation_id": "o_orderkey",
    "present_lon": "((o_orderkey*7919) % 600000)/1e3-200",
    "present_lat": "((o_orderkey*104729) % 200000)/1e3-100",
    "age_lower_ma": "case when o_orderkey % 17 = 0 then -1e0 else ((o_orderkey*31) % 7000)/1e2 end",
    "age_upper_ma": "case when o_orderkey % 17 = 0 then 61e0 else ((o_orderkey*31) % 7000)/1e2 "
    "+ (o_orderkey % 4) * 3e0 end",
    "age_representative_ma": "((o_orderkey*13) % 900)/1e1 - 5",
    "thickness_km": "case when o_orderkey % 19 = 0 then null else ((o_orderkey*37) % 12000)/1e2 end",
    "group_id": "o_custkey",
}
_FLAG_TEXT = """select *,
   coalesce(thickness_km > 80, false) as qc_thickness_gt80,
   coalesce(thickness_km > 100, false) as qc_thickness_gt100,
   coalesce(thickness_km < 2, false) as qc_thickness_lt2,
   age_representative_ma < 0 as qc_negative_age,
   not (present_lon between -180 and 360 and present_lat between -90 and 90)
     as qc_coords_out_of_range,
   age_lower_ma <= 0 and age_upper_ma >= 60 as qc_age_interval_covers_domain,
   age_lower_ma = age_upper_ma and not (age_lower_ma between 0 and 60)
     as qc_point_age_outside_domain,
   case when age_lower_ma = age_upper_ma
          then case when age_lower_ma between 0 and 60 then 1 else 0 end
        when least(age_upper_ma, 60e0) <= greatest(age_lower_ma, 0e0) then 0
        when age_upper_ma - age_lower_ma <= 5 then 3 else 8 end as age_nodes_k,
   case when age_lower_ma = age_upper_ma
          then case when age_lower_ma between 0 and 60 then 1e0 else 0e0 end
        when least(age_upper_ma, 60e0) <= greatest(age_lower_ma, 0e0) then 0e0
        else (least(age_upper_ma, 60e0) - greatest(age_lower_ma, 0e0))
             / (age_upper_ma - age_lower_ma) end as mass
 from raw"""
_RAW = ("raw", b.select_text(_FLAGGED, "orders"))


def _flagged(spark, sf):
    return records.with_quality_flags(b.apply(b.table(spark, sf, "orders"), _FLAGGED))


@query(
    with_(_RAW, ("flagged", _FLAG_TEXT))
    + f"""select observation_id, qc_thickness_gt80, qc_thickness_gt100, qc_thickness_lt2,
      qc_negative_age, qc_coords_out_of_range, qc_age_interval_covers_domain,
      qc_point_age_outside_domain, age_nodes_k, {r('mass', 'age_clipped_mass')} from flagged"""
)
def quality_flags(spark, sf):
    cols = [c for c in _flagged(spark, sf).columns if c.startswith("qc_")]
    return rounded(
        _flagged(spark, sf).select("observation_id", *cols, "age_nodes_k", "age_clipped_mass")
    )


@query(
    with_(_RAW, ("flagged", _FLAG_TEXT))
    + """select observation_id, thickness_km from flagged
    where not (qc_coords_out_of_range or qc_negative_age or qc_thickness_lt2
               or qc_point_age_outside_domain)
      and qc_thickness_gt80::int + qc_thickness_gt100::int <= 1"""
)
def primary_evidence(spark, sf):
    return _flagged(spark, sf).where(records.primary_evidence(1)).select(
        "observation_id", "thickness_km"
    )


@query(
    with_(_RAW, ("flagged", _FLAG_TEXT))
    + """select observation_id from flagged
    where thickness_km > 0 and abs(present_lat) <= 90
      and not (qc_coords_out_of_range or qc_negative_age or qc_thickness_lt2
               or qc_point_age_outside_domain)"""
)
def valid_records(spark, sf):
    f = _flagged(spark, sf)
    return f.where(records.valid_record(f.columns)).select("observation_id")


@query(
    with_(_RAW)
    + f"""select observation_id,
      {r('present_lon + 180 - floor((present_lon+180)/36e1)*36e1 - 180', 'lon180')},
      {r('present_lon - floor(present_lon/36e1)*36e1', 'lon360')} from raw"""
)
def longitude_normalisation(spark, sf):
    raw = b.apply(b.table(spark, sf, "orders"), _FLAGGED)
    return rounded(
        raw.select(
            "observation_id",
            sphere.wrap180("present_lon").alias("lon180"),
            sphere.wrap360("present_lon").alias("lon360"),
        )
    )


_HEADED = {
    "lat": "cast(((o_orderkey*104729) % 170000)/1e3-85 as {t})",
    "lon": "cast(((o_orderkey*7919) % 360000)/1e3-180 as {t})",
    "age_lo": "cast(((o_orderkey*31) % 5000)/1e2 + (o_orderkey % 3) as {t})",
    "age_hi": "cast(((o_orderkey*31) % 5000)/1e2 + (o_orderkey % 2) as {t})",
    "age_rep": "case when o_orderkey % 23 = 0 then 'about 20' else "
    "cast(((o_orderkey*31) % 5000)/1e2 as {t}) end",
    "epoch": "o_orderpriority",
    "thickness": "case when o_orderkey % 29 = 0 then 'n/a' else "
    "cast(5 + ((o_orderkey*37) % 6000)/1e2 as {t}) end",
}
_HEADED_SQL = ", ".join(
    f"{e.format(t='varchar')} as {k}" for k, e in _HEADED.items()
) + ", case when o_orderkey % 2 = 0 then '10.0' end as paleo"


@query(
    f"""with raw as (select distinct {_HEADED_SQL} from (
        select * from orders union all select * from orders where o_orderkey % 3 = 0)),
    std as (select lat::double as present_lat, lon::double as present_lon,
        least(age_lo::double, age_hi::double) as lo, greatest(age_lo::double, age_hi::double) as hi,
        try_cast(age_rep as double) as rep, epoch, try_cast(thickness as double) as h, paleo from raw)
    select epoch as epoch_label,
      case when lo = hi then 'point_inside' when hi - lo <= 5 then 'narrow_interval' end
        as age_semantics,
      paleo is not null as has_paleo_coordinates,
      count(*) as n, {r('avg(h)', 'mean_thickness')}, count(rep) as n_rep,
      {r('sum(hi - lo)', 'total_width')}, {r('avg(present_lon)', 'mean_lon')},
      {r('avg(present_lat)', 'mean_lat')}
    from std group by all"""
)
def standardise_raw_table(spark, sf):
    """Raw text table under its original headers, with repeated rows, standardised."""
    o = b.table(spark, sf, "orders")
    twice = o.unionByName(o.where("o_orderkey % 3 = 0"))
    heads = tables.RAW_HEADERS
    raw = twice.select(
        *[F.expr(e.format(t="string")).alias(heads[k]) for k, e in _HEADED.items()],
        F.expr("case when o_orderkey % 2 = 0 then '10.0' end").alias("paleo_lon"),
    )
    std = records.standardise(raw, heads)
    return rounded(
        std.groupBy("epoch_label", "age_semantics", "has_paleo_coordinates").agg(
            F.count("*").alias("n"),
            F.avg("thickness_km").alias("mean_thickness"),
            F.count("age_representative_ma").alias("n_rep"),
            F.sum("age_width_myr").alias("total_width"),
            F.avg("present_lon").alias("mean_lon"),
            F.avg("present_lat").alias("mean_lat"),
        )
    )


@query(
    """select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber)::bigint as total from (
      select distinct l_returnflag, l_linestatus, l_linenumber, l_suppkey from lineitem)
    group by 1, 2"""
)
def exact_duplicates(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"
    )
    return (
        records.drop_exact_duplicates(rows)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))
    )


@query(
    with_(OBS)
    + f"""select observation_id, {r('present_lon', 'lon')}, {r('present_lat', 'lat')},
      {r('sin(radians(present_lat))', 'sin_lat')},
      {r('(age_lower_ma + age_upper_ma)/2', 'age')},
      {r('age_upper_ma - age_lower_ma', 'age_width')}, {r('thickness_km', 'thickness_km')},
      'interval_midpoint' as variant from obs
    union all select observation_id, {r('present_lon', 'lon')}, {r('present_lat', 'lat')},
      {r('sin(radians(present_lat))', 'sin_lat')}, {r('age_lower_ma', 'age')},
      {r('age_upper_ma - age_lower_ma', 'age_width')}, {r('thickness_km', 'thickness_km')}, 'point_age' from obs"""
)
def comparison_features(spark, sf):
    o = b.obs(spark, sf).withColumn("age_representative_ma", F.col("age_lower_ma"))
    both = records.comparison_features(o).unionByName(records.comparison_features(o, True))
    return rounded(both)


@query(
    with_(OBS)
    + f"""select o.observation_id, {r('d', 'distance_km')},
      case when d <= 200 and age_upper_ma - age_lower_ma <= 10 then 'observation_supported'
           when k >= 0.9e0 and p >= 0.5e0 then 'physics_supported'
           else 'prior_dominated' end as tier
    from (select obs.*, (observation_id % 10)/9e0 as k, (observation_id % 7)/6e0 as p,
       6371*2*asin(sqrt(least(1e0, pow(sin(radians(present_lat - glat)/2), 2)
        + cos(radians(present_lat))*cos(radians(glat))*pow(sin(radians(present_lon-glon)/2), 2)))) as d
      from obs join (select group_id, avg(present_lon) as glon, avg(present_lat) as glat
                     from obs group by group_id) g using (group_id)) o"""
)
def evidence_tiers(spark, sf):
    o = b.obs(spark, sf)
    centres = o.groupBy("group_id").agg(
        F.avg("present_lon").alias("glon"), F.avg("present_lat").alias("glat")
    )
    d = sphere.great_circle_km("present_lon", "present_lat", "glon", "glat")
    rows = o.join(centres, "group_id").withColumn("distance_km", d)
    kin, proc = F.col("observation_id") % 10 / 9.0, F.col("observation_id") % 7 / 6.0
    tier = records.evidence_class(
        "distance_km", F.col("age_upper_ma") - F.col("age_lower_ma"), kin, proc
    )
    return rounded(rows.select("observation_id", "distance_km", tier.alias("tier")))


@query(
    """select l_orderkey, l_linenumber, l_partkey, reason from (
      select *, case when l_quantity - 5 < 0 then 'negative_thickness'
        when abs(l_extendedprice/2e1 - 1500) > 2000 then 'speed_out_of_range'
        when abs(l_discount*2e2 - 5) > 10 then 'source_out_of_range' end as reason
      from lineitem) where reason is not null"""
)
def unit_violations(spark, sf):
    l = b.table(spark, sf, "lineitem")
    reason = units.unit_violation(
        F.col("l_quantity") - 5,
        F.col("l_extendedprice") / 20.0 - 1500,
        F.col("l_discount") * 200.0 - 5,
    )
    return (
        l.select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


@query(
    f"""select c_custkey, {r('c_acctbal*1e1', 'km_per_myr')},
      {r('(c_acctbal/1e18)*31557600e6', 'per_myr')},
      {r('radians(c_acctbal/1e3)*6371', 'equator_speed')},
      {r('60 - c_acctbal/1e3', 'tau')} from customer"""
)
def unit_conversions(spark, sf):
    a = F.col("c_acctbal")
    return rounded(
        b.table(spark, sf, "customer").select(
            "c_custkey",
            units.cm_per_year_to_km_per_myr(a).alias("km_per_myr"),
            units.per_second_to_per_myr(a / 1e18).alias("per_myr"),
            units.pole_rate_to_equator_speed(a / 1e3).alias("equator_speed"),
            units.forward_time(a / 1e3).alias("tau"),
        )
    )


# --- nodes and densities -----------------------------------------------------


@query(
    with_(OBS, NODES, NODE_ROWS)
    + f"""select observation_id, node_idx, {r('node_age', 'node_age')},
      {r('node_weight', 'node_weight')} from node_rows"""
)
def age_nodes_uniform(spark, sf):
    return rounded(
        b.nodes(spark, sf).select(
            "observation_id", F.col("node_idx").cast("long"), "node_age", "node_weight"
        )
    )


def _tri_cdf(x):
    return (
        f"case when {x} <= (lo+hi)/2 then 2*pow(({x}-lo)/(hi-lo),2) "
        f"else 1-2*pow((hi-{x})/(hi-lo),2) end"
    )


def _tri_inv(u):
    return (
        f"case when {u} <= 0.5e0 then lo+(hi-lo)*sqrt(({u})/2) "
        f"else hi-(hi-lo)*sqrt(greatest(1-({u}),0e0)/2) end"
    )


@query(
    with_(
        OBS,
        NODES,
        (
            "tri",
            f"""select *, {_tri_cdf('na')} as ua, {_tri_cdf('nb')} as ub from (
            select observation_id, age_lower_ma as lo, age_upper_ma as hi, na, nb, k,
              unnest(range(k)) as node_idx from nodes where nb > na)""",
        ),
    )
    + f"""select observation_id, node_idx,
       {r(f"(({_tri_inv('(ua+(ub-ua)*node_idx/k)')}) + ({_tri_inv('(ua+(ub-ua)*(node_idx+1)/k)')}))/2", 'node_age')},
       {r('1e0/k', 'node_weight')}, {r('ub-ua', 'mass')} from tri
    union all select observation_id, 0, {r('age_lower_ma', 'a')}, 1e0, 1e0 from obs
       where age_lower_ma = age_upper_ma and age_lower_ma between 0 and 60"""
)
def age_nodes_triangular(spark, sf):
    rows = b.obs(spark, sf).withColumn(
        "mass",
        chrono.clipped_mass("age_lower_ma", "age_upper_ma", distribution="triangular"),
    )
    nodes = records.explode_nodes(rows, ["observation_id", "mass"], distribution="triangular")
    return rounded(
        nodes.select(
            "observation_id", F.col("node_idx").cast("long"), "node_age", "node_weight", "mass"
        )
    )


@query(
    with_(OBS, NODES, NODE_ROWS, b.SCORED)
    + f"select observation_id, node_idx, {r(b.T4_LOG_TEXT, 'log_density')} from scored"
)
def student_t_density(spark, sf):
    lp = chrono.t4_log_density("y", "mu", "sigma")
    return rounded(
        b.scored_nodes(spark, sf).select(
            "observation_id", F.col("node_idx").cast("long"), lp.alias("log_density")
        )
    )


@query(
    with_(OBS, NODES, NODE_ROWS, b.SCORED)
    + f"""select observation_id, node_idx, {r('resp', 'responsibility')},
      {r('resp * 5*(mu-y)/(4*sigma*sigma + (mu-y)*(mu-y))', 'nll_gradient')}
    from (select *, node_weight*{b.T4_TEXT}
            / sum(node_weight*{b.T4_TEXT}) over (partition by observation_id) as resp from scored)"""
)
def node_gradients(spark, sf):
    rows = scoring.node_responsibilities(b.scored_nodes(spark, sf))
    return rounded(
        rows.select(
            "observation_id", F.col("node_idx").cast("long"), "responsibility", "nll_gradient"
        )
    )


@query(
    with_(*SCORE_CTES)
    + f"select observation_id, {r('nll', 'nll')}, {r('expected', 'expected')} from record_nll"
)
def record_likelihood(spark, sf):
    return rounded(
        scoring.record_scores(b.scored_nodes(spark, sf)).select("observation_id", "nll", "expected")
    )


@query(
    with_(*SCORE_CTES)
    + f"""select cast(0 as double) as max_error,
      {r('(select avg(n.nll - p.point) from record_nll n join (select observation_id, '
          '-sum(node_weight*' + b.T4_LOG_TEXT + ') as point from scored group by 1) p '
          'using (observation_id))', 'jensen_gap')}"""
)
def replication_and_jensen(spark, sf):
    """Splitting nodes into copies changes nothing; the mixture NLL is the smaller one."""
    nodes = b.scored_nodes(spark, sf)
    err = scoring.replication_error(nodes, 5)
    gap = scoring.jensen_gap(nodes)
    return rounded(err.withColumn("jensen_gap", gap.select("jensen_gap").scalar()))


@query(
    with_(*SCORE_CTES)
    + f"""select {r('avg(case when abs(expected-y) < 2 then 0.5e0*(expected-y)*(expected-y)/2 '
                    'else abs(expected-y) - 1 end)/2', 'huber')} from record_nll"""
)
def huber_loss(spark, sf):
    return rounded(scoring.huber_term(scoring.record_scores(b.scored_nodes(spark, sf)), 2.0))


# --- sources -----------------------------------------------------------------

_REGISTRY = "(select n_nationkey as source_id, 1 + n_nationkey/1e1 as s, n_nationkey/1e2 as bias from nation)"


def _registry(spark, sf):
    return b.table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) as source_id",
        "1 + n_nationkey/1e1 as source_sigma_km",
        "n_nationkey/1e2 as source_bias_km",
    )


@query(
    with_(OBS)
    + f"""select observation_id, source_id, {r('sqrt(16 + s*s)', 'effective_sigma_km')},
      {r('coalesce(bias, 0)', 'source_bias_km')}
    from (select observation_id, group_id % 27 as source_id from obs) left join {_REGISTRY}
      using (source_id)"""
)
def source_scales(spark, sf):
    rows = b.obs(spark, sf).select(
        "observation_id", (F.col("group_id") % 27).alias("source_id")
    )
    out = records.register_sources(rows, _registry(spark, sf), 4.0)
    return rounded(
        out.select("observation_id", "source_id", "effective_sigma_km", "source_bias_km")
    )


@query(
    with_(OBS)
    + """select distinct group_id % 27 as source_id from obs
    where group_id % 27 not in (select n_nationkey from nation)"""
)
def unregistered_sources(spark, sf):
    rows = b.obs(spark, sf).select((F.col("group_id") % 27).alias("source_id"))
    return records.unregistered_sources(rows, _registry(spark, sf))


# --- trajectories ------------------------------------------------------------

@query(
    """with long as (select o_orderkey as source_row, k as slot,
        5e0*k + case when (o_orderkey + k) % 11 = 0 then 0.5e0 else 0e0 end as time_ma,
        case when (o_orderkey + k) % 7 = 0 then null else ((o_orderkey*7919 + k*101) % 360000)/1e3-180 end as lon,
        ((o_orderkey*104729 + k*77) % 170000)/1e3-85 as lat
      from orders, (select unnest(range(13)) as k))
    select slot, abs(time_ma - slot*5) <= 1e-6 as on_time, count(*) as n,
      """
    + f"{r('sum(lon)', 'sum_lon')}, {r('avg(lat)', 'mean_lat')}"
    + " from long where lon is not null group by 1, 2"
)
def trajectory_slots(spark, sf):
    """Thirteen wide time slots per row -> long samples; off-time slots are counted."""
    wide = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_row"),
        *[
            F.expr(
                f"cast({5 * k}e0 + case when (o_orderkey + {k}) % 11 = 0 then 0.5e0 else 0e0 end as string)"
            ).alias(trajectories._slot_name("TIME", k))
            for k in range(13)
        ],
        *[
            F.expr(
                f"case when (o_orderkey + {k}) % 7 = 0 then null else "
                f"((o_orderkey*7919 + {k}*101) % 360000)/1e3-180 end"
            ).alias(trajectories._slot_name("paleo_lon", k))
            for k in range(13)
        ],
        *[
            F.expr(f"((o_orderkey*104729 + {k}*77) % 170000)/1e3-85").alias(
                trajectories._slot_name("paleo_lat", k)
            )
            for k in range(13)
        ],
    )
    long = trajectories.unpivot_slots(wide)
    return rounded(
        long.groupBy(F.col("slot").cast("long").alias("slot"), "on_time").agg(
            F.count("*").alias("n"), F.sum("lon").alias("sum_lon"), F.avg("lat").alias("mean_lat")
        )
    )


_SEG = (
    "seg",
    """select * from (select source_row, time_ma as t0, lon as lon0, lat as lat0,
       lead(time_ma) over w as t1, lead(lon) over w as lon1, lead(lat) over w as lat1
     from samples window w as (partition by source_row order by time_ma))
   where t1 - t0 <= 5 + 1e-9""",
)


@query(
    with_(b.SAMPLES, _SEG)
    + f"select source_row, {r('t0', 't0')}, {r('t1', 't1')}, lon0, lon1, lat0, lat1 from seg"
)
def reliable_segments(spark, sf):
    segs = trajectories.reliable_segments(b.samples(spark, sf)).select(
        "source_row", "t0", "t1", "lon0", "lon1", "lat0", "lat1"
    )
    return segs.withColumns({c: F.round(c, 6) for c in ("t0", "t1")})


@query(
    with_(OBS, b.SAMPLES, _SEG)
    + f"""select observation_id, {r('m', 'trajectory_support_mass')}, m >= 0.5e0 as primary_set from (
      select observation_id, coalesce(case when count(t0) = 0 then 0
        when any_value(least(age_upper_ma, 60e0)) < any_value(greatest(age_lower_ma, 0e0)) then 0
        when any_value(age_lower_ma) = any_value(age_upper_ma)
          then max(case when age_lower_ma between t0 - 1e-9 and t1 + 1e-9 then 1e0 else 0e0 end)
        when any_value(least(age_upper_ma, 60e0)) = any_value(greatest(age_lower_ma, 0e0)) then 0
        else sum(greatest(0e0, least(age_upper_ma, 60e0, t1) - greatest(age_lower_ma, 0e0, t0)))
             / any_value(least(age_upper_ma, 60e0) - greatest(age_lower_ma, 0e0)) end, 0e0) as m
      from obs left join seg on seg.source_row = obs.observation_id % 160
      group by observation_id)"""
)
def trajectory_support(spark, sf):
    rows = b.obs(spark, sf).withColumn("source_row", F.col("observation_id") % 160)
    out = trajectories.support_mass(rows, b.samples(spark, sf))
    return rounded(out.select("observation_id", "trajectory_support_mass", "primary_set"))


_SLERP_CTES = (
    (
        "hit",
        """select n.observation_id, n.node_idx, n.node_weight, n.present_lon, n.present_lat,
        any_value(case when s.time_ma is not null then s.lon end) as exact_lon,
        any_value(case when s.time_ma is not null then s.lat end) as exact_lat,
        any_value(g.lon0) as lon0, any_value(g.lat0) as lat0,
        any_value(g.lon1) as lon1, any_value(g.lat1) as lat1,
        any_value((node_age - g.t0)/(g.t1 - g.t0)) as f
      from node_rows n
      left join samples s on s.source_row = n.observation_id % 160 and s.time_ma = n.node_age
      left join seg g on g.source_row = n.observation_id % 160
         and g.t0 < n.node_age and n.node_age < g.t1
      group by all""",
    ),
    (
        "vecs",
        """select *, cos(radians(lat0))*cos(radians(lon0)) as ax, cos(radians(lat0))*sin(radians(lon0)) as ay,
        sin(radians(lat0)) as az, cos(radians(lat1))*cos(radians(lon1)) as bx,
        cos(radians(lat1))*sin(radians(lon1)) as "by", sin(radians(lat1)) as bz from hit""",
    ),
    (
        "om",
        """select *, atan2(sqrt(pow(ay*bz-az*"by",2)+pow(az*bx-ax*bz,2)+pow(ax*"by"-ay*bx,2)),
          ax*bx+ay*"by"+az*bz) as omega from vecs""",
    ),
    (
        "pos",
        """select *, sin((1-f)*omega)/sin(omega) as wa, sin(f*omega)/sin(omega) as wb from om""",
    ),
)


@query(
    with_(OBS, NODES, NODE_ROWS, b.SAMPLES, _SEG, *_SLERP_CTES)
    + f"""select observation_id, node_idx,
      exact_lon is not null or lon0 is not null as node_from_trajectory,
      {r('coalesce(exact_lon, degrees(atan2(wa*ay+wb*"by", wa*ax+wb*bx)), present_lon)', 'node_lon')},
      {r('coalesce(exact_lat, degrees(atan2(wa*az+wb*bz, sqrt(pow(wa*ax+wb*bx,2)+pow(wa*ay+wb*"by",2)))), present_lat)', 'node_lat')}
    from pos"""
)
def node_positions(spark, sf):
    """Node position from the trajectory where locatable, else the present position."""
    nodes = b.nodes(spark, sf).withColumns(
        {
            "source_row": F.col("observation_id") % 160,
            "point_id": F.col("observation_id") * 8 + F.col("node_idx"),
        }
    )
    at = trajectories.positions_at(nodes, b.samples(spark, sf), age="node_age")
    out = trajectories.node_positions(at)
    return rounded(
        out.select(
            "observation_id",
            F.col("node_idx").cast("long"),
            "node_from_trajectory",
            "node_lon",
            "node_lat",
        )
    )


# --- splits ------------------------------------------------------------------


@query(
    with_(OBS)
    + f"""select observation_id, dense_rank() over (order by
        round_even(present_lat/{STEP_TEXT}, 0), round_even(present_lon/{STEP_TEXT}, 0)) - 1
        as site_cluster from obs"""
)
def site_clusters(spark, sf):
    return splits.with_site_cluster(b.obs(spark, sf)).select("observation_id", "site_cluster")


@query(with_(OBS) + f"select observation_id, {b.ROLE_TEXT} as role from obs")
def chronological_roles(spark, sf):
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    return b.obs(spark, sf).select(
        "observation_id", splits.window_role(lo, hi, (lo + hi) / 2.0, b.WINDOW).alias("role")
    )


_BLOCKS = ("blocked", f"select *, {b.block_text('present_lon', 'present_lat')} as spatial_block from obs")


def _blocked(spark, sf):
    return b.obs(spark, sf).withColumn(
        "spatial_block", splits.spatial_block("present_lon", "present_lat")
    )


@query(with_(OBS, _BLOCKS) + "select observation_id, spatial_block from blocked")
def spatial_blocks(spark, sf):
    return _blocked(spark, sf).select("observation_id", "spatial_block")


_DENSEST = (
    "densest",
    """select spatial_block, count(*) as n_records from blocked group by 1
   order by n_records desc, spatial_block limit 2""",
)


@query(with_(OBS, _BLOCKS, _DENSEST) + "select * from densest")
def densest_blocks(spark, sf):
    return splits.densest_blocks(_blocked(spark, sf))


@query(
    with_(OBS, _BLOCKS, _DENSEST)
    + """select observation_id, spatial_block in (select spatial_block from densest) as in_test
    from blocked"""
)
def block_holdout(spark, sf):
    rows = _blocked(spark, sf)
    train, test = splits.in_blocks(rows, splits.densest_blocks(rows))
    return train.select("observation_id", F.lit(False).alias("in_test")).unionByName(
        test.select("observation_id", F.lit(True).alias("in_test"))
    )


@query(
    with_(
        OBS,
        ("roles", f"select *, {b.ROLE_TEXT} as role from obs"),
        (
            "picked",
            """select g from (select g, row_number() over (order by md5('42-' || g), g) as rk,
            count(*) over () as m from (select distinct group_id::varchar as g from roles
              where role = 'train'))
          where rk <= case when m > 1 then least(m - 1, greatest(1, round_even(m*0.1e0, 0)))
                           else round_even(m*0.1e0, 0) end""",
        ),
    )
    + """select observation_id, case when role = 'test' then 2 when role = 'buffer' then -1
      when group_id::varchar in (select g from picked) then 1 else 0 end as split from roles"""
)
def split_by_age_window(spark, sf):
    out = splits.assign_split(
        b.obs(spark, sf), "group_id", window=b.WINDOW, validation_fraction=0.1, seed=42
    )
    return out.select("observation_id", "split")


_HOLD = "(select o_orderkey as observation_id from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')"


def _holdout(spark, sf):
    return (
        b.table(spark, sf, "orders")
        .where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
        .select(F.col("o_orderkey").alias("observation_id"))
    )


@query(
    with_(OBS)
    + f"""select observation_id, group_id in (select group_id from obs
        where observation_id in (select observation_id from {_HOLD})) as held_out from obs"""
)
def whole_group_holdout(spark, sf):
    out = splits.whole_group_holdout(b.obs(spark, sf), _holdout(spark, sf), "group_id")
    return out.select("observation_id", "held_out")


@query(
    with_(
        OBS,
        (
            "h",
            f"""select *, group_id in (select group_id from obs
        where observation_id in (select observation_id from {_HOLD})) as held from obs""",
        ),
        (
            "picked",
            """select g from (select g, row_number() over (order by md5('7-' || g), g) as rk,
            count(*) over () as m from (select distinct group_id::varchar as g from h where not held))
          where rk <= case when m > 1 then least(m - 1, greatest(1, round_even(m*0.25e0, 0)))
                           else round_even(m*0.25e0, 0) end""",
        ),
    )
    + """select observation_id, case when held then 2
      when group_id::varchar in (select g from picked) then 1 else 0 end as split from h"""
)
def split_by_holdout(spark, sf):
    out = splits.assign_split(
        b.obs(spark, sf),
        "group_id",
        holdout=_holdout(spark, sf),
        validation_fraction=0.25,
        seed=7,
    )
    return out.select("observation_id", "split")


@query(
    with_(
        OBS,
        (
            "tagged",
            """select w.label as "window", observation_id, round_even(present_lat/"""
            + STEP_TEXT
            + """,0) as sa, round_even(present_lon/"""
            + STEP_TEXT
            + """,0) as sb, case when age_upper_ma >= w.w0 and age_lower_ma <= w.w1 then
          case when age_upper_ma - age_lower_ma <= 5
             and (age_lower_ma+age_upper_ma)/2 between w.w0 and w.w1 then 'test' else 'buffer' end
          else 'train' end as role
        from obs, (values ('15-25', 15, 25), ('40-50', 40, 50), ('50-60', 50, 60)) w(label, w0, w1)""",
        ),
    )
    + """select "window", count(*) filter (role = 'train') as n_train,
       count(*) filter (role = 'test') as n_test, count(*) filter (role = 'buffer') as n_buffer,
       count(distinct (sa, sb)) filter (role = 'train') as train_sites,
       count(distinct (sa, sb)) filter (role = 'test') as test_sites,
       (select count(*) from (select sa, sb from tagged t where t."window" = tagged."window" and role = 'train'
         intersect select sa, sb from tagged t where t."window" = tagged."window" and role = 'test')) as shared_sites,
       count(*) as n_records, count(distinct (sa, sb)) as n_sites,
       (select count(*) from (select observation_id from tagged t where t."window" = tagged."window" and role = 'train'
         intersect select observation_id from tagged t where t."window" = tagged."window" and role = 'test')) as shared_ids,
       count(*) filter (role = 'train') > 0 and count(*) filter (role = 'test') > 0 as passed
    from tagged group by "window" """
)
def split_manifest(spark, sf):
    return splits.window_manifest(b.obs(spark, sf), [(15, 25), (40, 50), (50, 60)])


@query(
    with_(OBS)
    + f"""select count(*) as n_shared from (
      select observation_id from (select observation_id, {b.ROLE_TEXT} as role from obs) where role = 'train'
      intersect select observation_id from (select observation_id, {b.ROLE_TEXT} as role from obs)
        where role = 'test')"""
)
def split_leakage(spark, sf):
    lo, hi = F.col("age_lower_ma"), F.col("age_upper_ma")
    rows = b.obs(spark, sf).withColumn("role", splits.window_role(lo, hi, (lo + hi) / 2.0, b.WINDOW))
    shared = splits.shared_ids(rows.where("role = 'train'"), rows.where("role = 'test'"))
    return shared.agg(F.count("*").alias("n_shared"))


@query(
    """select o_custkey as k, 'missing' as problem from (select distinct o_custkey from orders)
      where o_custkey % 10 <> 3 and o_custkey not in (select l_suppkey from lineitem)
    union all select l_suppkey, 'unexpected' from (select distinct l_suppkey from lineitem)
      where l_suppkey not in (select o_custkey from orders where o_custkey % 10 <> 3)"""
)
def id_differences(spark, sf):
    want = (
        b.table(spark, sf, "orders")
        .where("o_custkey % 10 <> 3")
        .select(F.col("o_custkey").alias("k"))
        .distinct()
    )
    have = b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    return splits.id_differences(want, have, "k")


@query(
    """select l_partkey, dense_rank() over (order by l_partkey) - 1 as dense_id
    from (select distinct l_partkey from lineitem)"""
)
def dense_group_ids(spark, sf):
    return ordering.dense_ids(b.table(spark, sf, "lineitem"), "l_partkey", "dense_id")


@query(
    with_(OBS, NODES, NODE_ROWS)
    + """select observation_id, count(*) as n_nodes from node_rows
    where observation_id not in (select observation_id from node_rows
       where (observation_id + node_idx) % 13 = 0) group by 1"""
)
def drop_failed_records(spark, sf):
    nodes = b.nodes(spark, sf).withColumn(
        "ok", (F.col("observation_id") + F.col("node_idx")) % 13 != 0
    )
    return trajectories.drop_failed_records(nodes, "ok").groupBy("observation_id").agg(
        F.count("*").alias("n_nodes")
    )


@query(
    f"""with s as (select o_orderkey, ((o_orderkey*7919) % 360000)/1e3-180 as lon,
        ((o_orderkey*104729) % 170000)/1e3-85 as lat, (o_orderkey % 61) as age from orders)
    select age, count(*) as n, {r('avg(' + b.truth_text('lon', 'lat', 'age') + ')', 'mean_truth')},
      {r('min(' + b.truth_text('lon', 'lat', 'age') + ')', 'min_truth')} from s group by age"""
)
def analytic_truth(spark, sf):
    rows = b.obs(spark, sf).withColumn("age", F.col("observation_id") % 61)
    t = synthetic.truth("present_lon", "present_lat", F.col("age"))
    return rounded(
        rows.groupBy("age").agg(
            F.count("*").alias("n"), F.avg(t).alias("mean_truth"), F.min(t).alias("min_truth")
        )
    )

