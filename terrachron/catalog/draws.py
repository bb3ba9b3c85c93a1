"""Draw, history and spherical-harmonic queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import harmonics as fh
from ..functions import temporal
from ..functions.chronology import t4_quantile
from ..functions.physics import softplus
from ..operators import harmonics, histories, scoring
from ..plans import reports
from . import bridge as b
from .bridge import DRAWS, FIELD_CTES, NODE_ROWS, NODES, OBS, with_
from .registry import query, r, rounded

# --- draws -----------------------------------------------------------------------


@query(
    with_(DRAWS)
    + f"""select dim, {r('avg(value)', 'mean')}, count(*) as n, {r('quantile_cont(value, 0.05)', 'lower')},
      {r('quantile_cont(value, 0.95)', 'upper')} from draws group by dim"""
)
def posterior_summary(spark, sf):
    d = b.draws(spark, sf).withColumn("dim", F.col("dim").cast("long"))
    return rounded(histories.posterior_summary(d, ["dim"]))


@query(
    with_(
        DRAWS,
        ("s", "select max(draw) + 1 as d, (max(draw) + 1) // 2 as n, count(distinct chain) as c from draws"),
        (
            "h",
            """select dim, chain, case when draw < n then 0 else 1 end as half, avg(value) as m, var_samp(value) as v,
          any_value(n) as n from draws, s where draw < n or draw >= d - n group by 1, 2, 3""",
        ),
    )
    + f"""select {r('max(sqrt(((n-1)/n*w + b/n)/w))', 'max_split_rhat')} from (
      select dim, avg(v) as w, any_value(n)*var_samp(m) as b, any_value(n)::double as n from h group by 1)"""
)
def split_rhat(spark, sf):
    return rounded(histories.split_rhat(b.draws(spark, sf)))


# Node means per draw: the analytic truth plus an offset that is the mean of all
# vectors with one label, all their entries added up, so a label is a draw.
_DRAW_NODES = (
    "draw_nodes",
    """select s.observation_id, s.node_idx, s.node_weight, s.y, s.sigma, d.draw, s.mu + d.o as mu
   from scored s, (select label as draw, avg(list_sum(embedding::double[]))*6.25e0 as o from embeddings group by 1) d""",
)
_N_DRAWS = 10


def draw_nodes(spark, sf):
    offsets = (
        b.table(spark, sf, "embeddings")
        .groupBy(F.col("label").alias("draw"))
        .agg(
            (
                F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))) * 6.25
            ).alias("o")
        )
    )
    # The draws travel as one array per node and are unpacked in place.
    packed = offsets.agg(F.collect_list(F.struct("draw", "o")).alias("d")).select("d").scalar()
    nodes = b.scored_nodes(spark, sf, laid_out=True).withColumn("_d", packed)
    return nodes.select(
        "observation_id", "node_idx", "node_weight", "y", "sigma", "mu", F.explode("_d").alias("e")
    ).select(
        "observation_id", "node_idx", "node_weight", "y", "sigma",
        F.col("e.draw").cast("int").alias("draw"), (F.col("mu") + F.col("e.o")).alias("mu"),
    )


_PREDICTIVE = (
    "predictive",
    f"""select observation_id, -ln(avg(p)) as nll, avg(e) as expected, any_value(y) as y from (
     select observation_id, draw, sum(node_weight*{b.T4_TEXT}) as p, sum(node_weight*mu) as e, any_value(y) as y
     from draw_nodes group by 1, 2) group by 1""",
)


@query(
    with_(OBS, NODES, NODE_ROWS, b.SCORED, _DRAW_NODES, _PREDICTIVE)
    + f"select observation_id, {r('nll', 'nll')}, {r('expected', 'expected')} from predictive"
)
def predictive_likelihood(spark, sf):
    """Posterior predictive NLL and expected value per record."""
    out = histories.predictive_scores(draw_nodes(spark, sf), laid_out=True)
    return rounded(out.select("observation_id", "nll", "expected"))


_U = "(('0x' || substr(md5({0}), 1, 8))::bigint / 4294967296e0)"
_SAMPLES = (
    "samples",
    f"""select p.observation_id, p.k, mu + sigma*(case when u < 0.5e0 then -1 when u > 0.5e0 then 1 else 0 end)
        *2*sqrt(greatest(cos(acos(least(1e0, sqrt(4*u*(1-u))))/3)/sqrt(4*u*(1-u)) - 1, 0e0)) as sample
   from (select observation_id, k, floor({_U.format("'42-draw-' || observation_id || '-' || k")}*10) as draw,
           coalesce((select min(node_idx) from cum c where c.observation_id = w.observation_id
                and {_U.format("'42-node-' || w.observation_id || '-' || w.k")} < c.total), n - 1) as node_idx,
           {_U.format("'42-noise-' || observation_id || '-' || k")} + 0.5e0/4294967296e0 as u
         from (select observation_id, n, unnest(range(256)) as k from (
            select observation_id, count(*) as n from scored group by 1)) w) p
   join draw_nodes d using (observation_id, draw, node_idx)""",
)
_CUM = (
    "cum",
    """select observation_id, node_idx, sum(node_weight) over (partition by observation_id order by node_idx
       rows unbounded preceding) as total from scored""",
)
_PI = (
    "pint",
    """select observation_id, quantile_cont(sample, 0.05) as lower, quantile_cont(sample, 0.95) as upper
   from samples group by 1""",
)
_PI_CTES = (OBS, NODES, NODE_ROWS, b.SCORED, _DRAW_NODES, _CUM, _SAMPLES, _PI)


@query(with_(*_PI_CTES) + f"select observation_id, {r('lower', 'lower')}, {r('upper', 'upper')} from pint")
def predictive_intervals(spark, sf):
    """Central 90 % range of a reproducible predictive sample per record."""
    s = histories.predictive_samples(draw_nodes(spark, sf), _N_DRAWS, 256, 42, laid_out=True)
    return rounded(histories.predictive_intervals(s))


@query(
    with_(*_PI_CTES, _PREDICTIVE)
    + f"""select {r('avg(nll)', 'posterior_predictive_nll')}, {r('avg(abs(expected - y))', 'posterior_mean_mae_km')},
      {r('avg(case when y between lower and upper then 1e0 else 0e0 end)', 'coverage')}, {r('avg(upper-lower)', 'mean_width')},
      {r('avg(upper - lower + 2/(1-0.9e0)*(case when y < lower then lower - y when y > upper then y - upper else 0 end))', 'interval_score')},
      count(*) as n from predictive join pint using (observation_id)"""
)
def posterior_report(spark, sf):
    nodes = draw_nodes(spark, sf)
    intervals = histories.predictive_intervals(
        histories.predictive_samples(nodes, _N_DRAWS, 256, 42, laid_out=True)
    )
    scores = histories.predictive_scores(nodes, laid_out=True)
    return rounded(histories.posterior_report(scores, intervals))


@query(
    f"""select o_orderkey, {r('case when p < 0.5e0 then -1 when p > 0.5e0 then 1 else 0 end*2*sqrt(greatest(cos(acos(least(1e0, sqrt(4*p*(1-p))))/3)/sqrt(4*p*(1-p)) - 1, 0e0))', 't')}
    from (select o_orderkey, (o_orderkey % 9999 + 0.5e0)/1e4 as p from orders)"""
)
def t4_quantiles(spark, sf):
    o = b.table(spark, sf, "orders").selectExpr("o_orderkey", "(o_orderkey % 9999 + 0.5e0)/1e4 as p")
    return rounded(o.select("o_orderkey", t4_quantile("p").alias("t")))


# --- temporal whitening -------------------------------------------------------------
# Each vector is a history of 8 ages x 8 dimensions.

_AGES = [0.0, 2.0, 5.0, 10.0, 20.0, 30.0, 45.0, 60.0]
_HIST = (
    "hist",
    "select vec_id as history_id, d // 8 as age_idx, d % 8 as dim, embedding[d+1]::double as value, "
    "case when vec_id % 10 < 7 then 'train' else 'validation' end as split "
    "from embeddings, (select unnest(range(64)) as d)",
)


def _histories(spark, sf):
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("history_id"),
        F.when(F.col("vec_id") % 10 < 7, "train").otherwise("validation").alias("split"),
        F.posexplode("embedding").alias("d", "v"),
    ).select(
        "history_id", "split", F.floor(F.col("d") / 8).cast("int").alias("age_idx"),
        (F.col("d") % 8).alias("dim"), F.col("v").cast("double").alias("value"),
    )


def _matrix(name, m):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if m[i, j] != 0]
    return (name, b.values_text("rr, cc, l", rows))


_WHITE = (
    "white",
    """select history_id, split, dim, rr as age_idx, sum(l*value) as value from hist join linv on cc = age_idx group by 1, 2, 3, 4""",
)
_LINV = _matrix("linv", temporal.whitening_matrix(_AGES, 10.0, 2.0))


@query(
    with_(_HIST, _LINV, _WHITE)
    + f"select history_id, cast(age_idx as int) as age_idx, dim, {r('value', 'value')}, {r('(select 0.5e0*avg(w.value*w.value) from white w where w.history_id = white.history_id)', 'latent_gp_nll')} from white"
)
def whitened_histories(spark, sf):
    """Histories whitened over the age list, with the latent prior of each."""
    white = histories.whiten(_histories(spark, sf), _AGES, 10.0, ["history_id", "dim"], 2.0)
    prior = histories.latent_prior_nll(white, ["history_id"])
    out = white.withColumn("dim", F.col("dim").cast("long")).join(prior, "history_id")
    return rounded(out.select("history_id", "age_idx", "dim", "value", "latent_gp_nll"))


@query(with_(_HIST) + f"select history_id, cast(age_idx as int) as age_idx, dim, {r('value', 'value')} from hist")
def whitening_round_trip(spark, sf):
    """Unwhitening the whitened histories gives them back."""
    white = histories.whiten(_histories(spark, sf), _AGES, 10.0)
    back = histories.unwhiten(white, _AGES, 10.0)
    return rounded(back.withColumn("dim", F.col("dim").cast("long")))


@query(
    with_(_HIST, _LINV, _WHITE,
          ("st", """select dim, avg(value) as mean, greatest(stddev_pop(value), 1e-4) as scale from white
             where split = 'train' group by 1"""))
    + f"""select split, dim, {r('any_value(mean)', 'mean')}, {r('any_value(scale)', 'scale')},
      {r('avg((value - mean)/scale)', 'normalised_mean')} from white join st using (dim) group by 1, 2"""
)
def train_normalisation(spark, sf):
    """Statistics from training histories only, applied to every split."""
    white = histories.whiten(
        _histories(spark, sf), _AGES, 10.0, ["history_id", "split", "dim"], 2.0
    ).withColumn("dim", F.col("dim").cast("long"))
    stats = histories.train_normalisation(white)
    scaled = histories.normalise(white, stats)
    means = scaled.groupBy("split", "dim").agg(F.avg("value").alias("normalised_mean"))
    return rounded(means.join(stats, "dim").select("split", "dim", "mean", "scale", "normalised_mean"))


@query(
    f"""with e as (select vec_id, (embedding::double[]) as e from embeddings)
    select vec_id, {r('''greatest(x, 0) + ln(1 + exp(-abs(x))) + 0.05e0''', 'thickness_km')} from (
      select vec_id, 2.5e0 + (select sum(e[i+1]*e[i*5+j+15]*e[j+10]) from (select unnest(range(9)) as i), (select unnest(range(5)) as j))
        * 10/sqrt(45) + e[60] + e[61] + e[62] + e[63] + e[64] as x from e)"""
)
def tucker_decode(spark, sf):
    """Thickness decoded from all entries: 9 spatial x 5 context factors, their core, and the base."""
    e = b.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e")
    )
    rows = F.array(*[F.slice("e", 15 + 5 * i, 5) for i in range(9)])
    staged = e.select(
        "vec_id",
        F.slice("e", 1, 9).alias("spatial"),
        F.slice("e", 10, 5).alias("context"),
        rows.alias("core"),
        sum((F.col("e")[k] for k in range(59, 64)), F.lit(2.5)).alias("base"),
    )
    value = histories.tucker_value(scale_km=10.0, epsilon=0.05)
    return rounded(staged.select("vec_id", value.alias("thickness_km")))


@query(
    with_(_HIST)
    + f"""select q.age, h.dim, {r('sum(h.value*case when h.age_idx = a0 then 1 - f else f end)', 'value')}
    from (select distinct (o_custkey % 71)/1e0 as age, cast(floor((o_custkey % 71)/1e1) as int) as a0,
        (o_custkey % 71)/1e1 - floor((o_custkey % 71)/1e1) as f from orders) q
    join (select age_idx, dim, sum(value) as value from hist group by 1, 2) h on h.age_idx in (a0, a0 + 1)
    group by 1, 2"""
)
def cores_at_ages(spark, sf):
    """Cores interpolated between anchors ten Myr apart."""
    cores = _histories(spark, sf).groupBy("age_idx", F.col("dim").cast("long").alias("dim")).agg(
        F.sum("value").alias("value")
    )
    ages = b.table(spark, sf, "orders").selectExpr("(o_custkey % 71)/1e0 as age").distinct()
    return rounded(histories.core_at(cores, ages, 10.0, 8, keys=["dim"]))


@query(
    """select o_orderkey, x.anchor, round(x.w, 6) + 0e0 as w from (
      select o_orderkey, age, cast(floor(age/1e1) as int) as a0, age/1e1 - floor(age/1e1) as f from (
        select o_orderkey, (o_orderkey % 601)/1e1 as age from orders)) q,
      lateral (select a0 as anchor, case when a0 = 6 then 1e0 else 1 - f end as w
               union all select a0 + 1, f where a0 < 6) x"""
)
def anchor_weights(spark, sf):
    o = b.table(spark, sf, "orders").selectExpr("o_orderkey", "(o_orderkey % 601)/1e1 as age")
    w = o.select("o_orderkey", F.explode(temporal.anchor_weights("age", 10.0, 7)).alias("x"))
    return rounded(w.select("o_orderkey", "x.anchor", "x.w"))


# --- spherical harmonics ----------------------------------------------------------------

_K = math.sqrt
_BASIS2 = {
    "y0": f"{_K(1 / (4 * math.pi))!r}",
    "y1": f"({_K(3 / (4 * math.pi))!r}*sin(radians(lat)))",
    "y2": f"({-_K(3 / (4 * math.pi))!r}*cos(radians(lat))*cos(radians(lon)))",
    "y3": f"({-_K(3 / (4 * math.pi))!r}*cos(radians(lat))*sin(radians(lon)))",
    "y4": f"({_K(5 / (16 * math.pi))!r}*(3*pow(sin(radians(lat)),2) - 1))",
    "y5": f"({-_K(15 / (4 * math.pi))!r}*sin(radians(lat))*cos(radians(lat))*cos(radians(lon)))",
    "y6": f"({-_K(15 / (4 * math.pi))!r}*sin(radians(lat))*cos(radians(lat))*sin(radians(lon)))",
    "y7": f"({_K(15 / (16 * math.pi))!r}*pow(cos(radians(lat)),2)*cos(2*radians(lon)))",
    "y8": f"({_K(15 / (16 * math.pi))!r}*pow(cos(radians(lat)),2)*sin(2*radians(lon)))",
}


@query(
    with_(OBS)
    + "select observation_id, "
    + ", ".join(r(e, n) for n, e in _BASIS2.items())
    + " from (select observation_id, present_lon as lon, present_lat as lat from obs)"
)
def harmonic_basis(spark, sf):
    """All nine real harmonics up to degree two at every observation."""
    o = b.obs(spark, sf).withColumn("y", fh.basis(2, "present_lon", "present_lat"))
    return rounded(o.select("observation_id", *[F.col("y")[k].alias(f"y{k}") for k in range(9)]))


_QUAD = "(select sum(w)*16 from glat)"


_COEF = (
    "coef",
    "select age_idx, "
    + ", ".join(f"sum(value*{e}*w/{_QUAD}*4*pi()) as {n}" for n, e in _BASIS2.items())
    + " from field group by 1",
)


@query(
    with_(*FIELD_CTES, _COEF)
    + " union all ".join(
        f"select age_idx::bigint as age_idx, {k}::bigint as term, {r(f'y{k}', 'coefficient')}, "
        + r("0e0" if k == 0 else f"y{k}/({-2 if k < 4 else -6})", "potential")
        + " from coef"
        for k in range(9)
    )
)
def harmonic_analysis(spark, sf):
    """Quadrature least squares of all anchor fields, and their spectral inverse Laplacians."""
    from ..functions import grids

    c = harmonics.analyse(b.field(spark, sf), 2, grids.gauss_weight("i", b.NLAT), "age_idx")
    psi = harmonics.poisson_coefficients(c).select("age_idx", "term", F.col("coefficient").alias("potential"))
    return rounded(c.select("age_idx", "term", "coefficient").join(psi, ["age_idx", "term"]))


@query(
    with_(*FIELD_CTES, _COEF)
    + "select observation_id, "
    + r(" + ".join(f"y{k}*{e}" for k, e in enumerate(_BASIS2.values())), "value")
    + """ from (select observation_id, present_lon as lon, present_lat as lat, observation_id % 7 as age_idx from obs)
    join coef using (age_idx)"""
)
def harmonic_synthesis(spark, sf):
    """The analysed anchor fields evaluated at every observation, one anchor each."""
    from ..functions import grids

    c = harmonics.analyse(b.field(spark, sf), 2, grids.gauss_weight("i", b.NLAT), "age_idx")
    pts = b.obs(spark, sf).selectExpr(
        "observation_id", "present_lon as lon", "present_lat as lat", "observation_id % 7 as age_idx"
    )
    return rounded(harmonics.synthesise(pts, c, 2, by="age_idx").select("observation_id", "value"))


# --- variational objective --------------------------------------------------------------
# Model: degree 1 (4 terms) x 7 anchors; coefficients from customer balances.

_LEVEL = harmonics.initial_level(30.0)
_VCOEF = (
    "vcoef",
    f"""select (c_custkey % 28) // 4 as anchor, c_custkey % 4 as term,
      avg(c_acctbal)/1e3 + case when c_custkey % 4 = 0 then {_LEVEL!r}*3 else 0 end as value from customer group by 1, 2, c_custkey % 4""",
)


def _coefficients(spark, sf):
    c = b.table(spark, sf, "customer").groupBy(
        F.floor(F.col("c_custkey") % 28 / 4).alias("anchor"), (F.col("c_custkey") % 4).alias("term")
    ).agg(F.avg("c_acctbal").alias("m"))
    return c.select(
        "anchor", "term",
        (F.col("m") / 1e3 + F.when(F.col("term") == 0, _LEVEL * 3).otherwise(0.0)).alias("value"),
    )


_VNODES = (
    "vnodes",
    "select *, "
    + " + ".join(
        f"({e})*(coalesce((1-f)*(select value from vcoef where anchor = a0 and term = {k}),0) "
        f"+ coalesce(f*(select value from vcoef where anchor = a0+1 and term = {k}),0))"
        for k, e in enumerate(list(_BASIS2.values())[:4])
    )
    + """ as z from (select observation_id, node_idx, node_weight, thickness_km as y, 4e0 as sigma,
        present_lon as lon, present_lat as lat, cast(floor(node_age/1e1) as int) as a0,
        node_age/1e1 - floor(node_age/1e1) as f from node_rows)""",
)
_VSCORED = (
    "vscored",
    f"""select *, node_weight*{b.T4_TEXT}/sum(node_weight*{b.T4_TEXT}) over (partition by observation_id)
        * 5*(mu-y)/(4*sigma*sigma + (mu-y)*(mu-y)) as g
   from (select *, greatest(z,0) + ln(1+exp(-abs(z))) as mu from vnodes)""",
)
_V_CTES = (OBS, NODES, NODE_ROWS, _VCOEF, _VNODES, _VSCORED)


def variational_nodes(spark, sf):
    pts = b.nodes(spark, sf).selectExpr(
        "observation_id", "node_idx", "node_weight", "thickness_km as y", "4e0 as sigma",
        "present_lon as lon", "present_lat as lat", "node_age as age",
    )
    at = harmonics.anchor_fields_at(pts, _coefficients(spark, sf), 1, 10.0, 7)
    return at.withColumn("mu", softplus("z"))


@query(
    with_(*_V_CTES)
    + f"""select {r(f'(select avg(-ln(p)) from (select sum(node_weight*{b.T4_TEXT}) as p from vscored group by observation_id))', 'observation_nll')},
      {r('(select sum(pow(value - p, 2)) from (select value, lag(value) over (partition by term order by anchor) as p from vcoef))', 'roughness')}"""
)
def variational_objective(spark, sf):
    """Mean record NLL of the harmonic model and the roughness of its coefficients."""
    scores = scoring.record_scores(variational_nodes(spark, sf))
    rough = scoring.temporal_roughness(_coefficients(spark, sf), ["term"], "anchor")
    out = scores.agg(F.avg("nll").alias("observation_nll"))
    return rounded(out.withColumn("roughness", rough.select("roughness").scalar()))


@query(
    with_(
        *_V_CTES,
        (
            "gz",
            """select a0, f, lat, lon, g/(1+exp(-z))/(select count(distinct observation_id) from vscored) as g from vscored""",
        ),
        (
            "obsgrad",
            " union all ".join(
                f"select a0 as anchor, {k} as term, sum(g*(1-f)*{e}) as gradient from gz group by 1 "
                f"union all select a0+1, {k}, sum(g*f*{e}) from gz where a0 < 6 group by 1"
                for k, e in enumerate(list(_BASIS2.values())[:4])
            ),
        ),
        (
            "rough",
            """select anchor, term, 2*(coalesce(value - lag(value) over w, 0) + coalesce(value - lead(value) over w, 0)) as gradient
           from vcoef window w as (partition by term order by anchor)""",
        ),
    )
    + f"""select anchor::bigint as anchor, term::bigint as term, {r('sum(gradient)', 'gradient')} from (
      select anchor, term, gradient from obsgrad union all select anchor, term, 0.05e0*gradient from rough) group by 1, 2"""
)
def variational_gradient(spark, sf):
    """Analytic gradient of NLL plus roughness by anchor and term."""
    nodes = scoring.node_responsibilities(variational_nodes(spark, sf))
    n = nodes.select("observation_id").distinct().agg(F.count("*").alias("m")).select("m").scalar()
    counted = nodes.withColumn("_n", n)
    observation = harmonics.node_gradient(counted, F.col("_n"))
    rough = harmonics.roughness_gradient(_coefficients(spark, sf))
    out = harmonics.total_gradient([(1.0, observation), (0.05, rough)])
    return rounded(
        out.select(F.col("anchor").cast("long"), F.col("term").cast("long"), "gradient")
    )


@query(
    with_(
        OBS, b.MODERN, _VCOEF,
        (
            "mz",
            f"""select *, {b.block_text('case when lon >= 180 then lon - 360 else lon end', 'lat')} as block, """
            + " + ".join(
                f"({e})*(select value from vcoef where anchor = 0 and term = {k})"
                for k, e in enumerate(list(_BASIS2.values())[:4])
            )
            + " as z from modern",
        ),
        (
            "mg",
            "select block, " + ", ".join(
                f"sum(area_km2*(greatest(z,0)+ln(1+exp(-abs(z)))-value)/9/(1+exp(-z))*{e})/sum(area_km2) as g{k}"
                for k, e in enumerate(list(_BASIS2.values())[:4])
            ) + " from mz group by 1",
        ),
    )
    + " union all ".join(
        f"select 0::int as anchor, {k}::bigint as term, {r(f'avg(g{k})', 'gradient')} from mg" for k in range(4)
    )
)
def modern_gradient(spark, sf):
    """Gradient of the area-weighted endpoint loss at the youngest anchor."""
    from ..operators import splits

    cells = b.modern(spark, sf).withColumns(
        {
            "age": F.lit(0.0), "sigma": F.lit(3.0),
            "block": splits.spatial_block("lon", "lat"),
        }
    ).withColumnRenamed("value", "observed")
    at = harmonics.anchor_fields_at(cells, _coefficients(spark, sf), 1, 10.0, 7)
    out = harmonics.modern_gradient(at)
    return rounded(out.select("anchor", F.col("term").cast("long").alias("term"), "gradient"))


# --- ensembles of histories --------------------------------------------------------
# Cells are 8 ages x 2 rows x 4 columns; every third value is not observed. A core is told apart by its id.

_ENSEMBLE = (
    "ensemble",
    """select history_id, age_idx, dim, dim // 4 as i, dim % 4 as j, 30 + value as value, split,
     (history_id + 8*age_idx + dim) % 3 <> 0 as observed, value + history_id*1e-6 as core from hist""",
)
_LINV_ONE = _matrix("linv", temporal.whitening_matrix(_AGES, 10.0, 1.0))


def _ensemble(spark, sf):
    return _histories(spark, sf).selectExpr(
        "history_id", "cast(history_id % 50 as string) as group_id", "split", "age_idx", "dim",
        "cast(dim div 4 as int) as i", "cast(dim % 4 as int) as j", "30 + value as value",
        "3e1 as prediction", "cast((history_id + 8*age_idx + dim) % 3 <> 0 as int) as observed",
        "value + history_id*1e-6 as core",
    )


def _grid(spark):
    cells = spark.range(64).select(
        F.floor(F.col("id") / 8).cast("int").alias("age_idx"),
        F.floor(F.col("id") % 8 / 4).cast("int").alias("i"),
        (F.col("id") % 4).cast("int").alias("j"),
    )
    return cells


@query(
    with_(_HIST, _ENSEMBLE, _LINV_ONE,
          ("white", """select history_id, split, dim, rr as age_idx, sum(l*core) as value
             from ensemble join linv on cc = age_idx group by 1, 2, 3, 4"""),
          ("st", """select dim, avg(value) as mean, greatest(stddev_pop(value), 1e-4) as scale from white
             where split = 'train' group by 1"""),
          ("norm", "select history_id, avg((value - mean)/scale) as m from white join st using (dim) group by 1"),
          ("err", "select history_id, sqrt(avg((value - 30)*(value - 30))) as e from ensemble where observed group by 1"))
    + f"select history_id, {r('e', 'rmse_km')}, {r('m', 'normalised_mean')} from err join norm using (history_id)"
)
def ensemble_report(spark, sf):
    """Contract, errors and training-only normalisation of an ensemble of histories."""
    rows = _ensemble(spark, sf)
    cores = rows.select("history_id", "split", "age_idx", "dim", F.col("core").alias("value"))
    out = reports.ensemble_report(rows, cores, _AGES, _grid(spark))
    means = out["normalised"].groupBy("history_id").agg(F.avg("value").alias("normalised_mean"))
    return rounded(out["rmse"].join(means, "history_id").select("history_id", "rmse_km", "normalised_mean"))


@query(
    """select vec_id as history_id, case vec_id % 20 when 1 then 'other grid' when 2 then 'mask is not 0 or 1'
      when 3 then 'nothing observed' when 4 then 'observed value is not positive and finite'
      when 5 then 'other grid' end as field_problem,
      case vec_id % 20 when 6 then 'value is not finite' when 7 then 'age outside the anchors'
      when 8 then 'ages and dimensions incomplete' when 9 then 'other dimensions' end as core_problem
    from embeddings where vec_id % 20 between 1 and 9"""
)
def ensemble_problems(spark, sf):
    """Histories with planted faults, each named by the contract that it breaks."""
    rows = _ensemble(spark, sf).withColumn("k", F.col("history_id") % 20)
    k, first = F.col("k"), (F.col("age_idx") == 1) & (F.col("dim") == 1)
    fields_table = rows.where(~((k == 1) & first)).withColumns(
        {
            "observed": F.when((k == 2) & first, 2).when(k == 3, 0).when((k == 4) & first, 1).otherwise(F.col("observed")),
            "value": F.when((k == 4) & first, float("nan")).otherwise(F.col("value")),
            "i": F.when((k == 5) & first, 7).otherwise(F.col("i")),
        }
    )
    cores = rows.where(~((k == 8) & first)).select(
        "history_id",
        F.when((k == 7) & first, 8).otherwise(F.col("age_idx")).alias("age_idx"),
        F.when(k == 9, F.col("dim") + 1).otherwise(F.col("dim")).alias("dim"),
        F.when((k == 6) & first, float("inf")).otherwise(F.col("core")).alias("value"),
    )
    one = histories.field_problems(fields_table, _grid(spark)).withColumnRenamed("problem", "field_problem")
    two = histories.core_problems(cores, _AGES).withColumnRenamed("problem", "core_problem")
    return one.join(two, "history_id", "full_outer").select("history_id", "field_problem", "core_problem")
