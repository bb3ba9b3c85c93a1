"""Contract queries: each returns a report row or the violating rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, histories, scoring
from . import bridge as b
from .bridge import FIELD_CTES, NODE_ROWS, NODES, OBS, with_
from .registry import query, r, rounded


@query(
    """with t as (select l_orderkey as id, case when l_partkey % 31 = 0 then ' ' when l_partkey % 37 = 0
        then null else l_returnflag end as g from lineitem)
    select (select count(*) from t) as n_rows,
      (select count(*) from (select id from t group by id having count(*) > 1)) as repeated_ids,
      (select count(*) from t where g is null or trim(g) = '') as blank_groups"""
)
def identity_contract(spark, sf):
    t = b.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as id",
        "case when l_partkey % 31 = 0 then ' ' when l_partkey % 37 = 0 then null else l_returnflag end as g",
    )
    return checks.identity_report(t, "id", "g")


@query(
    """select l_orderkey, l_linenumber, count(*) as copies from lineitem
    group by 1, 2 having count(*) > 1"""
)
def repeated_keys(spark, sf):
    return checks.repeated_keys(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    with_(*FIELD_CTES, ("f", "select * from field where not (i = 3 and j % 5 = 0)"))
    + """select count(*) as n_cells, 0::bigint as repeated_cells, 0::bigint as outside_cells,
      count(*) filter (n % 7 = 1)::bigint as unusable_values,
      count(*) = 896 and count(*) filter (n % 7 = 1) = 0 as passed from f"""
)
def grid_contract(spark, sf):
    """A field with cells left out and some values made unusable."""
    f = b.field(spark, sf).where("not (i = 3 and j % 5 = 0)")
    f = f.withColumn("value", F.when(F.col("n") % 7 != 1, F.col("value")))
    return checks.grid_report(f, b.NLAT, b.NLON, b.ANCHORS, ["value"])


@query(
    with_(OBS, b.CELL_MEANS)
    + """select count(distinct age_idx) as n_ages, count(distinct age_idx) as n_index,
      min(age_idx)*1e1 as youngest, max(age_idx)*1e1 as oldest, 0::bigint as off_step,
      count(distinct age_idx) = 7 and min(age_idx) = 0 and max(age_idx) = 6 as passed from cell_means"""
)
def age_list_contract(spark, sf):
    """The anchors that records fall on, against the expected list."""
    ages = b.cell_means(spark, sf).select("age_idx", (F.col("age_idx") * 10.0).alias("age"))
    return checks.age_list_report(ages, b.STEP, 60.0)


@query(
    with_(*FIELD_CTES)
    + "select count(*) as n_cells, count(*) filter (value - 7.5e0 <= 0) as bad_values from field"
)
def usable_field(spark, sf):
    f = b.field(spark, sf).withColumn("value", F.col("value") - 7.5)
    return checks.usable_field(f)


@query(
    """with frozen as (select c_mktsegment as name, cast(count(*) as varchar) as frozen from customer group by 1),
    asked(name, requested) as (values ('BUILDING', '0'), ('HOUSEHOLD', (select count(*)::varchar from customer
       where c_mktsegment = 'HOUSEHOLD')), ('schema_version', '2'))
    select name, requested, frozen from asked left join frozen using (name)
    where frozen is distinct from requested"""
)
def protocol_contract(spark, sf):
    """Frozen name-value rows against a request: only the differences come back."""
    c = b.table(spark, sf, "customer")
    frozen = c.groupBy(F.col("c_mktsegment").alias("name")).agg(
        F.count("*").cast("string").alias("value")
    )
    household = frozen.where("name = 'HOUSEHOLD'").select("name", F.col("value").alias("requested"))
    asked = spark.createDataFrame(
        [("BUILDING", "0"), ("schema_version", "2")], "name string, requested string"
    )
    return checks.protocol_differences(frozen, asked.unionByName(household))


_HISTORIES = """select cast(vec_id as varchar) || ' ' as history_id, cast(vec_id // 10 as varchar) as group_id,
   case when vec_id % 100 < 70 then 'train' when vec_id % 100 < 85 then 'validation' else 'test' end as split
 from embeddings"""


def _histories(spark, sf):
    return b.table(spark, sf, "embeddings").selectExpr(
        "cast(vec_id as string) || ' ' as history_id",
        "cast(vec_id div 10 as string) as group_id",
        "case when vec_id % 100 < 70 then 'train' when vec_id % 100 < 85 then 'validation' else 'test' end as split",
    )


@query(
    f"""with h as ({_HISTORIES}), g as (select group_id, count(distinct split) as sides,
       bool_or(split = 'train') as t, bool_or(split = 'validation') as v from h group by 1)
    select 0::bigint as empty_ids, 0::bigint as repeated_ids, 0::bigint as bad_splits,
      (select count(*) from g where sides > 1) as crossing_groups,
      (select count(*) from g where t) as train_groups,
      (select count(*) from g where v) as validation_groups,
      (select count(*) from g where sides > 1) = 0 as passed"""
)
def history_split_contract(spark, sf):
    return histories.history_split_report(_histories(spark, sf))


@query(
    """with cores as (select case when e.vec_id % 5 = 4 and o.vec_id is not null then o.vec_id else e.vec_id end
          as source, e.vec_id as history_id from embeddings e left join embeddings o on o.vec_id = e.vec_id - 1)
    select count(*) as copies, min(history_id) as first_history from cores group by source having count(*) > 1"""
)
def repeated_histories(spark, sf):
    """Histories whose whole content equals another's (every fifth is a copy)."""
    e = b.table(spark, sf, "embeddings")
    donors = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    content = F.when((F.col("vec_id") % 5 == 4) & F.col("other").isNotNull(), F.col("other")).otherwise(
        F.col("embedding")
    )
    cores = (
        e.join(donors, "vec_id", "left")
        .select(F.col("vec_id").alias("history_id"), F.posexplode(content).alias("dim", "value"))
        .withColumn("age_idx", F.lit(0))
    )
    return histories.repeated_histories(cores).select("copies", "first_history")


_OBSERVED = """select l_suppkey as history_id, l_quantity - case when l_partkey % 50 = 0 then 60 else 0 end as value,
   l_linenumber % 3 = 0 and l_suppkey % 9 <> 0 as observed, l_extendedprice/1e3 as prediction from lineitem"""


def _observed(spark, sf):
    return b.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as history_id",
        "l_quantity - case when l_partkey % 50 = 0 then 60 else 0 end as value",
        "l_linenumber % 3 = 0 and l_suppkey % 9 <> 0 as observed",
        "l_extendedprice/1e3 as prediction",
    )


@query(
    f"""with t as ({_OBSERVED}) select history_id, count(*) filter (observed) as n_observed,
      count(*) filter (observed and value <= 0) as n_bad,
      count(*) filter (observed) > 0 and count(*) filter (observed and value <= 0) = 0 as passed
    from t group by 1"""
)
def observed_contract(spark, sf):
    return histories.observed_report(_observed(spark, sf))


@query(
    f"""with t as ({_OBSERVED}) select history_id, {r('sqrt(avg(pow(prediction - value, 2)))', 'rmse_km')}
    from t where observed group by 1"""
)
def observed_rmse(spark, sf):
    return rounded(histories.observed_rmse(_observed(spark, sf)))


@query(
    """select l_orderkey as evidence_id, min(l_returnflag) as first_role, max(l_returnflag) as last_role
    from lineitem group by 1 having min(l_returnflag) <> max(l_returnflag)"""
)
def double_use(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("evidence_id"), F.col("l_returnflag").alias("role")
    )
    return checks.double_use(rows)


@query(
    """select window_key, case when n_nationkey % 3 = 0 then 'reserved_final' when n_nationkey % 3 = 1 then 'open' end
        as status, n_nationkey is not null and n_nationkey % 3 = 1 as usable
    from (select distinct 'W' || (o_custkey % 40) as window_key from orders)
    left join nation on window_key = 'W' || n_nationkey"""
)
def window_status(spark, sf):
    asked = b.table(spark, sf, "orders").selectExpr("'W' || (o_custkey % 40) as window_key").distinct()
    registry = b.table(spark, sf, "nation").selectExpr(
        "'W' || n_nationkey as window_key",
        "case when n_nationkey % 3 = 0 then 'reserved_final' when n_nationkey % 3 = 1 then 'open' end as status",
    )
    return checks.window_status(asked, registry)


@query(
    with_(OBS, NODES, NODE_ROWS)
    + f"""select observation_id, {r('sum(w)', 'total')} from (
      select observation_id, node_weight * case when observation_id % 41 = 0 then 0.9e0 else 1 end as w
      from node_rows) group by 1 having abs(sum(w) - 1) > 1e-8"""
)
def unbalanced_weights(spark, sf):
    nodes = b.nodes(spark, sf).withColumn(
        "node_weight",
        F.col("node_weight") * F.when(F.col("observation_id") % 41 == 0, 0.9).otherwise(1.0),
    )
    return rounded(checks.unbalanced_weights(nodes))


@query(
    """select l_orderkey as factor_id, count(*) as n_ages, count(*) filter (c > 1) as repeated_ages,
      sum(b)::bigint as bad_scales from (
        select l_orderkey, 60 - l_linenumber*5e0 as age, count(*) as c, count(*) filter (l_discount <= 0) as b
        from lineitem group by 1, 2) group by 1
    having count(*) < 2 or count(*) filter (c > 1) > 0 or sum(b) > 0"""
)
def factor_contract(spark, sf):
    steps = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("factor_id"),
        (60.0 - F.col("l_linenumber") * 5.0).alias("age"),
        F.col("l_discount").alias("sigma"),
    )
    return checks.factor_report(steps, ["sigma"])


@query(
    """select l_orderkey as factor_id, l_linenumber as step, age from (
      select *, lag(age) over (partition by l_orderkey order by l_linenumber) as before from (
        select l_orderkey, l_linenumber, max(l_quantity) as age from lineitem group by 1, 2))
    where age >= before"""
)
def decreasing_ages(spark, sf):
    steps = (
        b.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("factor_id"), F.col("l_linenumber").alias("step"))
        .agg(F.max("l_quantity").alias("age"))
    )
    return checks.decreasing_age_violations(steps)


_DIGEST = """sha256('{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}')"""


@query(
    f"""with d as (select l_returnflag, {_DIGEST} as h from lineitem)
    select l_returnflag, count(*) as n_rows, sha256(count(*)::varchar
       || '|' || sum(('0x' || substr(h, 1, 15))::bigint)::varchar
       || '|' || sum(('0x' || substr(h, 17, 15))::bigint)::varchar
       || '|' || sum(('0x' || substr(h, 33, 15))::bigint)::varchar) as fingerprint
    from d group by 1"""
)
def content_fingerprint(spark, sf):
    return histories.content_fingerprint(
        b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_returnflag"]
    )


@query(
    f"""with c as (select c_nationkey as candidate, avg(abs(c_acctbal))/1e3 as mae, avg(c_acctbal)/1e3 as nll,
        stddev_pop(c_acctbal)/1e3 as modern from customer group by 1)
    select 'validation_mae' as metric, arg_min(candidate, mae) as candidate, {r('min(mae)', 'score')} from c
    union all select 'validation_nll', arg_min(candidate, nll), {r('min(nll)', 'score')} from c
    union all select 'joint_nll', arg_min(candidate, nll + 0.5e0*modern), {r('min(nll + 0.5e0*modern)', 'score')} from c"""
)
def selection_score(spark, sf):
    """Best candidate under each declared selection metric."""
    c = b.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("candidate")).agg(
        (F.avg(F.abs("c_acctbal")) / 1e3).alias("age_marginal_mean_mae_km"),
        (F.avg("c_acctbal") / 1e3).alias("nll"),
        (F.stddev_pop("c_acctbal") / 1e3).alias("modern_nll"),
    )
    out = None
    for m in ("validation_mae", "validation_nll", "joint_nll"):
        row = scoring.selection_score(c, m, 0.5).select(F.lit(m).alias("metric"), "candidate", "score")
        out = row if out is None else out.unionByName(row)
    return rounded(out)
