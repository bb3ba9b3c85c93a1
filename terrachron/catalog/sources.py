"""Source queries: the parsers over lines that are formed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import gpml, storage, tables, text
from . import bridge as b
from .bridge import MODERN, OBS, with_
from .registry import query, r, rounded


def _modern_lines(spark, sf):
    m = b.modern(spark, sf)
    return m.select(F.format_string("  %.7f   %.7f %.7f ", "lon", "lat", -F.col("value")).alias("value"))


@query(
    with_(OBS, MODERN)
    + f"""select i::int as i, count(*) as n, {r('avg(round(value, 7))', 'mean_value')},
      {r('avg(area_km2)', 'mean_area')} from modern group by i"""
)
def source_modern_grid(spark, sf):
    """Modern grid lines, parsed; one row per latitude."""
    g = text.parse_modern_grid(_modern_lines(spark, sf))
    return rounded(
        g.groupBy("i").agg(
            F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg("area_km2").alias("mean_area")
        )
    )


@query(
    with_(OBS, MODERN)
    + """select 64800::bigint as n_cells, 0::bigint as repeated_cells, 0::bigint as off_centre,
      count(*) filter (value <= 0)::bigint as wrong_sign,
      count(*) filter (value <= 0) = 0 as passed from modern"""
)
def source_modern_report(spark, sf):
    """The contract of the parsed modern grid."""
    return text.modern_grid_report(text.parse_modern_grid(_modern_lines(spark, sf)))


@query(
    with_(OBS, MODERN)
    + f"""select block, count(*) as n, {r('sum(area_km2)', 'area')}, 3e0 as sigma from (
      select *, {b.block_text('case when lon >= 180 then lon - 360 else lon end', 'lat')} as block from modern)
    group by block"""
)
def source_modern_endpoint(spark, sf):
    """Endpoint cells with sigma and block, summed by block."""
    e = text.modern_endpoint(text.parse_modern_grid(_modern_lines(spark, sf)), 3.0)
    return rounded(
        e.groupBy("block").agg(
            F.count("*").alias("n"), F.sum("area_km2").alias("area"), F.max("sigma").alias("sigma")
        )
    )


@query(with_(b.ROTATIONS) + "select plate_id::int as plate_id, age::double as age, lat::double as lat, lon::double as lon, angle::double as angle, conjugate_id::int as conjugate_id from rotations")
def source_rotations(spark, sf):
    """Rotation lines with comments, unreadable lines, missing parents and repeated keys."""
    rot = b.rotations(spark, sf)
    number = (F.col("plate_id") * 1000 + F.col("age")).cast("long")
    fields = ["plate_id", "age", "lat", "lon", "angle"]
    line = F.concat_ws("  ", *[F.col(c).cast("string") for c in fields])
    whole = F.when(F.col("conjugate_id") == 0, line).otherwise(
        F.concat_ws(" ", line, F.col("conjugate_id").cast("string"), F.lit("! note"))
    )
    again = F.concat_ws(" ", F.col("plate_id").cast("string"), F.col("age").cast("string"), F.lit("1 1 1 1"))
    parts = [
        rot.select(number.alias("n"), whole.alias("line")),
        rot.select((number + 10**7).alias("n"), again.alias("line")),
        rot.select((number + 10**8).alias("n"), F.lit("! comment").alias("line")),
        rot.select((number + 10**9).alias("n"), F.lit("7 five 1 2 3 4").alias("line")),
    ]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return text.parse_rotations(lines.withColumn("path", F.lit("model.rot")))


# One feature per supplier: a triangle, and for every second a hole; three files, one with a bad line.
def _snapshot_lines(spark, sf):
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    named = F.concat(F.lit("# @D"), F.col("k").cast("string"), F.lit('|"a|b ""'), F.col("k").cast("string"), F.lit('"""|f'), F.col("k").cast("string"))
    corner = lambda dx, dy: F.concat_ws(
        " ", ((F.col("k") % 300) + dx).cast("string"), ((F.col("k") % 70) + dy).cast("string")
    )
    outer = [corner(0, 0), corner(9, 0), corner(9, 0), corner(9, 9), corner(0, 0)]
    inner = [corner(5, 1), corner(7, 1), corner(7, 3)]
    own = [F.lit(">"), named, F.lit("# @P"), *outer]
    hole = [F.lit("# @H"), *inner]
    body = F.when(F.col("k") % 2 == 0, F.array(*own, *hole)).otherwise(F.array(*own))
    bad = F.when(F.col("k") == 5, F.concat(body, F.array(F.lit("east north")))).otherwise(body)
    rows = s.select("k", F.posexplode(bad).alias("p", "line"))
    path = lambda k: F.concat(F.lit("plates_"), (k * 10).cast("string"), F.lit("Ma.gmt"))
    lines = rows.select(
        path(F.col("k") % 3).alias("path"), (F.col("k") * 100 + F.col("p") + 100).alias("n"), "line"
    )
    heads = s.select((F.col("k") % 3).alias("f")).distinct().select(
        path(F.col("f")).alias("path"), F.lit(1).cast("long").alias("n"), F.lit("# @NPLATEID1|NAME|FEATURE_ID").alias("line")
    )
    return lines.unionByName(heads)


@query(
    """select 'f' || s_suppkey as feature_id, cast(s_suppkey as int) as plate_id, 'a|b "' || s_suppkey || '"' as name, role,
      (s_suppkey % 3)*1e1 as age, count(*) as n, min(x)::double as west
    from supplier, (values ('exterior', 0), ('exterior', 9), ('exterior', 9), ('hole', 5), ('hole', 7), ('hole', 7)) v(role, dx),
      lateral (select s_suppkey % 300 + dx as x)
    where s_suppkey % 3 <> 2 and (role = 'exterior' or s_suppkey % 2 = 0) group by s_suppkey, role"""
)
def source_snapshots(spark, sf):
    """Rings of the good snapshot files; the file with a bad line is left out whole."""
    p = text.snapshot_polygons(text.parse_snapshots(_snapshot_lines(spark, sf)))
    return p.groupBy("feature_id", "plate_id", F.col("meta")["NAME"].alias("name"), "role", "age").agg(
        F.count("*").alias("n"), F.min("lon").alias("west")
    )


@query("select 'plates_20Ma.gmt' as path, 'expected longitude and latitude' as problem, 1::bigint as rows where exists (select 1 from supplier where s_suppkey = 5)")
def source_snapshot_rejects(spark, sf):
    v = text.parse_snapshots(_snapshot_lines(spark, sf))
    return text.snapshot_rejects(v, text.snapshot_polygons(v))


@query(
    """select age, coalesce(n, 0) as n_files from (values (0e0), (1e1), (15e-1), (6e1)) a(age) left join (
      select case when p_size % 7 = 0 then 15e-1 else (p_size % 7)*1e1 end as age, count(*) as n from part
      where p_size % 5 <> 0 group by 1) using (age)"""
)
def source_snapshot_ages(spark, sf):
    """Files at exactly the requested ages, from their names."""
    names = b.table(spark, sf, "part").selectExpr(
        "concat('dir/p', p_partkey, case when p_size % 5 = 0 then '_Ma' else '_' end, "
        "case when p_size % 7 = 0 then '1.5' else cast((p_size % 7)*10 as string) end, "
        "case when p_size % 5 = 0 then 'x.gmt' else 'Ma.gmt' end) as path"
    )
    return text.snapshot_report(text.snapshot_ages(names), [0.0, 10.0, 1.5, 60.0]).select("age", "n_files")


def _members(spark, sf):
    """One XML member per supplier; every tenth has a malformed coordinate list."""
    return b.table(spark, sf, "supplier").selectExpr(
        "'c.gpml' as path",
        "s_suppkey as feature",
        "concat('\n <gpml:Basin><!-- <gml:name>no</gml:name> --><gml:name><![CDATA[a & ', s_suppkey, ']]></gml:name>"
        "<gpml:reconstructionPlateId><gpml:ConstantValue><gpml:value>', s_suppkey % 900, '</gpml:value></gpml:ConstantValue>"
        "</gpml:reconstructionPlateId><gml:beginPosition>', s_suppkey % 60, '</gml:beginPosition><gml:posList>0 ', "
        "s_suppkey % 90, ' 10 0 10 ', case when s_suppkey % 20 = 3 then 'ten' when s_suppkey % 20 = 13 then '5 6' else '10' end, "
        "'</gml:posList></gpml:Basin></gml:') as xml",
    )


@query(
    """select s_suppkey as feature, 'Basin' as feature_type, cast(s_suppkey % 900 as int) as plate_id,
      'a & ' || s_suppkey as name, (s_suppkey % 60)::varchar as begin, 3 as n_points, (s_suppkey % 90)::double as first_lat
    from supplier where s_suppkey % 10 <> 3"""
)
def source_features(spark, sf):
    """Features of well-formed members, with comments and CDATA sections in the text."""
    good = _members(spark, sf).where("feature % 10 <> 3")
    ring = F.col("rings")[0]
    return gpml.parse_features(good).select(
        "feature", "feature_type", "plate_id", "name", "begin", F.size(ring).alias("n_points"), ring[0]["lat"].alias("first_lat")
    )


@query(
    """select s_suppkey as feature, '0 ' || s_suppkey % 90 || ' 10 0 10 ' || case when s_suppkey % 20 = 3 then 'ten' else '5 6' end as text
    from supplier where s_suppkey % 10 = 3"""
)
def source_feature_rejects(spark, sf):
    return gpml.feature_rejects(_members(spark, sf)).select("feature", "text")


def _raw_observations(spark, sf):
    o = b.obs(spark, sf).drop("group_id")
    rows = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])
    flag = "case cast(observation_id as long) % 7 when 0 then 'true' when 1 then null when 2 then {} else 'false' end"
    return rows.withColumn("thickness_km", F.expr("case when cast(observation_id as long) % 11 = 0 then 'thick' else thickness_km end")), flag


@query(
    with_(OBS)
    + f"""select case observation_id % 7 when 0 then true when 1 then null else false end as qc_negative_age,
      count(*) as n, count(*) filter (observation_id % 11 <> 0) as n_thick,
      {r('sum(case when observation_id % 11 <> 0 then thickness_km end)', 'total_km')} from obs group by 1"""
)
def source_observations(spark, sf):
    """Typed observations from text columns; unreadable numbers are null."""
    raw, flag = _raw_observations(spark, sf)
    typed = tables.typed_observations(raw.withColumn("qc_negative_age", F.expr(flag.format("'False'"))))
    return rounded(
        typed.groupBy("qc_negative_age").agg(
            F.count("*").alias("n"), F.count("thickness_km").alias("n_thick"), F.sum("thickness_km").alias("total_km")
        )
    )


@query(
    with_(OBS)
    + "select observation_id::varchar as observation_id, 'qc_negative_age' as flag, 'maybe' as text from obs where observation_id % 7 = 2"
)
def source_flag_rejects(spark, sf):
    raw, flag = _raw_observations(spark, sf)
    return tables.flag_rejects(raw.withColumn("qc_negative_age", F.expr(flag.format("'maybe'"))))


@query(
    with_(OBS)
    + f"""select count(*) as n, count(*) filter (observation_id % 13 <> 0) as n_good,
      {r('sum(present_lon) filter (observation_id % 13 <> 0)', 'lon')}, {r('sum(age_lower_ma)', 'age')} from obs"""
)
def source_point_queries(spark, sf):
    """Point-query lines; a value that is no number is null."""
    lines = b.obs(spark, sf).selectExpr(
        "concat_ws(',', case when observation_id % 13 = 0 then 'west' else cast(present_lon as string) end, "
        "cast(present_lat as string), cast(age_lower_ma as string)) as value"
    )
    rows = tables.parse_rows(lines, tables.POINT_QUERY)
    return rounded(
        rows.agg(
            F.count("*").alias("n"), F.count("longitude").alias("n_good"), F.sum("longitude").alias("lon"), F.sum("age_ma").alias("age")
        )
    )


@query(
    with_(b.DRAWS)
    + f"select chain::int as chain, count(*) as n, {r('sum(value)', 'total')}, max(draw)::int as last_draw from draws group by chain"
)
def source_draws(spark, sf):
    """Draw lines under their declared schema."""
    lines = b.draws(spark, sf).select(
        F.concat_ws(",", *[F.col(c).cast("string") for c in ("chain", "draw", "dim", "value")]).alias("value")
    )
    return rounded(
        tables.parse_rows(lines, tables.DRAWS).groupBy("chain").agg(
            F.count("*").alias("n"), F.sum("value").alias("total"), F.max("draw").alias("last_draw")
        )
    )


# The given tables.
GIVEN = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@query()
def source_hashes(spark, sf):
    """Sizes and digests of the files of all given tables (no SQL reads files)."""
    return storage.geometry_hashes(spark, {t: f"{sf}/{t}.parquet" for t in GIVEN})
