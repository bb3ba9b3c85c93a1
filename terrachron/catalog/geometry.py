"""Geometry queries: vectors, rotations, plate circuits, polygons, nearest joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sphere
from ..operators import polygons, rotations, spherebins
from . import bridge as b
from .bridge import FIELD_CTES, MODERN, OBS, RINGS, ROTATIONS, with_
from .registry import query, r, rounded


def _unit(lon, lat, p):
    return (
        f"cos(radians({lat}))*cos(radians({lon})) as {p}x, "
        f"cos(radians({lat}))*sin(radians({lon})) as {p}y, sin(radians({lat})) as {p}z"
    )


_PAIRS = (
    "pairs",
    f"""select *, {_unit('lon', 'lat', 'a')}, {_unit('lon2', 'lat2', 'b')} from (
      select observation_id as qid, present_lon as lon, present_lat as lat,
        ((observation_id*6151) % 360000)/1e3-180 as lon2, ((observation_id*4903) % 170000)/1e3-85 as lat2,
        (observation_id % 97)/9.6e1 as t, ((observation_id*13) % 1600)/1e1 - 80 as plat,
        ((observation_id*17) % 3600)/1e1 - 180 as plon, ((observation_id*7) % 300)/1e2 - 1.5e0 as rate from obs)""",
)
_PAIR_COLUMNS = [
    "observation_id as qid", "present_lon as lon", "present_lat as lat",
    "((observation_id*6151) % 360000)/1e3-180 as lon2",
    "((observation_id*4903) % 170000)/1e3-85 as lat2", "(observation_id % 97)/9.6e1 as t",
    "((observation_id*13) % 1600)/1e1 - 80 as plat",
    "((observation_id*17) % 3600)/1e1 - 180 as plon", "((observation_id*7) % 300)/1e2 - 1.5e0 as rate",
]
_OMEGA = """atan2(sqrt(pow(ay*bz-az*"by",2)+pow(az*bx-ax*bz,2)+pow(ax*"by"-ay*bx,2)),
   least(greatest(ax*bx+ay*"by"+az*bz, -1e0), 1e0))"""


def _quoted(text):
    return text.replace(" as by,", ' as "by",')


_PAIRS = (_PAIRS[0], _quoted(_PAIRS[1]))


def _pairs(spark, sf):
    return b.obs(spark, sf).selectExpr(*_PAIR_COLUMNS)


@query(
    with_(OBS, _PAIRS)
    + f"""select qid, {r('ax', 'x')}, {r('ay', 'y')}, {r('az', 'z')}, {r('degrees(atan2(ay, ax))', 'lon_back')},
      {r('6371*' + _OMEGA, 'distance_km')} from pairs"""
)
def great_circle(spark, sf):
    p = _pairs(spark, sf)
    v = sphere.unit_vector("lon", "lat")
    return rounded(
        p.select(
            "qid", v.x.alias("x"), v.y.alias("y"), v.z.alias("z"),
            sphere.to_lonlat(v)[0].alias("lon_back"),
            sphere.great_circle_km("lon", "lat", "lon2", "lat2").alias("distance_km"),
        )
    )


@query(
    with_(OBS, _PAIRS, ("o", f"select *, {_OMEGA} as om from pairs"),
          ("m", """select qid, wa*ax + wb*bx as x, wa*ay + wb*"by" as y, wa*az + wb*bz as z from (
             select *, case when om < 1e-12 then 1-t else sin((1-t)*om)/sin(om) end as wa,
               case when om < 1e-12 then t else sin(t*om)/sin(om) end as wb from o)"""))
    + f"select qid, {r('degrees(atan2(y, x))', 'lon')}, {r('degrees(atan2(z, sqrt(x*x+y*y)))', 'lat')} from m"
)
def great_circle_interpolation(spark, sf):
    p = _pairs(spark, sf)
    v = sphere.slerp(sphere.unit_vector("lon", "lat"), sphere.unit_vector("lon2", "lat2"), "t")
    lon, lat = sphere.to_lonlat(v)
    return rounded(p.select("qid", lon.alias("lon"), lat.alias("lat")))


# Rodrigues' formula in the oracle, quaternions in the query.
_ROTATED = (
    "rot",
    f"""select qid, ax*cos(th) + (ky*az - kz*ay)*sin(th) + kx*kd*(1-cos(th)) as x,
      ay*cos(th) + (kz*ax - kx*az)*sin(th) + ky*kd*(1-cos(th)) as y,
      az*cos(th) + (kx*ay - ky*ax)*sin(th) + kz*kd*(1-cos(th)) as z
    from (select *, kx*ax + ky*ay + kz*az as kd, radians(rate*2e1) as th from (select *, {_unit('plon', 'plat', 'k')} from pairs))""",
)


@query(
    with_(OBS, _PAIRS, _ROTATED)
    + f"select qid, {r('degrees(atan2(y, x))', 'lon')}, {r('degrees(atan2(z, sqrt(x*x+y*y)))', 'lat')} from rot"
)
def stage_transport(spark, sf):
    """Points carried for 20 Myr under a constant stage pole."""
    lon, lat = sphere.stage_transport("lon", "lat", "plat", "plon", "rate", 20.0)
    return rounded(_pairs(spark, sf).select("qid", lon.alias("lon"), lat.alias("lat")))


@query(
    with_(OBS, _PAIRS, ("v", f"""select *, (ky*az - kz*ay)*s as vx, (kz*ax - kx*az)*s as vy, (kx*ay - ky*ax)*s as vz
       from (select *, radians(rate)*6371 as s, {_unit('plon', 'plat', 'k')} from pairs)"""))
    + f"""select qid, {r('-sin(radians(lon))*vx + cos(radians(lon))*vy', 'east')},
      {r('-sin(radians(lat))*cos(radians(lon))*vx - sin(radians(lat))*sin(radians(lon))*vy + cos(radians(lat))*vz', 'north')} from v"""
)
def pole_velocity(spark, sf):
    east, north = sphere.pole_velocity("lon", "lat", "plat", "plon", "rate")
    return rounded(_pairs(spark, sf).select("qid", east.alias("east"), north.alias("north")))


# --- rotations -------------------------------------------------------------------

_ASKED = (
    "asked",
    """select o_orderkey as qid, cast(case when o_custkey % 31 < 25 then o_custkey % 31 + 100
      when o_custkey % 31 < 30 then o_custkey % 31 - 24 else 777 end as int) as plate_id,
      (o_orderkey % 600)/1e1 as age from orders""",
)


def _asked(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "o_orderkey as qid",
        "cast(case when o_custkey % 31 < 25 then o_custkey % 31 + 100 "
        "when o_custkey % 31 < 30 then o_custkey % 31 - 24 else 777 end as int) as plate_id",
        "(o_orderkey % 600)/1e1 as age",
    )


_QUATS = (
    "quats",
    f"""select plate_id, age, conjugate_id, cos(radians(angle)/2) as w, sin(radians(angle)/2)*kx as x,
     sin(radians(angle)/2)*ky as y, sin(radians(angle)/2)*kz as z
   from (select *, {_unit('lon', 'lat', 'k')} from rotations)""",
)
_BRACKETS = (
    "brackets",
    """select *, lead(age) over p as age1, lead(w) over p as w1, lead(x) over p as x1, lead(y) over p as y1,
     lead(z) over p as z1, row_number() over p = 1 as first from quats
   window p as (partition by plate_id order by age)""",
)
# Step rotation of every (plate, age) of the model's plates and the asked ages.
_STEPS = (
    "qsteps",
    """select plate_id, a as age, conjugate_id as parent,
     wa*w + wb*coalesce(w1,w) as w, wa*x + wb*coalesce(x1,x) as x, wa*y + wb*coalesce(y1,y) as y, wa*z + wb*coalesce(z1,z) as z
   from (select *, case when f = 0 or om < 1e-12 then 1 - f else sin((1-f)*om)/sin(om) end as wa,
      case when f = 0 or om < 1e-12 then f else sg*sin(f*om)/sin(om) end as wb
     from (select *, acos(least(1e0, abs(c))) as om, case when c < 0 then -1 else 1 end as sg
       from (select b.*, a.age as a, case when a.age <= b.age or b.age1 is null then 0e0
                    else (a.age - b.age)/(b.age1 - b.age) end as f,
               b.w*coalesce(w1,w) + b.x*coalesce(x1,x) + b.y*coalesce(y1,y) + b.z*coalesce(z1,z) as c
         from brackets b, (select distinct age from asked) a
         where (a.age >= b.age and (b.age1 is null or a.age < b.age1)) or (b.first and a.age < b.age))))""",
)
_CIRCUIT = (
    "circuit",
    """select plate_id, age, here, w, x, y, z from walk where here = 0""",
)
_WALK = """walk as (
   select distinct plate_id, age, plate_id as here, 1e0 as w, 0e0 as x, 0e0 as y, 0e0 as z, 0 as hop from asked
   union all
   select k.plate_id, k.age, s.parent, s.w*k.w - s.x*k.x - s.y*k.y - s.z*k.z,
     s.w*k.x + s.x*k.w + s.y*k.z - s.z*k.y, s.w*k.y - s.x*k.z + s.y*k.w + s.z*k.x,
     s.w*k.z + s.x*k.y - s.y*k.x + s.z*k.w, hop + 1
   from walk k join qsteps s on s.plate_id = k.here and s.age = k.age
   where k.here <> 0 and hop < 11 and s.parent <> k.here)"""


def _recursive(*parts, tail=()):
    text = "with recursive " + ",\n".join(f"{n} as ({t})" for n, t in parts) + ",\n" + _WALK
    for n, t in tail:
        text += f",\n{n} as ({t})"
    return text + "\n"


_ROTATION_CTES = (ROTATIONS, _ASKED, _QUATS, _BRACKETS, _STEPS)


@query(
    with_(*_ROTATION_CTES)
    + f"""select qid, cast(parent as int) as parent, {r('w', 's_w')}, {r('x', 's_x')}, {r('y', 's_y')}, {r('z', 's_z')}
    from asked left join qsteps using (plate_id, age)"""
)
def rotation_brackets(spark, sf):
    """As-of rotation of every (plate, age) against its parent."""
    out = rotations.step_rotations(
        _asked(spark, sf), rotations.rotation_brackets(b.rotations(spark, sf))
    )
    return rounded(out.select("qid", "parent", "s_w", "s_x", "s_y", "s_z"))


@query(
    _recursive(*_ROTATION_CTES, tail=[_CIRCUIT])
    + f"""select plate_id, age, c.here is not null as ok, {r('case when w < 0 then -w else w end', 'r_w')},
      {r('case when w < 0 then -x else x end', 'r_x')}, {r('case when w < 0 then -y else y end', 'r_y')},
      {r('case when w < 0 then -z else z end', 'r_z')}
    from (select distinct plate_id, age from asked) left join circuit c using (plate_id, age)"""
)
def plate_circuits(spark, sf):
    """Total rotation of every distinct (plate, age), walked child to anchor."""
    out = rotations.total_rotations(_asked(spark, sf), b.rotations(spark, sf))
    return rounded(out.drop("clamped"))


_MOVED = (
    "moved",
    f"""select *, ax + 2*(y*tz - z*ty) as mx, ay + 2*(z*tx - x*tz) as my, az + 2*(x*ty - y*tx) as mz from (
     select *, y*az - z*ay + w*ax as tx, z*ax - x*az + w*ay as ty, x*ay - y*ax + w*az as tz from (
       select a.*, c.here is not null as ok, c.w, c.x, c.y, c.z, present_lon as lon, present_lat as lat,
         {_unit('present_lon', 'present_lat', 'a')}
       from asked a join obs on observation_id = qid left join circuit c using (plate_id, age)))""",
)


@query(
    _recursive(OBS, *_ROTATION_CTES, tail=[_CIRCUIT, _MOVED])
    + f"""select qid, ok, {r('case when ok then degrees(atan2(my, mx)) else lon end', 'rec_lon')},
      {r('case when ok then degrees(atan2(mz, sqrt(mx*mx+my*my))) else lat end', 'rec_lat')} from moved"""
)
def reconstruct_points(spark, sf):
    """Positions at their ages; points that cannot be rotated are flagged and kept."""
    pts = _asked(spark, sf).join(
        b.obs(spark, sf).selectExpr("observation_id as qid", "present_lon as lon", "present_lat as lat"),
        "qid",
    )
    out = rotations.reconstruct(pts, b.rotations(spark, sf))
    return rounded(out.select("qid", "ok", "rec_lon", "rec_lat"))


_BACK = (
    "back",
    """select qid, ok and (age = 0 or qid % 6 <> 0) as supported, degrees(atan2(my, mx)) as blon,
     degrees(atan2(mz, sqrt(mx*mx+my*my))) as blat from (
      select *, ax + 2*(y*tz - z*ty) as mx, ay + 2*(z*tx - x*tz) as my, az + 2*(x*ty - y*tx) as mz from (
       select *, y*az - z*ay + w*ax as tx, z*ax - x*az + w*ay as ty, x*ay - y*ax + w*az as tz from (
        select qid, age, ok, w, -x as x, -y as y, -z as z, ax, ay, az from moved)))""",
)
_BACK_SAMPLE = (
    "bsample",
    """select qid, sum(p.w * m.value) as v from (
     select qid, unnest([{'i': i0, 'j': j0, 'w': (1-fi)*(1-fj)},
        {'i': i0, 'j': (j0+1)%360, 'w': (1-fi)*fj}, {'i': i0+1, 'j': j0, 'w': fi*(1-fj)},
        {'i': i0+1, 'j': (j0+1)%360, 'w': fi*fj}], recursive := true)
     from (select qid,
        cast(least(floor(least(greatest(blat+89.5e0,0e0),179e0)),178) as int) as i0,
        least(greatest(blat+89.5e0,0e0),179e0) - least(floor(least(greatest(blat+89.5e0,0e0),179e0)),178) as fi,
        cast(floor((blon-0.5e0) - floor((blon-0.5e0)/36e1)*36e1) as int) % 360 as j0,
        (blon-0.5e0) - floor(blon-0.5e0) as fj from back where supported)) p
   join modern m on m.i = p.i and m.j = p.j group by qid""",
)


@query(
    _recursive(OBS, MODERN, *_ROTATION_CTES, tail=[_CIRCUIT, _MOVED, _BACK, _BACK_SAMPLE])
    + f"select qid, supported, {r('v', 'reference_km')} from back left join bsample using (qid)"
)
def material_reference(spark, sf):
    """Modern value at each point's back-rotated place; networks only at age zero."""
    cells = (
        _asked(spark, sf)
        .join(
            b.obs(spark, sf).selectExpr(
                "observation_id as qid", "present_lon as lon", "present_lat as lat"
            ),
            "qid",
        )
        .withColumn("in_network", F.col("qid") % 6 == 0)
    )
    out = rotations.material_reference(
        cells, b.rotations(spark, sf), b.modern(spark, sf).select("i", "j", "value")
    )
    return rounded(out.select("qid", "supported", "reference_km"))


# --- polygons --------------------------------------------------------------------
# The oracle tests containment by summing the turning angles of every edge.

_EDGES = (
    "edges",
    _quoted(
        f"""select *, {_unit('alon', 'alat', 'a')}, {_unit('blon', 'blat', 'b')}, {_unit('flon', 'flat', 'f')} from (
       select feature_id, ring, role, plate_id, priority, vertex, lon as alon, lat as alat,
         coalesce(lead(lon) over w, first(lon) over w) as blon, coalesce(lead(lat) over w, first(lat) over w) as blat,
         first(lon) over w as flon, first(lat) over w as flat from rings
       window w as (partition by feature_id, ring order by vertex))"""
    ),
)
_AREAS = (
    "areas",
    """select feature_id, ring, any_value(role) as role, count(*) as n, sum(2*atan2(
      fx*(ay*bz-az*"by") + fy*(az*bx-ax*bz) + fz*(ax*"by"-ay*bx),
      1 + fx*ax+fy*ay+fz*az + ax*bx+ay*"by"+az*bz + fx*bx+fy*"by"+fz*bz)) as area from edges group by 1, 2""",
)


@query(
    with_(RINGS, _EDGES, _AREAS)
    + f"select feature_id, ring, {r('area', 'signed_area_sr')}, n as n_vertices, abs(area) <= 4*pi() + 1e-6 as valid from areas"
)
def ring_areas(spark, sf):
    out = polygons.ring_report(b.rings(spark, sf))
    return rounded(out.select("feature_id", "ring", "signed_area_sr", "n_vertices", "valid"))


@query(
    with_(RINGS, ("d", """select *, lon - lag(lon) over w as step from rings
        window w as (partition by feature_id, ring order by vertex)"""))
    + f"""select feature_id, ring, vertex, {r('''lon + 36e1*sum(case when step > 180 then -ceil((step-180)/36e1)
        when step < -180 then ceil((-step-180)/36e1) else 0 end) over (partition by feature_id, ring order by vertex)''', 'unwrapped_lon')} from d"""
)
def unwrapped_rings(spark, sf):
    out = polygons.unwrap_longitudes(b.rings(spark, sf))
    return rounded(
        out.select("feature_id", "ring", F.col("vertex").cast("long").alias("vertex"), "unwrapped_lon")
    )


@query(
    """with v as (select l_orderkey as feature_id, row_number() over (partition by l_orderkey
          order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as vertex,
          l_linenumber % 3 as lon, l_suppkey % 2 as lat from lineitem),
      k as (select * from v qualify lag((lon, lat)) over (partition by feature_id order by vertex) is null
            or lag((lon, lat)) over (partition by feature_id order by vertex) <> (lon, lat)),
      m as (select *, first_value((lon, lat)) over w as f, count(*) over (partition by feature_id) as n,
              row_number() over w as k from k window w as (partition by feature_id order by vertex))
    select feature_id, count(*) as n, sum(vertex)::bigint as kept from m
    where not (k = n and n > 1 and f = (lon, lat)) group by 1"""
)
def clean_rings(spark, sf):
    """Repeated consecutive vertices and closing vertices dropped."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    v = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("feature_id"),
        F.row_number().over(w).alias("vertex"),
        (F.col("l_linenumber") % 3).alias("lon"),
        (F.col("l_suppkey") % 2).alias("lat"),
    )
    return polygons.clean_rings(v, ["feature_id"]).groupBy("feature_id").agg(
        F.count("*").alias("n"), F.sum("vertex").alias("kept")
    )


def _inside(points):
    return f"""select qid, feature_id, any_value(plate_id) as plate_id, any_value(priority) as priority from (
      select qid, feature_id, ring, any_value(e.role) as role, any_value(plate_id) as plate_id, any_value(priority) as priority,
        sum(atan2(px*(ay*bz-az*"by") + py*(az*bx-ax*bz) + pz*(ax*"by"-ay*bx),
             ax*bx+ay*"by"+az*bz - (px*ax+py*ay+pz*az)*(px*bx+py*"by"+pz*bz)))/(2*pi()) * any_value(sign(area)) as turns
      from ({points}) p, edges e join areas using (feature_id, ring) group by qid, feature_id, ring)
    group by qid, feature_id having bool_or(turns > 0.5e0 and role = 'exterior') and not bool_or(turns > 0.5e0 and role = 'hole')"""


_INSIDE = (
    "inside",
    _inside(f"select observation_id as qid, {_unit('present_lon', 'present_lat', 'p')} from obs"),
)


@query(
    with_(OBS, RINGS, _EDGES, _AREAS, _INSIDE)
    + """select observation_id, coalesce(p, -1) as plate_id from obs
    left join (select qid, arg_min(plate_id, priority) as p from inside group by 1) on qid = observation_id"""
)
def assign_plates(spark, sf):
    """First polygon (exterior minus holes) containing each point, -1 if none."""
    pts = b.obs(spark, sf).selectExpr(
        "observation_id", "present_lon as lon", "present_lat as lat"
    )
    return polygons.assign_plates(pts, b.rings(spark, sf)).select("observation_id", "plate_id")


@query(
    with_(OBS, RINGS, _EDGES, _AREAS, _INSIDE)
    + """select observation_id, n is not null as in_network, coalesce(n, p, -1) as plate_id from obs
    left join (select qid, arg_min(plate_id, priority) filter (priority % 4 <> 0) as p,
                 arg_min(plate_id, priority) filter (priority % 4 = 0) as n from inside group by 1) on qid = observation_id"""
)
def network_override(spark, sf):
    """Network polygons (every fourth) override plate polygons."""
    pts = b.obs(spark, sf).selectExpr(
        "observation_id", "present_lon as lon", "present_lat as lat"
    )
    v = b.rings(spark, sf)
    both = polygons.assign_plates(pts, v.where("priority % 4 <> 0"), out="p")
    both = polygons.assign_plates(both, v.where("priority % 4 = 0"), out="n")
    return polygons.override_ids(both, "n", "p").select("observation_id", "in_network", "plate_id")


_POINTS = (
    "pts",
    f"select observation_id as qid, {_unit('present_lon', 'present_lat', 'p')} from obs",
)
_NEAR_ARC = (
    "near",
    """select qid, min(case when (ny*az-nz*ay)*px + (nz*ax-nx*az)*py + (nx*ay-ny*ax)*pz >= 0
        and ("by"*nz-bz*ny)*px + (bz*nx-bx*nz)*py + (bx*ny-"by"*nx)*pz >= 0
      then abs(asin(least(1e0, greatest(-1e0, (px*nx+py*ny+pz*nz)/sqrt(nx*nx+ny*ny+nz*nz)))))
      else 2*asin(least(1e0, sqrt(least(pow(px-ax,2)+pow(py-ay,2)+pow(pz-az,2),
                                      pow(px-bx,2)+pow(py-"by",2)+pow(pz-bz,2)))/2)) end) as d
    from pts, (select *, ay*bz-az*"by" as nx, az*bx-ax*bz as ny, ax*"by"-ay*bx as nz from edges) e group by qid""",
)


@query(
    with_(OBS, RINGS, _EDGES, _POINTS, _NEAR_ARC)
    + f"select qid, {r('least(6371*d, 3e3)', 'outline_km')} from near"
)
def outline_distance(spark, sf):
    """Exact distance to the nearest outline arc, capped at 3000 km."""
    pts = b.obs(spark, sf).selectExpr(
        "observation_id as qid", "present_lon as lon", "present_lat as lat"
    )
    out = polygons.outline_distance(
        pts, b.rings(spark, sf), point_keys=["qid"], cap_km=3000.0
    )
    return rounded(out.select("qid", "outline_km"))


# Points that cut each arc into the fewest equal pieces of at most half a degree.
_SAMPLED = (
    "arc_samples",
    f"""select wa*ax + wb*bx as x, wa*ay + wb*"by" as y, wa*az + wb*bz as z from (
      select *, sin((1-f)*om)/sin(om) as wa, sin(f*om)/sin(om) as wb from (
       select *, k/n as f from (select *, unnest(range(cast(n as int))) as k from (
         select *, greatest(ceil(degrees({_OMEGA})/0.5e0), 1) as n, {_OMEGA} as om from edges))))""",
)


@query(
    with_(OBS, RINGS, _EDGES, _POINTS, _SAMPLED)
    + f"""select qid, {r('least(6371*2*asin(least(1e0, sqrt(min(pow(px-x,2)+pow(py-y,2)+pow(pz-z,2)))/2)), 3e3)', 'boundary_km')}
    from pts, arc_samples group by qid"""
)
def boundary_vertex_distance(spark, sf):
    """Distance to the nearest tessellated boundary vertex, capped at 3000 km."""
    pts = b.obs(spark, sf).selectExpr(
        "observation_id as qid", "present_lon as lon", "present_lat as lat"
    )
    out = polygons.boundary_vertex_distance(
        pts, b.rings(spark, sf), point_keys=["qid"], tessellation_deg=0.5
    )
    return rounded(out.select("qid", "boundary_km"))


_COVER = (
    "probes",
    f"""select i, j, o, {_unit('lon + dj*22.5e0', 'greatest(least(lat + di*22.5e0, 9e1), -9e1)', 'p')} from (
      select i, j, lat, lon, o, (o // 2 + 0.5e0)/2 - 0.5e0 as di, (o % 2 + 0.5e0)/2 - 0.5e0 as dj
      from field, (select unnest(range(4)) as o) where age_idx = 0)""",
)


@query(
    with_(*FIELD_CTES, RINGS, _EDGES, _AREAS, _COVER,
          ("hit", _inside("select i*100000 + j*10 + o as qid, px, py, pz from probes")))
    + """select i, j, count(distinct h.qid)/4e0 as coverage from probes
      left join hit h on h.qid = i*100000 + j*10 + o group by i, j"""
)
def coverage_fraction(spark, sf):
    """Share of four probes per cell inside the union of the polygons."""
    cells = b.field(spark, sf).where("age_idx = 0").select("i", "j", "lat", "lon")
    out = polygons.coverage_fraction(cells, b.rings(spark, sf), 22.5, 22.5, 2)
    return out.select("i", "j", "coverage")


@query(
    with_(RINGS)
    + """select feature_id, case when priority % 10 = 1 then 'geometry' when priority % 10 = 2 then 'plate_id'
        when priority % 10 = 3 then 'missing' end as problem, priority % 10 not in (1, 2, 3) as passed
      from (select feature_id, any_value(priority) as priority from rings group by 1)"""
)
def frame_registration(spark, sf):
    """Exported outlines against their source: some moved, renumbered or left out."""
    source = b.rings(spark, sf)
    exported = source.where("priority % 10 <> 3").withColumns(
        {
            "lat": F.col("lat") + F.when(F.col("priority") % 10 == 1, 0.01).otherwise(0.0),
            "plate_id": F.col("plate_id") + F.when(F.col("priority") % 10 == 2, 1).otherwise(0),
        }
    )
    return polygons.registration_report(exported, source).select("feature_id", "problem", "passed")


@query(
    with_(OBS, RINGS, _POINTS)
    + f"""select qid, {r('6371*2*asin(least(1e0, sqrt(min(pow(px-x,2)+pow(py-y,2)+pow(pz-z,2)))/2))', 'distance_km')}
    from pts, (select distinct cos(radians(lat))*cos(radians(lon)) as x, cos(radians(lat))*sin(radians(lon)) as y,
        sin(radians(lat)) as z from rings) group by qid"""
)
def nearest_vertex(spark, sf):
    """Uncapped distance to the nearest ring vertex."""
    t = b.rings(spark, sf).select(F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat")).distinct()
    t = t.withColumns(sphere.vec_columns(sphere.unit_vector("t_lon", "t_lat"), "t_"))
    pts = b.obs(spark, sf).selectExpr(
        "observation_id as qid", "present_lon as lon", "present_lat as lat"
    )
    out = spherebins.nearest_distance(
        pts, t, sphere.angle(sphere.vec_of("p_"), sphere.vec_of("t_")),
        point_keys=["qid"], cap_km=None, width=6.0,
    )
    return rounded(out.select("qid", "distance_km"))
