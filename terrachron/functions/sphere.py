"""Spherical geometry as column expressions.

Vectors and quaternions are small named tuples of columns, so a formula stays a
plain expression tree that whole-stage codegen compiles; no row leaves the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import EARTH_RADIUS_KM, as_column

COINCIDENT_ANGLE = 1e-12


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


class Quat(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column


def clip(value, low, high) -> Column:
    return F.least(F.greatest(as_column(value), as_column(low)), as_column(high))


def wrap180(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(as_column(lon) + 180.0, F.lit(360.0)) - 180.0


def wrap360(lon) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(as_column(lon), F.lit(360.0))


def vec_of(prefix: str) -> Vec:
    """The vector stored as ``<prefix>x, <prefix>y, <prefix>z``."""
    return Vec(F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z"))


def vec_columns(v: Vec, prefix: str) -> dict[str, Column]:
    return {prefix + "x": v.x, prefix + "y": v.y, prefix + "z": v.z}


def unit_vector(lon, lat) -> Vec:
    lam, phi = F.radians(as_column(lon)), F.radians(as_column(lat))
    return Vec(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))


def to_lonlat(v: Vec) -> tuple[Column, Column]:
    lon = F.degrees(F.atan2(v.y, v.x))
    lat = F.degrees(F.atan2(v.z, F.sqrt(v.x * v.x + v.y * v.y)))
    return lon, lat


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vec, k) -> Vec:
    k = as_column(k)
    return Vec(a.x * k, a.y * k, a.z * k)


def add(a: Vec, b: Vec) -> Vec:
    return Vec(a.x + b.x, a.y + b.y, a.z + b.z)


def angle(a: Vec, b: Vec) -> Column:
    """Geodesic angle in radians; atan2 form keeps precision at both ends."""
    return F.atan2(norm(cross(a, b)), clip(dot(a, b), -1.0, 1.0))


def great_circle_km(lon_a, lat_a, lon_b, lat_b) -> Column:
    return angle(unit_vector(lon_a, lat_a), unit_vector(lon_b, lat_b)) * EARTH_RADIUS_KM


def chord_to_km(chord) -> Column:
    return 2.0 * EARTH_RADIUS_KM * F.asin(clip(as_column(chord) / 2.0, 0.0, 1.0))


def blend_weights(omega, t) -> tuple[Column, Column]:
    """Weights of two unit vectors (or quaternions) an angle omega apart."""
    omega, t = as_column(omega), as_column(t)
    near = omega < COINCIDENT_ANGLE
    wa = F.when(near, 1.0 - t).otherwise(F.sin((1.0 - t) * omega) / F.sin(omega))
    wb = F.when(near, t).otherwise(F.sin(t * omega) / F.sin(omega))
    return wa, wb


def slerp(a: Vec, b: Vec, t) -> Vec:
    """Point at fraction t of the minor arc a->b; coincident ends blend linearly."""
    wa, wb = blend_weights(angle(a, b), t)
    return add(scale(a, wa), scale(b, wb))


def with_slerp(df: DataFrame, a: str, b: str, t, out: str, omega: str | None = None) -> DataFrame:
    """Add the vector ``out`` at fraction t from vector ``a`` to vector ``b`` (prefixes).

    The angle and the weights become columns of their own, so each is worked out once
    per row and the generated code stays small.
    """
    if omega is None:
        df = df.withColumn("_omega", angle(vec_of(a), vec_of(b)))
    wa, wb = blend_weights(omega or "_omega", t)
    df = df.withColumns({"_wa": wa, "_wb": wb})
    v = add(scale(vec_of(a), "_wa"), scale(vec_of(b), "_wb"))
    return df.withColumns(vec_columns(v, out)).drop("_wa", "_wb", "_omega")


# --- rotations ---------------------------------------------------------------


def rotation(pole_lat, pole_lon, angle_deg) -> Quat:
    """Unit quaternion of a finite rotation about an Euler pole."""
    half = F.radians(as_column(angle_deg)) / 2.0
    axis = unit_vector(pole_lon, pole_lat)
    s = F.sin(half)
    return Quat(F.cos(half), axis.x * s, axis.y * s, axis.z * s)


def compose(second: Quat, first: Quat) -> Quat:
    """Apply ``first``, then ``second``."""
    a, b = second, first
    return Quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def inverse(q: Quat) -> Quat:
    return Quat(q.w, -q.x, -q.y, -q.z)


def rotate(q: Quat, v: Vec) -> Vec:
    """v + 2 r x (r x v + w v) with r the vector part."""
    r = Vec(q.x, q.y, q.z)
    inner = add(cross(r, v), scale(v, q.w))
    return add(v, scale(cross(r, inner), 2.0))


def quat_of(prefix: str) -> Quat:
    return Quat(*[F.col(prefix + c) for c in "wxyz"])


def quat_columns(q: Quat, prefix: str) -> dict[str, Column]:
    return {prefix + c: v for c, v in zip("wxyz", q)}


def rotate_lonlat(lon, lat, pole_lat, pole_lon, angle_deg) -> tuple[Column, Column]:
    return to_lonlat(rotate(rotation(pole_lat, pole_lon, angle_deg), unit_vector(lon, lat)))


def stage_transport(lon, lat, pole_lat, pole_lon, rate_deg_per_myr, duration_myr):
    """Exact transport under a constant stage pole: one rotation by rate x time."""
    total = as_column(rate_deg_per_myr) * as_column(duration_myr)
    return rotate_lonlat(lon, lat, pole_lat, pole_lon, total)


def pole_velocity(lon, lat, pole_lat, pole_lon, rate_deg_per_myr) -> tuple[Column, Column]:
    """(east, north) velocity in km/Myr of a rigid rotation at a point."""
    omega = scale(unit_vector(pole_lon, pole_lat), F.radians(as_column(rate_deg_per_myr)))
    v = scale(cross(omega, unit_vector(lon, lat)), EARTH_RADIUS_KM)
    lam, phi = F.radians(as_column(lon)), F.radians(as_column(lat))
    east = Vec(-F.sin(lam), F.cos(lam), F.lit(0.0))
    north = Vec(-F.sin(phi) * F.cos(lam), -F.sin(phi) * F.sin(lam), F.cos(phi))
    return dot(v, east), dot(v, north)


# --- arcs and triangles ------------------------------------------------------


def triangle_excess(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed solid angle of a spherical triangle."""
    return 2.0 * F.atan2(dot(a, cross(b, c)), 1.0 + dot(a, b) + dot(b, c) + dot(a, c))


def bearing_turn(p: Vec, a: Vec, b: Vec) -> Column:
    """Signed angle subtended at p by the arc a->b; its ring sum is 2 pi x winding."""
    return F.atan2(dot(p, cross(a, b)), dot(a, b) - dot(p, a) * dot(p, b))


def arc_distance(p: Vec, a: Vec, b: Vec, n: Vec) -> Column:
    """Angle from p to the minor arc a-b with unit normal n: its foot if that is on the arc.

    The foot lies on the arc when p is on b's side of a and on a's side of b. A
    degenerate arc has a null normal and only its ends count.
    """
    along = (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0)
    to_plane = F.abs(F.asin(clip(dot(p, n), -1.0, 1.0)))
    return F.when(along, to_plane).otherwise(F.least(angle(p, a), angle(p, b)))


def arc_normal(a: Vec, b: Vec) -> Vec:
    """Unit normal of the great circle through a and b; null where they coincide."""
    n = cross(a, b)
    size = norm(n)
    return Vec(*[F.when(size > 1e-15, c / size) for c in n])
