"""Physical constants, unit conversions and unit guards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published convention for results to agree.
EARTH_RADIUS_KM = 6371.0
SECONDS_PER_JULIAN_MYR = 31_557_600.0 * 1.0e6
KM_PER_MYR_IN_ONE_CM_PER_YEAR = 10.0
AGE_DOMAIN_MA = (0.0, 60.0)
MAX_SPEED_KM_PER_MYR = 2000.0
MAX_SOURCE_KM_PER_MYR = 10.0


def as_column(value) -> Column:
    """Column name -> column, number -> literal, column -> itself."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def forward_time(age, domain=AGE_DOMAIN_MA) -> Column:
    """Physical time runs toward the present: tau = oldest age - age."""
    return F.lit(float(domain[1])) - as_column(age)


def cm_per_year_to_km_per_myr(speed) -> Column:
    return as_column(speed) * KM_PER_MYR_IN_ONE_CM_PER_YEAR


def per_second_to_per_myr(rate) -> Column:
    return as_column(rate) * SECONDS_PER_JULIAN_MYR


def pole_rate_to_equator_speed(rate_deg_per_myr) -> Column:
    """Speed at 90 degrees from the pole, km/Myr."""
    return as_column(rate_deg_per_myr) * (math.pi / 180.0 * EARTH_RADIUS_KM)


def unit_violation(thickness=None, speed=None, source=None) -> Column:
    """Reason a row breaks the unit guards, or null when it passes."""
    checks = []
    if thickness is not None:
        checks.append((as_column(thickness) < 0, "negative_thickness"))
    if speed is not None:
        checks.append((F.abs(as_column(speed)) > MAX_SPEED_KM_PER_MYR, "speed_out_of_range"))
    if source is not None:
        checks.append((F.abs(as_column(source)) > MAX_SOURCE_KM_PER_MYR, "source_out_of_range"))
    out = F.lit(None).cast("string")
    for bad, reason in reversed(checks):
        out = F.when(bad, F.lit(reason)).otherwise(out)
    return out
