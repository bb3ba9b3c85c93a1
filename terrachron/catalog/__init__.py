"""Registered queries: operators bound to the driver's tables, with oracle SQL."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import checks, draws, evaluation, fields, geometry, jobs, physics, records, sources  # noqa: F401
