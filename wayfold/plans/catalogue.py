"""All queries on the supplied tables, with their oracles."""

from __future__ import annotations

from wayfold.plans import geometry, placement, reports, schedules, telemetry, timetable  # noqa: F401
from wayfold.plans.registry import ORACLES, QUERIES
from wayfold.plans.timetable import positions as flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
