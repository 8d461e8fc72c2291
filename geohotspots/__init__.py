"""Hotspot analytics of geotagged, timestamped incident records on Spark."""

from geohotspots.config import (
    BoundingBox,
    ImpactWeights,
    PriorityConfig,
    TimeWindow,
)
from geohotspots.operators.forecast import DemandForecaster
from geohotspots.plans.zones import run, zone_tables
from geohotspots.session import build_session

__all__ = [
    "BoundingBox",
    "DemandForecaster",
    "ImpactWeights",
    "PriorityConfig",
    "TimeWindow",
    "build_session",
    "run",
    "zone_tables",
]
