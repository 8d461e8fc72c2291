"""Parameters shared by the operators.

Everything here is plain data that ends up as literals in a query plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

# --- fixed values -----------------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
LOCAL_TZ = "Asia/Kolkata"
SEED = 42
CLUSTER_PREFIX = "dbscan-"
CELL_PREFIX = "h3-"
NOISE_LABEL = -1
DEFAULT_AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)
DAY_LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
RISK_TIERS = ("HIGH", "MEDIUM", "LOW")
PRIVATE_COLUMNS = ("id", "vehicle_number", "updated_vehicle_number")
REQUIRED_COLUMNS = ("id", "latitude", "longitude", "created_datetime")
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class BoundingBox:
    """Inclusive coordinate box; rows outside it are rejected as bad geography."""

    lat_min: float = 12.7
    lat_max: float = 13.2
    lon_min: float = 77.3
    lon_max: float = 77.9


@dataclass(frozen=True)
class ImpactWeights:
    """Weights of the three impact components: each in [0, 1], sum 1 within 0.001."""

    severity: float = 0.45
    proximity: float = 0.35
    concentration: float = 0.20

    def validate(self) -> "ImpactWeights":
        values = (self.severity, self.proximity, self.concentration)
        if any(not 0.0 <= v <= 1.0 for v in values):
            raise ValueError(f"impact weights must lie in [0, 1]: {values}")
        if abs(sum(values) - 1.0) > 0.001:
            raise ValueError(f"impact weights must sum to 1, got {sum(values):.6f}")
        return self


@dataclass(frozen=True)
class PriorityConfig:
    """Reference instant and half-life of the recency factor.

    ``as_of=None`` means "latest event in the data".
    """

    as_of: datetime | None = None
    recency_halflife_days: float = 21.0

    def validate(self) -> "PriorityConfig":
        if not self.recency_halflife_days > 0:
            raise ValueError(
                f"recency_halflife_days must be > 0, got {self.recency_halflife_days!r}"
            )
        return self


@dataclass(frozen=True)
class TimeWindow:
    """Optional day-of-week (0 = Monday) and hour filter; ``None`` leaves an axis open."""

    day_of_week: int | None = None
    hour: int | None = None


def require_int(name: str, value: object, low: int, high: int | None = None) -> int:
    """``value`` as an int inside [low, high]; bools and floats are refused."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer, got {value!r}")
    if value < low or (high is not None and value > high):
        top = "" if high is None else f" and <= {high}"
        raise ValueError(f"{name} must be >= {low}{top}, got {value!r}")
    return value
