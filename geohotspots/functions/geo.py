"""Geometry column expressions: haversine, hexagonal binning, square sub-cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.config import EARTH_RADIUS_M, require_int

# --- fixed values of the hexagonal grid ---------------------------------------
HEX_EDGE_RES9_M = 200.786
HEX_LAT0 = 12.95
HEX_LON0 = 77.6
# -------------------------------------------------------------------------------


def haversine_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``sin^2(d / 2R)`` of the great-circle distance d; monotone in d."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    return F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_dlon), 2)


def haversine_limit(metres: float) -> float:
    """The value of :func:`haversine_term` at a distance of ``metres``."""
    return math.sin(metres / (2.0 * EARTH_RADIUS_M)) ** 2


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    term = haversine_term(lat1, lon1, lat2, lon2)
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(term))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; distances then need no further trigonometry."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_limit(metres: float) -> float:
    """Squared chord of two unit vectors ``metres`` apart on the ground."""
    return 4.0 * haversine_limit(metres)


def with_hex_cell(
    df: DataFrame,
    lat: str,
    lon: str,
    resolution: int = 9,
    name: str = "h3_cell",
    origin: tuple[float, float] = (HEX_LAT0, HEX_LON0),
) -> DataFrame:
    """Add the id ``hex{res}_{q}_{r}`` of the pointy-top hexagon that holds a coordinate.

    ``origin`` (latitude, longitude) is where the grid starts and its cells have their
    nominal size: choose it near the data. Ids of different origins do not compare.

    Local equirectangular projection, axial coordinates, cube rounding. The edge shrinks
    by sqrt(7) per resolution step. Every value used more than once is a column of its
    own step, which keeps the generated code small.
    """
    require_int("resolution", resolution, 0, 15)
    ky = math.radians(1.0) * EARTH_RADIUS_M
    lat0, lon0 = origin
    kx = ky * math.cos(math.radians(lat0))
    edge = HEX_EDGE_RES9_M * math.sqrt(7.0) ** (9 - resolution)
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    x = (F.col(lon) - F.lit(lon0)) * F.lit(kx)
    y = (F.col(lat) - F.lit(lat0)) * F.lit(ky)
    axial = df.select(
        *kept,
        ((x * F.lit(math.sqrt(3.0) / 3.0) - y / F.lit(3.0)) / F.lit(edge)).alias("_q"),
        ((y * F.lit(2.0) / F.lit(3.0)) / F.lit(edge)).alias("_r"),
    )
    q, r = F.col("_q"), F.col("_r")
    nearest = axial.withColumns(
        {
            "_rq": F.floor(q + F.lit(0.5)),
            "_rr": F.floor(r + F.lit(0.5)),
            "_rp": F.floor(-q - r + F.lit(0.5)),
        }
    )
    rq, rr, rp = F.col("_rq"), F.col("_rr"), F.col("_rp")
    gaps = nearest.withColumns(
        {"_dq": F.abs(rq - q), "_dr": F.abs(rr - r), "_dp": F.abs(rp - (-q - r))}
    )
    dq, dr, dp = F.col("_dq"), F.col("_dr"), F.col("_dp")
    fix_q = (dq > dr) & (dq > dp)
    cell_q = F.when(fix_q, -rp - rr).otherwise(rq)
    cell_r = F.when(fix_q, rr).when(dr > dp, -rq - rp).otherwise(rr)
    cell = F.concat(
        F.lit(f"hex{resolution}_"), cell_q.cast("string"), F.lit("_"), cell_r.cast("string")
    )
    return gaps.select(*kept, cell.alias(name))


@dataclass(frozen=True)
class SubcellGrid:
    """Square grid whose cells have a diagonal of at most ``eps_m``.

    Any two points of one cell are neighbours, and every neighbour of a point lies
    within ``reach_x`` columns and ``reach_y`` rows of its cell.
    """

    eps_m: float
    lat0: float
    lon0: float
    step_lat: float
    step_lon: float
    reach_x: int
    reach_y: int
    offsets: tuple[tuple[int, int], ...]

    # Shrinks cells a little so that rounding can never make a diagonal exceed eps.
    _SLACK = 1e-6

    @classmethod
    def covering(
        cls, eps_m: float, lat_min: float, lat_max: float, lon_min: float, lon_max: float
    ) -> "SubcellGrid":
        cosines = [math.cos(math.radians(v)) for v in (lat_min, lat_max)]
        cos_max = 1.0 if lat_min <= 0.0 <= lat_max else max(cosines)
        cos_min = min(cosines)
        side = eps_m / math.sqrt(2.0) * (1.0 - cls._SLACK)
        step_lat = math.degrees(side / EARTH_RADIUS_M)
        step_lon = math.degrees(side / (EARTH_RADIUS_M * cos_max))
        narrow = side * cos_min / cos_max
        limit = eps_m * (1.0 + cls._SLACK)
        if narrow <= 0 or limit / narrow > 64:
            raise ValueError("latitude range too wide for one neighbourhood grid")
        if max((lat_max - lat_min) / step_lat, (lon_max - lon_min) / step_lon) >= 2**30:
            raise ValueError("eps_m is too small for the extent of the data")
        reach_x, reach_y = int(limit / narrow) + 1, int(limit / side) + 1

        def gap(steps: int, width: float) -> float:
            return max(abs(steps) - 1, 0) * width

        offsets = tuple(
            (dx, dy)
            for dx in range(-reach_x, reach_x + 1)
            for dy in range(-reach_y, reach_y + 1)
            if math.hypot(gap(dx, narrow), gap(dy, side)) <= limit
        )
        return cls(eps_m, lat_min, lon_min, step_lat, step_lon, reach_x, reach_y, offsets)

    def column(self, lon: Column, level: int = 0) -> Column:
        """Column number; every level halves the cell, level n is level 0 scaled by 2^n."""
        return F.floor((lon - F.lit(self.lon0)) / F.lit(self.step_lon) * F.lit(2.0**level))

    def row(self, lat: Column, level: int = 0) -> Column:
        return F.floor((lat - F.lit(self.lat0)) / F.lit(self.step_lat) * F.lit(2.0**level))


#: Units of a degree in coordinate sums, about a millimetre each.
FIXED_UNITS = 10**8


def fixed_sum(coordinate: str) -> Column:
    """Sum of a coordinate in whole units, so it does not depend on the order of the rows.

    It is a decimal of 28 digits: a whole number of 64 bits ends at 5e8 rows of a group.
    """
    return F.sum(F.round(F.col(coordinate) * FIXED_UNITS).cast("decimal(18,0)"))


def fixed_mean(total: str, count: str = "n") -> Column:
    """Mean coordinate from partial sums of :func:`fixed_sum` and their counts."""
    whole = F.sum(F.col(total).cast("decimal(28,0)")).cast("double")
    return whole / F.sum(count) / FIXED_UNITS
