"""One pass over the assigned events; every hotspot measure derives from its result.

The result has a row per hotspot, cell, station, local date and hour. Its size depends on
hotspots and time span, not on the number of events, and sums are combined before the
shuffle, so a hotspot with a large share of all events costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.functions.geo import fixed_sum
from geohotspots.functions.text import trim_ws
from geohotspots.operators.spatial import in_hotspot

# --- fixed values: severity by violation token ---------------------------------
SEVERITY = {
    "PARKING NEAR ROAD CROSSING": 1.0,
    "WRONG PARKING ON CARRIAGEWAY": 0.9,
    "NO STOPPING ON ROAD": 0.85,
    "OBSTRUCTION ON ROAD": 0.8,
    "PARKING ON FOOTPATH": 0.7,
    "WRONG PARKING": 0.6,
    "NO PARKING ZONE": 0.5,
    "PARKING WITHOUT PERMIT": 0.4,
    "WRONG SIDE PARKING": 0.45,
    "PARKING NEAR JUNCTION": 0.75,
    "PARKING NEAR BUS STOP": 0.55,
    "PARKING NEAR SCHOOL": 0.5,
    "PARKING NEAR HOSPITAL": 0.5,
    "DOUBLE PARKING": 0.7,
}
SEVERITY_FLOOR = 0.3
CROSSING_TOKENS = (
    "PARKING NEAR ROAD CROSSING",
    "PARKING NEAR JUNCTION",
    "NO STOPPING ON ROAD",
    "WRONG PARKING ON CARRIAGEWAY",
)
# --------------------------------------------------------------------------------


def token_severity(tokens: Column, table: dict[str, float] = SEVERITY) -> Column:
    """Largest table weight among the tokens; 0 when none is known."""
    weights = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    known = F.transform(tokens, lambda t: F.coalesce(weights[t], F.lit(0.0)))
    return F.coalesce(F.array_max(known), F.lit(0.0))


def near_crossing(df: DataFrame, tokens: tuple[str, ...] = CROSSING_TOKENS) -> Column:
    """Whether an event names a junction or carries a crossing token."""
    hit = F.lit(False)
    if "junction_name" in df.columns:
        hit = hit | (trim_ws(F.col("junction_name")) != "")
    if "violation_type" in df.columns:
        crossing = F.array(*[F.lit(t) for t in tokens])
        hit = hit | F.arrays_overlap("violation_type", crossing)
    return F.coalesce(hit, F.lit(False))


def event_measures(events: DataFrame) -> DataFrame:
    """Narrow event rows: keys, local date and hour, severity weight, crossing flag."""
    severity = (
        token_severity(F.col("violation_type"))
        if "violation_type" in events.columns
        else F.lit(0.0)
    )
    keys = ["hotspot_id", "cluster_label", "h3_cell", "police_station"]
    return events.select(
        *[
            F.col(k) if k in events.columns else F.lit(None).cast("string").alias(k)
            for k in keys
        ],
        F.to_date("created_local").alias("local_date"),
        F.hour("created_local").alias("hour"),
        "latitude",
        "longitude",
        "created_at",
        severity.alias("severity"),
        near_crossing(events).cast("int").alias("near"),
    )


def hotspot_activity(assigned: DataFrame) -> DataFrame:
    """Partial sums per hotspot, cell, station, local date and hour."""
    rows = event_measures(assigned.filter(in_hotspot(assigned)))
    sums = rows.groupBy(
        "hotspot_id", "cluster_label", "h3_cell", "police_station", "local_date", "hour"
    ).agg(
        F.count("hotspot_id").alias("n"),
        fixed_sum("latitude").alias("sum_lat"),
        fixed_sum("longitude").alias("sum_lon"),
        F.max("severity").alias("severity"),
        F.sum("near").alias("near"),
        F.max("created_at").alias("last_at"),
    )
    return sums.filter(F.col("n") > 0)
