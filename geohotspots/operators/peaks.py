"""Weekly activity profiles and recurring peak windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geohotspots.config import require_int

# --- fixed values -----------------------------------------------------------------
SMOOTHING = 0.5
PEAK_THRESHOLD = 0.5
SLOTS = 7 * 24
# ------------------------------------------------------------------------------------


def _slot() -> Column:
    return F.weekday("local_date") * 24 + F.col("hour")


def slot_counts(activity: DataFrame) -> DataFrame:
    """Events per hotspot and slot of the week (slot = day * 24 + hour, Monday = 0)."""
    return activity.groupBy("hotspot_id", _slot().alias("slot")).agg(F.sum("n").alias("n"))


def peak_profiles(activity: DataFrame, hotspots: DataFrame | None = None) -> DataFrame:
    """One row per hotspot: ``intensity`` (168 values, maximum 1) and ``total_events``.

    Counts are smoothed by 0.5 and divided by the largest. With ``hotspots``, those
    without events are included with a flat profile. At most 168 entries are collected
    per hotspot.
    """
    counted = slot_counts(activity).groupBy("hotspot_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("counts"),
        F.max("n").alias("top"),
        F.sum("n").alias("total_events"),
    )
    if hotspots is not None:
        counted = hotspots.select("hotspot_id").join(counted, "hotspot_id", "left")
    top = F.coalesce("top", F.lit(0)) + F.lit(SMOOTHING)
    intensity = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)),
        lambda s: (F.coalesce(F.col("counts")[s], F.lit(0)) + F.lit(SMOOTHING)) / top,
    )
    return counted.select(
        "hotspot_id",
        intensity.alias("intensity"),
        F.coalesce("total_events", F.lit(0)).alias("total_events"),
    )


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Long form: ``(hotspot_id, day_of_week, hour, intensity, total_events)``."""
    rows = profiles.select(
        "hotspot_id", "total_events", F.posexplode("intensity").alias("slot", "intensity")
    )
    return rows.select(
        "hotspot_id",
        F.floor(F.col("slot") / 24).cast("int").alias("day_of_week"),
        (F.col("slot") % 24).alias("hour"),
        "intensity",
        "total_events",
    )


def profile_matrix(profiles: DataFrame) -> DataFrame:
    """Output view: 7 x 24 nested array per hotspot."""
    days = F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda d: F.slice("intensity", d * 24 + 1, 24)
    )
    return profiles.select("hotspot_id", days.alias("hour_dow_matrix"), "total_events")


def peak_cells(profiles: DataFrame, threshold: float = PEAK_THRESHOLD) -> DataFrame:
    """Slots at or above the threshold."""
    return profile_rows(profiles).filter(F.col("intensity") >= threshold)


def coalesce_peaks(cells: DataFrame) -> DataFrame:
    """Runs of consecutive hours within a day; intensity is the largest of the run."""
    day = Window.partitionBy("hotspot_id", "day_of_week").orderBy("hour")
    run = cells.withColumn("run", F.col("hour") - F.row_number().over(day))
    return run.groupBy("hotspot_id", "day_of_week", "run").agg(
        F.min("hour").alias("start_hour"),
        F.max("hour").alias("end_hour"),
        F.max("intensity").alias("expected_intensity"),
    ).drop("run")


def top_peaks(profiles: DataFrame, *, top_k: int = 3) -> DataFrame:
    """The ``top_k`` strongest windows per hotspot with their ``peak_rank``."""
    require_int("top_k", top_k, 1, SLOTS)
    strongest = Window.partitionBy("hotspot_id").orderBy(
        F.col("expected_intensity").desc(), "day_of_week", "start_hour"
    )
    windows = coalesce_peaks(peak_cells(profiles))
    return windows.withColumn("peak_rank", F.row_number().over(strongest)).filter(
        F.col("peak_rank") <= top_k
    )


def attach_peaks(zones: DataFrame, windows: DataFrame) -> DataFrame:
    """Add ``peak_windows`` (array of structs in rank order, ``[]`` if none)."""
    window = F.struct(
        "peak_rank", "day_of_week", "start_hour", "end_hour", "expected_intensity"
    )
    lists = windows.groupBy("hotspot_id").agg(
        F.array_sort(F.collect_list(window)).alias("peaks")
    )
    without_rank = F.transform("peaks", lambda w: w.dropFields("peak_rank"))
    return (
        zones.join(lists, "hotspot_id", "left")
        .withColumn("peak_windows", F.coalesce(without_rank, F.array()))
        .drop("peaks")
    )


def overall_matrix(events: DataFrame) -> DataFrame:
    """Counts per day of week and hour over all events."""
    return events.groupBy(
        F.weekday("created_local").alias("day_of_week"), F.hour("created_local").alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))


def top_zone_profile(profiles: DataFrame, zones: DataFrame) -> DataFrame:
    """Profile rows of the zone ranked first."""
    first = zones.filter(F.col("global_rank") == 1).select("hotspot_id")
    return profile_rows(profiles.join(first, "hotspot_id", "left_semi"))
