"""Summary reports over a finished run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.config import DAY_LABELS


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, bin_start, bin_end, n)`` over equal bins from minimum to maximum.

    The last bin is closed; a single value gets a range of one around it; empty bins
    count 0.
    """
    span = df.agg(
        F.struct(
            F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")
        )
    ).scalar()
    flat = span["lo"] == span["hi"]
    low = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    width = F.when(flat, F.lit(1.0)).otherwise(span["hi"] - span["lo"]) / bins
    placed = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(placed.alias("bin")).count()
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (low + width * F.col("bin")).alias("bin_start"),
        (low + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("n"),
    )


def _station_or(text: str) -> Column:
    station = F.col("police_station")
    return F.when(station.isNull() | (station == ""), F.lit(text)).otherwise(station)


def zones_per_station(zones: DataFrame, n: int = 15) -> DataFrame:
    counts = zones.groupBy(_station_or("(unknown)").alias("station")).agg(
        F.count(F.lit(1)).alias("n_zones")
    )
    return counts.orderBy(F.col("n_zones").desc(), "station").limit(n)


def top_labels(zones: DataFrame, n: int = 20) -> DataFrame:
    """``#rank station`` labels of the best zones with their score."""
    best = zones.orderBy("global_rank").limit(n)
    label = F.concat(
        F.lit("#"),
        F.col("global_rank").cast("string"),
        F.lit(" "),
        F.substring(_station_or("?"), 1, 18),
    )
    return best.select("global_rank", label.alias("label"), "priority_score")


def impact_geo(scored: DataFrame) -> DataFrame:
    return scored.select(
        "hotspot_id",
        F.col("centroid_lon").alias("longitude"),
        F.col("centroid_lat").alias("latitude"),
        "impact_score",
    )


def run_summary(
    scored: DataFrame,
    zones: DataFrame,
    report: DataFrame | None = None,
    used_dbscan: bool | None = None,
) -> DataFrame:
    """One row of headline numbers of a run.

    With the ingestion ``report`` also ``rows_read``, ``rows_retained``, ``rows_dropped``;
    with ``used_dbscan`` also the ``method``.
    """
    hotspots = scored.agg(
        F.struct(
            F.count(F.lit(1)).alias("hotspots"),
            F.avg("impact_score").alias("impact_mean"),
            F.max("impact_score").alias("impact_max"),
            F.max("member_count").alias("largest_hotspot"),
        )
    ).scalar()
    row = zones.agg(
        F.count(F.lit(1)).alias("zones"),
        F.avg("priority_score").alias("priority_mean"),
        F.max("priority_score").alias("priority_max"),
        F.count_distinct(_station_or("(unknown)")).alias("stations"),
    )
    parts = ("hotspots", "impact_mean", "impact_max", "largest_hotspot")
    columns = [F.col(f"_h.{p}").alias(p) for p in parts]
    columns += map(F.col, ("zones", "priority_mean", "priority_max", "stations"))
    if report is not None:
        names = {"rows_read": "total_rows_read", "rows_retained": "rows_retained", "rows_dropped": "total_dropped"}
        for name, metric in names.items():
            columns.append(report.filter(F.col("metric") == metric).select("n").scalar().alias(name))
    if used_dbscan is not None:
        columns.append(F.lit("dbscan" if used_dbscan else "cells").alias("method"))
    return row.withColumn("_h", hotspots).select(*columns)


def top_zones_with_peak(zones: DataFrame, windows: DataFrame, n: int = 5) -> DataFrame:
    """The best zones with station and first peak as text, ``n/a`` without one."""
    best = zones.orderBy("global_rank").limit(n)
    first = windows.filter(F.col("peak_rank") == 1)
    labels = F.array(*[F.lit(d) for d in DAY_LABELS])
    peak = F.concat(
        F.get(labels, F.col("day_of_week")),
        F.lit(" "),
        F.format_string("%02d-%02dh", "start_hour", "end_hour"),
    )
    return best.join(first, "hotspot_id", "left").select(
        "global_rank",
        _station_or("?").alias("station"),
        "priority_score",
        F.when(F.col("day_of_week").isNull(), F.lit("n/a")).otherwise(peak).alias("peak"),
    )
