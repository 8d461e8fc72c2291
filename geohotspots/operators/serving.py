"""Queries of a control room over the zone, hotspot and window tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geohotspots.config import CELL_PREFIX, DAY_LABELS, RISK_TIERS, TimeWindow
from geohotspots.sources.writers import drop_private


def active_hotspots(windows: DataFrame, when: TimeWindow = TimeWindow()) -> DataFrame | None:
    """Ids with a window that covers the hour and day asked for; None for no filter."""
    if when.hour is None and when.day_of_week is None:
        return None
    rows = windows
    if when.hour is not None:
        rows = rows.filter(F.lit(when.hour).between(F.col("start_hour"), F.col("end_hour")))
    if when.day_of_week is not None:
        rows = rows.filter(F.col("day_of_week") == when.day_of_week)
    return rows.select("hotspot_id").distinct()


def filter_by_ids(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows whose hotspot is among ``ids``; all rows for None."""
    return df if ids is None else df.join(ids, "hotspot_id", "left_semi")


def filtered_zones(
    zones: DataFrame,
    windows: DataFrame,
    when: TimeWindow = TimeWindow(),
    *,
    risk_tier: str | None = None,
    station: str | None = None,
) -> DataFrame:
    """Zones that meet the time, tier and station filters together."""
    rows = zones
    if risk_tier is not None:
        rows = rows.filter(F.col("risk_tier") == risk_tier)
    if station is not None:
        rows = rows.filter(F.col("police_station") == station)
    return filter_by_ids(rows, active_hotspots(windows, when))


def top_zones(zones: DataFrame, n: int = 20) -> DataFrame:
    listed = (
        "global_rank", "hotspot_id", "police_station", "priority_score", "risk_tier",
        "anomaly_score", "impact", "frequency", "persistence", "recency", "station_rank",
    )
    columns = [c for c in listed if c in zones.columns]
    return zones.orderBy("global_rank").limit(n).select(*columns)


def station_zones(zones: DataFrame, station: str) -> DataFrame:
    """Zones of one station in station order."""
    listed = (
        "station_rank", "hotspot_id", "priority_score", "risk_tier", "anomaly_score",
        "impact", "frequency", "persistence",
    )
    columns = [c for c in listed if c in zones.columns]
    return (
        zones.filter(F.col("police_station") == station)
        .select(*columns)
        .orderBy("station_rank")
    )


def _high(zones: DataFrame) -> Column:
    if "risk_tier" not in zones.columns:
        return F.lit(0).cast("bigint")
    return F.count_if(F.col("risk_tier") == "HIGH")


def station_kpis(zones: DataFrame) -> DataFrame:
    """Zones, HIGH zones and top score of every station."""
    return zones.groupBy("police_station").agg(
        F.count(F.lit(1)).alias("n_zones"),
        _high(zones).alias("n_high"),
        F.max("priority_score").alias("top_score"),
    )


def kpis(zones: DataFrame, all_zones: DataFrame | None = None) -> DataFrame:
    """One row: zones, HIGH zones, stations, mean score, all zones, HIGH share in per cent."""
    everything = zones if all_zones is None else all_zones
    row = zones.agg(
        F.count(F.lit(1)).alias("n_zones"),
        _high(zones).alias("n_high"),
        F.count_distinct("police_station").alias("n_stations"),
        F.avg("priority_score").alias("avg_score"),
    )
    return row.withColumns(
        {
            "total_zones": everything.agg(F.count(F.lit(1))).scalar(),
            "pct_high": F.try_divide(F.col("n_high") * 100.0, F.col("n_zones")),
        }
    )


def tier_counts(zones: DataFrame) -> DataFrame:
    """Zones per tier, all three tiers present."""
    counts = zones.agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("risk_tier"),
                    F.count_if(F.col("risk_tier") == t).alias("n_zones"),
                )
                for t in RISK_TIERS
            ]
        ).alias("tiers")
    )
    return counts.select(F.inline("tiers"))


def high_risk_top(zones: DataFrame, n: int = 12) -> DataFrame:
    listed = ("hotspot_id", "police_station", "priority_score", "anomaly_score")
    high = zones.filter(F.col("risk_tier") == "HIGH")
    best = high.orderBy(F.col("priority_score").desc(), "hotspot_id").limit(n)
    return best.select(*[c for c in listed if c in zones.columns])


def anomaly_top(zones: DataFrame, n: int = 12) -> DataFrame:
    order = [F.col("anomaly_score").desc(), F.col("hotspot_id").asc()]
    return zones.orderBy(*order).limit(n).select(
        "hotspot_id", "police_station", "anomaly_score", "risk_tier", "priority_score"
    )


def with_day_label(windows: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(d) for d in DAY_LABELS])
    return windows.withColumn("day_label", F.get(labels, F.col("day_of_week")))


def intensity_by_day(windows: DataFrame) -> DataFrame:
    """Mean window intensity Monday to Sunday, null for a day without windows."""
    day = F.col("day_of_week")
    means = windows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("day_of_week"),
                    F.lit(label).alias("day_label"),
                    F.avg(F.when(day == i, F.col("expected_intensity"))).alias(
                        "avg_intensity"
                    ),
                )
                for i, label in enumerate(DAY_LABELS)
            ]
        ).alias("days")
    )
    return means.select(F.inline("days"))


def top_windows(windows: DataFrame, n: int = 15) -> DataFrame:
    """The strongest windows with day label and ``HH:00–HH:00`` text."""
    order = ["hotspot_id", "day_of_week", "start_hour"]
    best = windows.orderBy(F.col("expected_intensity").desc(), *order).limit(n)
    text = F.format_string("%02d:00–%02d:00", "start_hour", "end_hour")
    return with_day_label(best).select(
        "hotspot_id", "day_label", text.alias("window"), "expected_intensity"
    )


def map_style(hotspots: DataFrame) -> DataFrame:
    """Marker radius and colour from the share of the largest member count."""
    top = F.greatest(hotspots.agg(F.max("member_count")).scalar(), F.lit(1))
    placed = hotspots.dropna(subset=["centroid_lat", "centroid_lon"]).withColumn(
        "share", F.coalesce("member_count", F.lit(1)) / top
    )
    share = F.col("share")
    return placed.withColumns(
        {
            "radius": (share * 420 + 80).cast("int"),
            "r": (share * 220 + 20).cast("int"),
            "g": ((1 - share) * 80 + 20).cast("int"),
            "b": (150 - share * 120).cast("int"),
            "a": F.lit(200),
        }
    ).drop("share")


def forecast_style(ranked: DataFrame) -> DataFrame:
    """Ranked forecast with whole totals, marker radius and colour."""
    top = F.greatest(ranked.agg(F.max("total_predicted")).scalar(), F.lit(1.0))
    return ranked.withColumns(
        {
            "radius": F.col("total_predicted") / top * 400 + 80,
            "total_rounded": F.bround("total_predicted", 0).cast("bigint"),
            "r": F.lit(220),
            "g": F.lit(50),
            "b": F.lit(100),
            "a": F.lit(180),
        }
    )


def is_fallback(hotspots: DataFrame) -> DataFrame:
    """One row: whether there are hotspots and all of them are cells."""
    every = F.bool_and(F.col("hotspot_id").startswith(CELL_PREFIX))
    return hotspots.agg(F.coalesce(every, F.lit(False)).alias("is_fallback"))


def station_list(zones: DataFrame) -> DataFrame:
    return (
        zones.select("police_station")
        .filter(F.col("police_station").isNotNull())
        .distinct()
        .orderBy("police_station")
    )


def sample_violations(events: DataFrame, per_station: int = 10) -> DataFrame:
    """The latest events of every station without private fields.

    The rank filter also runs before the shuffle, so a large station sends at most
    ``per_station`` rows per map task.
    """
    order = Window.partitionBy("police_station").orderBy(F.col("created_at").desc(), "id")
    ranked = events.withColumn("sample_no", F.row_number().over(order))
    return drop_private(ranked.filter(F.col("sample_no") <= per_station))
