"""Writers of the published artifacts. Private columns never leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.config import PRIVATE_COLUMNS

ZONE_COLUMNS = (
    "hotspot_id", "centroid_lat", "centroid_lon", "police_station", "impact",
    "frequency", "persistence", "recency", "priority_score", "global_rank",
    "station_rank",
)
RISK_COLUMNS = ("risk_tier", "anomaly_score")


def drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*PRIVATE_COLUMNS)


def write_priority_csv(zones: DataFrame, path: str, *, single_file: bool = False) -> str:
    """Zones by ascending rank, with header.

    The parts are written in parallel, each a contiguous range of ranks; ``single_file``
    makes one file, also when there are no zones.
    """
    columns = [*ZONE_COLUMNS, *(c for c in RISK_COLUMNS if c in zones.columns)]
    rows = drop_private(zones).select(*columns)
    if single_file:
        rows = rows.coalesce(1).sortWithinPartitions("global_rank")
    else:
        rows = rows.orderBy("global_rank")
    rows.write.mode("overwrite").csv(path, header=True)
    return path


def geojson_features(hotspots: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per hotspot (longitude first), nulls kept."""
    properties = [
        "hotspot_id",
        "member_count",
        "police_station",
        F.col("impact_score").alias("Congestion_Impact_Score"),
        "severity_component",
        "proximity_component",
        "concentration_component",
        "h3_cell",
        "cluster_label",
        *(c for c in RISK_COLUMNS if c in hotspots.columns),
    ]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array("centroid_lon", "centroid_lat").alias("coordinates"),
        ).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return drop_private(hotspots).select(
        "hotspot_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )


def write_geojson(hotspots: DataFrame, path: str) -> str:
    """Newline-delimited features in the order of their id, written in parallel."""
    lines = geojson_features(hotspots).orderBy("hotspot_id")
    lines.select("feature").write.mode("overwrite").text(path)
    return path


def _write_document(lines: DataFrame, path: str, opening: str, closing: str) -> str:
    """One text file: ``lines(hotspot_id, line)`` in order, with commas, between two lines.

    The entries stay rows: each carries its own comma, and the opening and closing lines
    are rows at the ends, so nothing is gathered into one value.
    """
    first = lines.agg(F.min("hotspot_id")).scalar()
    body = lines.select(
        F.lit(1).alias("part"),
        "hotspot_id",
        F.when(F.col("hotspot_id") == first, F.col("line"))
        .otherwise(F.concat(F.lit(","), F.col("line")))
        .alias("value"),
    )
    edges = lines.sparkSession.createDataFrame(
        [(0, "", opening), (2, "", closing)], body.schema
    )
    rows = body.unionByName(edges).coalesce(1).sortWithinPartitions("part", "hotspot_id")
    rows.select("value").write.mode("overwrite").text(path)
    return path


def write_geojson_document(hotspots: DataFrame, path: str) -> str:
    """One FeatureCollection text file."""
    lines = geojson_features(hotspots).withColumnRenamed("feature", "line")
    return _write_document(lines, path, '{"type":"FeatureCollection","features":[', "]}")


def write_peak_windows(windows: DataFrame, path: str, *, single_file: bool = False) -> str:
    """One ``{hotspot_id: [window, ...]}`` object per line, in the order of the id; with
    ``single_file`` one object for all."""
    window = F.struct("day_of_week", "start_hour", "end_hour", "expected_intensity")
    grouped = windows.groupBy("hotspot_id").agg(
        F.array_sort(F.collect_list(F.struct("peak_rank", window.alias("w")))).alias("ws")
    )
    lines = grouped.select(
        "hotspot_id", F.to_json(F.create_map("hotspot_id", F.col("ws.w"))).alias("line")
    )
    if single_file:
        inner = F.substring("line", 2, F.length("line") - 2)
        return _write_document(lines.withColumn("line", inner), path, "{", "}")
    lines.orderBy("hotspot_id").select("line").write.mode("overwrite").text(path)
    return path


def write_ingestion_report(report: DataFrame, path: str) -> str:
    """One JSON object with the totals and the drops by reason."""
    totals = ("total_rows_read", "rows_retained", "total_dropped")
    is_total = F.col("metric").isin(*totals)
    reasons = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(~is_total, F.struct("metric", "n"))))
    )
    document = report.agg(
        *[F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in totals],
        reasons.alias("dropped_by_reason"),
    )
    document.coalesce(1).write.mode("overwrite").json(path)
    return path
