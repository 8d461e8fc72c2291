"""Hexagonal binning, hotspot assignment and hotspot records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.config import CELL_PREFIX, CLUSTER_PREFIX, NOISE_LABEL, BoundingBox
from geohotspots.functions.geo import HEX_LAT0, HEX_LON0, fixed_mean, fixed_sum, with_hex_cell
from geohotspots.functions.text import MODE_NULL_TOKENS, is_null_like
from geohotspots.operators.dbscan import find_clusters, label_events
from geohotspots.session import cut_lineage


class Assignment(NamedTuple):
    """Events with ``hotspot_id`` (null for noise), and which method made them."""

    events: DataFrame
    used_dbscan: bool


def assign_cells(
    events: DataFrame,
    resolution: int = 9,
    name: str = "h3_cell",
    origin: tuple[float, float] = (HEX_LAT0, HEX_LON0),
) -> DataFrame:
    """Add the hexagon id of every event at ``resolution`` (0 to 15) in the grid at ``origin``."""
    return with_hex_cell(events, "latitude", "longitude", resolution, name, origin)


def by_cluster(events: DataFrame) -> DataFrame:
    """Hotspot id of the cluster; noise gets none."""
    label = F.col("cluster_label")
    return events.withColumn(
        "hotspot_id",
        F.when(label != NOISE_LABEL, F.concat(F.lit(CLUSTER_PREFIX), label.cast("string"))),
    )


def by_cell(events: DataFrame) -> DataFrame:
    """Hotspot id of the cell; there is no cluster label."""
    return events.withColumns(
        {
            "hotspot_id": F.concat(F.lit(CELL_PREFIX), F.col("h3_cell")),
            "cluster_label": F.lit(None).cast("int"),
        }
    )


def assign_hotspots(
    events: DataFrame,
    *,
    resolution: int = 9,
    eps_m: float = 75.0,
    min_samples: int = 15,
    order_by: str = "read_order",
    bbox: BoundingBox | None = None,
) -> Assignment:
    """Clusters when there is any, else one hotspot per occupied cell.

    A caller-supplied ``h3_cell`` column is kept.
    """
    celled = events if "h3_cell" in events.columns else assign_cells(events, resolution)
    found = find_clusters(
        celled, eps_m=eps_m, min_samples=min_samples, order_by=order_by, bbox=bbox
    )
    if found is None or found[0].isEmpty():
        return Assignment(by_cell(celled), False)
    return Assignment(by_cluster(label_events(celled, *found)), True)


def membership(assigned: DataFrame) -> DataFrame:
    """``(id, hotspot_id)`` of every event that belongs to a hotspot."""
    return assigned.filter(in_hotspot(assigned)).select("id", "hotspot_id")


def modal_value(
    df: DataFrame,
    by: list[str],
    value: str,
    *,
    weight: Column | None = None,
    skip: tuple[str, ...] | None = MODE_NULL_TOKENS,
) -> DataFrame:
    """Most frequent ``value`` per group, smallest on a tie; ``skip`` texts do not count.

    Counts are combined before the shuffle, and the winner is a minimum over one row per
    distinct value, so no group is gathered.
    """
    usable = F.col(value).isNotNull() if skip is None else ~is_null_like(F.col(value), skip)
    counts = df.groupBy(*by, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")
    )
    # A condition inside the aggregate, not a filter: Spark would push a filter on the
    # value down to the rows and compute the value there once more.
    candidate = F.when(usable, F.struct((-F.col("_n")).alias("rank"), F.col(value).alias("value")))
    best = counts.groupBy(*by).agg(F.min(candidate).alias("_best"))
    return best.filter(F.col("_best").isNotNull()).select(
        *by, F.col("_best.value").alias(value)
    )


def in_hotspot(assigned: DataFrame) -> Column:
    """Condition for events of a hotspot, stated on the label where there is one.

    The id of a cell is a long expression that a null test would repeat per event.
    """
    if "cluster_label" in assigned.columns:
        return F.coalesce(F.col("cluster_label") != NOISE_LABEL, F.lit(True))
    return F.col("hotspot_id").isNotNull()


def _groups(assigned: DataFrame) -> DataFrame:
    """Stored partial sums of hotspot size: one pass over the events, read several times."""
    keys = ["hotspot_id", "cluster_label", "h3_cell", "police_station"]
    present = [k for k in keys if k in assigned.columns]
    sums = assigned.filter(in_hotspot(assigned)).groupBy(*present).agg(
        F.count("hotspot_id").alias("n"),
        fixed_sum("latitude").alias("sum_lat"),
        fixed_sum("longitude").alias("sum_lon"),
    )
    return cut_lineage(sums.filter(F.col("n") > 0))


def summarise(groups: DataFrame, bbox: BoundingBox = BoundingBox()) -> DataFrame:
    """Hotspot records from partial sums ``(hotspot_id, ..., n, sum_lat, sum_lon)``.

    The coordinate sums are those of :func:`fixed_sum`.
    """

    def mean(total: str, low: float, high: float) -> Column:
        value = fixed_mean(total)
        return F.greatest(F.lit(low), F.least(F.lit(high), value))

    hotspots = groups.groupBy("hotspot_id", "cluster_label").agg(
        mean("sum_lat", bbox.lat_min, bbox.lat_max).alias("centroid_lat"),
        mean("sum_lon", bbox.lon_min, bbox.lon_max).alias("centroid_lon"),
        F.sum("n").alias("member_count"),
    )
    for name in ("h3_cell", "police_station"):
        if name in groups.columns:
            modal = modal_value(groups, ["hotspot_id"], name, weight=F.col("n"))
            hotspots = hotspots.join(modal, "hotspot_id", "left")
        else:
            hotspots = hotspots.withColumn(name, F.lit(None).cast("string"))
    return hotspots.select(
        "hotspot_id",
        "centroid_lat",
        "centroid_lon",
        "h3_cell",
        "cluster_label",
        "member_count",
        "police_station",
    )


def hotspots_from_clusters(
    labelled: DataFrame, bbox: BoundingBox = BoundingBox()
) -> DataFrame:
    """One hotspot per cluster label, noise left out."""
    return summarise(_groups(by_cluster(labelled)), bbox)


def hotspots_from_cells(celled: DataFrame, bbox: BoundingBox = BoundingBox()) -> DataFrame:
    """One hotspot per occupied cell."""
    return summarise(_groups(by_cell(celled)), bbox)


def build_hotspots(
    events: DataFrame, *, bbox: BoundingBox | None = None, **parameters
) -> DataFrame:
    """Hotspot records by cluster, or by cell when there is no cluster."""
    assigned = assign_hotspots(events, bbox=bbox, **parameters).events
    return summarise(_groups(assigned), bbox or BoundingBox())
