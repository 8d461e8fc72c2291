"""Zones from partial sums that increments extend; events of earlier days are not read again.

The state folder is a published set (see ``sources.published``) of activity tables, one for
each increment: sums by hotspot, cell, station, local date and hour, in buckets of the hotspot
id. Their counts and sums add up and their maxima are taken over, so the merged table equals
that of one run over all events, and everything a run derives from the activity equals its
tables. Buckets of all increments lie alike: merging them and all measures by hotspot need no
exchange. The size of the state depends on hotspots and time span, not on the number of events.

An increment's events must be new ones (``ingest.accepted_events`` of that increment), and a
hotspot's id must mean the same in all increments. Ids of cells do; those of clusters are
numbered anew by every clustering, so label increments with one clustering or use cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geohotspots.operators.activity import hotspot_activity
from geohotspots.operators.spatial import assign_cells, by_cell
from geohotspots.plans.zones import ZoneTables, derive_tables
from geohotspots.sources.bucketed import read_bucketed, write_bucketed
from geohotspots.sources.published import publish, resolve

KEY = "hotspot_id"
GROUP = (KEY, "cluster_label", "h3_cell", "police_station", "local_date", "hour")
SCHEMA = (
    "hotspot_id string, cluster_label int, h3_cell string, police_station string, local_date date, "
    "hour int, n bigint, sum_lat decimal(28,0), sum_lon decimal(28,0), severity double, near bigint, "
    "last_at timestamp"
)
BUCKETS = 256


def _split(artifact: str) -> tuple[int, str]:
    """Bucket count and increment of an artifact's name, ``<buckets>/<increment>``."""
    buckets, name = artifact.split("/", 1)
    return int(buckets), name


def _paths(spark: SparkSession, state_dir: str) -> dict[str, str]:
    try:
        return resolve(spark, state_dir)
    except FileNotFoundError:
        return {}


def cell_hotspots(events: DataFrame, resolution: int = 9) -> DataFrame:
    """Events with the hotspot of their cell; a caller-supplied ``h3_cell`` column is kept."""
    return by_cell(events if "h3_cell" in events.columns else assign_cells(events, resolution))


def merge_activity(activity: DataFrame) -> DataFrame:
    """Partial sums of several increments to one row per group.

    Null keys count as equal. Sums stay whole numbers, so no order of increments matters.
    """
    return activity.groupBy(*GROUP).agg(
        F.sum("n").alias("n"),
        F.sum("sum_lat").cast("decimal(28,0)").alias("sum_lat"),
        F.sum("sum_lon").cast("decimal(28,0)").alias("sum_lon"),
        F.max("severity").alias("severity"),
        F.sum("near").alias("near"),
        F.max("last_at").alias("last_at"),
    )


def add_activity(assigned: DataFrame, state_dir: str, name: str, buckets: int = BUCKETS) -> bool:
    """Add the activity of events with a ``hotspot_id`` to the state; False if ``name`` is there.

    The first increment settles the number of buckets. One that fails half-way leaves the
    state as it was. An empty increment counts as well. One increment runs at a time.
    """
    if not name or "/" in name:
        raise ValueError("an increment needs a name without a slash")
    if buckets < 1:
        raise ValueError("buckets must be positive")
    spark = assigned.sparkSession
    before = _paths(spark, state_dir)
    if before:
        buckets = _split(next(iter(before)))[0]
    if f"{buckets}/{name}" in before:
        return False

    schema = StructType.fromDDL(SCHEMA)

    def write(folder: str) -> str:
        path = f"{folder}/activity"
        write_bucketed(hotspot_activity(assigned).to(schema), path, [KEY], buckets)
        return path

    publish(spark, state_dir, {n: (lambda _, p=p: p) for n, p in before.items()} | {f"{buckets}/{name}": write})
    return True


def increments(spark: SparkSession, state_dir: str) -> list[str]:
    """Names of the increments in the state, in alphabetical order."""
    return sorted(_split(n)[1] for n in _paths(spark, state_dir))


def merged_activity(spark: SparkSession, state_dir: str) -> DataFrame:
    """Activity of all increments together, still in the buckets of the stored tables."""
    paths = _paths(spark, state_dir)
    if not paths:
        raise FileNotFoundError(f"no activity below {state_dir}")
    buckets = _split(next(iter(paths)))[0]
    # A compacted table stands for several increments under one path.
    return merge_activity(read_bucketed(spark, sorted(set(paths.values())), SCHEMA, [KEY], buckets))


def compact(spark: SparkSession, state_dir: str) -> None:
    """Replace the tables of all increments by one merged table: fewer files, equal sums.

    The names of the increments stay, so none can be added twice. Readers see the tables from
    before or the merged one. Nothing is shuffled, but the whole state is written.
    """
    paths = _paths(spark, state_dir)
    if len(set(paths.values())) < 2:
        return
    buckets = _split(next(iter(paths)))[0]
    merged = merged_activity(spark, state_dir)
    written: list[str] = []

    def write(folder: str) -> str:
        if not written:
            path = f"{folder}/activity"
            write_bucketed(merged, path, [KEY], buckets)
            written.append(path)
        return written[0]

    publish(spark, state_dir, {name: write for name in paths})


def zones_from_state(spark: SparkSession, state_dir: str, **parameters) -> ZoneTables:
    """Hotspots, scores, peaks and ranks from the state alone. ``parameters`` go to
    :func:`geohotspots.plans.zones.derive_tables`; ``assigned`` is None."""
    return derive_tables(merged_activity(spark, state_dir), **parameters)
