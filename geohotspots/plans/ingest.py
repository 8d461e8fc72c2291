"""Ingest by increments: each one joins what earlier ones accepted, and nothing is read twice.

The state folder is a published set (see ``sources.published``) that every increment extends by
its own accepted events and its own report. An increment counts once its line stands in the
manifest: one that fails half-way leaves the state as it was and may be run again under the
same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geohotspots.config import LOCAL_TZ, BoundingBox
from geohotspots.functions.timestamps import TIMESTAMP_FORMATS
from geohotspots.operators import clean
from geohotspots.session import store
from geohotspots.sources.published import publish, resolve

_EVENTS, _REPORT = "events/", "report/"


def _paths(spark: SparkSession, state_dir: str) -> dict[str, str]:
    try:
        return resolve(spark, state_dir)
    except FileNotFoundError:
        return {}


def _union(spark: SparkSession, paths: dict[str, str], kind: str) -> DataFrame:
    tables = [spark.read.parquet(path) for name, path in sorted(paths.items()) if name.startswith(kind)]
    if not tables:
        raise FileNotFoundError("no increment has been ingested")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _unseen(fresh: DataFrame, accepted: DataFrame | None, valid: DataFrame | None = None) -> DataFrame:
    """Rows of ``fresh`` whose id no accepted event has; null ids count as equal.

    Of the accepted events only the ids are read, and first reduced to those that occur in the
    increment. With ``valid``, the stored rows that ``fresh`` is made of, its ids need not be found
    first, and the ids met again are stored: Spark broadcasts them where they are few.
    """
    if accepted is None:
        return fresh
    ids = store(fresh.select("id")) if valid is None else valid.select("id")
    old = accepted.select(F.col("id").alias("old_id"))
    repeated = old.join(ids, F.col("old_id").eqNullSafe(F.col("id")), "left_semi")
    if valid is not None:
        repeated = store(repeated)
    return fresh.join(repeated, F.col("id").eqNullSafe(F.col("old_id")), "left_anti")


def ingest_increment(
    raw: DataFrame,
    state_dir: str,
    name: str,
    *,
    order_by: str | list[str] = "read_order",
    tz: str = LOCAL_TZ,
    bbox: BoundingBox = BoundingBox(),
    formats: Sequence[str] = TIMESTAMP_FORMATS,
) -> bool:
    """Clean ``raw`` and add its events with new ids to the state; False if ``name`` is there.

    Increments are taken in the order in which they are ingested: an id that an earlier one
    accepted is a duplicate in all later ones, and of equal ids in one increment the first in
    ``order_by`` stays. So increments together keep the rows that one run over all of them in
    that order keeps. One increment runs at a time.
    """
    if not name or "/" in name:
        raise ValueError("an increment needs a name without a slash")
    spark = raw.sparkSession
    before = _paths(spark, state_dir)
    if _EVENTS + name in before:
        return False
    # Parsed once; the report counts the same rows.
    tagged = store(clean.tag_rejects(raw, tz=tz, bbox=bbox, formats=formats))
    valid = tagged.filter(F.col("reject_reason").isNull())
    fresh = clean.accept(tagged, order_by=order_by)
    known = [p for p in before if p.startswith(_EVENTS)]
    accepted = _union(spark, before, _EVENTS) if known else None

    def events(folder: str) -> str:
        path = f"{folder}/events"
        _unseen(fresh, accepted, valid).write.parquet(path)
        return path

    def report(folder: str) -> str:
        path = f"{folder}/report"
        kept = spark.read.parquet(f"{folder}/events")
        clean.ingestion_report(tagged, cleaned=kept).write.parquet(path)
        return path

    earlier = {n: (lambda _, p=p: p) for n, p in before.items()}
    publish(spark, state_dir, earlier | {_EVENTS + name: events, _REPORT + name: report})
    return True


def accepted_events(spark: SparkSession, state_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Events of all increments, or of those in ``names`` (what came since the last run, say)."""
    paths = _paths(spark, state_dir)
    if names is not None:
        paths = {_EVENTS + n: paths[_EVENTS + n] for n in names}
    return _union(spark, paths, _EVENTS)


def accepted_report(spark: SparkSession, state_dir: str) -> DataFrame:
    """``metric, n`` of all increments together: every count of a report is additive."""
    rows = _union(spark, _paths(spark, state_dir), _REPORT)
    return rows.groupBy("metric").agg(F.sum("n").alias("n"))


def increments(spark: SparkSession, state_dir: str) -> list[str]:
    """Names of the increments in the state, in alphabetical order."""
    return sorted(n.removeprefix(_EVENTS) for n in _paths(spark, state_dir) if n.startswith(_EVENTS))
