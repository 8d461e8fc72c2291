"""Zones of merged increments against one run, and exchanges that buckets spare."""

import re

import pytest
from pyspark.sql import functions as F

from checks.tables import clean_rows
from geohotspots.operators import clean
from geohotspots.operators.activity import hotspot_activity
from geohotspots.operators.impact import score_impact
from geohotspots.operators.peaks import peak_profiles
from geohotspots.operators.spatial import summarise
from geohotspots.plans import activity_state as state
from geohotspots.plans.zones import derive_tables
from geohotspots.sources.bucketed import read_bucketed, write_bucketed
from geohotspots.sources.published import resolve

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Exchanges by a key; a shuffle that only counts rows of one group has none."""
    return re.findall(r"Exchange hashpartitioning|BroadcastExchange|Exchange rangepartitioning", plan(df))


@pytest.fixture(scope="module")
def events(spark):
    rows_ = clean_rows(spark, SF).withColumn("day", F.to_date("created_local"))
    return state.cell_hotspots(rows_).persist()


@pytest.fixture(scope="module")
def folder(spark, events, tmp_path_factory):
    """Three increments that share hotspots, dates and hours."""
    path = str(tmp_path_factory.mktemp("activity"))
    for no in range(3):
        part = events.filter(F.col("read_order") % 3 == no)
        assert state.add_activity(part, path, f"part-{no}", buckets=5)
    return path


def test_merged_increments_equal_one_run(spark, events, folder):
    merged = state.merged_activity(spark, folder)
    whole = hotspot_activity(events)
    assert merged.dtypes == whole.dtypes
    assert rows(merged) == rows(whole)
    got, want = state.zones_from_state(spark, folder, with_risk=False), derive_tables(whole, with_risk=False)
    assert rows(got.zones) == rows(want.zones) and got.zones.count() > 10
    assert rows(got.windows) == rows(want.windows)


def test_only_the_state_is_read_and_nothing_is_exchanged(spark, folder):
    merged = state.merged_activity(spark, folder)
    assert "events.parquet" not in plan(merged)
    assert exchanges(merged) == []
    assert exchanges(peak_profiles(merged)) == []
    with_off = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in with_off}
    try:
        for k, v in with_off.items():
            spark.conf.set(k, v)
        assert exchanges(summarise(merged)) == []
        scored = score_impact(summarise(merged), merged)
        assert exchanges(scored) == []
        assert "SortMergeJoin" in plan(scored)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_compaction_keeps_sums_and_names(spark, events, tmp_path):
    path = str(tmp_path / "state")
    for no in range(2):
        state.add_activity(events.filter(F.col("read_order") % 2 == no), path, f"part-{no}", buckets=3)
    before = rows(state.merged_activity(spark, path))
    state.compact(spark, path)
    assert rows(state.merged_activity(spark, path)) == before
    assert state.increments(spark, path) == ["part-0", "part-1"]
    assert len(set(resolve(spark, path).values())) == 1
    assert not state.add_activity(events, path, "part-1")
    # A later increment joins the compacted table in its buckets, whatever number it asks for.
    assert state.add_activity(events, path, "again", buckets=7)
    doubled = state.merged_activity(spark, path)
    assert exchanges(doubled) == []
    assert doubled.agg(F.sum("n")).first()[0] == 2 * events.count()


def test_a_failed_increment_leaves_the_state(spark, events, tmp_path):
    path = str(tmp_path / "state")
    state.add_activity(events.limit(50), path, "good", buckets=2)
    before = rows(state.merged_activity(spark, path))
    lost = events.limit(50).withColumn("police_station", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        state.add_activity(lost, path, "bad")
    assert rows(state.merged_activity(spark, path)) == before
    assert state.increments(spark, path) == ["good"]


def test_odd_increments(spark, events, tmp_path):
    path = str(tmp_path / "it's a state")
    with pytest.raises(FileNotFoundError):
        state.merged_activity(spark, path)
    with pytest.raises(ValueError):
        state.add_activity(events, path, "a/b")
    with pytest.raises(ValueError):
        state.add_activity(events, path, "a", buckets=0)
    assert state.add_activity(events.limit(0), path, "none", buckets=2)
    assert state.merged_activity(spark, path).count() == 0
    # Null stations and no station column at all are the same group.
    assert state.add_activity(events.withColumn("police_station", F.lit(None).cast("string")), path, "null")
    assert state.add_activity(events.drop("police_station"), path, "absent")
    merged = state.merged_activity(spark, path)
    one = hotspot_activity(events.drop("police_station"))
    assert merged.count() == one.count()
    assert merged.agg(F.sum("n")).first()[0] == 2 * events.count()


def test_buckets_by_id_spare_the_second_exchange(spark, tmp_path):
    raw = clean_rows(spark, SF).select(F.col("id"), "read_order", "latitude")
    raw = raw.unionByName(raw.withColumn("read_order", F.col("read_order") + 10**6))
    raw = raw.unionByName(raw.limit(3).withColumn("id", F.lit(None).cast("string")))
    path = str(tmp_path / "by id")
    write_bucketed(raw, path, ["id"], 4)
    stored = read_bucketed(spark, [path], "id string, read_order bigint, latitude double", ["id"], 4)
    assert rows(stored) == rows(raw)
    first = clean.dedupe_first(stored)
    assert exchanges(first) == [] and len(exchanges(clean.dedupe_first(raw))) == 1
    assert rows(first) == rows(clean.dedupe_first(raw))
    other = str(tmp_path / "signal")
    write_bucketed(raw.select("id").distinct().withColumn("signal", F.length("id")), other, ["id"], 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(first.join(read_bucketed(spark, [other], "id string, signal int", ["id"], 4), "id")) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
