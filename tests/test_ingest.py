"""Increments against one run over all rows."""

import pytest
from pyspark.sql import functions as F

from checks import registry
from geohotspots.operators import clean
from geohotspots.plans import ingest
from geohotspots.session import store

RAW = "id string, latitude string, longitude string, created_datetime string, read_order long"
GOOD, TIME = ("13.0", "77.5"), "2024-01-15 09:00:00"
ROWS = [
    ("a", "0", "0", TIME, 0), ("a", *GOOD, TIME, 1), ("b", *GOOD, "bad", 2), (None, *GOOD, TIME, 3),
    ("a", *GOOD, "2024-01-16", 4), ("b", *GOOD, TIME, 5), (None, *GOOD, TIME, 6), ("c", *GOOD, TIME, 7),
    ("c", *GOOD, TIME, 8), ("d", *GOOD, TIME, 9), ("b", *GOOD, TIME, 10), ("e", "x", "77.5", TIME, 11),
]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def state_of(spark, tmp_path, cuts):
    state = str(tmp_path / "state")
    for no, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ROWS)])):
        part = spark.createDataFrame(ROWS[a:b], RAW).repartition(3)
        assert ingest.ingest_increment(part, state, f"day{no}")
    return state


@pytest.mark.parametrize("cuts", [[4], [4, 4, 9]])
def test_increments_equal_one_run(spark, tmp_path, cuts):
    state, whole = state_of(spark, tmp_path, cuts), spark.createDataFrame(ROWS, RAW)
    assert rows(ingest.accepted_events(spark, state)) == rows(clean.clean_events(whole))
    assert rows(ingest.accepted_report(spark, state)) == rows(clean.ingestion_report(whole))
    assert ingest.increments(spark, state) == [f"day{n}" for n in range(len(cuts) + 1)]


def test_an_increment_counts_once(spark, tmp_path):
    state = state_of(spark, tmp_path, [4])
    before = rows(ingest.accepted_events(spark, state))
    again = spark.createDataFrame([("z", *GOOD, TIME, 0)], RAW)
    assert not ingest.ingest_increment(again, state, "day1")
    assert rows(ingest.accepted_events(spark, state)) == before
    assert {r["id"] for r in ingest.accepted_events(spark, state, ["day1"]).collect()} == {"b", "c", "d"}


def test_a_failed_increment_leaves_the_state(spark, tmp_path):
    state = state_of(spark, tmp_path, [4])
    before = rows(ingest.accepted_events(spark, state)), rows(ingest.accepted_report(spark, state))
    fails = F.when(F.col("id") == "y", F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    broken = spark.createDataFrame([("y", *GOOD, TIME, 0), ("x", *GOOD, TIME, 1)], RAW).withColumn("id", fails)
    with pytest.raises(Exception, match="lost"):
        ingest.ingest_increment(broken, state, "day2")
    assert before == (rows(ingest.accepted_events(spark, state)), rows(ingest.accepted_report(spark, state)))
    assert ingest.ingest_increment(spark.createDataFrame([("x", *GOOD, TIME, 1)], RAW), state, "day2")
    assert "x" in {r["id"] for r in ingest.accepted_events(spark, state).collect()}


def test_odd_increments(spark, tmp_path):
    state = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        ingest.accepted_events(spark, state)
    with pytest.raises(ValueError):
        ingest.ingest_increment(spark.createDataFrame(ROWS, RAW), state, "a/b")
    empty = spark.createDataFrame([], RAW)
    assert ingest.ingest_increment(empty, state, "none") and ingest.accepted_events(spark, state).count() == 0
    wider = spark.createDataFrame(ROWS, RAW).withColumn("note", F.lit("n"))
    assert ingest.ingest_increment(wider, state, "wide")
    events = ingest.accepted_events(spark, state)
    assert events.filter("note = 'n'").count() == events.count() > 0


def test_old_ids_are_not_shuffled_for_a_small_increment(spark, tmp_path):
    state = state_of(spark, tmp_path, [4])
    old = ingest.accepted_events(spark, state)
    fresh = clean.clean_events(spark.createDataFrame(ROWS[:4], RAW))
    plan = ingest._unseen(fresh, old)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_layouts_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    events = spark.range(3000).withColumnRenamed("id", "event_id")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(registry, "_scratch", lambda t, name: f"{tmp_path}/{name}")
    row = registry.QUERIES["scan_csv_layouts"](spark, str(tmp_path)).first()
    assert (row["total_rows_read"], row["malformed_row"]) == (9000, 3000)
    assert len(list((tmp_path / "layouts.csv").glob("part-*"))) > 1


def test_ids_seen_before_do_not_shuffle_the_increment(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(ingest, "store", lambda df: stored.append(store(df)) or stored[-1])
    raw = spark.sql(
        "select cast(if(id = 7, null, id) as string) as id, id as read_order, '12.95' as latitude, '77.6' as longitude, "
        "'2024-01-15 09:00:00' as created_datetime from range(40)"
    )
    ingest.ingest_increment(raw.filter("read_order < 30"), str(tmp_path), "a")
    ingest.ingest_increment(raw.filter("read_order >= 20 or read_order = 7"), str(tmp_path), "b")
    # The ids met again are stored, not all ids of the increment.
    assert sorted(str(r[0]) for r in stored[-1].collect()) == sorted([*map(str, range(20, 30)), "None"])
    events = ingest.accepted_events(spark, str(tmp_path))
    assert sorted(r["read_order"] for r in events.collect()) == list(range(40))
