"""Impact, peaks, priority and risk on small literal inputs and on the given tables."""

import math
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from checks.tables import clean_rows
from geohotspots.config import ImpactWeights, PriorityConfig, TimeWindow
from geohotspots.operators import (
    activity,
    impact,
    peaks,
    priority,
    reports,
    risk,
    serving,
    spatial,
)
from geohotspots.plans import zones as plan
from geohotspots.session import cut_lineage

SF = "/root/testdata/sf0.001"
EVENT = (
    "id string, hotspot_id string, cluster_label int, h3_cell string, police_station string, "
    "latitude double, longitude double, junction_name string, violation_type array<string>, "
    "created_local timestamp_ntz, created_at timestamp"
)


def events(spark, rows):
    """Rows of (hotspot, local time, tokens, junction)."""
    full = [
        (
            str(i), h, 0, "c", "S", 12.95, 77.6, junction, tokens, local,
            (local - timedelta(minutes=330)).replace(tzinfo=timezone.utc),
        )
        for i, (h, local, tokens, junction) in enumerate(rows)
    ]
    return spark.createDataFrame(full, EVENT)


def at(day, hour):
    return datetime(2024, 1, day, hour, 15)  # 1 January 2024 is a Monday


@pytest.fixture(scope="module")
def tables(spark):
    return plan.zone_tables(cut_lineage(clean_rows(spark, SF)))


def test_components(spark):
    rows = [
        ("a", at(1, 9), ["WRONG PARKING", "DOUBLE PARKING"], None),
        ("a", at(2, 9), ["PARKING NEAR JUNCTION"], " "),
        ("a", at(3, 9), [], "J1"),
        ("b", at(1, 0), ["UNHEARD OF"], None),
        ("b", at(1, 12), None, None),
    ]
    act = activity.hotspot_activity(events(spark, rows))
    got = {r.hotspot_id: r for r in impact.impact_components(act).collect()}
    assert got["a"].severity_component == 0.75 and got["b"].severity_component == 0.3
    assert got["a"].proximity_component == pytest.approx(2 / 3)
    assert got["b"].proximity_component == 0
    assert got["a"].concentration_component == 1
    assert got["b"].concentration_component == pytest.approx(1 - 1 / math.log2(24))


def test_uniform_hours_are_not_concentrated(spark):
    act = activity.hotspot_activity(events(spark, [("a", at(1, h), [], None) for h in range(24)]))
    assert impact.concentration(act).first()[1] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("weights", [(0.9, 0.9, 0.9), (-0.1, 0.6, 0.5), (0.4, 0.4, 0.1)])
def test_weights_are_checked(weights):
    with pytest.raises(ValueError):
        ImpactWeights(*weights).validate()


def test_impact_scale(spark, tables):
    scores = [r.impact_score for r in tables.scored.collect()]
    assert max(scores) == pytest.approx(100) and min(scores) >= 0
    none = tables.scored.filter("false").drop("impact_score", "breakdown")
    assert impact.scale_to_max(none).count() == 0
    zero = tables.scored.withColumn("impact_raw", F.lit(0.0))
    assert {r.impact_score for r in impact.scale_to_max(zero).collect()} == {0.0}


def test_signal_lifts_within_bounds(spark):
    raw = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "hotspot_id string, impact_raw double")
    signal = spark.createDataFrame([("a", 0.5), ("b", 7.0)], "hotspot_id string, signal double")
    got = {r.hotspot_id: r.impact_raw for r in impact.boost_with_signal(raw, signal).collect()}
    assert got == {"a": 0.75, "b": 1.0, "c": 0.5}


def test_profile_with_one_peak_and_without_events(spark):
    rows = [("a", at(5, 22), [], None)] * 3 + [("a", at(5, 23), [], None)] * 4
    act = activity.hotspot_activity(events(spark, rows))
    hotspots = spark.createDataFrame([("a",), ("none",)], "hotspot_id string")
    profiles = peaks.peak_profiles(act, hotspots)
    got = {r.hotspot_id: r for r in profiles.collect()}
    assert got["a"].total_events == 7 and got["none"].total_events == 0
    assert max(got["a"].intensity) == 1 and min(got["a"].intensity) > 0
    assert set(got["none"].intensity) == {1.0}
    windows = peaks.top_peaks(profiles, top_k=3).orderBy("hotspot_id", "peak_rank").collect()
    first = windows[0]
    assert (first.day_of_week, first.start_hour, first.end_hour) == (4, 22, 23)
    assert [(w.day_of_week, w.start_hour, w.end_hour) for w in windows[1:]] == [
        (0, 0, 23), (1, 0, 23), (2, 0, 23),
    ]


@pytest.mark.parametrize("k", [0, 169, 1.0, True])
def test_top_k_is_checked(spark, k, tables):
    with pytest.raises(ValueError):
        peaks.top_peaks(tables.profiles, top_k=k)


def test_recency(spark):
    as_of = datetime(2024, 1, 22, 12, tzinfo=timezone.utc)
    rows = [(as_of,), (as_of - timedelta(days=21),), (as_of - timedelta(days=10**4),)]
    df = spark.createDataFrame(rows, "t timestamp")
    decay = priority.recency_decay(F.col("t"), priority.instant(as_of), 21)
    got = [r[0] for r in df.orderBy(F.col("t").desc()).select(decay).collect()]
    assert got[:2] == [1.0, 0.5] and got[2] == 1e-12
    with pytest.raises(Exception, match="later than"):
        late = spark.createDataFrame([(as_of + timedelta(seconds=1),)], "t timestamp")
        late.select(decay).collect()
    with pytest.raises(ValueError):
        PriorityConfig(recency_halflife_days=0).validate()


def test_ranks_tie_on_text_order_and_are_contiguous(spark):
    rows = [(f"dbscan-{i}", "A" if i % 3 else None, 50.0) for i in range(12)] + [("dbscan-99", "A", 60.0)]
    zones = spark.createDataFrame(rows, "hotspot_id string, police_station string, priority_score double")
    for parts in (1, 7):
        ranked = priority.rank_in_station(priority.rank_global(zones.repartition(parts))).collect()
        order = sorted(rows, key=lambda r: (-r[2], r[0]))
        assert {r.hotspot_id: r.global_rank for r in ranked} == {r[0]: i + 1 for i, r in enumerate(order)}
        for station in ("A", None):
            ids = [r[0] for r in order if r[1] == station]
            got = {r.hotspot_id: r.station_rank for r in ranked if r.police_station == station}
            assert got == {h: i + 1 for i, h in enumerate(ids)}


def test_collapsed_ranges_become_one_and_zero_factors_win(spark):
    rows = [("a", at(1, 9), ["WRONG PARKING"], None), ("b", at(1, 9), ["WRONG PARKING"], None)]
    act = activity.hotspot_activity(events(spark, rows))
    scored = impact.score_impact(spatial.summarise(act), act)
    got = priority.priority_factors(scored, act).collect()
    assert all((r.frequency, r.persistence, r.recency) == (1, 1, 1) for r in got)
    assert all(r.priority_score == pytest.approx(100) for r in got)
    zero = spark.createDataFrame([(0.0, 1.0, 1.0, 1.0)], ["impact", "frequency", "persistence", "recency"])
    assert zero.select(priority.geometric_mean()).first()[0] == 0


def test_run_invariants(tables):
    zones = tables.zones.collect()
    assert tables.used_dbscan and len(zones) == 15
    assert sorted(z.global_rank for z in zones) == list(range(1, 16))
    for z in zones:
        for v in (z.impact, z.frequency, z.persistence, z.recency):
            assert 0 <= v <= 1
        assert 0 <= z.priority_score <= 100 and len(z.peak_windows) <= 3
        assert all(0 <= w.start_hour <= w.end_hour <= 23 for w in z.peak_windows)
        assert z.risk_tier in ("HIGH", "MEDIUM", "LOW") and 0 <= z.anomaly_score <= 1
    counts = tables.assigned.groupBy("hotspot_id").count().filter("hotspot_id is not null")
    by_id = {r.hotspot_id: r["count"] for r in counts.collect()}
    assert by_id == {r.hotspot_id: r.member_count for r in tables.scored.collect()}


def test_run_does_not_depend_on_partitioning(spark, tables):
    again = plan.zone_tables(clean_rows(spark, SF).repartition(3))
    columns = ["hotspot_id", "global_rank", "station_rank", "risk_tier", "anomaly_score"]
    assert sorted(map(tuple, again.zones.select(columns).collect())) == sorted(
        map(tuple, tables.zones.select(columns).collect())
    )


FEATURES = "hotspot_id string, " + ", ".join(f"{c} double" for c in risk.FEATURES)


def features(spark, n, outlier=False):
    rows = [(f"h{i:04d}", 50.0 + i % 5, 0.5, 0.3 + (i % 7) / 100, 0.2, 3.0) for i in range(n)]
    if outlier:
        rows.append(("odd", 99.0, 0.5, 0.99, 0.2, 9.0))
    return spark.createDataFrame(rows, FEATURES)


def test_planted_outlier_is_most_anomalous_whatever_the_partitions(spark):
    runs = []
    for parts in (1, 6):
        df = risk.standardise(features(spark, 400, outlier=True).repartition(parts))
        runs.append({r.hotspot_id: r.anomaly_score for r in risk.anomaly_scores(df).collect()})
    assert runs[0] == runs[1] and len(runs[0]) == 401
    assert runs[0]["odd"] == 1.0 and sorted(runs[0].values())[-2] < 1.0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_hotspots(spark, n):
    df = features(spark, n)
    std = risk.standardise(df)
    assert risk.anomaly_scores(std).count() == n
    tiers = [r.risk_tier for r in risk.risk_tiers(df, std).orderBy("hotspot_id").collect()]
    assert tiers == [[], ["HIGH"], ["LOW", "HIGH"]][n]


def test_identical_hotspots_fall_back_to_quantiles(spark):
    df = spark.createDataFrame([(h, 50.0, 0.5, 0.5, 0.5, 3.0) for h in "abc"], FEATURES)
    std = risk.standardise(df)
    assert {r.anomaly_score for r in risk.anomaly_scores(std).collect()} == {0.0}
    assert {r.risk_tier for r in risk.risk_tiers(df, std).collect()} == {"HIGH"}


def test_tiers_follow_mean_impact(spark, tables):
    means = tables.scored.groupBy("risk_tier").agg(F.avg("impact_score").alias("m")).collect()
    by_tier = {r.risk_tier: r.m for r in means}
    assert by_tier["HIGH"] > by_tier["MEDIUM"] > by_tier["LOW"]


def test_missing_risk_is_unknown(spark):
    zones = spark.createDataFrame([("a",)], "hotspot_id string")
    none = spark.createDataFrame([], "hotspot_id string, risk_tier string, anomaly_score double")
    row = risk.attach_risk(zones, none).first()
    assert (row.risk_tier, row.anomaly_score) == ("UNKNOWN", 0.5)


def test_time_filter(spark):
    windows = spark.createDataFrame(
        [("a", 5, 8, 11), ("b", 6, 9, 9)], "hotspot_id string, day_of_week int, start_hour int, end_hour int"
    )
    def ids(when):
        return sorted(r[0] for r in serving.active_hotspots(windows, when).collect())

    assert serving.active_hotspots(windows, TimeWindow()) is None
    assert ids(TimeWindow(hour=9)) == ["a", "b"] and ids(TimeWindow(day_of_week=6)) == ["b"]
    assert ids(TimeWindow(hour=11, day_of_week=6)) == []


def test_histogram_of_one_value(spark):
    rows = reports.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", 4).orderBy("bin")
    got = [(r.bin_start, r.n) for r in rows.collect()]
    assert got == [(4.5, 0), (4.75, 0), (5.0, 3), (5.25, 0)]


def test_peak_windows_are_attached_in_rank_order(tables):
    ranked = {}
    for w in tables.windows.orderBy("peak_rank").collect():
        ranked.setdefault(w.hotspot_id, []).append((w.day_of_week, w.start_hour))
    for z in tables.zones.collect():
        assert [(w.day_of_week, w.start_hour) for w in z.peak_windows] == ranked.get(z.hotspot_id, [])


def test_sample_never_shows_private_columns(spark):
    rows = serving.sample_violations(clean_rows(spark, SF), 2)
    assert not {"id", "vehicle_number"} & set(rows.columns)
    assert rows.groupBy("police_station").count().agg(F.max("count")).first()[0] == 2


def test_first_day_is_monday(spark):
    assert date(2024, 1, 1).weekday() == 0
    act = activity.hotspot_activity(events(spark, [("a", at(1, 9), [], None)]))
    assert peaks.slot_counts(act).first()["slot"] == 9


def test_risk_tiers_repeat_over_many_rows(spark):
    columns = ["hotspot_id", *risk.FEATURES]
    df = spark.range(6000).select(
        F.format_string("hotspot_%05d", F.col("id")).alias("hotspot_id"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 10_000.0).alias(c) for i, c in enumerate(risk.FEATURES)],
    )

    def tiers(parts):
        rows = df.repartition(parts).select(*columns)
        return {r.hotspot_id: r.risk_tier for r in risk.risk_tiers(rows, risk.standardise(rows), restarts=2).collect()}

    first = tiers(7)
    assert len(set(first.values())) == 3
    assert tiers(7) == first and tiers(1) == first and tiers(4) == first
