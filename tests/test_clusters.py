"""Density clustering against a direct implementation on adversarial layouts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geohotspots.config import BoundingBox
from geohotspots.functions.geo import haversine_m
from geohotspots.operators import dbscan, ordering, spatial
from geohotspots.operators.components import connected_components

METRE = 1.0 / 111_194.93


def brute_force(points, eps, min_samples):
    """Labels by definition: components of core points, smallest label for borders."""
    lat, lon = np.radians(np.array(points)).T
    a = (
        np.sin((lat[:, None] - lat) / 2) ** 2
        + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    )
    near = 2 * 6_371_000 * np.arcsin(np.sqrt(a)) <= eps
    core = near.sum(axis=1) >= min_samples
    labels = np.full(len(points), -1)
    label = 0
    for start in range(len(points)):
        if not core[start] or labels[start] >= 0:
            continue
        stack = [start]
        labels[start] = label
        while stack:
            for q in np.flatnonzero(near[stack.pop()] & core & (labels < 0)):
                labels[q] = label
                stack.append(q)
        label += 1
    for p in np.flatnonzero(~core):
        around = labels[near[p] & core]
        if len(around):
            labels[p] = around.min()
    return labels.tolist()


def spark_labels(spark, points, eps, min_samples, parts=3, **kwargs):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "read_order long, latitude double, longitude double")
    out = dbscan.cluster_dbscan(
        df.repartition(parts), eps_m=eps, min_samples=min_samples, **kwargs
    )
    got = {r.read_order: r.cluster_label for r in out.collect()}
    return [got[i] for i in range(len(points))]


def layout(kind):
    rng = np.random.default_rng(7)
    base = np.array([12.95, 77.6])
    if kind == "blobs and noise":
        centres = base + rng.uniform(-0.01, 0.01, (6, 2))
        blobs = np.concatenate([c + rng.normal(0, 25 * METRE, (40, 2)) for c in centres])
        return np.concatenate([blobs, base + rng.uniform(-0.012, 0.012, (80, 2))])
    if kind == "long chain":
        steps = np.arange(150)
        line = base + np.stack([steps * 30 * METRE, (steps % 7) * 9 * METRE], axis=1)
        return rng.permutation(line)
    if kind == "one hot coordinate":
        hot = np.repeat(base[None], 120, axis=0)
        return np.concatenate([hot, base + rng.uniform(-0.002, 0.002, (120, 2))])
    if kind == "rings that nearly touch":
        turns = rng.uniform(0, 2 * math.pi, 300)
        gap = np.where(np.arange(300) % 2 == 0, -1.0, 1.0) * 88
        ring = np.stack([np.cos(turns) * 50, np.sin(turns) * 50 + gap], axis=1)
        return base + ring * METRE
    raise AssertionError(kind)


@pytest.mark.parametrize(
    "kind", ["blobs and noise", "long chain", "one hot coordinate", "rings that nearly touch"]
)
@pytest.mark.parametrize("min_samples", [1, 4, 15])
def test_labels_equal_brute_force(spark, kind, min_samples):
    points = layout(kind)
    expected = brute_force(points, 75.0, min_samples)
    assert spark_labels(spark, points, 75.0, min_samples) == expected


def test_crowded_sub_cells_use_salts_and_quartering(spark, monkeypatch):
    """Tiny limits force every split: salted probes and several quartering levels."""
    monkeypatch.setattr(dbscan, "SALT_POINTS", 5)
    monkeypatch.setattr(dbscan, "EXACT_PAIRS", 2)
    rng = np.random.default_rng(3)
    base = np.array([12.95, 77.6])
    blobs = [base + [0, i * 105 * METRE] + rng.uniform(-1, 1, (60, 2)) * 24 * METRE for i in range(5)]
    points = np.concatenate([*blobs, base + rng.uniform(-0.003, 0.006, (60, 2))])
    for min_samples in (5, 20):
        expected = brute_force(points, 75.0, min_samples)
        assert spark_labels(spark, points, 75.0, min_samples) == expected


def test_partitioning_does_not_matter(spark):
    points = layout("blobs and noise")
    runs = [spark_labels(spark, points, 75.0, 6, parts) for parts in (1, 7)]
    assert runs[0] == runs[1]


def test_known_box_gives_the_same_labels(spark):
    points = layout("blobs and noise")
    free = spark_labels(spark, points, 120.0, 6)
    assert spark_labels(spark, points, 120.0, 6, bbox=BoundingBox()) == free


@pytest.mark.parametrize("eps", [-1, 0, 5001, True, "75"])
def test_eps_is_checked(spark, eps):
    with pytest.raises(ValueError):
        dbscan.check_parameters(eps, 5)


@pytest.mark.parametrize("min_samples", [0, 1.5, True])
def test_min_samples_is_checked(spark, min_samples):
    with pytest.raises(ValueError):
        dbscan.check_parameters(75.0, min_samples)


EVENTS = "id string, read_order long, latitude double, longitude double, police_station string"


def test_all_noise_falls_back_to_cells(spark):
    rows = [("a", 0, 12.95, 77.6, "S"), ("b", 1, 12.9501, 77.6, "S")]
    events = spark.createDataFrame(rows, EVENTS)
    assigned = spatial.assign_hotspots(events, min_samples=500)
    assert not assigned.used_dbscan
    built = spatial.build_hotspots(events, min_samples=500).collect()
    assert all(h.hotspot_id.startswith("h3-") and h.cluster_label is None for h in built)
    assert sum(h.member_count for h in built) == 2


def test_no_events_give_no_hotspots(spark):
    events = spark.createDataFrame([], EVENTS)
    assert dbscan.cluster_dbscan(events).count() == 0
    assert spatial.build_hotspots(events).count() == 0


def test_hex_resolution_is_checked(spark):
    events = spark.createDataFrame([("a", 0, 12.95, 77.6, "S")], EVENTS)
    for good in (0, 15):
        assert spatial.assign_cells(events, good).count() == 1
    for bad in (-1, 16, 99, 9.0, True):
        with pytest.raises(ValueError):
            spatial.assign_cells(events, bad)


def test_hex_centre_is_near(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(12.7, 13.2, 200), rng.uniform(77.3, 77.9, 200))]
    events = spark.createDataFrame(rows, "latitude double, longitude double")
    edge, ky = 200.786, math.radians(1) * 6_371_000
    kx = ky * math.cos(math.radians(12.95))
    for r in spatial.assign_cells(events, 9).collect():
        q, s = map(int, r.h3_cell.removeprefix("hex9_").split("_"))
        x, y = edge * math.sqrt(3) * (q + s / 2), edge * 1.5 * s
        away = math.hypot((r.longitude - 77.6) * kx - x, (r.latitude - 12.95) * ky - y)
        assert away <= edge * (1 + 1e-9)


def test_modal_value_ignores_null_texts_and_prefers_the_smaller(spark):
    rows = [("h", v) for v in ("b", "a", "b", "a", "", "NULL", "", "", None, "nat")] + [("e", "na")]
    df = spark.createDataFrame(rows, "hotspot_id string, v string")
    assert [tuple(r) for r in spatial.modal_value(df, ["hotspot_id"], "v").collect()] == [("h", "a")]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (20, 20)] + [(100 + i, 101 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert {got[n] for n in (1, 2, 3)} == {1} and {got[n] for n in (6, 7, 8, 9)} == {6}
    assert {got[n] for n in range(100, 161)} == {100}


def test_haversine(spark):
    row = spark.range(1).select(
        haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")
    ).first()
    assert row.d == pytest.approx(math.radians(1) * 6_371_000)


def test_positions_and_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 20, 300), np.zeros(200)]).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    placed = ordering.global_position(df, [F.col("v").desc(), F.col("i").asc()], "p").collect()
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    assert {r.i: r.p for r in placed} == {i: p + 1 for p, i in enumerate(order)}
    probs = [0.0, 1 / 3, 0.5, 2 / 3, 0.975, 1.0]
    got = [r.quantile for r in ordering.exact_quantiles(df, "v", probs).orderBy("prob_no").collect()]
    assert got == pytest.approx(list(np.quantile(values, probs)))


@pytest.mark.parametrize("crowded", [256, 3])
def test_neighbours_are_counted_once_a_point(spark, monkeypatch, crowded):
    """One row a point, not one for each sub-cell in reach, whether targets go by tile or by salt."""
    monkeypatch.setattr(dbscan, "CROWDED_POINTS", crowded)
    monkeypatch.setattr(dbscan, "SALT_POINTS", 2)
    rng = np.random.default_rng(3)
    points = np.array([12.95, 77.6]) + rng.uniform(0, 1400 * METRE, (700, 2))
    points = np.concatenate([points, [12.95, 77.6] + rng.uniform(0, 30 * METRE, (40, 2))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    events = spark.createDataFrame(rows, "read_order long, latitude double, longitude double")
    grid = dbscan.grid_for(events, 75.0, None)
    sized, cells = dbscan.density(events, grid, 6, "read_order")
    got = dbscan.sparse_neighbour_counts(sized, cells, grid).collect()
    lat, lon = np.radians(points).T
    a = (
        np.sin((lat[:, None] - lat) / 2) ** 2
        + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    )
    near = (2 * 6_371_000 * np.arcsin(np.sqrt(a)) <= 75.0).sum(axis=1)
    assert len(got) == len({r.first_order for r in got}) > 300
    assert all(r.hits == near[r.first_order] for r in got)
    expected = brute_force(points, 75.0, 6)
    assert spark_labels(spark, points, 75.0, 6) == expected
