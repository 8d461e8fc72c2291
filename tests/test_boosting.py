"""Poisson trees against plain split search, planted effects and the regression."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from geohotspots.operators import boosting, evaluate, forecast, ordering, panel
from geohotspots.operators.boosting import Boosting, fit_forests, fit_trees

ONE = dict(trees=1, learning_rate=1.0, feature_share=1.0)


def plain_bins(values, bins):
    order = sorted(values)
    ends = sorted({order[(i * len(order)) // bins] for i in range(1, bins)} | {order[-1]})[:-1]
    return ends


def plain_split(rows, labels, numbers, categories, s):
    """Best gain over all cuts of numbers and all ends of the order of categories."""
    n, total = len(rows), sum(labels)
    p = round(math.exp(math.log((total + 0.5) / n)) * 1_000_000) / 1_000_000

    def gain(y, m, smooth):
        step = math.log((y + smooth) / (m * p + smooth))
        return y * step - m * p * (math.exp(step) - 1)

    best = (0.0, None, None)
    for c in numbers + categories:
        smooth = s.smoothing if c in numbers else s.category_smoothing
        if c in numbers:
            sets = [(cut, [r[c] <= cut for r in rows]) for cut in plain_bins([r[c] for r in rows], s.bins)]
        else:
            y, m = {}, {}
            for r, label in zip(rows, labels):
                y[r[c]] = y.get(r[c], 0) + label
                m[r[c]] = m.get(r[c], 0) + 1
            ratio = {v: y[v] / (m[v] * p + smooth) for v in y}
            sets = []
            for sign in (1, -1):
                order = sorted(y, key=lambda v: (sign * ratio[v], v))
                for k in range(1, min(len(order), s.max_levels) + 1):
                    chosen = set(order[:k])
                    sets.append((chosen, [r[c] in chosen for r in rows]))
        for what, left in sets:
            m_left, y_left = sum(left), sum(x for x, side in zip(labels, left) if side)
            if min(m_left, n - m_left) < s.min_rows:
                continue
            g = gain(y_left, m_left, smooth) + gain(total - y_left, n - m_left, smooth) - gain(total, n, smooth)
            if g > best[0] + 1e-5:
                best = (g, c, what)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_first_split_is_the_best_of_all(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [
        {"a": float(np.round(rng.normal(), 1)), "b": int(rng.integers(0, 200)), "c": int(rng.integers(0, 12))}
        for _ in range(400)
    ]
    effect = [(lambda r: r["a"] > 0.3), (lambda r: r["b"] % 200 < 60), (lambda r: r["c"] in (2, 5, 7)), (lambda r: False)][seed]
    labels = [int(rng.poisson(4 if effect(r) else 1.5)) for r in rows]
    df = spark.createDataFrame([(r["a"], r["b"], r["c"], y) for r, y in zip(rows, labels)], "a double, b long, c int, count long")
    s = Boosting(**ONE, depth=1, min_rows=20, bins=16)
    model = fit_trees(df, ("a", "b", "c"), ("c",), settings=s)
    gain, feature, what = plain_split(rows, labels, ["a", "b"], ["c"], s)
    root = model.trees[0][0]
    assert model.features[root["feature"]] == feature
    assert root["gain"] == pytest.approx(gain, abs=2e-5)
    if feature == "c":
        # Both sides of a split are the same split.
        assert set(root["levels"]) in (what, set(range(12)) - what)
    else:
        assert root["cut"] == what
    # A tree of one split repeats the (smoothed) sums of its leaves.
    sums = model.transform(df).groupBy("prediction").agg(F.sum("count").alias("y"), F.count("*").alias("n")).collect()
    base = math.exp(model.base)
    smooth = s.category_smoothing if feature == "c" else s.smoothing
    for r in sums:
        assert r.prediction == pytest.approx(base * (r.y + smooth) / (r.n * base + smooth), rel=1e-5)


def test_planted_groups_of_cells_are_one_split(spark):
    rows = [(c, d, 9 if c % 3 == 0 else 1) for c in range(60) for d in range(10)]
    df = spark.createDataFrame(rows, "cell_code int, day int, count int")
    model = fit_trees(df, ("cell_code", "day"), ("cell_code",), settings=Boosting(**ONE, depth=1))
    assert set(model.trees[0][0]["levels"]) == {c for c in range(60) if c % 3 == 0}
    assert model.importance() == {"cell_code": 1.0, "day": 0.0}


def test_partitions_do_not_change_the_model(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal()), int(rng.integers(0, 9)), int(rng.poisson(3))) for _ in range(600)]
    df = spark.createDataFrame(rows, "x double, c int, count int")
    settings = Boosting(trees=10, depth=2, min_rows=20)
    one, seven = (fit_trees(df.repartition(k), ("x", "c"), ("c",), settings=settings) for k in (1, 7))
    assert one == seven and len(one.trees) > boosting.STORED_TREES


def test_settings_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), int(x * 3) % 4, int(rng.poisson(1 + 3 * (x > 0.5)))) for x in rng.random(500)]
    df = spark.createDataFrame(rows, "x double, c int, count int")
    settings = [Boosting(trees=2, depth=1, min_rows=10), Boosting(trees=4, depth=3, learning_rate=0.5, min_rows=40)]
    assert fit_forests(df, ("x", "c"), ("c",), "count", settings) == [
        fit_trees(df, ("x", "c"), ("c",), settings=s) for s in settings
    ]
    with pytest.raises(ValueError, match="bins"):
        fit_forests(df, ("x",), (), "count", [Boosting(bins=4), Boosting(bins=8)])


def test_missing_values_zero_counts_and_empty_tables(spark, tmp_path):
    rows = [(None if i % 4 == 0 else float(i), None if i % 5 == 0 else i % 2, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, c int, count int")
    model = fit_trees(df, ("x", "c"), ("c",), settings=Boosting(trees=2, min_rows=10))
    scored = model.transform(df).collect()
    assert all(r.prediction > 0 for r in scored)
    model.save(spark, f"{tmp_path}/m")
    assert boosting.PoissonTrees.load(spark, f"{tmp_path}/m") == model
    zero = fit_trees(df.withColumn("count", F.lit(0)), ("x",), settings=Boosting(trees=2))
    assert all(0 < r.prediction < 0.01 for r in zero.transform(df).collect())
    none = fit_trees(df.limit(0), ("x", "c"), ("c",))
    assert none.trees == () and none.transform(df).count() == 200


def test_trees_learn_what_the_regression_cannot(spark):
    """Two groups of cells that swap their weekday and weekend demand."""
    rng = np.random.default_rng(4)
    start = date(2024, 1, 1)
    days = []
    for cell in range(16):
        for d in range(70):
            day = start + timedelta(days=d)
            high = (day.weekday() >= 5) == (cell % 2 == 0)
            days.append((f"c{cell:02d}", day, int(rng.poisson(20 if high else 3))))
    daily = spark.createDataFrame(days, "h3_cell string, date date, count long")
    rows = panel.training_rows(panel.add_calendar(panel.add_rolling(panel.add_lags(panel.zero_fill(daily)))))
    rows = panel.add_cell_code(rows, panel.cell_codes(daily))
    train, test = panel.time_split(rows, 14)
    trees = forecast.fit_demand(train, "trees", {"trees": 8, "learning_rate": 0.5, "min_rows": 20})
    glm = forecast.fit_demand(train)
    mae = {
        name: evaluate.naive_baseline(forecast.predict_counts(test, model)).first()
        for name, model in (("trees", trees), ("glm", glm))
    }
    assert mae["trees"].mae < 0.9 * mae["glm"].mae and mae["trees"].mae < mae["trees"].baseline_mae
    shares = {r.feature: r.importance for r in forecast.feature_importance(trees, train).collect()}
    assert set(shares) == set(panel.FEATURES) and sum(shares.values()) == pytest.approx(1)
    sweep = evaluate.grid_sweep(train, test, "trees", [{"trees": 1, "depth": 1}, {"trees": 4, "learning_rate": 0.5, "min_rows": 20}])
    assert sweep.best["trees"] == 4 and sweep.tried[1][1] < sweep.tried[0][1]


NASTY = [
    [1.0], [2.0, 2.0, 2.0], [-1e308, 1e308, 0.0, 5e-324, -5e-324, 1e-300],
    [float(i % 7) for i in range(500)], [math.exp(i / 3) for i in range(-300, 300)],
    [float("inf"), 1.0, 2.0, float("-inf")], [random.Random(3).gauss(0, 1) for _ in range(700)],
]


@pytest.mark.parametrize("values", NASTY)
def test_order_statistics(spark, values):
    rows = [(v, -v) for v in values] + [(None, None), (float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    found = ordering.order_statistics(df, ["a", "b"], lambda n: list(range(0, n, max(n // 50, 1))))
    assert found == {
        "a": sorted(values)[:: max(len(values) // 50, 1)], "b": sorted(-v for v in values)[:: max(len(values) // 50, 1)],
    }


def test_quantiles_equal_percentile_without_a_sort(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.lognormal(0, 3, 1001)], "v double")
    probabilities = [0.0, 0.25, 1 / 3, 0.5, 0.975, 1.0]
    got = [r["quantile"] for r in ordering.exact_quantiles(df, "v", probabilities).orderBy("prob_no").collect()]
    wanted = df.selectExpr(f"percentile(v, array({', '.join(map(repr, probabilities))})) AS p").first().p
    assert got == pytest.approx(wanted, rel=1e-12)
    assert ordering.exact_quantiles(df.limit(0), "v", probabilities).count() == 0
