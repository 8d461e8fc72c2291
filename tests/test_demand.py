"""Panel, forecast and evaluation."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.tables import clean_rows
from geohotspots.operators import evaluate, forecast, panel, spatial
from geohotspots.plans import forecasting
from geohotspots.session import cut_lineage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def celled(spark):
    return cut_lineage(spatial.assign_cells(clean_rows(spark, SF), 8))


def daily(spark, rows):
    return spark.createDataFrame(
        [(c, date(2024, 1, 1) + timedelta(days=d), n) for c, d, n in rows],
        "h3_cell string, date date, count long",
    )


def test_zero_fill_covers_the_common_range(spark):
    filled = panel.zero_fill(daily(spark, [("a", 0, 2), ("a", 3, 1), ("b", 5, 4)])).collect()
    assert len(filled) == 12 and sum(r["count"] for r in filled) == 7
    a = {r.date.day: r["count"] for r in filled if r.h3_cell == "a"}
    assert a == {1: 2, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}


def test_features_look_back_only_and_stay_inside_the_cell(spark):
    counts = {"a": [5, 1, 4, 2, 8, 3, 9, 7, 6, 2], "b": [100] * 10}
    rows = [(c, d, n) for c, ns in counts.items() for d, n in enumerate(ns)]
    built = panel.add_rolling(panel.add_lags(panel.zero_fill(daily(spark, rows)))).collect()
    for r in built:
        past = counts[r.h3_cell][: r.date.day - 1]
        assert r.lag_1 == (past[-1] if past else None)
        assert r.lag_7 == (past[-7] if len(past) >= 7 else None)
        for name, k in (("roll_7_mean", 7), ("roll_14_mean", 14), ("expanding_mean", 99)):
            got = r[name]
            assert got == pytest.approx(np.mean(past[-k:])) if past else got is None


def test_unknown_cell_code(spark):
    codes = panel.cell_codes(daily(spark, [("b", 0, 1), ("a", 0, 1)]))
    rows = panel.add_cell_code(daily(spark, [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)]), codes)
    assert {r.h3_cell: r.cell_code for r in rows.collect()} == {"a": 0, "b": 1, "c": -1}


def test_recursive_forecast_matches_a_plain_loop(spark):
    counts = {"a": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0], "b": [2.0, 7.0]}
    history = daily(spark, [(c, d, int(n)) for c, ns in counts.items() for d, n in enumerate(ns)])
    cells = spark.createDataFrame(
        [("a", 0, 1.0, 2.0, "S"), ("b", 1, 1.0, 2.0, "S")],
        "h3_cell string, cell_code int, centroid_lat double, centroid_lon double, police_station string",
    )

    def predict(rows):
        return rows.withColumn(
            "prediction",
            F.col("lag_1") * 0.2 + F.col("lag_7") * 0.1 + F.col("roll_7_mean") * 0.3
            + F.col("roll_14_mean") * 0.2 + F.col("expanding_mean") * 0.1 + F.col("dow") - 3,
        )

    got = forecast.forecast_days(history, cells, date(2024, 1, 9), predict, 9).collect()
    table = {(r.h3_cell, r.date): r.predicted_count for r in got}
    assert len(table) == 18
    for cell, past in counts.items():
        h = list(past)
        for step in range(1, 10):
            day = date(2024, 1, 9) + timedelta(days=step)
            lag_7 = h[-7] if len(h) >= 7 else np.mean(h)
            y = (
                h[-1] * 0.2 + lag_7 * 0.1 + np.mean(h[-7:]) * 0.3 + np.mean(h[-14:]) * 0.2
                + np.mean(h) * 0.1 + day.weekday() - 3
            )
            h.append(max(y, 0.0))
            assert table[cell, day] == pytest.approx(h[-1])


def test_forecast_ranking(spark):
    rows = [
        ("a", date(2024, 1, 1), 1.0, 1.0, 1.0, "S"), ("a", date(2024, 1, 2), 4.0, 1.0, 1.0, "S"),
        ("a", date(2024, 1, 3), 4.0, 1.0, 1.0, "S"), ("b", date(2024, 1, 1), 9.0, 1.0, 1.0, "S"),
        ("c", date(2024, 1, 1), 99.0, 1.0, 1.0, None),
    ]
    df = spark.createDataFrame(
        rows, "h3_cell string, date date, predicted_count double, centroid_lat double, centroid_lon double, police_station string"
    )
    got = [(r.forecast_rank, r.h3_cell, r.peak_date.day) for r in forecast.forecast_hotspots(df, 5).collect()]
    assert got == [(1, "a", 2), (2, "b", 1)]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.poisson(3, 200), np.round(rng.uniform(0.5, 6, 200), 1)
    label = (y >= 4).astype(int)
    df = spark.createDataFrame(
        [(int(a), float(b), int(c)) for a, b, c in zip(y, p, label)], "count long, prediction double, label int"
    )
    m = evaluate.regression_metrics(df).first()
    assert m.mae == pytest.approx(np.abs(y - p).mean())
    assert m.rmse == pytest.approx(math.sqrt(((y - p) ** 2).mean()))
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    pos, neg = p[label == 1], p[label == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first().auc == pytest.approx(auc)
    assert math.isnan(evaluate.roc_auc(df.filter("label = 1")).first().auc)
    tried = evaluate.f1_by_threshold(df).orderBy("threshold_no").collect()
    cuts = np.quantile(p, np.linspace(0.5, 0.95, 19))
    assert [r.threshold for r in tried] == pytest.approx(list(cuts))
    for r, c in zip(tried, cuts):
        tp = ((p >= c) & (label == 1)).sum()
        assert r.f1 == pytest.approx(2 * tp / ((p >= c).sum() + label.sum()))
    none = evaluate.confusion(df, F.lit(1e9)).first()
    assert (none.precision, none.recall, none.f1, none.tp) == (0, 0, 0, 0)


def test_poisson_model_beats_the_weekly_lag(celled):
    done = forecasting.evaluate_forecaster(celled, test_days=7, min_cell_total=20)
    row = done.baseline.first()
    assert row.mae < row.baseline_mae and row.improvement_pct > 0
    assert len(done.tried) == 4 and done.best_params in [p for p, _ in done.tried]
    assert done.importance.count() > 5
    assert done.metrics.first().poisson_deviance > 0


def test_tree_model(spark, celled):
    rows = forecasting.evaluation_panel(celled, 20)
    train, test = panel.time_split(rows, 7)
    model = forecast.fit_demand(train, "gbt", {"maxIter": 5, "maxDepth": 3})
    assert forecast.predict_counts(test, model).agg(F.min("prediction")).first()[0] >= 0
    assert forecast.feature_importance(model, train).count() == len(panel.FEATURES)
    with pytest.raises(ValueError):
        forecast.demand_pipeline("linear")


def test_saved_forecaster_predicts_the_same(spark, celled, tmp_path):
    with pytest.raises(RuntimeError):
        forecast.DemandForecaster().predict_next_days()
    fitted = forecast.DemandForecaster(min_cell_total=20).fit(celled)
    loaded = forecast.DemandForecaster.load(spark, fitted.save(str(tmp_path / "model")))
    def rows(f):
        return sorted((r.h3_cell, r.date, round(r.predicted_count, 9)) for r in f.predict_next_days(3).collect())

    assert rows(fitted) == rows(loaded) and loaded.last_date == fitted.last_date
    with pytest.raises(ValueError):
        fitted.predict_next_days(0)


def test_local_dates_make_the_panel(spark):
    rows = [("c", datetime(2024, 1, 1, 23, 59)), ("c", datetime(2024, 1, 2, 0, 1)), (None, datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "h3_cell string, created_local timestamp_ntz")
    got = sorted((r.date.day, r["count"]) for r in panel.daily_counts(df).collect())
    assert got == [(1, 1), (2, 1)]
