"""Training run of the demand forecaster: sweep, hold-out metrics, final fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.operators import evaluate
from geohotspots.operators.forecast import (
    DemandForecaster,
    feature_importance,
    predict_counts,
)
from geohotspots.operators.panel import (
    MIN_CELL_TOTAL,
    add_cell_code,
    build_daily_panel,
    cell_codes,
    time_split,
    training_rows,
)
from geohotspots.session import cut_lineage


@dataclass(frozen=True)
class Evaluation:
    """Hold-out results. The F1 threshold is chosen on the hold-out it is reported on."""

    best_params: dict
    tried: list[tuple[dict, float]]
    scored: DataFrame
    metrics: DataFrame
    baseline: DataFrame
    auc: DataFrame
    confusion: DataFrame
    importance: DataFrame


def evaluation_panel(celled: DataFrame, min_cell_total: int = MIN_CELL_TOTAL) -> DataFrame:
    """Training rows with codes over the cells that remain."""
    panel = training_rows(
        build_daily_panel(celled, min_cell_total=min_cell_total)
    ).drop("cell_code")
    return cut_lineage(add_cell_code(panel, cell_codes(panel)))


def evaluate_forecaster(
    celled: DataFrame,
    *,
    kind: str = "glm",
    grid: Sequence[dict] | None = None,
    test_days: int = 30,
    min_cell_total: int = MIN_CELL_TOTAL,
) -> Evaluation:
    """Sweep the settings on a temporal hold-out and measure the best."""
    rows = evaluation_panel(celled, min_cell_total)
    train, test = (cut_lineage(part) for part in time_split(rows, test_days))
    best, model, tried = evaluate.grid_sweep(train, test, kind, grid)
    scored = cut_lineage(
        evaluate.hotspot_day_label(predict_counts(test, model), train)
    )
    threshold = evaluate.best_threshold(evaluate.f1_by_threshold(scored)).first()[0]
    return Evaluation(
        best_params=best,
        tried=tried,
        scored=scored,
        metrics=evaluate.regression_metrics(scored),
        baseline=evaluate.naive_baseline(scored),
        auc=evaluate.roc_auc(scored),
        confusion=evaluate.confusion(scored, F.lit(threshold)),
        importance=feature_importance(model, train),
    )


def train_and_save(
    celled: DataFrame, path: str, params: dict, forecaster: DemandForecaster
) -> DemandForecaster:
    """Fit on all data with the chosen settings and store the state."""
    fitted = forecaster.fit(celled, params)
    fitted.save(path)
    return fitted
