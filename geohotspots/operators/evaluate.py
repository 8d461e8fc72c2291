"""Evaluation of forecasts: error metrics, hotspot-day classification, settings sweep."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.operators.forecast import GRIDS, Model, fit_settings, predict_counts
from geohotspots.operators.ordering import exact_quantiles, running_sums

# --- fixed values ------------------------------------------------------------------
LABEL_QUANTILE = 0.75
THRESHOLD_QUANTILES = tuple(0.5 + 0.025 * i for i in range(19))
# -------------------------------------------------------------------------------------


def regression_metrics(
    scored: DataFrame, actual: str = "count", prediction: str = "prediction"
) -> DataFrame:
    """One row: ``mae``, ``rmse``, ``r2``, ``poisson_deviance``.

    The deviance is only defined, and only given, when every prediction is positive.
    """
    y, p = F.col(actual).cast("double"), F.col(prediction)
    ratio = F.when(y > 0, y * F.ln(F.try_divide(y, p))).otherwise(F.lit(0.0))
    sums = scored.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.pow(y - p, 2)).alias("mse"),
        F.var_pop(y).alias("var"),
        F.when(F.min(p) > 0, 2.0 * F.avg(ratio - y + p)).alias("poisson_deviance"),
    )
    return sums.select(
        "mae",
        F.sqrt("mse").alias("rmse"),
        (1.0 - F.try_divide("mse", "var")).alias("r2"),
        "poisson_deviance",
    )


def improvement(baseline_error: Column, error: Column) -> Column:
    """Per cent by which ``error`` is below the baseline."""
    return F.try_divide(baseline_error - error, baseline_error) * 100.0


def naive_baseline(
    scored: DataFrame, actual: str = "count", prediction: str = "prediction"
) -> DataFrame:
    """MAE of the weekly lag, MAE of the prediction, and the improvement in per cent."""
    errors = scored.agg(
        F.avg(F.abs(F.col(actual) - F.col("lag_7"))).alias("baseline_mae"),
        F.avg(F.abs(F.col(actual) - F.col(prediction))).alias("mae"),
    )
    return errors.withColumn(
        "improvement_pct", improvement(F.col("baseline_mae"), F.col("mae"))
    )


def label_threshold(train: DataFrame) -> Column:
    """Scalar: the 75th percentile of the training counts."""
    return exact_quantiles(train, "count", [LABEL_QUANTILE]).select("quantile").scalar()


def hotspot_day_label(test: DataFrame, train: DataFrame) -> DataFrame:
    """Add ``label``: 1 on days at or above the training threshold."""
    return test.withColumn(
        "label", (F.col("count") >= label_threshold(train)).cast("int")
    )


def roc_auc(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``auc``: share of correctly ordered pairs, ties half; NaN for one class.

    Rows are counted per score before the shuffle; the pairs come from running counts.
    """
    hit = F.col(label) == 1
    per_score = scored.groupBy(F.col(prediction).alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    ranked = running_sums(per_score, [F.col("score").asc()], {"neg_upto": F.col("neg")})
    pairs = F.sum(
        F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / F.lit(2.0))
    )
    area = F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg"))
    return ranked.agg(F.coalesce(area, F.lit(float("nan"))).alias("auc"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def f1_by_threshold(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    quantiles: Sequence[float] = THRESHOLD_QUANTILES,
) -> DataFrame:
    """``(threshold_no, threshold, f1)`` for every candidate threshold.

    The candidates are a handful of quantiles; one pass counts hits for all of them.
    """
    found = exact_quantiles(scored, prediction, quantiles).collect()
    cuts = [r["quantile"] for r in sorted(found, key=lambda r: r["prob_no"])]
    hit = F.col(label) == 1
    above = [F.col(prediction) >= F.lit(c) for c in cuts]
    counts = scored.agg(
        F.count_if(hit).alias("pos"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("threshold_no"),
                    F.lit(cuts[i]).alias("threshold"),
                    F.count_if(a & hit).alias("tp"),
                    F.count_if(a).alias("flagged"),
                )
                for i, a in enumerate(above)
            ]
        ).alias("rows"),
    )
    rows = counts.select("pos", F.inline("rows"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("pos") + F.col("flagged"))
    return rows.select("threshold_no", "threshold", f1.alias("f1"))


def best_threshold(candidates: DataFrame) -> DataFrame:
    """One row ``(threshold, f1)``: the best F1, the lowest candidate on a tie."""
    best = F.max_by(
        F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold_no"))
    ).alias("best")
    return candidates.agg(best).select("best.*")


def confusion(
    scored: DataFrame, threshold: Column, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1 (0 where undefined)."""
    hit, flagged = F.col(label) == 1, F.col(prediction) >= threshold
    counts = scored.agg(
        F.count_if(~hit & ~flagged).alias("tn"),
        F.count_if(~hit & flagged).alias("fp"),
        F.count_if(hit & ~flagged).alias("fn"),
        F.count_if(hit & flagged).alias("tp"),
    )
    tp = F.col("tp")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + F.col("fp")),
            "recall": _ratio(tp, tp + F.col("fn")),
            "f1": _ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
        }
    )


Predictor = Callable[[DataFrame], DataFrame]


def sweep_errors(test: DataFrame, predictors: Sequence[Predictor]) -> list[float]:
    """Hold-out MAE of every predictor, which adds a ``prediction``, from one job."""
    rows = test
    for no, predict in enumerate(predictors):
        rows = predict(rows).withColumnRenamed("prediction", f"_p{no}")
    errors = [
        F.avg(F.abs(F.col("count") - F.col(f"_p{no}"))).alias(f"e{no}")
        for no in range(len(predictors))
    ]
    return list(rows.agg(*errors).first())


class Sweep(NamedTuple):
    """Settings with the least hold-out MAE, their model, and all settings with their MAE."""

    best: dict
    model: Model
    tried: list[tuple[dict, float]]


def grid_sweep(
    train: DataFrame, test: DataFrame, kind: str = "glm", grid: Sequence[dict] | None = None
) -> Sweep:
    """Fit every setting on ``train`` and measure it on ``test``; ties go to the first.

    Without a ``grid`` the settings listed for the kind of model are tried.
    """
    grid = grid or GRIDS[kind]
    models = fit_settings(train, kind, grid)
    predictors = [lambda rows, m=m: predict_counts(rows, m) for m in models]
    errors = sweep_errors(test, predictors)
    at = min(range(len(models)), key=lambda i: errors[i])
    return Sweep(grid[at], models[at], list(zip(grid, errors)))
