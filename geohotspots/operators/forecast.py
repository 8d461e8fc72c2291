"""Demand forecasting on the daily panel: model, recursive forecast, ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geohotspots.config import SEED, require_int
from geohotspots.functions.geo import fixed_mean, fixed_sum
from geohotspots.operators.boosting import Boosting, PoissonTrees, fit_forests, fit_trees
from geohotspots.operators.panel import (
    CATEGORIES,
    FEATURES,
    MIN_CELL_TOTAL,
    PANEL_RESOLUTION,
    build_daily_panel,
    cell_codes,
    training_rows,
)
from geohotspots.operators.spatial import modal_value
from geohotspots.session import cut_lineage

TAIL_DAYS = 21
Predictor = Callable[[DataFrame], DataFrame]

_LOG_FEATURES = ("lag_1", "lag_7", "roll_7_mean", "roll_14_mean", "expanding_mean")
# Settings tried by the sweep: ridge strength of the Poisson model.
GLM_GRID = ({"regParam": 0.0001}, {"regParam": 0.001}, {"regParam": 0.01}, {"regParam": 0.1})
GBT_GRID = (
    {"maxDepth": 5, "stepSize": 0.05, "maxIter": 60, "minInstancesPerNode": 50},
    {"maxDepth": 6, "stepSize": 0.05, "maxIter": 70, "minInstancesPerNode": 50},
    {"maxDepth": 6, "stepSize": 0.03, "maxIter": 90, "minInstancesPerNode": 30},
    {"maxDepth": 7, "stepSize": 0.03, "maxIter": 90, "minInstancesPerNode": 30},
)
# Settings of the Poisson trees: size of a tree, rate, number of trees, rows of a leaf.
TREES_GRID = (
    {"depth": 3, "learning_rate": 0.2, "trees": 15, "min_rows": 50},
    {"depth": 4, "learning_rate": 0.2, "trees": 15, "min_rows": 50},
    {"depth": 4, "learning_rate": 0.12, "trees": 20, "min_rows": 30},
    {"depth": 5, "learning_rate": 0.12, "trees": 20, "min_rows": 30},
)
GRIDS = {"glm": GLM_GRID, "gbt": GBT_GRID, "trees": TREES_GRID}
Model = PipelineModel | PoissonTrees


def demand_pipeline(kind: str = "glm", params: dict | None = None) -> Pipeline:
    """Unfitted pipeline from panel features to ``prediction``.

    ``glm``: Poisson regression with log link on logged look-back features and the day
    of week. ``gbt``: boosted trees on the raw feature list.
    """
    params = params or {}
    if kind == "gbt":
        settings = {"subsamplingRate": 0.8, "seed": SEED, "maxIter": 60, **params}
        return Pipeline(
            stages=[
                VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
                GBTRegressor(labelCol="count", **settings),
            ]
        )
    if kind != "glm":
        raise ValueError(f"model kind must be 'glm', 'gbt' or 'trees', got {kind!r}")
    logs = ", ".join(f"log1p({c}) AS log_{c}" for c in _LOG_FEATURES)
    settings = {"regParam": 0.001, "maxIter": 50, **params}
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"),
            OneHotEncoder(inputCol="dow", outputCol="dow_vec", handleInvalid="keep"),
            VectorAssembler(
                inputCols=[f"log_{c}" for c in _LOG_FEATURES] + ["is_weekend", "dow_vec"],
                outputCol="features",
            ),
            GeneralizedLinearRegression(
                family="poisson", link="log", labelCol="count", **settings
            ),
        ]
    )


def fit_demand(train: DataFrame, kind: str = "glm", params: dict | None = None) -> Model:
    """The model of :func:`demand_pipeline`, or for ``trees`` boosted Poisson trees that split
    cell, day of week, month and weekend by sets of their values."""
    if kind == "trees":
        return fit_trees(train, FEATURES, CATEGORIES, settings=Boosting(**(params or {})))
    return demand_pipeline(kind, params).fit(train)


def fit_settings(train: DataFrame, kind: str, grid: Sequence[dict]) -> list[Model]:
    """One model for each setting. Features are assembled once; trees grow side by side."""
    if kind == "trees":
        settings = [Boosting(**params) for params in grid]
        return list(fit_forests(train, FEATURES, CATEGORIES, "count", settings))
    stages = [demand_pipeline(kind, params).getStages() for params in grid]
    features = Pipeline(stages=stages[0][:-1]).fit(train)
    assembled = cut_lineage(features.transform(train).select("features", "count"))
    return [
        PipelineModel(stages=[*features.stages, own[-1].fit(assembled)]) for own in stages
    ]


def predict_counts(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """Add ``prediction`` >= 0; without a model it is the naive ``lag_7``."""
    if model is None:
        return rows.withColumn("prediction", F.col("lag_7").cast("double"))
    predicted = model.transform(rows)
    return predicted.withColumn(
        "prediction", F.greatest(F.col("prediction"), F.lit(0.0))
    ).select(*rows.columns, "prediction")


def feature_importance(model: Model, features: DataFrame) -> DataFrame:
    """``(feature, importance)``: share of the gain of all splits for trees, or absolute GLM
    coefficient times the standard deviation of the feature, so that any scales compare.

    ``features`` is the panel whose deviations count; names come from its metadata.
    """
    if isinstance(model, PoissonTrees):
        shares = list(model.importance().items())
        return features.sparkSession.createDataFrame(shares, "feature string, importance double")
    last = model.stages[-1]
    assembled = model.transform(features)
    meta = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        spread = assembled.select(Summarizer.std(F.col("features"))).first()[0]
        values = abs(last.coefficients.toArray() * spread.toArray())
    rows = [(names[i], float(v)) for i, v in enumerate(values)]
    return features.sparkSession.createDataFrame(rows, "feature string, importance double")


def cell_dim(celled: DataFrame, codes: DataFrame) -> DataFrame:
    """Known cells with code, mean coordinate and modal station ('' counts)."""
    sums = cut_lineage(
        celled.groupBy("h3_cell", "police_station").agg(
            F.count(F.lit(1)).alias("n"),
            fixed_sum("latitude").alias("lat"),
            fixed_sum("longitude").alias("lon"),
        )
    )
    centres = sums.groupBy("h3_cell").agg(
        fixed_mean("lat").alias("centroid_lat"),
        fixed_mean("lon").alias("centroid_lon"),
    )
    modal = modal_value(sums, ["h3_cell"], "police_station", weight=F.col("n"), skip=None)
    return codes.join(centres, "h3_cell").join(modal, "h3_cell", "left")


def tail_history(panel: DataFrame, days: int = TAIL_DAYS) -> DataFrame:
    """Counts of the last ``days`` days of every cell."""
    cutoff = F.date_sub(panel.agg(F.max("date")).scalar(), days)
    return panel.filter(F.col("date") > cutoff).select("h3_cell", "date", "count")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return total / F.size(values)


def _last(values: Column, k: int) -> Column:
    size = F.size(values)
    return F.slice(values, F.greatest(size - k + 1, F.lit(1)), F.lit(k))


def forecast_days(
    history: DataFrame,
    cells: DataFrame,
    last_date: date | Column,
    predict: Predictor,
    n_days: int = 7,
) -> DataFrame:
    """Recursive daily forecast of every cell: ``(h3_cell, date, predicted_count, ...)``.

    A cell's recent counts are one array (bounded: tail plus forecast days). A step reads
    its features off the array and appends its prediction, so all steps are narrow: the
    plan has one shuffle, and cells advance in parallel.
    """
    require_int("n_days", n_days, 1)
    start = last_date if isinstance(last_date, Column) else F.lit(last_date)
    recent = history.groupBy("h3_cell").agg(
        F.array_sort(F.collect_list(F.struct("date", "count"))).alias("h")
    )
    state = recent.select(
        "h3_cell", F.transform("h", lambda d: d["count"].cast("double")).alias("h")
    ).join(cells, "h3_cell")
    keep = state.columns
    for step in range(1, n_days + 1):
        h = F.col("h")
        day = F.date_add(start, step)
        dow = F.weekday(day)
        rows = state.withColumns(
            {
                "lag_1": F.element_at(h, -1),
                "lag_7": F.when(F.size(h) >= 7, F.get(h, F.size(h) - 7)).otherwise(_mean(h)),
                "roll_7_mean": _mean(_last(h, 7)),
                "roll_14_mean": _mean(_last(h, 14)),
                "expanding_mean": _mean(h),
                "dow": dow,
                "is_weekend": (dow >= 5).cast("int"),
                "month": F.month(day),
                "day": F.dayofmonth(day),
                "day_of_year": F.dayofyear(day),
            }
        )
        scored = predict(rows)
        grown = F.concat(h, F.array(F.greatest(F.col("prediction"), F.lit(0.0))))
        state = scored.withColumn("h", grown).select(*keep)
    steps = F.arrays_zip(
        F.sequence(F.lit(1), F.lit(n_days)).alias("step"),
        _last(F.col("h"), n_days).alias("predicted_count"),
    )
    carried = [c for c in keep if c not in ("h3_cell", "h", "cell_code")]
    return state.select("h3_cell", *carried, F.inline(steps)).select(
        "h3_cell",
        F.date_add(start, F.col("step")).alias("date"),
        "predicted_count",
        *carried,
    )


def forecast_hotspots(forecast: DataFrame, top_n: int = 20) -> DataFrame:
    """Cells by total predicted count with their peak date; incomplete cells are left out."""
    keys = ["h3_cell", "centroid_lat", "centroid_lon", "police_station"]
    totals = forecast.dropna(subset=keys[1:]).groupBy(*keys).agg(
        F.sum("predicted_count").alias("total_predicted"),
        F.max(
            F.struct(
                "predicted_count", (-F.unix_date("date")).alias("early"), "date"
            )
        ).alias("peak"),
    )
    best = totals.orderBy(F.col("total_predicted").desc(), "h3_cell").limit(top_n)
    # top_n rows: numbering them in one task is fine.
    order = Window.orderBy(F.col("total_predicted").desc(), "h3_cell")
    return best.select(
        F.row_number().over(order).alias("forecast_rank"),
        *keys,
        "total_predicted",
        F.col("peak.date").alias("peak_date"),
    )


@dataclass(frozen=True)
class DemandForecaster:
    """Settings and, once fitted, the state needed to forecast."""

    resolution: int = PANEL_RESOLUTION
    min_cell_total: int = MIN_CELL_TOTAL
    kind: str = "glm"
    model: Model | None = None
    cells: DataFrame | None = None
    history: DataFrame | None = None
    last_date: date | None = None

    def fit(self, celled: DataFrame, params: dict | None = None) -> "DemandForecaster":
        """Fitted copy; ``celled`` are clean events with an ``h3_cell`` column."""
        panel = cut_lineage(build_daily_panel(celled, min_cell_total=self.min_cell_total))
        train = training_rows(panel)
        return replace(
            self,
            model=fit_demand(train, self.kind, params),
            cells=cut_lineage(cell_dim(celled, cell_codes(train))),
            history=cut_lineage(tail_history(panel)),
            last_date=panel.agg(F.max("date")).first()[0],
        )

    def predict_next_days(self, n_days: int = 7) -> DataFrame:
        if self.model is None:
            raise RuntimeError("forecaster is not fitted")
        return forecast_days(
            self.history,
            self.cells,
            self.last_date,
            lambda rows: predict_counts(rows, self.model),
            n_days,
        )

    def predict_hotspots(self, n_days: int = 7, top_n: int = 20) -> DataFrame:
        return forecast_hotspots(self.predict_next_days(n_days), top_n)

    def save(self, path: str) -> str:
        """Write model, cells, history and settings below ``path``."""
        if self.model is None:
            raise RuntimeError("forecaster is not fitted")
        if isinstance(self.model, PoissonTrees):
            self.model.save(self.cells.sparkSession, f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        self.history.write.mode("overwrite").parquet(f"{path}/history")
        settings = [(self.resolution, self.min_cell_total, self.kind, self.last_date)]
        self.cells.sparkSession.createDataFrame(
            settings, "resolution int, min_cell_total int, kind string, last_date date"
        ).coalesce(1).write.mode("overwrite").json(f"{path}/settings")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DemandForecaster":
        settings = (
            spark.read.schema(
                "resolution int, min_cell_total int, kind string, last_date date"
            )
            .json(f"{path}/settings")
            .first()
        )
        trees = settings["kind"] == "trees"
        return cls(
            **settings.asDict(),
            model=PoissonTrees.load(spark, f"{path}/model") if trees else PipelineModel.load(f"{path}/model"),
            cells=spark.read.parquet(f"{path}/cells"),
            history=spark.read.parquet(f"{path}/history"),
        )
