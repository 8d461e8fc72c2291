"""Daily panel per cell, zero-filled, with features that only look back.

All windows are per cell, so a cell's days are the largest group: bounded by the time
span, not by its events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from geohotspots.operators.ordering import global_position
from geohotspots.session import cut_lineage

# --- fixed values ------------------------------------------------------------------
PANEL_RESOLUTION = 8
MIN_CELL_TOTAL = 50
FEATURES = (
    "lag_1", "lag_7", "roll_7_mean", "roll_14_mean", "expanding_mean",
    "dow", "is_weekend", "month", "day", "day_of_year", "cell_code",
)
CATEGORIES = ("cell_code", "dow", "month", "is_weekend")
# -------------------------------------------------------------------------------------


def _by_date() -> WindowSpec:
    return Window.partitionBy("h3_cell").orderBy("date")


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per cell and local date."""
    usable = F.col("h3_cell").isNotNull() & F.col("created_local").isNotNull()
    counts = events.groupBy("h3_cell", F.to_date("created_local").alias("date")).agg(
        F.count(F.when(usable, 1)).alias("count")
    )
    # Not a filter on the cell: it would be computed once more for every event.
    return counts.filter(F.col("count") > 0)


def busy_cells(daily: DataFrame, min_cell_total: int = MIN_CELL_TOTAL) -> DataFrame:
    """Keep the days of cells with at least ``min_cell_total`` events overall."""
    total = F.sum("count").over(Window.partitionBy("h3_cell"))
    return daily.withColumn("_total", total).filter(
        F.col("_total") >= min_cell_total
    ).drop("_total")


def zero_fill(daily: DataFrame) -> DataFrame:
    """A row for every cell and every date between the first and last date of all.

    Every row emits its date and the empty dates up to the next one, so no cells x dates
    grid is joined.
    """
    span = daily.agg(
        F.struct(F.min("date").alias("first"), F.max("date").alias("last"))
    ).scalar()
    is_first = F.row_number().over(_by_date()) == 1
    following = F.lead("date").over(_by_date())
    spread = daily.withColumns(
        {
            "_from": F.when(is_first, span["first"]).otherwise(F.col("date")),
            "_until": F.coalesce(F.date_sub(following, 1), span["last"]),
        }
    ).select(
        "h3_cell",
        F.col("date").alias("_date"),
        "count",
        F.explode(F.sequence("_from", "_until")).alias("date"),
    )
    return spread.select(
        "h3_cell",
        "date",
        F.when(F.col("date") == F.col("_date"), F.col("count")).otherwise(0).alias("count"),
    )


def add_lags(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {f"lag_{k}": F.lag("count", k).over(_by_date()) for k in (1, 7)}
    )


def add_rolling(panel: DataFrame) -> DataFrame:
    """Means of the previous 7, 14 and all previous days of the same cell."""

    def before(start: int):
        return F.avg("count").over(_by_date().rowsBetween(start, -1))

    return panel.withColumns(
        {
            "roll_7_mean": before(-7),
            "roll_14_mean": before(-14),
            "expanding_mean": before(Window.unboundedPreceding),
        }
    )


def add_calendar(panel: DataFrame) -> DataFrame:
    dow = F.weekday("date")
    return panel.withColumns(
        {
            "dow": dow,
            "is_weekend": (dow >= 5).cast("int"),
            "month": F.month("date"),
            "day": F.dayofmonth("date"),
            "day_of_year": F.dayofyear("date"),
        }
    )


def cell_codes(panel: DataFrame) -> DataFrame:
    """``(h3_cell, cell_code)``: 0-based place of the cell in sorted order."""
    cells = panel.select("h3_cell").distinct()
    placed = global_position(cells, [F.col("h3_cell").asc()], "_place")
    return placed.select("h3_cell", (F.col("_place") - 1).alias("cell_code"))


def add_cell_code(panel: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``cell_code``; cells that are not in ``codes`` get -1."""
    joined = panel.join(codes, "h3_cell", "left")
    return joined.withColumn("cell_code", F.coalesce("cell_code", F.lit(-1)))


def build_daily_panel(
    celled: DataFrame,
    *,
    min_cell_total: int = MIN_CELL_TOTAL,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Zero-filled panel with all features; ``celled`` events carry ``h3_cell``.

    The daily counts are stored: span, codes and panel then read them, not the events.
    """
    daily = cut_lineage(busy_cells(daily_counts(celled), min_cell_total))
    panel = add_calendar(add_rolling(add_lags(zero_fill(daily))))
    return add_cell_code(panel, cell_codes(daily) if codes is None else codes)


def training_rows(panel: DataFrame) -> DataFrame:
    """Rows with a full set of look-back features."""
    return panel.dropna(subset=["lag_7", "roll_7_mean", "expanding_mean"])


def time_split(panel: DataFrame, test_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ``test_days`` days are held out."""
    cutoff = F.date_sub(panel.agg(F.max("date")).scalar(), test_days)
    return panel.filter(F.col("date") <= cutoff), panel.filter(F.col("date") > cutoff)
