"""Priority score and ranks of zones."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.config import DEFAULT_AS_OF, PriorityConfig
from geohotspots.operators.impact import clip
from geohotspots.operators.ordering import global_position, position_in_group

# --- fixed values: weights of the geometric mean -------------------------------------
FACTOR_WEIGHTS = {
    "impact": 0.40,
    "frequency": 0.25,
    "persistence": 0.20,
    "recency": 0.15,
}
# ---------------------------------------------------------------------------------------


def instant(value: datetime) -> Column:
    """A Python datetime (naive means UTC) as a timestamp literal of that instant."""
    aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(micros))


def default_as_of(rows: DataFrame, column: str = "created_at") -> Column:
    """Latest event instant as a scalar, a fixed date when there is none."""
    return F.coalesce(rows.agg(F.max(column)).scalar(), instant(DEFAULT_AS_OF))


def _as_of(rows: DataFrame, column: str, config: PriorityConfig) -> Column:
    config.validate()
    return default_as_of(rows, column) if config.as_of is None else instant(config.as_of)


def raw_factors(activity: DataFrame) -> DataFrame:
    """Per hotspot: active local dates and latest event."""
    return activity.groupBy("hotspot_id").agg(
        F.count_distinct("local_date").alias("active_days"),
        F.max("last_at").alias("last_at"),
    )


def recency_decay(last_at: Column, as_of: Column, halflife_days: float) -> Column:
    """``2^(-days / halflife)``, clipped to (0, 1]; an event after ``as_of`` is an error."""
    micros = F.unix_micros(as_of) - F.unix_micros(last_at)
    days = micros / F.lit(86_400_000_000.0)
    decay = clip(F.pow(F.lit(2.0), -days / F.lit(float(halflife_days))), 1e-12, 1.0)
    late = F.raise_error(F.lit("last event is later than as_of")).cast("double")
    return F.when(last_at > as_of, late).otherwise(decay)


def recency(activity: DataFrame, config: PriorityConfig = PriorityConfig()) -> DataFrame:
    as_of = _as_of(activity, "last_at", config)
    last = activity.groupBy("hotspot_id").agg(F.max("last_at").alias("last_at"))
    return last.select(
        "hotspot_id",
        recency_decay(F.col("last_at"), as_of, config.recency_halflife_days).alias("recency"),
    )


def minmax(c: Column, low: Column, high: Column) -> Column:
    """``(c - low) / (high - low)``; 1 when the range has collapsed."""
    return F.when(high == low, F.lit(1.0)).otherwise((c - low) / (high - low))


def geometric_mean(weights: dict[str, float] = FACTOR_WEIGHTS) -> Column:
    """Weighted geometric mean of factor columns; 0 as soon as one factor is 0."""
    any_zero = F.lit(False)
    logs = F.lit(0.0)
    for name, weight in weights.items():
        any_zero = any_zero | (F.col(name) == 0.0)
        logs = logs + F.lit(weight) * F.ln(name)
    return F.when(any_zero, F.lit(0.0)).otherwise(F.exp(logs))


def priority_factors(
    scored: DataFrame, activity: DataFrame, config: PriorityConfig = PriorityConfig()
) -> DataFrame:
    """Scored hotspots with the four factors in [0, 1] and ``priority_score``."""
    as_of = _as_of(activity, "last_at", config)
    raw = scored.join(raw_factors(activity), "hotspot_id", "left").withColumns(
        {
            "active_days": F.coalesce("active_days", F.lit(0)),
            "last_at": F.coalesce(F.col("last_at"), as_of),
        }
    )
    span = raw.agg(
        F.struct(
            F.min("member_count").alias("f0"),
            F.max("member_count").alias("f1"),
            F.min("active_days").alias("p0"),
            F.max("active_days").alias("p1"),
        )
    ).scalar()
    factors = raw.withColumns(
        {
            "impact": F.col("impact_score") / 100.0,
            "frequency": minmax(F.col("member_count"), span["f0"], span["f1"]),
            "persistence": minmax(F.col("active_days"), span["p0"], span["p1"]),
            "recency": recency_decay(
                F.col("last_at"), as_of, config.recency_halflife_days
            ),
        }
    )
    return factors.withColumn(
        "priority_score", clip(geometric_mean() * 100.0, 0.0, 100.0)
    )


def rank_global(zones: DataFrame) -> DataFrame:
    """``global_rank``: 1..N by score descending, then by id as text."""
    order = [F.col("priority_score").desc(), F.col("hotspot_id").asc()]
    return global_position(zones, order, "global_rank")


def rank_in_station(zones: DataFrame) -> DataFrame:
    """``station_rank``: 1..M within a station; a missing station is one group."""
    order = [
        F.col("police_station").asc_nulls_first(),
        F.col("priority_score").desc(),
        F.col("hotspot_id").asc(),
    ]
    placed = global_position(zones, order, "_position")
    return position_in_group(placed, "police_station", "_position", "station_rank").drop(
        "_position"
    )


def rank_zones(
    scored: DataFrame, activity: DataFrame, config: PriorityConfig = PriorityConfig()
) -> DataFrame:
    """Priority zones: factors, score, global rank and rank within the station."""
    zones = priority_factors(scored, activity, config).select(
        "hotspot_id",
        "centroid_lat",
        "centroid_lon",
        "police_station",
        *FACTOR_WEIGHTS,
        "priority_score",
    )
    return rank_in_station(rank_global(zones))
