"""Impact score: severity, proximity, hour concentration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.config import ImpactWeights
from geohotspots.operators.activity import SEVERITY_FLOOR


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def severity(activity: DataFrame, floor: float = SEVERITY_FLOOR) -> DataFrame:
    """Largest token weight per hotspot, ``floor`` without a known token."""
    return activity.groupBy("hotspot_id").agg(
        F.coalesce(F.nullif(F.max("severity"), F.lit(0.0)), F.lit(floor)).alias(
            "severity_component"
        )
    )


def proximity(activity: DataFrame) -> DataFrame:
    """Share of a hotspot's events near a junction or crossing."""
    return activity.groupBy("hotspot_id").agg(
        (F.sum("near") / F.sum("n")).alias("proximity_component")
    )


def _hour_entropy(hour_counts: Column) -> Column:
    total = F.aggregate(hour_counts, F.lit(0).cast("bigint"), lambda a, n: a + n)
    share = F.transform(F.filter(hour_counts, lambda n: n > 0), lambda n: n / total)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def concentration(activity: DataFrame) -> DataFrame:
    """One minus the normalised entropy of the hour-of-day distribution, in [0, 1]."""
    hours = activity.groupBy("hotspot_id").agg(
        F.array(
            *[F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)) for h in range(24)]
        ).alias("hours")
    )
    value = 1.0 - _hour_entropy(F.col("hours")) / F.lit(math.log2(24))
    return hours.select(
        "hotspot_id", clip(value, 0.0, 1.0).alias("concentration_component")
    )


def impact_components(activity: DataFrame, floor: float = SEVERITY_FLOOR) -> DataFrame:
    """All three components; one grouping of the activity."""
    hours = F.array(
        *[F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)) for h in range(24)]
    )
    sums = activity.groupBy("hotspot_id").agg(
        F.max("severity").alias("top"),
        F.sum("near").alias("near"),
        F.sum("n").alias("n"),
        hours.alias("hours"),
    )
    value = 1.0 - _hour_entropy(F.col("hours")) / F.lit(math.log2(24))
    return sums.select(
        "hotspot_id",
        F.coalesce(F.nullif(F.col("top"), F.lit(0.0)), F.lit(floor)).alias(
            "severity_component"
        ),
        (F.col("near") / F.col("n")).alias("proximity_component"),
        clip(value, 0.0, 1.0).alias("concentration_component"),
    )


def impact_raw(
    hotspots: DataFrame, components: DataFrame, weights: ImpactWeights = ImpactWeights()
) -> DataFrame:
    """Weighted sum of the components; a hotspot without events has (floor, 0, 0)."""
    weights.validate()
    joined = hotspots.join(components, "hotspot_id", "left").fillna(
        {
            "severity_component": SEVERITY_FLOOR,
            "proximity_component": 0.0,
            "concentration_component": 0.0,
        }
    )
    return joined.withColumn(
        "impact_raw",
        F.lit(weights.severity) * F.col("severity_component")
        + F.lit(weights.proximity) * F.col("proximity_component")
        + F.lit(weights.concentration) * F.col("concentration_component"),
    )


def boost_with_signal(scored: DataFrame, signal: DataFrame | None) -> DataFrame:
    """Lift raw scores by an outside ``signal(hotspot_id, signal)`` in [0, 1].

    The signal table must have at most one row per hotspot.
    """
    if signal is None:
        return scored
    raw = F.col("impact_raw")
    lift = clip(F.col("signal"), 0.0, 1.0)
    joined = scored.join(signal.select("hotspot_id", "signal"), "hotspot_id", "left")
    return joined.withColumn(
        "impact_raw", F.when(F.col("signal").isNull(), raw).otherwise(raw + (1.0 - raw) * lift)
    ).drop("signal")


def scale_to_max(scored: DataFrame) -> DataFrame:
    """``impact_score``: raw scores scaled so that the largest is 100; all 0 if it is 0."""
    top = scored.agg(F.max("impact_raw")).scalar()
    scale = F.when(top > 0, F.lit(100.0) / top).otherwise(F.lit(0.0))
    return scored.withColumn("impact_score", clip(F.col("impact_raw") * scale, 0.0, 100.0))


def with_breakdown(scored: DataFrame) -> DataFrame:
    parts = ("severity", "proximity", "concentration")
    pairs = [x for p in parts for x in (F.lit(p), F.col(f"{p}_component"))]
    return scored.withColumn("breakdown", F.create_map(*pairs))


def score_impact(
    hotspots: DataFrame,
    activity: DataFrame,
    weights: ImpactWeights = ImpactWeights(),
    *,
    signal: DataFrame | None = None,
) -> DataFrame:
    """Hotspots with components, raw score, score in [0, 100] and breakdown map."""
    raw = impact_raw(hotspots, impact_components(activity), weights)
    return with_breakdown(scale_to_max(boost_with_signal(raw, signal)))
