"""Operators over a global order that never put the whole data into one task.

Rows are range-partitioned on the order, each partition is numbered on its own, and the
partition totals (one row per partition) shift the numbers. Quantiles need no order: they
are found by counting ranges.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geohotspots.session import cut_lineage


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add inclusive running sums over the global ``order``.

    ``order`` must be unique per row, or rows with equal keys share work in one
    partition in an arbitrary order. The range bounds are sampled, so partition numbers
    are only stable once stored: hence the checkpoint.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part").agg(
        *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    # One row per partition: small by construction, so a single-task window is fine.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_part",
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_s_{name}")
            for name in sums
        ],
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = placed.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    shifted = numbered.join(F.broadcast(shifts), "_part")
    return shifted.withColumns(
        {name: F.col(name) + F.col(f"_s_{name}") for name in sums}
    ).drop("_part", *[f"_s_{name}" for name in sums])


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based position of every row in the global ``order``."""
    ranked = running_sums(df, order, {name: F.lit(1)})
    return ranked.withColumn(name, F.col(name).cast("int"))


def position_in_group(df: DataFrame, group: str, position: str, name: str) -> DataFrame:
    """Turn a global position ordered by (group, ...) into a position within the group.

    The first position of each group comes from a map-side combined minimum, so no group
    is ever gathered, however large. Null is a group of its own.
    """
    first = df.groupBy(F.col(group).alias("_g")).agg(F.min(position).alias("_first"))
    joined = df.join(first, F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn(
        name, (F.col(position) - F.col("_first") + 1).cast("int")
    ).drop("_g", "_first")


def count_below(ends: Column, value: Column, longest: int, inclusive: bool = False) -> Column:
    """How many of the ascending ``ends`` (an array of at most ``longest``) are below, or also
    at, ``value``; found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(longest, 1).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        end = F.get(ends, at + step - 1)
        return F.when(end <= value if inclusive else end < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


#: Counted ranges of one pass of :func:`order_statistics`, over all values looked for.
RANGES = 4096
_BOUNDS = "array<struct<lo:array<double>,hi:array<double>,first:int>>"


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]]
) -> dict[str, list[float]]:
    """Values of ``columns`` at given 0-based places of their own order, without a sort.

    ``ranks`` gets the number of values of a column (nulls and NaN are left out). Each pass
    splits the range around every value looked for into equal parts and counts the rows in
    each, with the least and the largest value there; the part that holds the place is the
    next range, until it holds one value only. Ranges of all columns and places are counted
    together, with map-side sums, and only counts reach the driver: at most ``RANGES`` and
    two for each value looked for.
    """
    v = F.col("v")
    rows = df.select(
        F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("no", "v")
    ).filter(v.isNotNull() & ~F.isnan(v))
    whole = rows.groupBy("no").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    # One entry for each value: column, place in the range, range.
    looked: list[list] = []
    found: dict[str, list[float]] = {c: [] for c in columns}
    for row in sorted(whole.collect(), key=lambda r: r["no"]):
        looked += [[row["no"], k, row["lo"], row["hi"]] for k in ranks(row["n"])]
    while True:
        ranges = sorted({(no, lo, hi) for no, _, lo, hi in looked if lo < hi})
        if not ranges:
            break
        at = {r: i for i, r in enumerate(ranges)}
        parts = max(RANGES // len(ranges), 2)
        # By column: lower ends, upper ends, and the number of the first range.
        bounds = [
            {"lo": [r[1] for r in ranges if r[0] == no], "hi": [r[2] for r in ranges if r[0] == no],
             "first": sum(r[0] < no for r in ranges)}
            for no in range(len(columns))
        ]
        own = F.get(F.from_json(F.lit(json.dumps(bounds)), _BOUNDS), F.col("no"))
        longest = max(len(b["lo"]) for b in bounds)
        inside = rows.withColumn("own", own).withColumn(
            "place", count_below(F.col("own.lo"), v, longest, inclusive=True) - 1
        ).select(
            "v",
            (F.col("own.first") + F.col("place")).alias("r"),
            F.get("own.lo", F.col("place")).alias("lo"),
            F.get("own.hi", F.col("place")).alias("hi"),
        ).filter("v <= hi")
        counted = (
            # Halves first: the difference of two doubles may be beyond their range. Both ends
            # have a part of their own, so that every pass narrows, infinite ends included.
            inside.selectExpr(
                "v",
                "r",
                f"CASE v WHEN hi THEN {parts} WHEN lo THEN -1 ELSE greatest(0, least({parts - 1}, "
                f"floor(coalesce(try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), 0D) * {parts}))) END AS part",
            )
            .groupBy("r", "part")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        tallies: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda x: (x["r"], x["part"])):
            tallies.setdefault(row["r"], []).append(row)
        for entry in looked:
            for row in tallies.get(at.get((entry[0], entry[2], entry[3])), ()):
                if entry[1] < row["n"]:
                    entry[2:] = row["lo"], row["hi"]
                    break
                entry[1] -= row["n"]
    for no, _, value, _ in looked:
        found[columns[no]].append(value)
    return found


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Rows ``(prob_no, probability, quantile)`` with linear interpolation.

    Found by counting (:func:`order_statistics`), so nothing is sorted; no rows without
    values.
    """
    total = 0

    def around(n: int) -> list[int]:
        nonlocal total
        total = n
        places = [p * (n - 1) for p in probabilities]
        return [k for at in places for k in (math.floor(at), math.ceil(at))]

    values = order_statistics(df, [value], around)[value]
    rows = []
    for i, p in enumerate(probabilities if values else ()):
        low, high = values[2 * i : 2 * i + 2]
        at = p * (total - 1)
        rows.append((i, float(p), low + (high - low) * (at - math.floor(at))))
    return df.sparkSession.createDataFrame(
        rows, "prob_no int, probability double, quantile double"
    )
