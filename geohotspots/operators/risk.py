"""Unsupervised risk columns: isolation-forest anomaly score and risk tier."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geohotspots.config import RISK_TIERS, SEED
from geohotspots.operators.impact import clip
from geohotspots.operators.ordering import exact_quantiles
from geohotspots.operators.trees import FOREST, forest_sum
from geohotspots.session import cut_lineage

# --- fixed values ------------------------------------------------------------------
FEATURES = (
    "impact_score", "severity_component", "proximity_component",
    "concentration_component", "log_member_count",
)
TREES = 200
TREE_ROWS = 256
RESTARTS = 10
UNKNOWN_TIER = "UNKNOWN"
UNKNOWN_ANOMALY = 0.5
# -------------------------------------------------------------------------------------

#: Draws are whole numbers below this prime.
PRIME = 2**31 - 1
#: Coordinates are whole numbers of these parts: what rounding leaves of equal values in
#: different sums splits no tree and moves no centre.
PARTS = 1_000_000
ROUNDS = 100


def risk_features(scored: DataFrame) -> DataFrame:
    return scored.select(
        "hotspot_id", *FEATURES[:-1], F.log1p("member_count").alias(FEATURES[-1])
    )


def standardise(features: DataFrame) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    stats = features.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in FEATURES],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES],
        )
    ).scalar()
    return features.select(
        "hotspot_id",
        *[
            F.coalesce(
                F.try_divide(F.col(c) - stats[f"m_{c}"], stats[f"s_{c}"]), F.lit(0.0)
            ).alias(c)
            for c in FEATURES
        ],
    )


def mean_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _hex_number(text: Column, first: int) -> Column:
    """Eight hex digits of ``text`` as a draw below :data:`PRIME`."""
    return F.conv(F.substring(text, first, 8), 16, 10).cast("long") % PRIME


def _row_draws(seed: int) -> tuple[Column, Column]:
    """Two numbers of a hotspot; ``(a + t * b) % PRIME`` is its draw number ``t``."""
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.col("hotspot_id")).cast("binary"))
    return _hex_number(code, 1), _hex_number(code, 9)


def _coordinates() -> Column:
    return F.array(*[F.round(F.col(c) * PARTS) for c in FEATURES])


def tree_samples(standardised: DataFrame, n: int, *, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """``(tree, hotspot_id, x)``: for each tree the ``TREE_ROWS`` hotspots of the smallest
    draws, with their features as an array.

    A draw depends on the id, the tree and the seed, not on partitioning. A filter on the
    draw leaves about twice the rows a tree needs before they are ranked.
    """
    size = min(TREE_ROWS, n)
    limit = int(PRIME * min(1.0, (2.0 * size + 200.0) / max(n, 1))) + 1
    a, b = _row_draws(seed)
    numbered = standardised.select("hotspot_id", _coordinates().alias("x"), a.alias("a"), b.alias("b"))
    draws = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.struct(t.alias("tree"), ((F.col("a") + t * F.col("b")) % PRIME).alias("draw")),
        ),
        lambda d: d["draw"] < limit,
    )
    drawn = numbered.select("hotspot_id", "x", F.inline(draws))
    order = Window.partitionBy("tree").orderBy("draw", "hotspot_id")
    ranked = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= size)
    return ranked.select("tree", "hotspot_id", "x")


def isolation_forest(samples: DataFrame, size: int, *, seed: int = SEED) -> DataFrame:
    """One row ``forest``: the trees as nested arrays, nodes in heap order.

    Each round takes the least and the largest value of every feature in each node, draws one
    of the features that differ and a cut between, and moves the rows on. All rounds run in
    the partitions of the samples: a tree has at most ``TREE_ROWS`` rows.
    """
    height = math.ceil(math.log2(max(size, 2)))
    rows = samples.withColumns({"node": F.lit(1), "path": F.expr("CAST(array() AS array<struct<node:int,feature:int,cut:double>>)")})
    here = Window.partitionBy("tree", "node")
    places = range(len(FEATURES))
    for _ in range(height):
        ranged = rows.withColumns(
            {"lo": F.array(*[F.min(F.get("x", F.lit(i))).over(here) for i in places]),
             "hi": F.array(*[F.max(F.get("x", F.lit(i))).over(here) for i in places])}
        )
        differing = F.array_compact(
            F.array(*[F.when(F.get("lo", F.lit(i)) < F.get("hi", F.lit(i)), F.lit(i)) for i in places])
        )
        code = F.md5(F.concat_ws(":", F.lit(str(seed)), "tree", "node").cast("binary"))
        chosen = ranged.withColumn("open", differing).withColumn(
            "f", F.when(F.size("open") > 0, F.get("open", _hex_number(code, 1) % F.size("open")))
        )
        lo, hi = F.get("lo", F.col("f")), F.get("hi", F.col("f"))
        cut = lo + (hi - lo) * (_hex_number(code, 9) / F.lit(PRIME))
        step = F.array(F.struct("node", F.col("f").alias("feature"), F.col("cut")))
        rows = chosen.withColumn("cut", cut).select(
            "tree", "x",
            F.when(F.col("f").isNull(), F.col("node"))
            .otherwise(2 * F.col("node") + (F.get("x", F.col("f")) > F.col("cut")).cast("int")).alias("node"),
            F.when(F.col("f").isNull(), F.col("path")).otherwise(F.concat("path", step)).alias("path"),
        )
    # Rows of a leaf end there together, so their number is its number of rows.
    leaves = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path"))
    paths = F.array(*[F.lit(mean_path(n)) for n in range(size + 1)])
    value = F.size("path") + F.get(paths, F.col("n").cast("int"))
    ends = F.array(F.struct("node", F.lit(-1).alias("feature"), F.lit(0.0).alias("cut"), value.alias("value")))
    inner = F.transform("path", lambda p: F.struct(p["node"], p["feature"], p["cut"], F.lit(0.0).alias("value")))
    trees = leaves.select("tree", F.inline(F.concat(inner, ends))).distinct().groupBy("tree").agg(
        F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut", "value")))).alias("nodes")
    )
    found = F.transform(
        F.sequence(F.lit(1), F.lit(2 ** (height + 1) - 1)), lambda k: F.try_element_at("nodes", k)
    )
    nodes = F.transform(
        found,
        lambda node, i: F.when(
            node.isNotNull(),
            F.struct(
                node["feature"].alias("feature"), node["cut"].alias("cut"),
                F.lit(None).cast("array<int>").alias("levels"), (2 * i + 1).alias("left"), (2 * i + 2).alias("right"),
                node["value"].alias("value"),
            ),
        ),
    )
    listed = trees.select("tree", nodes.alias("nodes"))
    ordered = F.array_sort(F.collect_list(F.struct("tree", "nodes")), lambda s, t: s["tree"] - t["tree"])
    return listed.agg(F.transform(ordered, lambda t: t["nodes"]).alias("forest"))


def anomaly_scores(
    standardised: DataFrame, *, trees: int = TREES, seed: int = SEED
) -> DataFrame:
    """``anomaly_score`` in [0, 1], 4 decimals; all 0 when all raw scores are equal.

    The forest has a bound, ``trees`` times twice ``TREE_ROWS`` nodes, whatever the number of
    hotspots; every row walks it in column functions.
    """
    # Every row walks all trees, so small tables, too, are dealt over all tasks.
    parts = int(standardised.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(standardised.repartition(parts, "hotspot_id"))
    n = rows.count()
    size = min(TREE_ROWS, n)
    if size < 2:
        return rows.select("hotspot_id", F.lit(0.0).alias("anomaly_score"))
    samples = tree_samples(rows, n, trees=trees, seed=seed).repartition(min(parts, trees), "tree")
    grown = isolation_forest(samples, size, seed=seed).select(F.to_json("forest")).first()[0]
    forest = F.from_json(F.lit(grown), FOREST)
    height = math.ceil(math.log2(size))
    total = forest_sum(forest, _coordinates(), height)
    raw = cut_lineage(
        rows.select("hotspot_id", F.pow(F.lit(2.0), -(total / trees) / mean_path(size)).alias("raw"))
    )
    span = raw.agg(F.struct(F.min("raw").alias("lo"), F.max("raw").alias("hi"))).scalar()
    scaled = F.try_divide(F.col("raw") - span["lo"], span["hi"] - span["lo"])
    return raw.select(
        "hotspot_id",
        F.bround(clip(F.coalesce(scaled, F.lit(0.0)), 0.0, 1.0), 4).alias("anomaly_score"),
    )


def quantile_tiers(features: DataFrame) -> DataFrame:
    """Tier by the exact thirds of the impact score."""
    thirds = exact_quantiles(features, "impact_score", [2 / 3, 1 / 3])
    high, low = (
        thirds.filter(F.col("prob_no") == i).select("quantile").scalar() for i in (0, 1)
    )
    impact = F.col("impact_score")
    tier = F.when(impact >= high, "HIGH").when(impact >= low, "MEDIUM").otherwise("LOW")
    return features.select("hotspot_id", tier.alias("risk_tier"))


def _distances(x: Column, centres: Column) -> Column:
    """``(square of the distance, number)`` to each of some centres."""

    def square(centre: Column) -> Column:
        parts = [F.get(x, F.lit(i)) - F.get(centre, F.lit(i)) for i in range(len(FEATURES))]
        return reduce(lambda total, d: total + d * d, parts[1:], parts[0] * parts[0])

    return F.transform(centres, lambda c, i: F.struct(square(c).alias("d"), i.alias("cluster")))


def _centres(values) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<array<array<double>>>")


def seed_centres(points: DataFrame, restarts: int, seed: int) -> list[list[list[int]]]:
    """Three starting points for each restart: a random one, then each time one drawn with
    odds by the square of its distance to those before.

    Draws come from hashed ids. A draw with odds is the least of exponential waiting times,
    a plain minimum, so one pass finds the next centre of all restarts.
    """
    a, b = _row_draws(seed)
    drawn = points.withColumns({"a": a, "b": b})
    chosen: list[list] = [[] for _ in range(restarts)]
    for no in range(3):
        draw = (F.col("a") + (3 * F.col("start") + no) * F.col("b")) % PRIME
        starts = drawn.select("*", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("start"))
        if no:
            near = F.array_min(_distances(F.col("x"), F.get(_centres(chosen), F.col("start"))))["d"]
            wait = -F.ln((draw + 1) / F.lit(float(PRIME + 1))) / F.when(near > 0, near)
        else:
            wait = draw
        first = starts.withColumn("wait", wait.cast("double")).filter("wait IS NOT NULL").groupBy("start").agg(
            F.min(F.struct("wait", "hotspot_id", "x")).alias("first")
        )
        for row in first.collect():
            chosen[row["start"]].append(list(row["first"]["x"]))
    return chosen


def risk_tiers(
    features: DataFrame, standardised: DataFrame, *, restarts: int = RESTARTS, seed: int = SEED
) -> DataFrame:
    """K-Means tiers named by mean impact; quantile tiers when three are not to be had.

    All restarts run in the same passes: one grouped sum a round moves the centres of all of
    them, until none moves. Coordinates are whole millionths of a deviation, so sums, and
    with them the tiers, do not depend on partitioning. The restart of least cost wins, the
    first of equals.
    """
    points = cut_lineage(standardised.select("hotspot_id", _coordinates().cast("array<bigint>").alias("x")))
    if len(points.select("x").distinct().limit(3).collect()) < 3:
        return quantile_tiers(features)
    centres = seed_centres(points, restarts, seed)

    def nearest() -> DataFrame:
        best = F.transform(_centres(centres), lambda c: F.array_min(_distances(F.col("x"), c)))
        return points.select("hotspot_id", "x", F.posexplode(best).alias("start", "best"))

    for _ in range(ROUNDS):
        sums = nearest().groupBy("start", "best.cluster").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(len(FEATURES))]).alias("sums"),
        )
        moved = [[list(c) for c in start] for start in centres]
        for row in sums.collect():
            moved[row["start"]][row["cluster"]] = [s / row["n"] for s in row["sums"]]
        if moved == centres:
            break
        centres = moved
    costs = nearest().groupBy("start").agg(F.sum(F.round(F.col("best.d") / PARTS).cast("long")).alias("cost"))
    start = costs.agg(F.min(F.struct("cost", "start")).alias("least")).first()["least"]["start"]
    placed = nearest().filter(F.col("start") == start).select("hotspot_id", "best.cluster")
    joined = cut_lineage(placed.join(features.select("hotspot_id", "impact_score"), "hotspot_id"))
    # At most three rows: one per cluster.
    means = joined.groupBy("cluster").agg(F.avg("impact_score").alias("impact")).collect()
    if len(means) < 3:
        return quantile_tiers(features)
    names = F.create_map(
        *[
            F.lit(x)
            for row, tier in zip(
                sorted(means, key=lambda r: (-r["impact"], r["cluster"])), RISK_TIERS
            )
            for x in (row["cluster"], tier)
        ]
    )
    return joined.select("hotspot_id", names[F.col("cluster")].alias("risk_tier"))


def compute_risk(scored: DataFrame, *, seed: int = SEED) -> DataFrame:
    """``(hotspot_id, anomaly_score, risk_tier)`` of scored hotspots."""
    features = cut_lineage(risk_features(scored))
    standardised = cut_lineage(standardise(features))
    scores = anomaly_scores(standardised, seed=seed)
    return scores.join(risk_tiers(features, standardised, seed=seed), "hotspot_id")


def attach_risk(df: DataFrame, risk: DataFrame) -> DataFrame:
    """Add the risk columns; hotspots without a score get ``UNKNOWN`` and 0.5."""
    joined = df.join(
        risk.select("hotspot_id", "risk_tier", "anomaly_score"), "hotspot_id", "left"
    )
    return joined.fillna({"risk_tier": UNKNOWN_TIER, "anomaly_score": UNKNOWN_ANOMALY})
