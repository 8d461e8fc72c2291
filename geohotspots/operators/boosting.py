"""Boosted regression trees for counts: Poisson objective, log link, sets of categories.

A tree grows level by level. One grouped sum a level gives, for every open node, feature
and bin, the rows, the counted events ``y`` and the expected events ``p``: the gradient of
the Poisson loss is ``p - y`` and its Hessian ``p``. Running sums over bins give all splits
at once, and only the best split of each node and feature reaches the driver. A leaf takes
the step ``ln((y + smoothing) / (p + smoothing))``, the optimum for a constant with a prior,
and the gain of a split is what the steps of both sides gain in log-likelihood.

Numbers are binned at exact order statistics. The levels of a category are ordered by
``y / (p + category_smoothing)`` in each node; the ``max_levels`` lowest and highest are
tried as sets, so a set has a bound however many levels there are, and only that many of a
node meet in one task. Expected events are summed as whole millionths, so a model does not
depend on partitioning.

Several settings grow side by side in the same sums, so a sweep costs the jobs of one fit.
Trees reach the plan as constants that the generated code only refers to: every level of
every tree runs the same code, compiled once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geohotspots.config import SEED
from geohotspots.operators.ordering import count_below, order_statistics
from geohotspots.operators.trees import forest_literal, forest_sum, leaf_values
from geohotspots.session import cut_lineage

#: Expected events are counted in these parts of one event.
PARTS = 1_000_000
#: Trees after which the running prediction of all rows is stored.
STORED_TREES = 8


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit."""

    trees: int = 25
    depth: int = 3
    learning_rate: float = 0.15
    min_rows: int = 50
    feature_share: float = 0.8
    bins: int = 64
    max_levels: int = 32
    smoothing: float = 1.0
    category_smoothing: float = 10.0
    seed: int = SEED


@dataclass(frozen=True)
class PoissonTrees:
    """A fitted model: log of the mean count, trees of nodes, and the features they read."""

    base: float
    trees: tuple[tuple[dict, ...], ...]
    features: tuple[str, ...]
    categories: tuple[str, ...]
    settings: Boosting

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``, always positive."""
        return rows.withColumn("prediction", F.exp(self.margin()))

    def margin(self) -> Column:
        if not self.trees:
            return F.lit(self.base)
        features = F.array(*[F.col(c).cast("double") for c in self.features])
        return F.lit(self.base) + forest_sum(forest_literal(self.trees), features, self.settings.depth)

    def importance(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits; 0 for all without splits."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for node in tree:
                if node["feature"] >= 0:
                    gains[self.features[node["feature"]]] += node["gain"]
        total = sum(gains.values())
        return {c: g / total if total else 0.0 for c, g in gains.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({**asdict(self), "settings": asdict(self.settings)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PoissonTrees":
        state = json.loads(spark.read.text(path).first()[0])
        return cls(
            state["base"],
            tuple(tuple(tree) for tree in state["trees"]),
            tuple(state["features"]),
            tuple(state["categories"]),
            Boosting(**state["settings"]),
        )


def bin_cuts(rows: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Upper ends of all bins but the last: distinct values at equal steps of the order."""
    found = order_statistics(
        rows, columns, lambda n: sorted({(i * n) // bins for i in range(1, bins)} | {n - 1})
    )
    return {c: sorted(set(values))[:-1] for c, values in found.items()}


def _constants(values, kind: str) -> Column:
    """Nested lists as one constant, indexed by model and then by node or feature."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _at(values: Column, outer: str, inner: str) -> Column:
    return F.get(F.get(values, F.col(outer)), F.col(inner))


def best_splits(
    placed: DataFrame, totals: Sequence[Sequence], categories: Sequence[bool], settings: Sequence[Boosting]
) -> DataFrame:
    """The best split by each feature of the nodes of ``placed(model, node, feature, bin, y, p)``.

    ``totals[model][node]`` are the sums ``y, p, n`` of a node, ``p`` in whole parts. The left
    side of a numeric split are the bins up to ``bin``, that of a category its ``levels``. Of
    equal gains the fewest bins or levels win, the lowest first.
    """
    sums = placed.groupBy("model", "node", "feature", "bin").agg(
        F.sum("y").alias("y"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")
    )
    category = F.get(F.lit(list(categories)), F.col("feature"))
    own = [_constants([[getattr(s, c)] for s in settings], f"array<array<{k}>>") for c, k in (
        ("smoothing", "double"), ("category_smoothing", "double"), ("min_rows", "bigint"), ("max_levels", "int"),
    )]
    smoothing, category_smoothing, min_rows, max_levels = (F.get(F.get(c, F.col("model")), F.lit(0)) for c in own)
    ratio = F.col("y") / (F.col("p") / F.lit(PARTS) + category_smoothing)
    # Categories are read from both ends, numbers from the first bin only.
    ends = sums.withColumn("category", category).select(
        "*", F.explode(F.when(F.col("category"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))).alias("end")
    )
    keyed = ends.withColumn("key", F.when(F.col("category"), ratio * F.col("end")).otherwise(F.col("bin")))
    order = Window.partitionBy("model", "node", "feature", "end").orderBy("key", "bin")
    longest = max(max(s.bins, s.max_levels) for s in settings)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= longest)
    running = ranked.withColumns(
        {f"{c}_left": F.sum(c).over(upto) for c in "ypn"} | {"levels": F.collect_list("bin").over(upto)}
    )
    whole = _constants(totals, "array<array<array<bigint>>>")
    node = _at(whole, "model", "node")
    sides = running.withColumns({f"{c}_all": F.get(node, F.lit(i)) for i, c in enumerate("ypn")}).withColumn(
        "s", F.when(F.col("category"), category_smoothing).otherwise(smoothing)
    )

    def gain(y: Column, p: Column) -> Column:
        expected = p / F.lit(PARTS)
        step = F.ln((y + F.col("s")) / (expected + F.col("s")))
        return y * step - expected * (F.exp(step) - 1)

    y, p, n, y_all, p_all, n_all = (F.col(c) for c in ("y_left", "p_left", "n_left", "y_all", "p_all", "n_all"))
    gained = F.round(gain(y, p) + gain(y_all - y, p_all - p) - gain(y_all, p_all), 6)
    scored = sides.withColumn("gain", gained).filter(
        (F.col("gain") > 0) & (n >= min_rows) & (n_all - n >= min_rows)
        & (~F.col("category") | (F.col("place") <= max_levels))
    )
    keys = ["model", "node", "feature", "end"]
    best = F.max_by(
        F.struct("place", "bin", "gain", "y_left", "p_left", "n_left", F.when(F.col("category"), F.col("levels")).alias("levels")),
        F.struct("gain", -F.col("place")),
    )
    return scored.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def _leaf(value: float) -> dict:
    return {"feature": -1, "bin": None, "cut": None, "levels": None, "left": -1, "right": -1, "value": value, "gain": 0.0}


def _walked(trees: Sequence[Sequence[dict]], value: str, depth: int) -> Column:
    """For each model the ``value`` of the leaf, or its ``place``, by bins ``b``."""
    shown = [
        [{**node, "cut": node["bin"], "value": place if value == "place" else node["value"]} for place, node in enumerate(tree)]
        for tree in trees
    ]
    return leaf_values(forest_literal(shown), F.col("b").cast("array<double>"), depth)


def fit_forests(
    train: DataFrame,
    features: Sequence[str],
    categories: Sequence[str],
    label: str,
    settings: Sequence[Boosting],
) -> list[PoissonTrees]:
    """One model for each of ``settings``, which must agree in ``bins``.

    Missing numbers go to the first bin, missing categories to level -1; rows without label
    are left out. Rows are stored once as bins, and their running predictions every
    ``STORED_TREES`` trees.
    """
    if len({s.bins for s in settings}) > 1:
        raise ValueError("settings fitted together must have the same number of bins")
    numbers = [c for c in features if c not in categories]
    cuts = bin_cuts(train, numbers, settings[0].bins) if numbers else {}
    ends = _constants([cuts.get(c, []) for c in features], "array<array<double>>")
    binned = [
        F.coalesce(F.col(c).cast("int"), F.lit(-1)) if c in categories
        else F.when(F.col(c).isNull(), 0).otherwise(
            count_below(F.get(ends, F.lit(i)), F.col(c).cast("double"), len(cuts[c]))
        )
        for i, c in enumerate(features)
    ]
    labelled = cut_lineage(
        train.filter(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), F.array(*binned).alias("b"))
    )
    y_all, n_all = labelled.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    base = math.log((y_all + 0.5) / n_all) if n_all else 0.0
    models = range(len(settings))
    rows = labelled.withColumn("margins", F.array_repeat(F.lit(base), len(settings)))
    draws = [Random(s.seed) for s in settings]
    grown: list[list] = [[] for _ in models]
    growing = [bool(n_all and s.trees) for s in settings]
    deepest = max(s.depth for s in settings)
    whole = [[y_all, n_all * round(math.exp(base) * PARTS), n_all] for _ in models]
    while any(growing):
        used = [
            set(draws[m].sample(range(len(features)), max(1, round(settings[m].feature_share * len(features)))))
            for m in models
        ]
        trees, totals = _grow(rows, used, [c in categories for c in features], settings, growing, whole)
        for m in models:
            # What the next tree has to explain: the sums of the leaves, moved by their steps.
            leaves = [(node["value"], totals[m][i][1]) for i, node in enumerate(trees[m]) if node["feature"] < 0]
            whole[m] = [y_all, round(math.fsum(p * math.exp(value) for value, p in leaves)), n_all]
            if growing[m] and len(trees[m]) > 1:
                grown[m].append(trees[m])
            growing[m] &= len(trees[m]) > 1 and len(grown[m]) < settings[m].trees
        moved = F.zip_with("margins", _walked(trees, "value", deepest), lambda margin, step: margin + step)
        rows = rows.withColumn("margins", moved)
        if max(map(len, grown)) % STORED_TREES == 0:
            rows = cut_lineage(rows)
    for node in (node for trees in grown for tree in trees for node in tree):
        if node["feature"] >= 0 and node["levels"] is None:
            node["cut"] = cuts[features[node["feature"]]][node["bin"]]
    return [
        PoissonTrees(base, tuple(map(tuple, grown[m])), tuple(features), tuple(categories), settings[m]) for m in models
    ]


def fit_trees(
    train: DataFrame,
    features: Sequence[str],
    categories: Sequence[str] = (),
    label: str = "count",
    settings: Boosting = Boosting(),
) -> PoissonTrees:
    """:func:`fit_forests` with one setting."""
    return fit_forests(train, features, categories, label, [settings])[0]


def _grow(
    rows: DataFrame,
    used: Sequence[set],
    categories: Sequence[bool],
    settings: Sequence[Boosting],
    growing: Sequence[bool],
    whole: Sequence[list],
) -> tuple[list[list[dict]], list[list]]:
    """One tree for each growing model, a grouped sum for each level of all, and the sums of
    all nodes; a single leaf of value 0 for the others. ``whole`` are the sums of the roots."""
    models = range(len(settings))
    trees = [[_leaf(0.0)] for _ in models]
    expected = F.transform("margins", lambda margin: F.round(F.exp(margin) * PARTS).cast("long"))
    totals: list[list] = [[sums] for sums in whole]
    opened = [{0} if growing[m] else set() for m in models]
    read = _constants([[i in u for i in range(len(categories))] for u in used], "array<array<boolean>>")
    for level in range(max(s.depth for s in settings)):
        opened = [o if level < settings[m].depth else set() for m, o in enumerate(opened)]
        if not any(opened):
            break
        is_open = _constants([[i in opened[m] for i in range(len(trees[m]))] for m in models], "array<array<boolean>>")
        zipped = F.arrays_zip(expected.alias("p"), _walked(trees, "place", level).alias("node"))
        placed = (
            rows.select("y", "b", F.posexplode(zipped).alias("model", "z"))
            .select("y", "b", "model", F.col("z.p").alias("p"), F.col("z.node").cast("int").alias("node"))
            .filter(_at(is_open, "model", "node"))
            .select("model", "node", "y", "p", F.posexplode("b").alias("feature", "bin"))
            .filter(_at(read, "model", "feature"))
        )
        best: dict = {}
        for split in best_splits(placed, totals, categories, settings).collect():
            rank = (-split["gain"], split["feature"], split["place"], -split["end"])
            key = (split["model"], split["node"])
            if key not in best or rank < best[key][0]:
                best[key] = (rank, split)
        opened = [set() for _ in models]
        for (m, node), (_, split) in sorted(best.items()):
            own, tree = settings[m], trees[m]
            s = own.category_smoothing if categories[split["feature"]] else own.smoothing
            left = [split[f"{c}_left"] for c in "ypn"]
            right = [a - b for a, b in zip(totals[m][node], left)]
            tree[node] = {
                **_leaf(0.0), "feature": split["feature"], "gain": split["gain"], "left": len(tree), "right": len(tree) + 1,
                "bin": None if split["levels"] else split["bin"],
                "levels": sorted(split["levels"]) if split["levels"] else None,
            }
            for y, p, n in (left, right):
                if n >= 2 * own.min_rows:
                    opened[m].add(len(tree))
                tree.append(_leaf(own.learning_rate * math.log((y + s) / (p / PARTS + s))))
                totals[m].append([y, p, n])
    return trees, totals
