"""Decision trees as nested arrays, walked in column functions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A node: feature number (-1 in a leaf), largest value or else the levels that go left,
#: places of both children in the tree, value of a leaf. The root stands first.
NODE = "struct<feature:int,cut:double,levels:array<int>,left:int,right:int,value:double>"
FOREST = f"array<array<{NODE}>>"


def forest_literal(trees: Sequence[Sequence[dict]]) -> Column:
    """A forest known to the driver as one constant."""
    return F.from_json(F.lit(json.dumps(trees)), FOREST)


def leaf_values(forest: Column, features: Column, depth: int) -> Column:
    """The leaf value of every tree for an array of features; missing values go left."""

    def below(tree: Column, node: Column) -> Column:
        value = F.get(features, node["feature"])
        left = F.when(
            node["levels"].isNull(), F.coalesce(value <= node["cut"], F.lit(True))
        ).otherwise(F.array_contains(node["levels"], F.coalesce(value, F.lit(-1)).cast("int")))
        return F.when(node["feature"] < 0, node).otherwise(
            F.get(tree, F.when(left, node["left"]).otherwise(node["right"]))
        )

    def walk(tree: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(max(depth, 1)))
        return F.aggregate(steps, F.get(tree, F.lit(0)), lambda node, _: below(tree, node))["value"]

    return F.transform(forest, walk)


def forest_sum(forest: Column, features: Column, depth: int) -> Column:
    """Sum of the leaf values of all trees, in their order."""
    values = leaf_values(forest, features, depth)
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)
