"""Which feature moves a boosted prediction by how much: exact Shapley values along the paths of trees.

A tree is told as its leaves. What a leaf asks of a feature, however many splits ask it, is one interval and the share of
training rows that go the leaf's way there. If a feature is known, a row passes its interval or not; if it's unknown, that
share passes. So a leaf is a game among the features on its path alone, and its Shapley values are sums over their few
subsets, however many features a model has. Leaves are a small table that goes to every task; rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ask:
    """Of one feature: above `low` and at most `high`, which `share` of the rows that get there are."""

    feature: str
    low: float
    high: float
    share: float


@dataclass(frozen=True)
class Leaf:
    value: float
    asks: tuple[Ask, ...]


def leaves(tree: tuple | float, asks: tuple[Ask, ...] = ()) -> list[Leaf]:
    """Of a tree: a number, or (feature, threshold, share of rows at most the threshold, tree for these, tree for others)."""
    if not isinstance(tree, tuple):
        return [Leaf(float(tree), asks)]
    feature, threshold, share, left, right = tree

    def narrowed(low: float, high: float, part: float) -> tuple[Ask, ...]:
        old = next((a for a in asks if a.feature == feature), Ask(feature, -math.inf, math.inf, 1.0))
        new = Ask(feature, max(low, old.low), min(high, old.high), old.share * part)
        return (*(a for a in asks if a.feature != feature), new)

    return leaves(left, narrowed(-math.inf, threshold, share)) + leaves(right, narrowed(threshold, math.inf, 1 - share))


def tree_of(node, names: list[str], weight: float) -> tuple | float:
    """A fitted tree's node as leaves() takes it, its values times a weight."""
    if node.getClass().getSimpleName() == "LeafNode":
        return weight * node.prediction()
    left, right, split = node.leftChild(), node.rightChild(), node.split()
    share = left.impurityStats().count() / (left.impurityStats().count() + right.impurityStats().count())
    return names[split.featureIndex()], split.threshold(), share, tree_of(left, names, weight), tree_of(right, names, weight)


def fitted_leaves(model: PipelineModel, names: list[str]) -> list[Leaf]:
    """Leaves of models.boosted(), on the scale on which the logistic function gives its probability."""
    booster = model.stages[-1]
    # the library's probability is the logistic function of twice its margin
    return [leaf for tree, w in zip(booster.trees, booster.treeWeights, strict=True) for leaf in leaves(tree_of(tree._java_obj.rootNode(), names, 2 * w))]


def subset_weights(n: int) -> list[tuple[tuple[int, ...], float]]:
    """Subsets of n other features with their Shapley weights."""
    return [(s, math.factorial(k) * math.factorial(n - k) / math.factorial(n + 1)) for k in range(n + 1) for s in combinations(range(n), k)]


def expected_margin(model: list[Leaf]) -> float:
    return sum(leaf.value * math.prod(a.share for a in leaf.asks) for leaf in model)


def values(model: list[Leaf], names: list[str], x: np.ndarray) -> np.ndarray:
    """Shapley values of rows x features; a row's values and the expected margin sum to its margin."""
    out, place = np.zeros(x.shape), {n: i for i, n in enumerate(names)}
    for leaf in model:
        at = [place[a.feature] for a in leaf.asks]
        passes = [(x[:, i] > a.low) & (x[:, i] <= a.high) for i, a in zip(at, leaf.asks, strict=True)]
        for k, i in enumerate(at):
            others = [j for j in range(len(at)) if j != k]
            total = np.zeros(len(x))
            for known, weight in subset_weights(len(others)):
                part = np.full(len(x), weight)
                for m, j in enumerate(others):
                    part = part * (passes[j] if m in known else leaf.asks[j].share)
                total += part
            out[:, i] += leaf.value * (passes[k] - leaf.asks[k].share) * total
    return out


def attributed(rows: DataFrame, model: list[Leaf], names: list[str], out: str) -> DataFrame:
    """Adds an array of Shapley values, one for each of names, which are columns without nulls."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)
            found = values(model, names, x)
            yield pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(names)).cast(pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return rows.withColumn(out, F.arrow_udf(run, "array<double>")(*(F.col(n).cast("double") for n in names)))


def to_probability(base: Column, change: Column) -> Column:
    """What a unit of margin is worth in probability when the margin goes from base to base + change."""
    sigmoid = lambda m: 1 / (1 + F.exp(-m))
    slope = sigmoid(base) * (1 - sigmoid(base))
    return F.when(F.abs(change) < 1e-12, slope).otherwise((sigmoid(base + change) - sigmoid(base)) / change)


def explained(rows: DataFrame, model: list[Leaf], names: list[str], groups: dict[str, str]) -> DataFrame:
    """p and baseline of A for each row, and a map from group to its effect in probability; all effects and the baseline sum to p.

    rows: oriented features a_<f>, b_<f>, diff_<f>, filled. The row and its swap are both explained; an effect is half
    the difference, as p is half of what both say.
    """
    turned = {n: -F.col(n) if n.startswith("diff_") else F.col(f"{'b' if n[0] == 'a' else 'a'}_{n[2:]}") for n in names}
    rows = rows.withColumns({f"_swap_{n}": c for n, c in turned.items()})
    rows = attributed(rows, model, names, "_forward")
    swapped = [Leaf(leaf.value, tuple(Ask(f"_swap_{a.feature}", a.low, a.high, a.share) for a in leaf.asks)) for leaf in model]
    rows = attributed(rows, swapped, [f"_swap_{n}" for n in names], "_back")
    base = F.lit(expected_margin(model))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumns({"_forward_unit": to_probability(base, total("_forward")), "_back_unit": to_probability(base, total("_back"))})
    effect = lambda i: 0.5 * (F.get("_forward", F.lit(i)) * F.col("_forward_unit") - F.get("_back", F.lit(i)) * F.col("_back_unit"))
    by_group: dict[str, Column] = {}
    for i, n in enumerate(names):
        by_group[groups[n]] = by_group[groups[n]] + effect(i) if groups[n] in by_group else effect(i)
    rows = rows.withColumn("effects", F.create_map(*(x for g, c in by_group.items() for x in (F.lit(g), c))))
    start = 1 / (1 + F.exp(-base))
    rows = rows.withColumn("baseline", 0.5 * (start + (1 - start)))
    return rows.withColumn("p", F.col("baseline") + total(F.map_values("effects"))).drop("_forward", "_back", "_forward_unit", "_back_unit", *(f"_swap_{n}" for n in names))
