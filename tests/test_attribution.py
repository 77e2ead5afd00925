"""Shapley values of trees against all subsets of features, and of a fitted booster against its own probability."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.operators import attribution, history, models, pairwise
from ringside.sources import proxy

NAMES = [f"x{i}" for i in range(8)]


def grown(r, depth):
    if depth == 0 or r.random() < 0.1:
        return r.uniform(-1, 1)
    return r.choice(NAMES), r.choice([0.2, 0.4, 0.6, 0.8]), r.uniform(0.1, 0.9), grown(r, depth - 1), grown(r, depth - 1)


def expected(tree, row, known):
    """Mean of a tree where some features are known and splits on others are taken by their shares."""
    if not isinstance(tree, tuple):
        return tree
    feature, threshold, share, left, right = tree
    if feature in known:
        return expected(left if row[feature] <= threshold else right, row, known)
    return share * expected(left, row, known) + (1 - share) * expected(right, row, known)


def test_all_subsets_of_eight_features():
    r = random.Random(5)
    trees = [grown(r, 5) for _ in range(4)]
    model = [leaf for t in trees for leaf in attribution.leaves(t)]
    x = np.array([[r.random() for _ in NAMES] for _ in range(12)])
    found = attribution.values(model, NAMES, x)
    assert attribution.expected_margin(model) == pytest.approx(sum(expected(t, {}, ()) for t in trees))
    for row, own in zip(x, found, strict=True):
        row = dict(zip(NAMES, row, strict=True))
        worth = {s: sum(expected(t, row, s) for t in trees) for k in range(9) for s in map(frozenset, itertools.combinations(NAMES, k))}
        for i, n in enumerate(NAMES):
            rest = [m for m in NAMES if m != n]
            shapley = sum(math.factorial(k) * math.factorial(7 - k) / math.factorial(8) * (worth[frozenset(s) | {n}] - worth[frozenset(s)]) for k in range(8) for s in itertools.combinations(rest, k))
            assert own[i] == pytest.approx(shapley, abs=1e-12)


def test_fitted_booster(spark, data):
    bouts = proxy.bouts(spark, data)
    features = ["prior_bouts", "prior_win_rate"]
    names = pairwise.oriented(features)
    rows = pairwise.model_ready(pairwise.pairs(bouts, history.record(history.sides(bouts)), features), features)
    filled = rows.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0 if n.startswith("diff") else 0.5)) for n in names}).cache()
    model = models.boosted(filled, names, depth=3, iterations=4)
    forward, back = (models.predicted(model, df, names) for df in (filled, pairwise.swapped(filled)))
    p = {r.bout_id: 0.5 * (r.p + 1 - r.q) for r in forward.join(back.select("bout_id", F.col("p").alias("q")), "bout_id").collect()}
    out = attribution.explained(filled, attribution.fitted_leaves(model, names), names, {n: n.split("_", 1)[1] for n in names}).collect()
    assert {r.bout_id: r.p for r in out} == pytest.approx(p, abs=1e-9)
    assert all(set(r.effects) == set(features) and r.p == pytest.approx(r.baseline + sum(r.effects.values())) for r in out)
    assert any(abs(r.effects["prior_win_rate"]) > 0.01 for r in out)
