"""Models trained together against each trained alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.operators import history, many, pairwise
from ringside.sources import proxy


def alone(x, y, c):
    """Newton's method for one model; the intercept isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1 / c), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def test_together_and_alone(spark, data):
    features = ["prior_bouts", "prior_win_rate"]
    bouts = proxy.bouts(spark, data)
    rows = many.blocks(pairwise.model_ready(pairwise.pairs(bouts, history.record(history.sides(bouts)), features), features)).repartition(3).cache()
    packs = {"all": pairwise.oriented(features)[:4], "rate": ["diff_prior_win_rate"]}
    candidates = [many.Candidate(f"{n}-{c}", tuple(p), c) for n, p in packs.items() for c in (0.01, 1.0)]
    models = many.trained(rows, candidates, 3)
    assert len(models) == 12
    data = rows.toPandas()
    scores = {(r.candidate, r.fold): r for r in many.fold_scores(rows, models).collect()}
    for m in models:
        train, test = data[data.block < m.fold], data[data.block == m.fold]
        names = list(m.candidate.features)
        fill = train[names].astype(float).median()
        assert m.fill == pytest.approx(fill.to_numpy(), abs=0.03)
        fill = dict(zip(names, m.fill, strict=True))
        scaled = lambda d: (d[names].astype(float).fillna(fill) - m.mean) / m.scale  # noqa: B023, E731
        assert scaled(train).mean().abs().max() < 1e-9 and scaled(train).std(ddof=0).to_numpy() == pytest.approx(1)
        w = alone(scaled(train).to_numpy(), train.a_won.to_numpy(), m.candidate.c)
        assert m.weights == pytest.approx(w, abs=1e-6)
        p = 1 / (1 + np.exp(-np.column_stack([scaled(test), np.ones(len(test))]) @ w))
        y, found = test.a_won.to_numpy(), scores[m.candidate.name, f"fold_{m.fold}"]
        assert (found.n, found.log_loss, found.brier, found.accuracy) == (len(test), pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))), pytest.approx(np.mean((p - y) ** 2)), pytest.approx(np.mean((p >= 0.5) == y)))


def test_front(spark):
    rows = [("a", "f1", 0.5, 0.2, 0.7), ("a", "f2", 0.7, 0.2, 0.7), ("b", "f1", 0.6, 0.2, 0.7), ("b", "f2", 0.6, 0.2, 0.7), ("c", "f1", 0.7, 0.3, 0.6), ("c", "f2", 0.8, 0.3, 0.6), ("d", "f1", 0.9, 0.1, 0.5), ("d", "f2", 0.9, 0.1, 0.5)]
    scores = spark.createDataFrame(rows, "candidate string, fold string, log_loss double, brier double, accuracy double")
    assert {r.candidate: r.on_front for r in many.pareto_front(scores).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_no_rows(spark):
    rows = spark.createDataFrame([], "x double, a_won int, block int")
    models = many.trained(rows, [many.Candidate("m", ("x",), 1.0)], 2)
    assert [m.weights.tolist() for m in models] == [[0.0, 0.0]] * 2 and many.fold_scores(rows, models).where(F.col("log_loss").isNotNull()).isEmpty()
