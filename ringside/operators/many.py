"""Many models in one pass: packs of features, strengths of regularisation and folds trained together.

All models are logistic regressions over the same rows. A step reads the rows once: each task sums gradients and second
derivatives of every model that hasn't settled over its own rows, one sum by model and place brings them together, and a
Newton step follows on the driver, which holds nothing but a few numbers for each model. A fold trains on the blocks of
time before its own and is scored on its own block, so no row is copied for a fold, and folds aren't trained in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.operators.evaluate import DAY, boundaries
from ringside.plans.shared import discard, shelve

#: Steps at most, and the change of a weight at which a model has settled.
STEPS, SETTLED = 30, 1e-8


@dataclass(frozen=True)
class Candidate:
    """A pack of features and the inverse strength of its L2 penalty."""

    name: str
    features: tuple[str, ...]
    c: float


@dataclass
class Fitted:
    """A candidate trained for a fold: how features are filled and scaled, and the weights, the intercept last."""

    candidate: Candidate
    fold: int
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, x: np.ndarray, place: dict[str, int]) -> np.ndarray:
        own = x[:, [place[f] for f in self.candidate.features]]
        own = (np.where(np.isnan(own), self.fill, own) - self.mean) / self.scale
        return np.column_stack([own, np.ones(len(own))])


def blocks(rows: DataFrame, shares: tuple[float, ...] = (0.55, 0.70, 0.85, 1.0)) -> DataFrame:
    """rows, written once, with block: 0 up to the first boundary of whole dates, then 1, 2, ...; fold k trains on blocks below k."""
    rows = shelve(rows)
    ends = boundaries(rows, list(shares[:-1]))
    return rows.withColumn("block", sum(((F.col(DAY) > F.lit(e)).cast("int") for e in ends), F.lit(0)))


def _table(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)]) if n else np.zeros((batch.num_rows, 0))
    return x, batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64), batch.column(n + 1).to_numpy(zero_copy_only=False)


def _sums(rows: DataFrame, names: list[str], models: list[Fitted], of, size) -> list[np.ndarray]:
    """For each model, of(model, inputs, labels, blocks), size(model) numbers, summed over all rows: one sum by model and place."""
    shared, place = rows.sparkSession.sparkContext.broadcast(models), {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | float] = [0.0] * len(shared.value)
        for batch in batches:
            x, y, block = _table(batch, len(names))
            for i, m in enumerate(shared.value):
                total[i] = total[i] + of(m, m.inputs(x, place), y, block)
        flat = [np.atleast_1d(t) for t in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(flat)), [len(t) for t in flat])), pa.array(np.concatenate([np.arange(len(t)) for t in flat])), pa.array(np.concatenate(flat).astype(np.float64))], ["model", "at", "value"]
        )

    found = rows.mapInArrow(run, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).collect()  # models x places
    out = [np.zeros(size(m)) for m in models]
    for r in found:
        out[r.model][r.at] = r.value
    return out


def _derivatives(m: Fitted, x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
    own = block < m.fold
    x, y = x[own], y[own]
    p = 1 / (1 + np.exp(-(x @ m.weights)))
    return np.concatenate([x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


def _scores(m: Fitted, x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
    own = block == m.fold
    p, y = np.clip(1 / (1 + np.exp(-(x[own] @ m.weights))), 1e-15, 1 - 1e-15), y[own]
    return np.array([own.sum(), -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), ((p - y) ** 2).sum(), ((p >= 0.5) == (y == 1)).sum()])


def trained(rows: DataFrame, candidates: list[Candidate], folds: int, label: str = "a_won") -> list[Fitted]:
    """Every candidate for folds 1 to `folds`. rows: the features, the label and block.

    Gaps are filled with a fold's median (to one part in ten thousand of the rows), features scaled to unit variance, both
    from the fold's training rows alone. A fold without training rows keeps weights of zero.
    """
    names = sorted({f for c in candidates for f in c.features})
    narrow = shelve(rows.select(*(F.col(n).cast("double").alias(n) for n in names), F.col(label).cast("double"), F.col("block").cast("int")))
    inside = lambda k, n: F.when(F.col("block") < k, F.col(n))
    every = [(k, n) for k in range(1, folds + 1) for n in names]
    medians = narrow.agg(*(F.percentile_approx(inside(k, n), 0.5, 10_000) for k, n in every)).first()
    fill = {key: m if m is not None else 0.0 for key, m in zip(every, medians, strict=True)}
    filled = {(k, n): F.when(F.col("block") < k, F.coalesce(F.col(n), F.lit(fill[k, n]))) for k, n in every}
    moments = narrow.agg(*(x for c in filled.values() for x in (F.avg(c), F.stddev_pop(c)))).first()
    mean = {key: moments[2 * i] or 0.0 for i, key in enumerate(every)}
    scale = {key: moments[2 * i + 1] or 1.0 for i, key in enumerate(every)}
    models = []
    for c in candidates:
        for k in range(1, folds + 1):
            of = lambda d: np.array([d[k, n] for n in c.features])  # noqa: B023, E731
            models.append(Fitted(c, k, of(fill), of(mean), of(scale), np.zeros(len(c.features) + 1)))
    moving = list(models)
    for _ in range(STEPS):
        still = []
        for m, sums in zip(moving, _sums(narrow, names, moving, _derivatives, lambda m: len(m.weights) * (len(m.weights) + 1)), strict=True):
            d = len(m.weights)
            penalty = np.append(np.full(d - 1, 1 / m.candidate.c), 0.0)
            step = np.linalg.lstsq(sums[d:].reshape(d, d) + np.diag(penalty), sums[:d] + penalty * m.weights, rcond=None)[0]
            m.weights = m.weights - step
            if np.abs(step).max() > SETTLED:
                still.append(m)
        moving = still
        if not moving:
            break
    discard(narrow)
    return models


def fold_scores(rows: DataFrame, models: list[Fitted], label: str = "a_won") -> DataFrame:
    """candidate, fold, n, log_loss, brier and accuracy of every model on its fold's own block: one pass for all."""
    names = sorted({f for m in models for f in m.candidate.features})
    narrow = rows.select(*(F.col(n).cast("double").alias(n) for n in names), F.col(label).cast("double"), F.col("block").cast("int"))
    out = []
    for m, s in zip(models, _sums(narrow, names, models, _scores, lambda _: 4), strict=True):
        n = s[0]
        out.append((m.candidate.name, f"fold_{m.fold}", int(n), *(float(v / n) if n else None for v in s[1:])))
    return rows.sparkSession.createDataFrame(out, "candidate string, fold string, n long, log_loss double, brier double, accuracy double")


#: Objectives of the front, each the less the better.
OBJECTIVES = ("mean_log_loss", "worst_log_loss", "deviation_log_loss", "mean_brier", "mean_error")


def pareto_front(scores: DataFrame) -> DataFrame:
    """Each candidate with its five objectives over the folds, and whether no other is at least as good in all and better in one."""
    loss = F.col("log_loss")
    by = scores.groupBy("candidate").agg(
        F.avg(loss).alias("mean_log_loss"), F.max(loss).alias("worst_log_loss"), F.stddev_pop(loss).alias("deviation_log_loss"), F.avg("brier").alias("mean_brier"), F.avg(1 - F.col("accuracy")).alias("mean_error")
    )
    rows = by.collect()  # a row for each candidate of the grid
    points = [np.array([r[o] for o in OBJECTIVES]) for r in rows]
    front = [not any((q <= p).all() and (q < p).any() for q in points) for p in points]
    out = [(*r, f) for r, f in zip(rows, front, strict=True)]
    return scores.sparkSession.createDataFrame(out, "candidate string, " + ", ".join(f"{o} double" for o in OBJECTIVES) + ", on_front boolean")
