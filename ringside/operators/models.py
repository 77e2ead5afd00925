"""Training and prediction with pyspark.ml; every model sees each bout from both sides."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.operators.evaluate import symmetric
from ringside.operators.pairwise import augmented, oriented, swapped


def _as_doubles(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({f"x_{f}": F.col(f).cast("double") for f in features})


def logistic(rows: DataFrame, features: list[str], label: str = "a_won", c: float = 1.0) -> PipelineModel:
    """Medians for what is missing, unit variance, then L2 logistic regression with strength 1 / (n c)."""
    xs, filled = [f"x_{f}" for f in features], [f"i_{f}" for f in features]
    n = max(1, rows.count())
    stages = [
        Imputer(strategy="median", inputCols=xs, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"),
        LogisticRegression(labelCol=label, regParam=1 / (n * c), elasticNetParam=0.0, maxIter=200),
    ]
    return Pipeline(stages=stages).fit(_as_doubles(rows, features))


def boosted(rows: DataFrame, features: list[str], label: str = "a_won", depth: int = 3, iterations: int = 20, seed: int = 7) -> PipelineModel:
    xs, filled = [f"x_{f}" for f in features], [f"i_{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=xs, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), GBTClassifier(labelCol=label, maxDepth=depth, maxIter=iterations, seed=seed)]
    return Pipeline(stages=stages).fit(_as_doubles(rows, features))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features of a boosted model, the weightiest first, ties by name."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def predicted(model: PipelineModel, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    out = model.transform(_as_doubles(rows, features))
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, name)


def majority(rows: DataFrame, label: str = "a_won") -> float:
    return rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5


def symmetric_model(rows: DataFrame, names: list[str]) -> PipelineModel:
    """Logistic regression on the rows and their swaps."""
    return logistic(augmented(rows).drop("is_swap"), oriented(names))


def symmetric_predictions(model: PipelineModel, rows: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """Forward, swapped and symmetric probability of each row."""
    forward = predicted(model, rows, oriented(names), "p_forward")
    own = forward.withColumn("_own", F.struct("*")).drop("p_forward")  # the row as it is goes beside its swap: one pass, no join
    back = predicted(model, swapped(own), oriented(names), "p_swap")
    columns = [*key, *(c for c in forward.columns if c not in key)]
    return back.select(*(F.col(f"_own.{c}").alias(c) for c in columns), "p_swap").withColumn("p", symmetric(F.col("p_forward"), F.col("p_swap")))


def platt(rows: DataFrame, p: str, label: str = "a_won") -> PipelineModel:
    logit = rows.withColumn("x_p", F.ln(F.col(p) / (1 - F.col(p))))
    return Pipeline(stages=[VectorAssembler(inputCols=["x_p"], outputCol="features"), LogisticRegression(labelCol=label)]).fit(logit)


def isotonic(rows: DataFrame, p: str, label: str = "a_won"):
    return IsotonicRegression(labelCol=label, featuresCol=p).fit(rows.withColumn(label, F.col(label).cast("double")))


def grid(rows: DataFrame, folded: DataFrame, packs: dict[str, list[str]], label: str = "a_won") -> DataFrame:
    """Log loss of each feature pack on each fold. Models are trained in turn: a pack and a fold are a distributed job each."""
    from ringside.operators.evaluate import metrics

    found = None
    folds = [r.fold for r in folded.select("fold").distinct().orderBy("fold").collect()]
    for name, features in packs.items():
        for fold in folds:
            own = folded.where(F.col("fold") == fold)
            model = logistic(own.where("part = 'train'"), features, label)
            scored = metrics(predicted(model, own.where("part = 'validation'"), features), ["fold"], label).select(F.lit(name).alias("candidate"), "fold", "log_loss", "brier", "auc")
            found = scored if found is None else found.unionByName(scored)
    return found
