"""What-ifs: shifted probabilities, simulated outcomes, contributions of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def counterfactual(rows: DataFrame, base: str, shifts: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Probability after changes of features: each clamped to its bounds, weighted, added to the logit; clipped to 0.01..0.99, four decimals.

    shifts: column -> (weight, low, high).
    """
    moved = sum((F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(low)), F.lit(high)) * w for c, (w, low, high) in shifts.items()), F.lit(0.0))
    p = F.least(F.greatest(F.col(base), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.withColumn("p_shifted", F.round(F.least(F.greatest(sigmoid(F.ln(p / (1 - p)) + moved), F.lit(0.01)), F.lit(0.99)), 4))


METHODS = {"decision": 0.5, "ko_tko": 0.3, "submission": 0.2}


def monte_carlo(spark: SparkSession, p_a: float, rounds: int = 3, runs: int = 10_000, seed: int = 7) -> DataFrame:
    """Simulated bouts, a row each: who wins, how, in which round, after how many seconds.

    Random numbers come from a hash of seed, run and purpose, so they don't depend on how runs are dealt to tasks.
    """
    u = lambda what: (F.xxhash64(F.lit(seed), F.col("id"), F.lit(what)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    drawn = spark.range(runs).withColumns({k: u(k) for k in ("winner", "method", "round", "clock")})
    ko, sub = METHODS["ko_tko"], METHODS["submission"]
    method = F.when(F.col("method") < ko, "ko_tko").when(F.col("method") < ko + sub, "submission").otherwise("decision")
    rows = drawn.select(F.col("id").alias("run"), (F.col("winner") < p_a).alias("a_wins"), method.alias("method"), F.col("round"), F.col("clock"))
    inside = F.floor(F.col("round") * rounds) + 1
    rows = rows.withColumn("round_no", F.when(F.col("method") == "decision", rounds).otherwise(inside))
    return rows.withColumn("seconds", F.when(F.col("method") == "decision", rounds * 300).otherwise((F.col("round_no") - 1) * 300 + F.ceil(F.col("clock") * 300))).drop("round", "clock")


def distribution(runs: DataFrame) -> DataFrame:
    """Shares by method and round, and mean and percentiles of the time, over all runs."""
    total = runs.agg(F.count("*").alias("total"), F.avg("seconds").alias("mean_seconds"), *(F.percentile("seconds", F.lit(q / 100)).alias(f"p{q}") for q in (10, 25, 50, 75, 90)))
    parts = runs.groupBy("method", "round_no").agg(F.count("*").alias("n"), F.avg(F.col("a_wins").cast("double")).alias("a_share"))
    return parts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))  # one row on the right


#: Parts of feature names, and the group that they stand for, in the order in which they are looked for.
GROUPS = (("strik", "striking"), ("takedown", "grappling"), ("submission", "grappling"), ("control", "grappling"), ("streak", "form"), ("recent", "form"), ("days", "activity"), ("bouts", "experience"), ("win", "record"), ("loss", "record"))


def group_of(name: Column) -> Column:
    out = None
    for part, group in GROUPS:
        out = F.when(name.contains(part), group) if out is None else out.when(name.contains(part), group)
    return out.otherwise("other")


def contributions(rows: DataFrame, key: str, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of each feature in a linear margin, weight * (value - mean), a row each. weights: column -> (weight, mean)."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), ((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) * w).alias("contribution")) for c, (w, m) in weights.items())))
    return rows.select(key, each.alias("x")).select(key, "x.*").withColumn("feature_group", group_of(F.col("feature")))


def grouped_contributions(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key, "feature_group").agg(F.sum("contribution").alias("contribution")).withColumn("size", F.abs("contribution"))


def allocated(margin: Column, base: Column) -> Column:
    """Factor that turns contributions to the margin into contributions to the probability."""
    slope = sigmoid(base) * (1 - sigmoid(base))
    return F.when(F.abs(margin) < 1e-9, slope).otherwise((sigmoid(base + margin) - sigmoid(base)) / margin)


def display_gap(value: Column, scale: float) -> Column:
    return F.round(F.least(F.greatest(value / scale, F.lit(-1.0)), F.lit(1.0)), 3)


def direction(gap: Column) -> Column:
    return F.when(gap >= 0.05, "a").when(gap <= -0.05, "b").otherwise("even")
