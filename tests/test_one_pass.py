"""Splits, folds and blocks make their input once; a swapped row is scored beside its own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringside import queries
from ringside.operators import evaluate, many, models, pairwise
from ringside.sources import proxy


@pytest.mark.parametrize("split", [evaluate.temporal_split, evaluate.rolling_folds, many.blocks])
def test_rows_are_made_once(spark, split):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    days = spark.range(100).select(F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 20).cast("int")).alias("fight_date"))
    assert split(days.mapInArrow(seen, "fight_date date")).count() >= 100
    assert made.value == 100


def test_pairs_read_the_lines_once(spark, data):
    assert len(queries._paired(spark, data).inputFiles()) == 2  # lines and orders
    plan = queries._paired(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Join") == 1  # lines with their orders


def test_a_side_that_is_missing(spark):
    bouts = spark.createDataFrame([("b1", "f1", "f2"), ("b2", "f1", "f3")], "bout_id string, fighter_a_id string, fighter_b_id string")
    own = spark.createDataFrame([("b1", "f1", 1), ("b1", "f2", 2), ("b2", "f1", 3), ("b2", "f9", 4)], "bout_id string, fighter_id string, n long")
    assert [tuple(r) for r in pairwise.pairs(bouts, own, ["n"], missing=False).collect()] == [("b1", "f1", "f2", 1, 2, -1.0)]


def test_both_orders_are_scored_without_a_join(spark, data):
    rows = pairwise.model_ready(queries._paired(spark, data), ["prior_bouts", "prior_win_rate"]).limit(200).localCheckpoint()
    model = models.symmetric_model(rows, ["prior_bouts", "prior_win_rate"])
    found = models.symmetric_predictions(model, rows, ["prior_bouts", "prior_win_rate"], ["bout_id"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    names = pairwise.oriented(["prior_bouts", "prior_win_rate"])
    alone = {r.bout_id: r.p for r in models.predicted(model, pairwise.swapped(rows), names).collect()}
    assert all(r.p_swap == pytest.approx(alone[r.bout_id]) and r.p == pytest.approx(0.5 * (r.p_forward + 1 - r.p_swap)) for r in found.collect())


def test_sources_share_their_bouts(spark, data):
    one, two = queries._sources(spark, data)
    assert set(one.inputFiles()) & set(two.inputFiles())
    assert not any("lineitem" in f for f in one.inputFiles() + two.inputFiles())
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, proxy.source_one(spark, data).collect()), key=str)
