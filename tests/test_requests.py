"""Requests in a batch against single ones, and a model against its bundle."""

import datetime

import pytest
from pyspark.sql import functions as F

from ringside.operators import adjusted, history, models, pairwise, performance, ratings, requests
from ringside.sources import proxy


@pytest.fixture(scope="module")
def past(spark, data):
    bouts, perf = proxy.bouts(spark, data).cache(), proxy.performance(spark, data).cache()
    own = performance.absorbed(performance.window_stats(perf, adjusted.ADJUSTED, ("career",)))
    return bouts, perf, requests.history_rows(bouts, perf, ratings.overall(bouts), adjusted.observations(perf, own)).cache()


def test_batch_equals_single_requests(spark, past):
    bouts, _, rows = past
    asked = [(i, a, b, datetime.date(y, 6, 1)) for i, (a, b, y) in enumerate([("f000003", "f000005", 1995), ("f000007", "f000001", 1998), ("f000002", "f000004", 1992), ("f000001", "nobody", 1997)])]
    table = spark.createDataFrame(asked, "request_id int, fighter_a_id string, fighter_b_id string, request_date date")
    found = {(r.request_id, r.fighter_id): r for r in requests.vectors(table, rows).collect()}
    assert len(found) == 8
    same = ["prior_bouts", "prior_wins", "prior_win_rate", "days_since_last", "bouts_last_180d", "bouts_last_730d", "recent_5_win", "recent_5_win_rate", *history.STREAKS, "prior_ko_tko_wins", "finish_win_rate", "is_debut"]
    for i, a, b, day in asked:
        for r in history.at_date(bouts, a, b, str(day)).collect():
            assert [found[i, r.fighter_id][c] for c in same] == [r[c] for c in same], (i, r.fighter_id)
    nobody = found[3, "nobody"]
    assert (nobody.prior_bouts, nobody.rating, nobody.peak, nobody.days_since_last, nobody.career_knockdowns_mean) == (0, 1500.0, 1500.0, None, None)


def test_vectors_at_a_bouts_own_date_are_its_snapshot(spark, past):
    """Performance, ratings and adjusted values as of a bout's date are those that windows give it."""
    bouts, perf, rows = past
    asked = bouts.select(F.col("bout_id").alias("request_id"), "fighter_a_id", "fighter_b_id", F.col("fight_date").alias("request_date"))
    found = {(r.request_id, r.fighter_id): r for r in requests.vectors(asked, rows).collect()}
    stats = performance.window_stats(perf)
    own = performance.absorbed(performance.window_stats(perf, adjusted.ADJUSTED, ("career",)))
    snap = adjusted.snapshots(adjusted.observations(perf, own))
    strong = ratings.strength(bouts, ratings.overall(bouts))
    for frame, names in ((stats, {f"{s}_{m}_mean": f"{s}_{m}_mean" for s in performance.SPANS for m in ("knockdowns", "control_seconds")}),
                         (strong, {"rating_before": "rating", "peak": "peak", "change_last_3": "change_last_3", "opponents_mean": "opponents_mean", "rated_bouts": "rated_bouts"}),
                         (snap, {f"{m}_{x}": f"adjusted_{m}_{x}" for m in adjusted.ADJUSTED for x in ("count", "mean", "last_3", "last_5")})):
        for r in frame.collect():
            mine = found[r.bout_id, r.fighter_id]
            assert [mine[n] for n in names.values()] == pytest.approx([r[n] for n in names], nan_ok=True), (r.bout_id, r.fighter_id)


def test_routes_and_bundle(spark, past, tmp_path):
    bouts, _, rows = past
    features = ["prior_bouts", "prior_win_rate"]
    stored = pairwise.model_ready(pairwise.pairs(bouts, history.record(history.sides(bouts)), features), features)
    model = models.symmetric_model(stored, features)
    bundle = requests.Bundle.of_model(model, features, {"always": 0.0, "never": 0.5})
    expected = {r.bout_id: r.p for r in models.symmetric_predictions(model, stored, features, ["bout_id"]).collect()}
    path = f"file://{tmp_path}/bundle"
    sha = requests.save_bundle(spark, bundle, path)
    assert requests.save_bundle(spark, bundle, path) == sha and requests.load_bundle(spark, path) == requests.Bundle.of_text(bundle.text(), sha)
    (tmp_path / "bundle" / ".bundle.json.crc").unlink(missing_ok=True)
    (tmp_path / "bundle" / "bundle.json").write_text(bundle.text().replace("always", "Always"))
    with pytest.raises(ValueError, match="manifest"):
        requests.load_bundle(spark, path)
    asked = stored.select(F.col("bout_id").alias("request_id"), "fighter_a_id", "fighter_b_id", F.col("fight_date").alias("request_date"))
    back = asked.select("request_id", F.col("fighter_b_id").alias("fighter_a_id"), F.col("fighter_a_id").alias("fighter_b_id"), "request_date")
    later = asked.withColumn("request_date", F.lit(datetime.date(2030, 1, 1)))
    of = lambda df: {r.request_id: r for r in bundle.predicted(requests.answered(df, stored, rows, features)).collect()}
    exact, turned, rebuilt = of(asked), of(back), of(later)
    assert {r.route for r in exact.values()} == {"exact"} and {r.route for r in turned.values()} == {"reversed"} and {r.route for r in rebuilt.values()} == {"rebuilt"}
    assert {k: r.p for k, r in exact.items()} == pytest.approx(expected, abs=1e-9)
    assert {k: 1 - r.p for k, r in turned.items()} == pytest.approx(expected, abs=1e-9)
    assert all(r.speaks_always and not r.speaks_never for r in exact.values())
    assert all(exact[k].predicted_id == turned[k].predicted_id for k in exact)


def test_no_bout_is_repeated_for_a_request(spark):
    """Many requests for one competitor of many bouts: rows are those of bouts and requests, not their product."""
    n = 3000
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % c).cast("int"))
    rows = spark.range(n).select(
        F.format_string("b%05d", "id").alias("bout_id"), day(1000).alias("fight_date"), F.lit("x").alias("fighter_id"), F.lit("y").alias("opponent_id"), F.lit("win").alias("outcome"), F.lit("KO").alias("finish_method"),
        F.lit(1500.0).alias("rating_after"), F.lit(1500.0).alias("opponent_rating"),
    )
    asked = spark.range(n).select(F.col("id").alias("request_id"), F.lit("x").alias("fighter_a_id"), F.lit("z").alias("fighter_b_id"), day(1200).alias("request_date"))
    found = requests.vectors(asked, rows, (), ())
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "LeftSemi" not in line]
    expected = {i: (3 * min(i % 1200, 1000), 3 * (min(i % 1200, 1000) - min(max(i % 1200 - 180, 0), 1000))) for i in range(n)}
    assert {r.request_id: (r.prior_bouts, r.bouts_last_180d) for r in found.where("fighter_id = 'x'").collect()} == expected
    assert found.where("fighter_id = 'z' AND prior_bouts = 0 AND rating = 1500").count() == n
