"""Hand-made histories, and what must not change when the future does."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ringside.operators import history, pairwise, ratings

SCHEMA = "bout_id string, fight_date date, fighter_a_id string, fighter_b_id string, winner_id string, is_no_contest boolean, is_draw boolean, finish_method string, division string"
D = dt.date


def bout(n, day, a, b, winner, method="KO/TKO", kind="", division="x"):
    return (f"b{n}", day, *sorted((a, b)), winner, kind == "nc", kind == "draw", method, division)


#: m's career: two wins, one of them early, a loss, a no contest, a draw; then a bout a year after the last.
CAREER = [
    bout(11, D(2011, 3, 5), "m", "p", "m", "S-DEC"),
    bout(12, D(2011, 6, 18), "q", "m", "q", "U-DEC"),
    bout(13, D(2012, 1, 10), "m", "r", "m", "KO/TKO"),
    bout(14, D(2012, 4, 1), "p", "m", None, "Overturned", "nc"),
    bout(15, D(2012, 7, 1), "m", "q", None, "U-DEC", "draw"),
    bout(16, D(2013, 7, 1), "m", "t", "t", "KO/TKO"),
]


def snapshots(spark, rows):
    found = history.prefight_history(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.bout_id, r.fighter_id): r.asDict() for r in found}


def test_a_career_by_hand(spark):
    found = snapshots(spark, CAREER)
    at = found["b16", "m"]
    assert [at[f"prior_{k}"] for k in ("bouts", "wins", "losses", "draws", "no_contests")] == [5, 2, 1, 1, 1]
    assert at["prior_win_rate"] == pytest.approx(2 / 3) and at["prior_loss_rate"] == pytest.approx(1 / 3) and at["days_since_last"] == 365
    assert [at[s] for s in ("win_streak", "loss_streak", "unbeaten_streak", "winless_streak")] == [0, 0, 1, 1]  # the no contest ends every run
    assert (at["prior_ko_tko_wins"], at["prior_decision_wins"], at["finish_win_rate"]) == (1, 1, 0.5)
    assert (at["bouts_last_365d"], at["bouts_last_730d"]) == (1, 3)
    assert found["b13", "m"]["loss_streak"] == 1 and found["b14", "m"]["win_streak"] == found["b14", "m"]["unbeaten_streak"] == 1
    other = found["b16", "t"]
    assert other["is_debut"] and other["prior_loss_rate"] is None and other["days_since_last"] is None and other["finish_win_rate"] is None


def many(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = sorted(r.sample("abcdefgh", 2))
        kind = r.choice(["", "", "", "", "draw", "nc"])
        rows.append(bout(i, D(2020, 1, 1) + dt.timedelta(days=r.randrange(60)), a, b, None if kind else r.choice((a, b)), r.choice(["KO/TKO", "Submission", "U-DEC", "DQ"]), kind, r.choice("xyz")))
    return rows


def replay(rows, k=5):
    """Last five and streaks, bout by bout in plain Python."""
    out = {}
    for row in rows:
        for me in row[2:4]:
            past = sorted((p[1], p[0], p) for p in rows if me in p[2:4] and p[1] < row[1])
            names = ["no_contest" if p[5] else "draw" if p[6] else "win" if p[4] == me else "loss" for _, _, p in past]
            recent = names[-k:]
            streaks = []
            for kept in history.STREAKS.values():
                n = 0
                for x in reversed(names):
                    if x not in kept:
                        break
                    n += 1
                streaks.append(n)
            out[row[0], me] = ([recent.count(o) for o in history.OUTCOMES], streaks)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_replay(spark, seed):
    rows = many(seed)
    found, expected = snapshots(spark, rows), replay(rows)
    assert {k: ([v[f"recent_5_{o}"] for o in history.OUTCOMES], [v[s] for s in history.STREAKS]) for k, v in found.items()} == expected


def test_order_of_rows_is_nothing(spark):
    rows = many(3)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    assert snapshots(spark, rows) == snapshots(spark, shuffled)


def test_future_and_same_day_are_unseen(spark):
    rows = many(4)
    cut = D(2020, 2, 1)
    changed = [r if r[1] < cut else (r[0], r[1], r[2], r[3], r[3] if r[4] == r[2] else r[4], r[5], r[6], "DQ", r[8]) for r in rows]
    before, after = snapshots(spark, rows), snapshots(spark, changed)
    same = [k for r in rows if r[1] <= cut for k in ((r[0], r[2]), (r[0], r[3]))]
    hide = lambda v: {c: x for c, x in v.items() if c != "outcome"}
    assert all(hide(before[k]) == hide(after[k]) for k in same)
    assert before != after


def elo(rows):
    rating, out = {}, {}
    for day in sorted({r[1] for r in rows}):
        today, change = [r for r in rows if r[1] == day], {}
        for r in today:
            if not r[5]:
                a, b = r[2], r[3]
                s = 0.5 if r[6] else float(r[4] == a)
                g = 24 * (s - 1 / (1 + 10 ** ((rating.get(b, 1500) - rating.get(a, 1500)) / 400)))
                change[a], change[b] = change.get(a, 0) + g, change.get(b, 0) - g
        for r in today:
            for f in r[2:4]:
                out[r[0], f] = rating.get(f, 1500)
        for f, g in change.items():
            rating[f] = rating.get(f, 1500) + g
    return out


def test_ratings_against_replay(spark):
    rows = many(5)
    bouts = spark.createDataFrame(rows, SCHEMA)
    found = {(r.bout_id, r.fighter_id): r.rating_before for r in ratings.overall(bouts).collect()}
    assert found == pytest.approx(elo(rows))
    parts = {(r.bout_id, r.fighter_id): r.rating_before for r in ratings.by_division(bouts).collect()}
    expected = {k: v for d in "xyz" for k, v in elo([r for r in rows if r[8] == d]).items()}
    assert parts == pytest.approx(expected)


def test_swap_is_an_involution(spark):
    bouts = spark.createDataFrame(many(6), SCHEMA)
    features = ["prior_bouts", "prior_win_rate"]
    rows = pairwise.model_ready(pairwise.pairs(bouts, history.record(history.sides(bouts)), features), features)
    twice = pairwise.swapped(pairwise.swapped(rows))
    assert sorted(map(str, rows.collect())) == sorted(map(str, twice.select(rows.columns).collect()))


def test_unknown_outcome_fails(spark):
    rows = spark.createDataFrame([bout(1, D(2020, 1, 1), "a", "b", "z")], SCHEMA)
    with pytest.raises(Exception, match="no outcome"):
        history.sides(rows).collect()


def test_as_of_equals_history(spark):
    rows = many(7)
    bouts = spark.createDataFrame(rows, SCHEMA)
    last = max(rows, key=lambda r: (r[1], r[0]))
    found = {r.fighter_id: r.prior_bouts for r in history.at_date(bouts, last[2], last[3], str(last[1])).collect()}
    whole = snapshots(spark, rows)
    assert found == {f: whole[last[0], f]["prior_bouts"] for f in last[2:4]}


def test_empty(spark):
    assert history.prefight_history(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ratings.overall(spark.createDataFrame([], SCHEMA)).agg(F.count("*")).first()[0] == 0


def test_windows_of_days_grow_and_do_not_slide(spark, data):
    """A frame of days that slides is read again for each row."""
    from ringside.operators import performance
    from ringside.sources import proxy

    days = tuple(s for s, (n, _) in performance.SPANS.items() if n)
    rows = proxy.performance(spark, data)
    found = performance.window_stats(rows, ("knockdowns", "control_seconds"), days)
    assert "rangeframe, -365" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    doubles = rows.withColumns({m: F.col(m).cast("double") for m in ("knockdowns", "control_seconds")})
    slid = performance.window_stats(doubles, ("knockdowns", "control_seconds"), days)
    assert "rangeframe, -365" in slid._jdf.queryExecution().optimizedPlan().toString().lower()
    told = lambda df: sorted((r.bout_id, r.fighter_id, *(r[c] for c in found.columns if c.startswith("days_"))) for r in df.collect())
    assert told(found) == told(slid)
