"""Ratings by slices and components against one serial fold."""

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringside.operators import ratings
from ringside.sources import proxy


def serial(rows, key=lambda r: ""):
    rating, found = {}, {}
    days = {}
    for r in rows:
        days.setdefault(r.fight_date, []).append(r)
    for day in sorted(days):
        change = {}
        for r in days[day]:
            a, b = (key(r), r.fighter_a_id), (key(r), r.fighter_b_id)
            if not r.is_no_contest:
                points = 0.5 if r.is_draw else float(r.winner_id == r.fighter_a_id)
                gain = 24 * (points - 1 / (1 + 10 ** ((rating.get(b, 1500.0) - rating.get(a, 1500.0)) / 400)))
                change[a], change[b] = change.get(a, 0.0) + gain, change.get(b, 0.0) - gain
        for r in days[day]:
            for own, other in ((r.fighter_a_id, r.fighter_b_id), (r.fighter_b_id, r.fighter_a_id)):
                own, other = (key(r), own), (key(r), other)
                before = rating.get(own, 1500.0)
                found[r.bout_id, own[1]] = before, before + change.get(own, 0.0), rating.get(other, 1500.0)
        for p, x in change.items():
            rating[p] = rating.get(p, 1500.0) + x
    return found


def close(frame, expected):
    found = {(r.bout_id, r.fighter_id): (r.rating_before, r.rating_after, r.opponent_rating) for r in frame.collect()}
    assert found.keys() == expected.keys()
    assert all(x == pytest.approx(y, abs=1e-9) for k, y in expected.items() for x, y in zip(found[k], y, strict=True))


@pytest.fixture(scope="module")
def some(spark, data):
    """Few bouts of many competitors, so that slices fall apart, and then a crowd that all meet."""
    rows = proxy.bouts(spark, data).orderBy("fight_date", "bout_id").limit(300)
    apart = rows.withColumns({x: F.concat(x, F.lit("-"), F.substring("bout_id", 8, 2)) for x in ("winner_id", "fighter_a_id", "fighter_b_id")})
    return apart.withColumn("bout_id", F.concat(F.lit("x"), "bout_id")).unionByName(rows).cache()


@pytest.mark.parametrize("least", [7, 60, 10_000])
def test_slices_give_the_serial_ratings(some, least):
    close(ratings.overall(some, least), serial(some.collect()))


def test_divisions_are_apart(some):
    expected = serial(some.collect(), lambda r: r.division)
    found = ratings.by_division(some, least_slice=90)
    close(found, expected)
    of = {r.bout_id: r.division for r in some.collect()}
    assert all(r.division == of[r.bout_id] for r in found.collect())


def test_components_by_slice(spark):
    chain = [(0, f"n{i:03}", f"n{i + 1:03}") for i in range(0, 40)] + [(1, "n000", "n001"), (1, "n003", "n002"), (2, "n005", "n005")]
    found = {(r.slice, r.node): r.part for r in ratings.components(spark.createDataFrame(chain, "slice long, a string, b string")).collect()}
    assert {p for (s, _), p in found.items() if s == 0} == {"n000"} and found[1, "n003"] == "n002" and found[1, "n001"] == "n000" and found[2, "n005"] == "n005"


def test_a_fold_streams_parts_in_any_batches():
    rows = [("p", None, None, x, None, 1500.0, None) for x in "abc"]
    rows += [("p", datetime.date(2020, 1, d), f"g{d}{i}", "abc"[i], "abc"[i - 2], (d + i) % 3 / 2, i != d % 3) for d in range(1, 20) for i in range(2)]
    rows += [("q", None, None, x, None, 1510.0, None) for x in "ad"] + [("q", datetime.date(2020, 1, 1), "h", "a", "d", 1.0, True)]
    names, kinds = ("part", "fight_date", "bout_id", "a", "b", "points", "rated"), ("string", "date32", "string", "string", "string", "double", "bool")
    table = pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})
    told = [pa.Table.from_batches(ratings._fold(iter(table.to_batches(max_chunksize=size)))).to_pylist() for size in (1, 7, 1000)]
    assert told[0] == told[1] == told[2]
    bouts = [r for r in told[0] if r["bout_id"]]
    last = {r["a"]: r["a_after"] for r in told[0][: len(bouts) + 2] if r["bout_id"] is None}
    assert len(bouts) == 39 and len(told[0]) == 39 + 5 and sum(last.values()) == pytest.approx(4500) and len(last) == 3
    assert (bouts[-1]["bout_id"], bouts[-1]["a_before"], bouts[-1]["a_after"], bouts[-1]["b_after"]) == ("h", 1510.0, 1522.0, 1498.0)


def test_rounds_are_few(spark):
    """Eight million bouts were 160 rounds."""
    bouts = spark.range(2400).select(F.date_add(F.lit("2019-01-01").cast("date"), F.col("id").cast("int")).alias("fight_date"), F.explode(F.sequence(F.lit(1), F.lit(3340))))
    assert ratings.slices_of_dates(bouts, ratings.LEAST_SLICE).agg(F.count_distinct("slice")).first()[0] <= 5


def test_slices_take_no_rounds(spark, some):
    """Each slice was a few jobs, after rounds over a graph of competitors."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for least in (7, 10_000):
        spark.sparkContext.setJobGroup(f"slices of {least}", "")
        assert ratings.overall(some, least).count() == 2 * some.count()
        counts.append(len(tracker.getJobIdsForGroup(f"slices of {least}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(counts) <= 20


def test_packed_slices_tell_what_their_members_come_with():
    """Ratings by dates of two chains, cut into slices and batches, are those of a fold over each whole chain."""
    rows = [("2020-01-%02d" % d, f"g{d:02}{i}", "abcd"[(d + i) % 4], "abcd"[(d + 2 * i + 1) % 4], (d + i) % 3 / 2, (d + i) % 5 != 0) for d in range(1, 25) for i in range(2)]
    day = pa.array([datetime.date.fromisoformat(r[0]) for r in rows])
    table = pa.table([day, *(pa.array(c) for c in list(zip(*rows, strict=True))[1:])], names=["fight_date", "bout_id", "a", "b", "points", "rated"])
    slices = [(d.day - 1) // 7 for d in day.to_pylist()]
    rated = pa.table({**{c: table[c] for c in ("fight_date", "a", "b")}, "points": pa.array([p if r else None for *_, p, r in rows])})
    both = []
    for chain in "xy":
        own = rated.append_column("part", pa.array([f"{s:010}{chain}" for s in slices]))
        both += list(ratings._packed(iter(own.to_batches(max_chunksize=3))))
    starts = pa.Table.from_batches(ratings._members(ratings._carried(iter(both)))).to_pylist()
    whole = table.append_column("part", pa.array(["w"] * len(rows)))
    told = [r for b in ratings._fold(iter(whole.to_batches(max_chunksize=5)), with_last=False) for r in b.to_pylist()]
    expected = {}
    for r, s in zip(told, slices, strict=True):
        for x in "ab":
            expected.setdefault((s, r[x]), r[f"{x}_before"])
    for chain in "xy":
        assert {(int(r["part"][:10]), r["a"]): r["points"] for r in starts if r["part"].endswith(chain)} == expected


def test_strength_takes_no_join(spark, some):
    """What a bout's sides and outcomes are comes with the ratings; all windows share one sort."""
    found = ratings.strengths(ratings.sided(some))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and sum("Sort [fighter_id#" in line for line in plan.splitlines()) == 1
    expected = ratings.strength(some, ratings.overall(some))
    names = sorted(expected.columns)
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, expected.select(names).collect()))


def test_a_winner_of_another_bout_fails(some):
    other = some.limit(1).withColumns({"winner_id": F.lit("nobody"), "is_draw": F.lit(False), "is_no_contest": F.lit(False)})
    with pytest.raises(Exception, match="no outcome for bout"):
        ratings.sided(other).collect()
