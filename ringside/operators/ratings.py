"""Elo ratings, and what windows make of them.

A rating depends on all bouts before it, so no window can give it. Bouts of one date are rated together from the
ratings at its start, as arrays. Time is cut into slices of whole dates, of LEAST_SLICE bouts at most, which are dealt to
tasks three times, whatever their number:

* each slice is packed: numbers for its competitors, and 16 bytes a bout;
* the packed dates go through one task in order (by division: one for each), which holds a rating for each competitor and
  one date, and tells what the competitors of a slice are rated at where they first appear in it;
* with these, slices are rated in parallel, now with their rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.windows import BOUT, DAY, OWNER, last_prior, ordered, prior, with_columns
from ringside.operators.graph import components  # noqa: F401
from ringside.operators.history import checked_winner, sides
from ringside.plans.shared import discard, shelve

START, STEP, SCALE = 1500.0, 24.0, 400.0
#: Bouts of a slice at most, to whole dates: what a task gets.
LEAST_SLICE = 2_000_000
#: Slices of a table that has fewer bouts than so many whole ones.
_SLICES = 32
#: A part is named by its slice's number in so many digits, and its chain.
_SLICE = 10
#: Rows of a batch that a task sends on.
_BATCH = 8192


def expected(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / SCALE))


def slices_of_dates(bouts: DataFrame, most: int) -> DataFrame:
    """(date, slice): whole dates in order, a new slice wherever the running number of bouts passes a multiple of `most`.

    There is a row for each date.
    """
    days = bouts.groupBy(DAY).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.select(DAY, F.floor(before / F.lit(most)).cast("long").alias("slice"))


class _Ratings:
    """Ratings by place; a name has its place from where it is first met, and START until it is rated or set."""

    def __init__(self) -> None:
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.rating, self._change = np.empty(0), np.empty(0)

    def places(self, names: pa.Array) -> np.ndarray:
        place = self.place
        found = np.fromiter(map(place.__getitem__, names.to_numpy(zero_copy_only=False)), np.int64, len(names))
        if len(place) > len(self.rating):
            more = len(place) + len(self.rating) + 1024
            self.rating = np.concatenate([self.rating, np.full(more, START)])
            self._change = np.zeros(len(self.rating))
        return found

    def rate(self, a: np.ndarray, b: np.ndarray, points: np.ndarray, rated: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """A date's bouts, in order -> a before and after, b before and after."""
        x, y = self.rating[a], self.rating[b]
        gain = STEP * (points - 1 / (1 + 10 ** ((y - x) / SCALE)))
        if rated is not None:
            gain = np.where(rated, gain, 0.0)
        np.add.at(self._change, np.stack([a, b], 1).ravel(), np.stack([gain, -gain], 1).ravel())
        after = x + self._change[a], y + self._change[b]
        self.rating[a], self.rating[b] = after
        self._change[a] = self._change[b] = 0.0
        return x, after[0], y, after[1]


def _dates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, pa.Table]]:
    """(part, date, rows) of rows by part and date, each date whole, however the batches are cut."""
    key, held = None, []
    for batch in batches:
        part, day = batch.column("part"), batch.column(DAY)
        if not batch.num_rows:
            continue
        same = pc.and_(pc.equal(part[1:], part[:-1]), pc.equal(pc.fill_null(day.cast("int32"), -(2**31))[1:], pc.fill_null(day.cast("int32"), -(2**31))[:-1]))
        cuts = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = part[i].as_py(), day[i].as_py()
            if held and own != key:
                yield *key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(i, j - i))
    if held:
        yield *key, pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    return rows[name].combine_chunks() if rows[name].num_chunks != 1 else rows[name].chunk(0)


def _batched(tables: Iterator[pa.Table], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tables of any sizes -> batches of _BATCH rows at most."""
    held: list[pa.Table] = []
    for table in tables:
        held.append(table)
        if sum(t.num_rows for t in held) >= _BATCH:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=_BATCH)
            held = []
    yield from pa.concat_tables([schema.empty_table(), *held]).combine_chunks().to_batches(max_chunksize=_BATCH)


_TOLD = pa.schema([("part", pa.string()), (BOUT, pa.string()), (DAY, pa.date32()), ("a", pa.string()), ("b", pa.string()), ("points", pa.float64()), ("rated", pa.bool_()), *((f"{x}_{when}", pa.float64()) for x in "ab" for when in ("before", "after"))])
_TOLD_SQL = f"part string, {BOUT} string, {DAY} date, a string, b string, points double, rated boolean, a_before double, a_after double, b_before double, b_after double"


def _fold(batches: Iterator[pa.RecordBatch], with_last: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows by part, date and bout -> a row a bout and, if asked for, one without a bout for each member's last rating.

    A part begins with its members' ratings, which have no date.
    """

    def told() -> Iterator[pa.Table]:
        now, ratings = None, _Ratings()

        def last() -> pa.Table:
            n = len(ratings.place)
            own = {"part": pa.array([now] * n, pa.string()), "a": pa.array(list(ratings.place), pa.string()), "a_after": pa.array(ratings.rating[:n])}
            return pa.table([own.get(f.name, pa.nulls(n, f.type)) for f in _TOLD], schema=_TOLD)

        for part, date, rows in _dates(batches):
            if part != now:
                if with_last and now is not None:
                    yield last()
                now, ratings = part, _Ratings()
            a, points = ratings.places(_column(rows, "a")), _column(rows, "points").to_numpy(zero_copy_only=False)
            if date is None:
                ratings.rating[a] = points
                continue
            found = ratings.rate(a, ratings.places(_column(rows, "b")), points, _column(rows, "rated").to_numpy(zero_copy_only=False))
            yield pa.table([*(rows[f.name].cast(f.type) for f in list(_TOLD)[:-4]), *map(pa.array, found)], schema=_TOLD)
        if with_last and now is not None:
            yield last()

    yield from _batched(told(), _TOLD)


_PACKED = pa.schema([("part", pa.string()), (DAY, pa.date32()), ("names", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("points", pa.binary())])
_STARTS = pa.schema([("part", pa.string()), ("names", pa.binary()), ("ratings", pa.binary())])
_MEMBERS = pa.schema([("part", pa.string()), ("a", pa.string()), ("points", pa.float64())])


def _stream(names: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([names], names=["name"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _names(stream: bytes) -> pa.Array:
    return pa.ipc.open_stream(stream).read_next_batch().column(0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part, date and bout -> a row a date: names that the part meets first, and bouts with points as numbers in the part and points."""
    now, members = None, _Ratings()
    for part, date, rows in _dates(batches):
        if part != now:
            now, members = part, _Ratings()
        known, a, b = len(members.place), _column(rows, "a"), _column(rows, "b")
        own, other = members.places(a), members.places(b)
        at, first = np.unique(np.concatenate([own, other]), return_index=True)
        names = pa.concat_arrays([a, b]).take(pa.array(first[at >= known]))
        points = _column(rows, "points").to_numpy(zero_copy_only=False)
        rated = ~np.isnan(points)
        row = part, date, _stream(names), own[rated].astype("<i4").tobytes(), other[rated].astype("<i4").tobytes(), points[rated].astype("<f8").tobytes()
        yield pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, row, strict=True))], schema=_PACKED)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed dates by chain and date -> the ratings at which a part's members come into it."""
    chain, part, ratings, local, n = None, None, _Ratings(), np.empty(1024, np.int64), 0
    for batch in batches:
        for row in range(batch.num_rows):
            own = {c: batch.column(c)[row].as_py() for c in _PACKED.names}
            if own["part"] != part:
                part, n = own["part"], 0
            if part[_SLICE:] != chain:
                chain, ratings = part[_SLICE:], _Ratings()
            at = ratings.places(_names(own["names"]))
            if n + len(at) > len(local):
                local = np.concatenate([local[:n], np.empty(n + len(at) + 1024, np.int64)])
            local[n : n + len(at)] = at
            n += len(at)
            if len(at):
                yield pa.RecordBatch.from_pylist([{"part": part, "names": own["names"], "ratings": ratings.rating[at].astype("<f8").tobytes()}], schema=_STARTS)
            ratings.rate(*(local[np.frombuffer(own[x], "<i4")] for x in "ab"), np.frombuffer(own["points"], "<f8"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, names, ratings in zip(*(batch.column(c) for c in _STARTS.names), strict=True):
            found = _names(names.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(found), pa.string()), found, pa.array(np.frombuffer(ratings.as_py(), "<f8"))], schema=_MEMBERS)


def _rated(games: DataFrame, least_slice: int) -> DataFrame:
    """games: bout, date, players a and b, points of a, rated, chain -> a row a bout with the ratings of both before and after."""
    games = shelve(games)
    most = max(min(least_slice, -(-games.count() // _SLICES)), 1)
    part = F.concat(F.lpad(F.col("slice").cast("string"), _SLICE, "0"), "chain").alias("part")
    sliced = games.join(F.broadcast(slices_of_dates(games, most)), DAY).select(part, BOUT, DAY, "a", "b", "points", "rated")
    dealt = lambda rows: rows.repartition("part").sortWithinPartitions("part", F.asc_nulls_first(DAY), BOUT)
    known = F.when(F.col("rated"), F.col("points")).alias("points")
    packed = shelve(dealt(sliced).select("part", DAY, "a", "b", known).mapInArrow(_packed, f"part string, {DAY} date, names binary, a binary, b binary, points binary"))
    chain = F.expr(f"substring(part, {_SLICE + 1})")
    starts = shelve(packed.repartition(chain).sortWithinPartitions(chain, "part", DAY).mapInArrow(_carried, "part string, names binary, ratings binary"))
    discard(packed)
    rows = sliced.unionByName(starts.mapInArrow(_members, "part string, a string, points double"), allowMissingColumns=True)
    return dealt(rows).mapInArrow(partial(_fold, with_last=False), _TOLD_SQL).withColumn("chain", chain).drop("part")


def _sided(folded: DataFrame) -> DataFrame:
    """Two rows a bout, with the opponent, the outcome and both ratings."""
    points = {"a": F.col("points"), "b": 1 - F.col("points")}
    said = lambda own: F.when(~F.col("rated"), "no_contest").when(points[own] == 0.5, "draw").when(points[own] == 1, "win").otherwise("loss")
    side = lambda own, other: F.struct(F.col(own).alias(OWNER), F.col(other).alias("opponent_id"), said(own).alias("outcome"), F.col(f"{own}_before").alias("rating_before"), F.col(f"{own}_after").alias("rating_after"), F.col(f"{other}_before").alias("opponent_rating"))
    return folded.select(BOUT, DAY, "chain", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select(BOUT, DAY, "chain", "x.*")


def _games(bouts: DataFrame, chain: Column) -> DataFrame:
    """chain: what has ratings of its own, a string."""
    points = F.when(F.col("is_draw"), 0.5).when(F.col("winner_id") == F.col("fighter_a_id"), 1.0).otherwise(0.0)
    return bouts.select(BOUT, DAY, F.col("fighter_a_id").alias("a"), F.col("fighter_b_id").alias("b"), points.alias("points"), (~F.col("is_no_contest")).alias("rated"), chain.alias("chain"))


_RATINGS = ("rating_before", "rating_after", "opponent_rating")


def overall(bouts: DataFrame, least_slice: int = LEAST_SLICE) -> DataFrame:
    """Ratings over all bouts, before and after the date of each; no contests rate nothing."""
    return _sided(_rated(_games(bouts, F.lit("")), least_slice)).select(BOUT, OWNER, *_RATINGS)


def by_division(bouts: DataFrame, division: str = "division", least_slice: int = LEAST_SLICE) -> DataFrame:
    """The same within each division; bouts of an unknown division have none."""
    known = _games(bouts, F.col(division)).where("chain IS NOT NULL")
    return _sided(_rated(known, least_slice)).select(BOUT, OWNER, *_RATINGS, F.col("chain").alias(division))


def sided(bouts: DataFrame, least_slice: int = LEAST_SLICE) -> DataFrame:
    """overall() with date, opponent and outcome, as the fold passes them on; a bout without an outcome fails, as in sides()."""
    return _sided(_rated(_games(bouts.withColumn("winner_id", checked_winner()), F.lit("")), least_slice)).drop("chain")


def by_bout(bouts: DataFrame, least_slice: int = LEAST_SLICE) -> DataFrame:
    """A row a bout: the ratings of fighter_a_id (a_before, a_after) and of fighter_b_id."""
    return _rated(_games(bouts, F.lit("")), least_slice).select(BOUT, *(f"{x}_{when}" for x in "ab" for when in ("before", "after")))


def of_sides(long: DataFrame) -> DataFrame:
    """rating_before, rating_after and opponent_rating in place of by_bout()'s columns, which rows of either side bear; and of fighter_a_id."""
    own = lambda a, b: F.when(F.col(OWNER) == F.col("fighter_a_id"), F.col(a)).otherwise(F.col(b))
    said = {"rating_before": own("a_before", "b_before"), "rating_after": own("a_after", "b_after"), "opponent_rating": own("b_before", "a_before")}
    return long.withColumns(said).drop("a_before", "a_after", "b_before", "b_after")


def so_far() -> dict[str, Column]:
    """Rated bouts, the peak and the mean of the opponents' ratings before each date; rows without a contest count for none."""
    met = lambda c: F.when(F.col("outcome") != "no_contest", F.col(c))
    return {
        "rated_bouts": F.count(met("outcome")).over(prior()),
        "peak": F.greatest(F.lit(START), F.coalesce(F.max(met("rating_after")).over(prior()), F.lit(START))),
        "opponents_mean": F.avg(met("opponent_rating")).over(prior()),
    }


def strength(bouts: DataFrame, rated: DataFrame) -> DataFrame:
    """strengths() of a history and ratings made elsewhere."""
    return strengths(sides(bouts).join(rated, [BOUT, OWNER]).drop("winner_id", "is_no_contest", "is_draw"))


def strengths(long: DataFrame) -> DataFrame:
    """From the ratings: counts, the peak, the change over three rated bouts, and the ratings of the opponents met.

    long: sided(). One shuffle and one sort, by competitor.
    """
    long = ordered(long.where("outcome <> 'no_contest'"))
    beaten = F.when(F.col("outcome") == "win", F.col("opponent_rating"))
    long = with_columns(
        long,
        **so_far(),
        third_last=last_prior(F.first("rating_after"), 3),
        opponents_last_3=last_prior(F.avg("opponent_rating"), 3),
        opponents_last_5=last_prior(F.avg("opponent_rating"), 5),
        beaten_mean=F.avg(beaten).over(prior()),
        beaten_best=F.max(beaten).over(prior()),
    )
    return long.withColumn("change_last_3", F.when(F.col("rated_bouts") >= 3, F.col("rating_before") - F.col("third_last"))).drop("third_last")


def division_debuts(bouts: DataFrame) -> DataFrame:
    """Earlier rated bouts of a competitor in the bout's division, and whether it's the first."""
    long = sides(bouts, "division").where("outcome <> 'no_contest' AND division IS NOT NULL")
    past = Window.partitionBy(OWNER, "division").orderBy(F.unix_date(DAY)).rangeBetween(Window.unboundedPreceding, -1)
    return long.select(BOUT, OWNER, "division", F.count("*").over(past).alias("division_bouts")).withColumn("is_division_debut", F.col("division_bouts") == 0)
