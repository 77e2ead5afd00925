"""The engine's queries over the tables at hand, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.functions import names, parsing
from ringside.functions.windows import BOUT, DAY, OWNER
from ringside.operators import adjusted, catalog, evaluate, governance, history, identity, pairwise, performance, quality, ratings, reconcile, simulate
from ringside.plans.shared import shelve
from ringside.sources import proxy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6, coarse: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Doubles to a few digits (those in `coarse` to four), no negative zero; flags as they are."""
    return df.select(*((F.round(F.col(c), 4 if c in coarse else digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_BOUTS = f"WITH bouts AS ({proxy.duck(proxy.BOUTS)})"
_LONG = (
    _BOUTS
    + """, sided AS (
  SELECT bout_id, fight_date, fighter_a_id AS fighter_id, fighter_b_id AS opponent_id, winner_id, is_no_contest, is_draw, finish_method, division FROM bouts
  UNION ALL SELECT bout_id, fight_date, fighter_b_id, fighter_a_id, winner_id, is_no_contest, is_draw, finish_method, division FROM bouts),
o AS (SELECT *, CASE WHEN is_no_contest THEN 'no_contest' WHEN is_draw THEN 'draw' WHEN winner_id = fighter_id THEN 'win' ELSE 'loss' END AS outcome FROM sided)"""
)
_BACK = (
    _LONG
    + """, back AS (
  SELECT t.bout_id, t.fighter_id, t.fight_date AS at_date, p.fight_date, p.outcome, p.finish_method, p.bout_id AS prior_bout,
    row_number() OVER (PARTITION BY t.bout_id, t.fighter_id ORDER BY p.fight_date DESC, p.bout_id DESC) AS back
  FROM o t JOIN o p ON p.fighter_id = t.fighter_id AND p.fight_date < t.fight_date)"""
)
_STRICT = "PARTITION BY fighter_id ORDER BY fight_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"


def _sides(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return history.sides(proxy.bouts(spark, sf_dir), *keep)


@query(
    _BACK
    + """ SELECT o.bout_id, o.fighter_id, o.opponent_id, o.fight_date, o.outcome, count(b.back) AS prior_bouts,
  count(*) FILTER (b.outcome = 'win') AS prior_wins, count(*) FILTER (b.outcome = 'loss') AS prior_losses, count(*) FILTER (b.outcome = 'draw') AS prior_draws,
  count(*) FILTER (b.outcome = 'no_contest') AS prior_no_contests, CAST(date_diff('day', max(b.fight_date), o.fight_date) AS BIGINT) AS days_since_last,
  count(*) FILTER (b.outcome IN ('win', 'loss')) AS prior_decisive,
  round(count(*) FILTER (b.outcome = 'win') / nullif(count(*) FILTER (b.outcome IN ('win', 'loss')), 0), 6) AS prior_win_rate,
  round(count(*) FILTER (b.outcome = 'loss') / nullif(count(*) FILTER (b.outcome IN ('win', 'loss')), 0), 6) AS prior_loss_rate,
  count(b.back) = 0 AS is_debut
FROM o LEFT JOIN back b ON b.bout_id = o.bout_id AND b.fighter_id = o.fighter_id
GROUP BY o.bout_id, o.fighter_id, o.opponent_id, o.fight_date, o.outcome"""
)
def w01_w02_w03_w08_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.record(_sides(spark, sf_dir))
    return rounded(rows.drop("winner_id", "is_no_contest", "is_draw"))


@query(
    _BACK
    + """ SELECT o.bout_id, o.fighter_id, count(*) FILTER (date_diff('day', b.fight_date, o.fight_date) <= 180) AS bouts_last_180d,
  count(*) FILTER (date_diff('day', b.fight_date, o.fight_date) <= 365) AS bouts_last_365d, count(*) FILTER (date_diff('day', b.fight_date, o.fight_date) <= 730) AS bouts_last_730d
FROM o LEFT JOIN back b ON b.bout_id = o.bout_id AND b.fighter_id = o.fighter_id GROUP BY o.bout_id, o.fighter_id"""
)
def w04_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.activity(_sides(spark, sf_dir)).select(BOUT, OWNER, *(f"bouts_last_{n}d" for n in (180, 365, 730)))


@query(
    _BACK
    + """ SELECT o.bout_id, o.fighter_id, count(*) FILTER (b.outcome = 'win') AS recent_5_win, count(*) FILTER (b.outcome = 'loss') AS recent_5_loss,
  count(*) FILTER (b.outcome = 'draw') AS recent_5_draw, count(*) FILTER (b.outcome = 'no_contest') AS recent_5_no_contest,
  round(count(*) FILTER (b.outcome = 'win') / nullif(count(*) FILTER (b.outcome IN ('win', 'loss')), 0), 6) AS recent_5_win_rate
FROM o LEFT JOIN back b ON b.bout_id = o.bout_id AND b.fighter_id = o.fighter_id AND b.back <= 5 GROUP BY o.bout_id, o.fighter_id"""
)
def w05_recent_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.recent(_sides(spark, sf_dir))
    return rounded(rows.select(BOUT, OWNER, *(f"recent_5_{n}" for n in (*history.OUTCOMES, "win_rate"))))


@query(
    _BACK
    + " SELECT o.bout_id, o.fighter_id, "
    + ", ".join(
        f"coalesce(min(b.back) FILTER (b.outcome NOT IN ({', '.join(repr(x) for x in kept)})) - 1, count(b.back)) AS {name}"
        for name, kept in history.STREAKS.items()
    )
    + " FROM o LEFT JOIN back b ON b.bout_id = o.bout_id AND b.fighter_id = o.fighter_id GROUP BY o.bout_id, o.fighter_id"
)
def w06_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.streaks(_sides(spark, sf_dir)).select(BOUT, OWNER, *history.STREAKS)


_CATEGORY = "CASE WHEN lower({0}) LIKE '%ko%' THEN 'ko_tko' WHEN lower({0}) LIKE '%sub%' THEN 'submission' WHEN lower({0}) LIKE '%dec%' THEN 'decision' ELSE 'other' END"


@query(
    _BACK
    + ", c AS (SELECT *, " + _CATEGORY.format("finish_method") + " AS category FROM back WHERE outcome = 'win')"
    + """ SELECT o.bout_id, o.fighter_id, count(*) FILTER (c.category = 'ko_tko') AS prior_ko_tko_wins, count(*) FILTER (c.category = 'submission') AS prior_submission_wins,
  count(*) FILTER (c.category = 'decision') AS prior_decision_wins, count(*) FILTER (c.category = 'other') AS prior_other_wins,
  round((count(c.category) - count(*) FILTER (c.category = 'decision')) / nullif(count(c.category), 0), 6) AS finish_win_rate
FROM o LEFT JOIN c ON c.bout_id = o.bout_id AND c.fighter_id = o.fighter_id GROUP BY o.bout_id, o.fighter_id"""
)
def w07_finishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.finishes(_sides(spark, sf_dir, "finish_method"))
    return rounded(rows.select(BOUT, OWNER, *(f"prior_{k}_wins" for k in ("ko_tko", "submission", "decision", "other")), "finish_win_rate"))


_XORS = ", ".join(f"coalesce(bit_xor(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT) OVER w, 0) AS x{i}" for i in range(4))
_EVIDENCE = (
    _LONG
    + f""", hs AS (SELECT bout_id, fighter_id, fight_date, sha256(concat_ws('|', bout_id, CAST(fight_date AS VARCHAR), outcome)) AS h FROM o),
xs AS (SELECT bout_id, fighter_id, count(*) OVER w AS n, {_XORS} FROM hs WINDOW w AS ({_STRICT}))
SELECT bout_id, fighter_id, sha256(concat_ws('|', fighter_id, n, x0, x1, x2, x3)) AS evidence_sha256 FROM xs"""
)


def _history_sql(bouts: str = _BOUTS, where: str = "TRUE") -> str:
    """The whole snapshot from the parts above, over a given form of the table of bouts."""
    parts = [ORACLE_SQL[n] for n in ("w01_w02_w03_w08_record", "w04_activity", "w05_recent_five", "w06_streaks", "w07_finishes")] + [_EVIDENCE]
    joined = " JOIN ".join(f"({p.replace(_BOUTS, bouts, 1)}) p{i}" + (" USING (bout_id, fighter_id)" if i else "") for i, p in enumerate(parts))
    return f"SELECT * FROM {joined} WHERE {where}"


@query(_history_sql())
def w09_w10_prefight_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.prefight_history(proxy.bouts(spark, sf_dir)))


@query(
    _LONG
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY fighter_id ORDER BY fight_date DESC, bout_id DESC) AS k, count(*) OVER ("""
    + _STRICT
    + """) AS prior_bouts FROM o) SELECT fighter_id, bout_id, fight_date, outcome, prior_bouts FROM r WHERE k = 1"""
)
def w28_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.record(_sides(spark, sf_dir)).select(OWNER, BOUT, DAY, "outcome", "prior_bouts")
    return history.latest(rows)


@query(
    _LONG
    + ", n AS (SELECT bout_id, fighter_id, count(*) OVER (" + _STRICT + ") AS n FROM o)"
    + """ SELECT b.bout_id, x.n AS a_prior_bouts, y.n AS b_prior_bouts, x.n - y.n AS diff_prior_bouts
FROM bouts b JOIN n x ON x.bout_id = b.bout_id AND x.fighter_id = b.fighter_a_id JOIN n y ON y.bout_id = b.bout_id AND y.fighter_id = b.fighter_b_id"""
)
def w26_prior_bouts_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bout_counts(proxy.bouts(spark, sf_dir))


_PERF = f"WITH perf AS ({proxy.duck(proxy.PERFORMANCE)})"
_PBACK = (
    _PERF
    + """, back AS (SELECT t.bout_id AS at_bout, p.*, row_number() OVER (PARTITION BY t.bout_id, t.fighter_id ORDER BY p.fight_date DESC, p.bout_id DESC) AS back,
  date_diff('day', p.fight_date, t.fight_date) AS age FROM perf t JOIN perf p ON p.fighter_id = t.fighter_id AND p.fight_date < t.fight_date)"""
)


@query(
    _PBACK
    + """, z AS (SELECT at_bout, fighter_id, count(*) AS n, avg(coalesce(knockdowns, 0)) AS ck, avg(coalesce(control_seconds, 0)) AS cc,
   avg(coalesce(knockdowns, 0)) FILTER (back <= 3) AS rk, avg(coalesce(control_seconds, 0)) FILTER (back <= 3) AS rc FROM back GROUP BY at_bout, fighter_id)
SELECT p.bout_id, p.fighter_id, coalesce(z.n, 0) AS prior_rows, round(coalesce(ck, 0), 6) AS career_knockdowns, round(coalesce(cc, 0), 6) AS career_control_seconds,
  round(coalesce(rk, 0), 6) AS rolling_knockdowns, round(coalesce(rc, 0), 6) AS rolling_control_seconds
FROM perf p LEFT JOIN z ON z.at_bout = p.bout_id AND z.fighter_id = p.fighter_id"""
)
def w24_zero_filled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ("knockdowns", "control_seconds")
    rows = history.by_name(proxy.performance(spark, sf_dir), values)
    return rounded(rows.select(BOUT, OWNER, "prior_rows", *(f"career_{v}" for v in values), *(f"rolling_{v}" for v in values)))


@query(
    """WITH back AS (SELECT t.event_id AS at_event, t.ts AS at_ts, p.*, row_number() OVER (PARTITION BY t.event_id ORDER BY p.ts DESC, p.event_id DESC) AS back
  FROM events t JOIN events p ON p.user_id = t.user_id AND p.ts < t.ts),
z AS (SELECT at_event, count(*) AS n, avg(CASE WHEN value > 0 THEN 1.0 WHEN value IS NULL THEN NULL ELSE 0.0 END * 1.0) AS w, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS wins, epoch_us(max(at_ts)) - epoch_us(max(ts)) AS gap, avg(value) AS m,
   avg(value) FILTER (back <= 1) AS m1, avg(value) FILTER (back <= 3) AS m3, avg(value) FILTER (back <= 5) AS m5 FROM back GROUP BY at_event)
SELECT e.event_id, e.user_id, coalesce(n, 0) AS prior_rows, round(wins / n, 6) AS win_rate, round(coalesce(gap / 86400000000.0, -1), 6) AS layoff_days, round(m, 6) AS career_mean,
  round(m1, 6) AS mean_last_1, round(m3, 6) AS mean_last_3, round(m5, 6) AS mean_last_5, round(m3 - m, 6) AS trend
FROM events e LEFT JOIN z ON z.at_event = e.event_id"""
)
def w25_event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = proxy.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return rounded(history.at_timestamps(events).drop("ts", "value"))


def _stats_sql() -> str:
    out = []
    for span, (days, k) in performance.SPANS.items():
        inside = f"b.back <= {k}" if k else f"b.age <= {days}" if days else "true"
        for m in proxy.METRICS:
            out += [
                f"count(b.{m}) FILTER ({inside}) AS {span}_{m}_observed", f"count(*) FILTER ({inside} AND b.at_bout IS NOT NULL AND b.{m} IS NULL) AS {span}_{m}_missing",
                f"CAST(sum(b.{m}) FILTER ({inside}) AS BIGINT) AS {span}_{m}_sum", f"round(sum(b.{m}) FILTER ({inside}) / nullif(count(b.{m}) FILTER ({inside}), 0), 6) AS {span}_{m}_mean",
            ]
    return ", ".join(out)


@query(_PBACK + f" SELECT p.bout_id, p.fighter_id, {_stats_sql()} FROM perf p LEFT JOIN back b ON b.at_bout = p.bout_id AND b.fighter_id = p.fighter_id GROUP BY p.bout_id, p.fighter_id")
def w11_a09_performance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.window_stats(proxy.performance(spark, sf_dir))
    return rounded(rows.select(BOUT, OWNER, *(f"{s}_{m}_{x}" for s in performance.SPANS for m in proxy.METRICS for x in ("observed", "missing", "sum", "mean"))))


@query(
    _PBACK
    + """ SELECT p.bout_id, p.fighter_id, round(sum(b.significant_strikes_landed) / nullif(sum(b.significant_strikes_attempted), 0), 6) AS career_strike_accuracy,
  round(sum(b.total_strikes_landed) / nullif(sum(b.total_strikes_attempted), 0), 6) AS career_total_accuracy, round(sum(b.takedowns_landed) / nullif(sum(b.takedowns_attempted), 0), 6) AS career_takedown_accuracy
FROM perf p LEFT JOIN back b ON b.at_bout = p.bout_id AND b.fighter_id = p.fighter_id GROUP BY p.bout_id, p.fighter_id"""
)
def w12_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = tuple(m for pair in performance.ACCURACY.values() for m in pair)
    rows = performance.accuracy(performance.window_stats(proxy.performance(spark, sf_dir), needed, ("career",)))
    return rounded(rows.select(BOUT, OWNER, *(f"career_{n}_accuracy" for n in performance.ACCURACY)))


def _absorbed_sql(m: str) -> str:
    name = f"absorbed_{m}"
    return (
        f"count(q.{m}) AS {name}_observed, count(*) FILTER (b.at_bout IS NOT NULL AND q.{m} IS NULL) AS {name}_missing, "
        f"CAST(sum(q.{m}) AS BIGINT) AS {name}_sum, round(sum(q.{m}) / nullif(count(q.{m}), 0), 6) AS {name}_mean"
    )


@query(
    _PBACK
    + " SELECT p.bout_id, p.fighter_id, "
    + ", ".join(_absorbed_sql(m) for m in performance.ABSORBED)
    + ", "
    + ", ".join(f"round(1 - sum(q.{landed}) / nullif(sum(q.{tried}), 0), 6) AS {n}_defense" for n, (landed, tried) in performance.ACCURACY.items())
    + """ FROM perf p LEFT JOIN back b ON b.at_bout = p.bout_id AND b.fighter_id = p.fighter_id LEFT JOIN perf q ON q.bout_id = b.bout_id AND q.fighter_id = b.opponent_id
GROUP BY p.bout_id, p.fighter_id"""
)
def w13_w14_j08_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.absorbed(proxy.performance(spark, sf_dir))
    values = (f"absorbed_{m}_{x}" for m in performance.ABSORBED for x in ("observed", "missing", "sum", "mean"))
    return rounded(rows.select(BOUT, OWNER, *values, *(f"{n}_defense" for n in performance.ACCURACY)))


_DURATION = """dur AS (SELECT bout_id, CASE WHEN s < 60 AND finish_round > 0 AND m * 60 + s <= 300 AND (finish_round - 1) * 300 + m * 60 + s > 0 THEN CAST((finish_round - 1) * 300 + m * 60 + s AS BIGINT) END AS duration
  FROM (SELECT bout_id, finish_round, TRY_CAST(regexp_extract(finish_time, '^([0-9]+):([0-9]{1,2})$', 1) AS BIGINT) AS m, TRY_CAST(regexp_extract(finish_time, '^([0-9]+):([0-9]{1,2})$', 2) AS BIGINT) AS s FROM bouts) x)"""


@query(_BOUTS + ", " + _DURATION + " SELECT bout_id, duration FROM dur")
def w17_f17_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.durations(proxy.bouts(spark, sf_dir))


@query(
    _BOUTS + ", " + _DURATION + _PBACK.replace("WITH perf", ", perf", 1)
    + """ SELECT p.bout_id, p.fighter_id, d.duration, count(e.duration) AS timed_bouts, count(*) FILTER (b.at_bout IS NOT NULL AND e.duration IS NULL) AS untimed_bouts, """
    + ", ".join(f"round({k} * sum(b.{m}) FILTER (e.duration IS NOT NULL) / nullif(sum(e.duration) FILTER (b.{m} IS NOT NULL), 0), 6) AS {n}" for n, (m, k) in performance.PACES.items())
    + """ FROM perf p LEFT JOIN dur d ON d.bout_id = p.bout_id LEFT JOIN back b ON b.at_bout = p.bout_id AND b.fighter_id = p.fighter_id LEFT JOIN dur e ON e.bout_id = b.bout_id GROUP BY p.bout_id, p.fighter_id, d.duration"""
)
def w15_w16_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performance.pace(proxy.performance(spark, sf_dir), proxy.bouts(spark, sf_dir))
    return rounded(rows.select(BOUT, OWNER, "duration", "timed_bouts", "untimed_bouts", *performance.PACES))


@query(_PERF + " SELECT count(*) FILTER (significant_strikes_landed > significant_strikes_attempted) AS strike_violations, count(*) FILTER (total_strikes_landed > total_strikes_attempted) AS total_violations, count(*) FILTER (takedowns_landed > takedowns_attempted) AS takedown_violations FROM perf")
def x06_landed_above_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.landed_above_attempted(proxy.performance(spark, sf_dir))


def _ratings_sql(division: str = "''", where: str = "TRUE") -> str:
    """Ratings date by date: every player's rating after each date, from that after the date before."""
    return (
        _BOUTS.replace("WITH", "WITH RECURSIVE", 1)
        + f""", g AS MATERIALIZED (SELECT bout_id, {division} AS division, fighter_a_id, fighter_b_id, concat({division}, '|', fighter_a_id) AS a, concat({division}, '|', fighter_b_id) AS b, NOT is_no_contest AS rated,
    CASE WHEN is_draw THEN 0.5::DOUBLE WHEN winner_id = fighter_a_id THEN 1 ELSE 0 END AS points, dense_rank() OVER (PARTITION BY {division} ORDER BY fight_date) AS d FROM bouts WHERE {where}),
r(d, player, rating) AS (SELECT 0::BIGINT, player, 1500::DOUBLE FROM (SELECT a AS player FROM g UNION SELECT b FROM g) x
  UNION ALL SELECT r.d + 1, r.player, r.rating + coalesce(c.gain, 0) FROM r LEFT JOIN (SELECT player, sum(gain) AS gain FROM (
      SELECT unnest([a, b]) AS player, unnest([x, -x]) AS gain FROM (
        SELECT g.a, g.b, 24 * (points - 1 / (1 + power(10, (y.rating - z.rating) / 400))) AS x FROM g JOIN r z ON z.player = g.a AND z.d + 1 = g.d JOIN r y ON y.player = g.b AND y.d = z.d WHERE rated) q) p GROUP BY player) c ON c.player = r.player
    WHERE r.d < (SELECT max(d) FROM g)),
sided AS (SELECT bout_id, division, d, fighter_a_id AS fighter_id, a AS player, b AS other FROM g UNION ALL SELECT bout_id, division, d, fighter_b_id, b, a FROM g),
rated AS (SELECT s.bout_id, s.fighter_id, s.division, x.rating AS rating_before, y.rating AS rating_after, z.rating AS opponent_rating FROM sided s
  JOIN r x ON x.player = s.player AND x.d = s.d - 1 JOIN r y ON y.player = s.player AND y.d = s.d JOIN r z ON z.player = s.other AND z.d = s.d - 1)"""
    )


#: Four digits: a recurrence over thousands of dates adds up in another order elsewhere.
_RATED_COLUMNS = "bout_id, fighter_id, round(rating_before, 4) AS rating_before, round(rating_after, 4) AS rating_after, round(opponent_rating, 4) AS opponent_rating"


@query(_ratings_sql() + f" SELECT {_RATED_COLUMNS} FROM rated")
def w18_overall_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratings.overall(proxy.bouts(spark, sf_dir)), 4)


@query(_ratings_sql("division", "division IS NOT NULL") + f" SELECT {_RATED_COLUMNS}, division FROM rated")
def w19_division_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratings.by_division(proxy.bouts(spark, sf_dir)), 4)


@query(
    _LONG
    + """, d AS (SELECT *, count(*) OVER (PARTITION BY fighter_id, division ORDER BY fight_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS division_bouts FROM o WHERE outcome <> 'no_contest' AND division IS NOT NULL)
SELECT bout_id, fighter_id, division, division_bouts, division_bouts = 0 AS is_division_debut FROM d"""
)
def w19_division_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.division_debuts(proxy.bouts(spark, sf_dir))


@query(
    _ratings_sql()
    + """, o AS (SELECT rated.*, b.fight_date, CASE WHEN fighter_id = fighter_a_id THEN fighter_b_id ELSE fighter_a_id END AS opponent_id, CASE WHEN is_draw THEN 'draw' WHEN winner_id = fighter_id THEN 'win' ELSE 'loss' END AS outcome
  FROM rated JOIN bouts b USING (bout_id) WHERE NOT is_no_contest),
back AS (SELECT t.bout_id, t.fighter_id, p.rating_after, p.opponent_rating, CASE WHEN p.outcome = 'win' THEN p.opponent_rating END AS beaten, row_number() OVER (PARTITION BY t.bout_id, t.fighter_id ORDER BY p.fight_date DESC, p.bout_id DESC) AS back
  FROM o t JOIN o p ON p.fighter_id = t.fighter_id AND p.fight_date < t.fight_date)
SELECT o.bout_id, o.fighter_id, fight_date, opponent_id, outcome, round(max(rating_before), 4) AS rating_before, round(max(o.rating_after), 4) AS rating_after, round(max(o.opponent_rating), 4) AS opponent_rating,
  count(b.back) AS rated_bouts, round(greatest(1500, coalesce(max(b.rating_after), 1500)), 4) AS peak, round(max(rating_before) - max(b.rating_after) FILTER (back = 3), 4) AS change_last_3,
  round(avg(b.opponent_rating), 4) AS opponents_mean, round(avg(b.opponent_rating) FILTER (back <= 3), 4) AS opponents_last_3, round(avg(b.opponent_rating) FILTER (back <= 5), 4) AS opponents_last_5,
  round(avg(beaten), 4) AS beaten_mean, round(max(beaten), 4) AS beaten_best
FROM o LEFT JOIN back b ON b.bout_id = o.bout_id AND b.fighter_id = o.fighter_id GROUP BY o.bout_id, o.fighter_id, fight_date, opponent_id, outcome"""
)
def w20_w21_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ratings.strengths(ratings.sided(proxy.bouts(spark, sf_dir)))
    return rounded(long, 4)


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once: it meets itself twice, as the opponent's
    rows = shelve(proxy.performance(spark, sf_dir).select(BOUT, DAY, OWNER, "opponent_id", *performance.ABSORBED))
    own = performance.absorbed(performance.window_stats(rows, adjusted.ADJUSTED, ("career",)))
    return adjusted.observations(rows, own)


_ADJ = (
    _PBACK
    + ", usual AS (SELECT p.bout_id, p.fighter_id, "
    + ", ".join(f"avg(b.{m}) AS does_{m}, avg(q.{m}) AS allows_{m}" for m in adjusted.ADJUSTED)
    + """ FROM perf p LEFT JOIN back b ON b.at_bout = p.bout_id AND b.fighter_id = p.fighter_id LEFT JOIN perf q ON q.bout_id = b.bout_id AND q.fighter_id = b.opponent_id GROUP BY p.bout_id, p.fighter_id),
adj AS (SELECT p.bout_id, p.fighter_id, p.fight_date, """
    + ", ".join(f"(p.{m} - q.{m}) - (u.allows_{m} - u.does_{m}) AS adjusted_{m}" for m in adjusted.ADJUSTED)
    + " FROM perf p JOIN perf q ON q.bout_id = p.bout_id AND q.fighter_id = p.opponent_id JOIN usual u ON u.bout_id = p.bout_id AND u.fighter_id = p.opponent_id)"
)


@query(_ADJ + " SELECT bout_id, fighter_id, " + ", ".join(f"round(adjusted_{m}, 6) AS adjusted_{m}" for m in adjusted.ADJUSTED) + " FROM adj")
def w22_j09_adjusted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_adjusted(spark, sf_dir).select(BOUT, OWNER, *(f"adjusted_{m}" for m in adjusted.ADJUSTED)))


def _snapshot_sql(m: str) -> str:
    return f""", ab_{m} AS (SELECT t.bout_id, t.fighter_id, p.adjusted_{m} AS v, row_number() OVER (PARTITION BY t.bout_id, t.fighter_id ORDER BY p.fight_date DESC, p.bout_id DESC) AS back
  FROM adj t JOIN adj p ON p.fighter_id = t.fighter_id AND p.fight_date < t.fight_date WHERE p.adjusted_{m} IS NOT NULL),
s_{m} AS (SELECT bout_id, fighter_id, count(*) AS {m}_count, round(avg(v), 5) AS {m}_mean, round(avg(v) FILTER (back <= 3), 5) AS {m}_last_3, round(avg(v) FILTER (back <= 5), 5) AS {m}_last_5 FROM ab_{m} GROUP BY bout_id, fighter_id)"""


_SNAPSHOTS = (
    _ADJ
    + "".join(map(_snapshot_sql, adjusted.ADJUSTED))
    + " SELECT bout_id, fighter_id, "
    + ", ".join(f"coalesce({m}_count, 0) AS {m}_count, {m}_mean, {m}_last_3, {m}_last_5" for m in adjusted.ADJUSTED)
    + " FROM adj "
    + " ".join(f"LEFT JOIN s_{m} USING (bout_id, fighter_id)" for m in adjusted.ADJUSTED)
)


@query(_SNAPSHOTS)
def w23_adjusted_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjusted.snapshots(_adjusted(spark, sf_dir)), 5)


_RATES = (
    _LONG
    + ", rates AS (SELECT bout_id, fighter_id, CAST(count(*) FILTER (outcome = 'win') OVER (" + _STRICT + ") AS DOUBLE) / nullif(count(*) FILTER (outcome IN ('win', 'loss')) OVER (" + _STRICT + "), 0) AS rate, count(*) OVER (" + _STRICT + ") AS n FROM o)"
    + """, paired AS (SELECT b.bout_id, b.fight_date, b.fighter_a_id, b.fighter_b_id, b.winner_id, b.is_draw, b.is_no_contest, b.division, x.n AS a_prior_bouts, y.n AS b_prior_bouts, x.rate AS a_prior_win_rate, y.rate AS b_prior_win_rate,
    CAST(x.n AS DOUBLE) - y.n AS diff_prior_bouts, x.rate - y.rate AS diff_prior_win_rate
  FROM bouts b JOIN rates x ON x.bout_id = b.bout_id AND x.fighter_id = b.fighter_a_id JOIN rates y ON y.bout_id = b.bout_id AND y.fighter_id = b.fighter_b_id)"""
)
_FEATURES = ["prior_bouts", "prior_win_rate"]


_BOUT_COLUMNS = [BOUT, DAY, "fighter_a_id", "fighter_b_id", "winner_id", "is_draw", "is_no_contest", "division"]


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = history.sides(proxy.bouts(spark, sf_dir), "fighter_a_id", "fighter_b_id", "division")
    return pairwise.sides_met(history.record(long), _BOUT_COLUMNS, _FEATURES)


_PAIR_COLUMNS = "a_prior_bouts, b_prior_bouts, round(a_prior_win_rate, 6) AS a_prior_win_rate, round(b_prior_win_rate, 6) AS b_prior_win_rate, diff_prior_bouts, round(diff_prior_win_rate, 6) AS diff_prior_win_rate"


@query(_RATES + f" SELECT bout_id, {_PAIR_COLUMNS}, a_prior_win_rate IS NULL AS a_prior_win_rate_missing, diff_prior_win_rate IS NULL AS diff_prior_win_rate_missing FROM paired")
def j10_u07_f35_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paired(spark, sf_dir).select(BOUT, *pairwise.oriented(_FEATURES), "a_prior_win_rate_missing", "diff_prior_win_rate_missing"))


@query(_RATES + f" SELECT bout_id, fight_date, {_PAIR_COLUMNS}, CAST(winner_id = fighter_a_id AS INTEGER) AS a_won FROM paired WHERE NOT is_draw AND NOT is_no_contest")
def p11_model_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairwise.model_ready(_paired(spark, sf_dir), _FEATURES)
    return rounded(rows.select(BOUT, DAY, *pairwise.oriented(_FEATURES), "a_won"))


@query(
    _RATES
    + """ SELECT bout_id, b_prior_bouts AS a_prior_bouts, a_prior_bouts AS b_prior_bouts, round(b_prior_win_rate, 6) AS a_prior_win_rate, round(a_prior_win_rate, 6) AS b_prior_win_rate,
  0.0 - diff_prior_bouts AS diff_prior_bouts, round(b_prior_win_rate - a_prior_win_rate, 6) AS diff_prior_win_rate, fighter_b_id AS fighter_a_id, fighter_a_id AS fighter_b_id, 1 - CAST(winner_id = fighter_a_id AS INTEGER) AS a_won
FROM paired WHERE NOT is_draw AND NOT is_no_contest"""
)
def u08_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairwise.swapped(pairwise.model_ready(_paired(spark, sf_dir), _FEATURES))
    return rounded(rows.select(BOUT, *pairwise.oriented(_FEATURES), "fighter_a_id", "fighter_b_id", "a_won"))


@query(_RATES + " SELECT s.is_swap, count(*) AS n, CAST(sum(CASE WHEN s.is_swap THEN 1 - w ELSE w END) AS BIGINT) AS won FROM (SELECT CAST(winner_id = fighter_a_id AS INTEGER) AS w FROM paired WHERE NOT is_draw AND NOT is_no_contest) p, (VALUES (false), (true)) s(is_swap) GROUP BY s.is_swap")
def u02_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairwise.augmented(pairwise.model_ready(_paired(spark, sf_dir), _FEATURES))
    return rows.groupBy("is_swap").agg(F.count("*").alias("n"), F.sum("a_won").alias("won"))


def _contradicted(i: int) -> str:
    """Pairs whose flag of the i-th column is turned round, so that the check has something to find."""
    return f"(a_prior_bouts + 2 * b_prior_bouts) % {5 + i} = {i % 3}"


@query(_RATES + " SELECT " + ", ".join(f"count(*) FILTER ({_contradicted(i)}) AS {n}_mismatches" for i, n in enumerate(pairwise.oriented(_FEATURES))) + " FROM paired")
def p12_missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = {f"{n}_missing": F.col(f"{n}_missing") != F.expr(_contradicted(i)) for i, n in enumerate(pairwise.oriented(_FEATURES))}
    return pairwise.missing_mismatches(_paired(spark, sf_dir).withColumns(planted), _FEATURES)


_S1, _S2 = proxy.duck(proxy.SOURCE_ONE), proxy.duck(proxy.SOURCE_TWO)
_KEY = "nullif(trim(regexp_replace(regexp_replace(lower({0}), '[''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
_SIDE = """CASE WHEN lower(trim(outcome)) IN ('red', 'red_win') THEN rk WHEN lower(trim(outcome)) IN ('blue', 'blue_win') THEN bk WHEN lower(trim(outcome)) IN ('draw', 'draws') THEN 'draw'
  WHEN lower(trim(outcome)) IN ('nc', 'no contest', 'no_contest', 'overturned') THEN 'no_contest' ELSE 'uninterpreted:' || lower(trim(outcome)) END"""


def _keyed_sql(source: str) -> str:
    return f"""SELECT *, {_SIDE} AS winner, CAST(event_date AS VARCHAR) || '|' || least(rk, bk) || '|' || greatest(rk, bk) AS match_key,
  count(*) OVER (PARTITION BY CAST(event_date AS VARCHAR) || '|' || least(rk, bk) || '|' || greatest(rk, bk)) AS same FROM (SELECT *, {_KEY.format('red_name')} AS rk, {_KEY.format('blue_name')} AS bk FROM ({source}) s0) s1"""


_FORMS = {
    "outcome": ("{0}.winner", "{0}.winner"),
    "method": ("{0}.method", "replace(" + _KEY.format("{0}.method") + ", ' ', '_')"),
    "rounds": ("{0}.rounds", "TRY_CAST(regexp_extract(trim({0}.rounds), '^([0-9]+)(\\s|$)', 1) AS INTEGER)"),
    "division": ("{0}.division", "trim(regexp_replace(" + _KEY.format("{0}.division") + ", ' bout$', ''))"),
    "clock": ("{0}.clock", "TRY_CAST(regexp_extract({0}.clock, '^([0-9]+):', 1) AS BIGINT) * 60 + TRY_CAST(regexp_extract({0}.clock, ':([0-9]+)$', 1) AS BIGINT)"),
    "round_no": ("CAST({0}.round_no AS VARCHAR)", "{0}.round_no"),
}


def _status_sql(field: str) -> str:
    raw, key = _FORMS[field]
    l, r, lk, rk = raw.format("l"), raw.format("r"), key.format("l"), key.format("r")
    return f"CASE WHEN {l} IS NULL AND {r} IS NULL THEN 'missing_both' WHEN {l} IS NULL THEN 'missing_left' WHEN {r} IS NULL THEN 'missing_right' WHEN {l} = {r} THEN 'equal' WHEN {lk} = {rk} THEN 'equivalent' ELSE 'differs' END"


_RECON = (
    f"WITH one AS ({_keyed_sql(_S1)}), two AS ({_keyed_sql(_S2)}), j AS (SELECT coalesce(l.match_key, r.match_key) AS match_key, l.record_id AS left_id, r.record_id AS right_id, l.winner AS l_winner, r.winner AS r_winner, "
    "CASE WHEN l.same > 1 OR r.same > 1 THEN 'ambiguous' WHEN r.record_id IS NULL THEN 'only_left' WHEN l.record_id IS NULL THEN 'only_right' ELSE 'both' END AS matching, "
    + ", ".join(f"{_status_sql(f)} AS {f}_s" for f in reconcile.FIELDS)
    + " FROM one l FULL OUTER JOIN two r ON l.match_key = r.match_key), k AS (SELECT match_key, left_id, right_id, l_winner, r_winner, matching, "
    + ", ".join(f"CASE WHEN matching = 'both' THEN {f}_s END AS {f}_status" for f in reconcile.FIELDS)
    + ", "
    + " + ".join(f"CAST({f}_s = 'differs' AS INTEGER)" for f in reconcile.FIELDS)
    + " AS n_diff, concat_ws('+', "
    + ", ".join(f"CASE WHEN {f}_s = 'differs' THEN '{f}' END" for f in reconcile.FIELDS)
    + ") AS combination FROM j), c AS (SELECT *, CASE WHEN matching <> 'both' THEN matching WHEN outcome_status = 'differs' THEN 'outcome_conflict' WHEN n_diff > 1 THEN 'several_differ' WHEN n_diff = 1 THEN combination || '_differs' WHEN "
    + " AND ".join(f"{f}_status IN ('equal', 'missing_both')" for f in reconcile.FIELDS)
    + " THEN 'exact' ELSE 'equivalent' END AS class FROM k)"
)
_RECON_COLUMNS = "match_key, left_id, right_id, matching, " + ", ".join(f"{f}_status" for f in reconcile.FIELDS) + ", class"


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sources of the bouts, which are made and written once."""
    bouts = shelve(proxy.bouts(spark, sf_dir))
    return proxy.source_one(spark, sf_dir, bouts), proxy.source_two(spark, sf_dir, bouts)


@query(_RECON + f" SELECT {_RECON_COLUMNS} FROM c")
def j01_j02_f24_f25_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconciliation(*_sources(spark, sf_dir))


@query(
    _RECON
    + " SELECT 'class' AS kind, class AS name, count(*) AS n FROM c GROUP BY class UNION ALL SELECT 'combination', combination, count(*) FROM c WHERE matching = 'both' AND n_diff > 0 GROUP BY combination UNION ALL SELECT 'field', name, count(*) FROM ("
    + " UNION ALL ".join(f"SELECT '{f}:' || {f}_status AS name FROM c WHERE matching = 'both'" for f in reconcile.FIELDS)
    + ") f GROUP BY name"
)
def a08_reconciliation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.report(*_sources(spark, sf_dir))


@query(_RECON + f" SELECT {_RECON_COLUMNS} FROM c WHERE class IN ('ambiguous', 'outcome_conflict', 'several_differ')")
def x02_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.for_review(*_sources(spark, sf_dir))


_WALK = (
    _RECON
    + ", walk AS (SELECT DISTINCT sha256(match_key) AS bout_key, 'one' AS source, left_id AS record_id, CASE WHEN right_id IS NULL THEN 'opens' ELSE 'attaches' END AS role FROM c WHERE left_id IS NOT NULL UNION SELECT DISTINCT sha256(match_key), 'two', right_id, 'opens' FROM c WHERE right_id IS NOT NULL)"
)


@query(_WALK + " SELECT bout_key, source, record_id, role FROM walk")
def j03_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.crosswalk(*_sources(spark, sf_dir))


@query(_WALK + " SELECT bout_key, string_agg(source, ',' ORDER BY source) AS sources, string_agg(record_id, ',' ORDER BY record_id) AS records FROM walk GROUP BY bout_key")
def a01_semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.semantic_groups(reconcile.crosswalk(*_sources(spark, sf_dir)))


@query(
    _WALK
    + f""", d1 AS (SELECT w.bout_key, min(trim(regexp_replace({_KEY.format('s.division')}, ' bout$', ''))) AS d FROM walk w JOIN ({_S1}) s ON s.record_id = w.record_id WHERE w.source = 'one' GROUP BY 1),
d2 AS (SELECT w.bout_key, min(trim(regexp_replace({_KEY.format('s.division')}, ' bout$', ''))) AS d FROM walk w JOIN ({_S2}) s ON s.record_id = w.record_id WHERE w.source = 'two' GROUP BY 1)
SELECT coalesce(d1.bout_key, d2.bout_key) AS bout_key, coalesce(d1.d, d2.d) AS division FROM d1 FULL OUTER JOIN d2 ON d1.bout_key = d2.bout_key"""
)
def j13_division_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _sources(spark, sf_dir)
    return reconcile.division_of(reconcile.crosswalk(one, two), one, two)


@query(_RECON + " SELECT left_id, right_id, CASE WHEN l_winner = r_winner THEN l_winner WHEN right(left_id, 1) = '7' THEN l_winner END AS winner, CASE WHEN l_winner = r_winner THEN 'agreed' WHEN right(left_id, 1) = '7' AND l_winner IS NOT NULL THEN 'decided' ELSE 'open' END AS basis FROM c WHERE matching = 'both'")
def j04_g04_resolved_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _sources(spark, sf_dir)
    rows = reconcile.compared(one, two).where("matching = 'both'")
    decisions = rows.where(F.col("l.record_id").endswith("7")).select(F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), F.col("l.winner").alias("winner"))
    return reconcile.resolved_outcomes(one, two, decisions)


_ALIASES = f"WITH al AS (SELECT record_id, 'red' AS side, red_name AS raw FROM ({_S1}) a UNION ALL SELECT record_id, 'blue', blue_name FROM ({_S1}) b UNION ALL SELECT record_id, 'red', red_name FROM ({_S2}) c UNION ALL SELECT record_id, 'blue', blue_name FROM ({_S2}) d), nk AS (SELECT *, {_KEY.format('raw')} AS name_key FROM al)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _sources(spark, sf_dir)
    return identity.alias_rows(one).unionByName(identity.alias_rows(two))


@query(_ALIASES + " SELECT record_id, side, raw, name_key FROM nk")
def x23_f01_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir)


@query(
    _ALIASES
    + """, g AS (SELECT name_key, raw, count(*) AS n FROM nk GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY n DESC, raw) AS k FROM g)
SELECT name_key, max(raw) FILTER (k = 1) AS name, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS records FROM r GROUP BY name_key"""
)
def x08_canonical_fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_fighters(_aliases(spark, sf_dir)).drop("fighter_id")


@query(
    _ALIASES
    + """, h AS (SELECT DISTINCT name_key, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('fighter:' || name_key)) AS h FROM nk)
SELECT name_key, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), printf('%02x', (('0x' || substr(h, 17, 2))::INTEGER & 63) | 128) || substr(h, 19, 2), substr(h, 21, 12)) AS fighter_id FROM h"""
)
def f03_fighter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_fighters(_aliases(spark, sf_dir)).select("name_key", "fighter_id")


@query(_ALIASES + ", g AS (SELECT name_key, raw, min(raw) OVER (PARTITION BY name_key) AS first_raw FROM (SELECT DISTINCT name_key, raw FROM nk) x) SELECT name_key, first_raw, raw, 'review_required' AS state, CAST(1 AS DOUBLE) AS score FROM g WHERE raw <> first_raw")
def j17_x24_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.candidate_pairs(_aliases(spark, sf_dir))


@query(_ALIASES + ", g AS (SELECT name_key, raw, count(*) AS n FROM nk GROUP BY 1, 2) SELECT name_key, string_agg(raw, '; ' ORDER BY raw) AS spellings, CAST(sum(n) AS BIGINT) AS records FROM g GROUP BY name_key HAVING count(*) > 1")
def a22_a21_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.review_queue(_aliases(spark, sf_dir))


@query(_ALIASES + f", dv AS (SELECT record_id, division FROM ({_S1}) s UNION ALL SELECT record_id, division FROM ({_S2}) s) SELECT name_key, count(DISTINCT division) AS divisions FROM nk JOIN dv USING (record_id) GROUP BY name_key HAVING count(DISTINCT division) >= 2")
def f02_homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _sources(spark, sf_dir)
    return identity.homonyms(_aliases(spark, sf_dir), one.select("record_id", "division").unionByName(two.select("record_id", "division")))


_PRED = (
    _RATES
    + """, pred AS (SELECT bout_id, fight_date, division, fighter_a_id, fighter_b_id, CAST(winner_id = fighter_a_id AS INTEGER) AS a_won,
  round(1 / (1 + exp(-4 * coalesce(diff_prior_win_rate, 0))), 6) AS p FROM paired WHERE NOT is_draw AND NOT is_no_contest)"""
)
_SPLIT = (
    _PRED
    + """, days AS (SELECT fight_date, count(*) AS n FROM pred GROUP BY 1), run AS (SELECT fight_date, sum(n) OVER (ORDER BY fight_date) AS until, (SELECT sum(n) FROM days) AS total FROM days),
cut AS (SELECT (SELECT fight_date FROM run ORDER BY abs(until - 0.7 * total), fight_date LIMIT 1) AS c1, (SELECT fight_date FROM run ORDER BY abs(until - 0.85 * total), fight_date LIMIT 1) AS c2, (SELECT fight_date FROM run ORDER BY abs(until - 0.55 * total), fight_date LIMIT 1) AS c0, (SELECT max(fight_date) FROM run) AS c3),
split AS (SELECT pred.*, CASE WHEN fight_date <= c1 THEN 'train' WHEN fight_date <= c2 THEN 'validation' ELSE 'test' END AS split FROM pred, cut),
folds AS (SELECT pred.*, 'fold_1' AS fold, CASE WHEN fight_date <= c0 THEN 'train' ELSE 'validation' END AS part FROM pred, cut WHERE fight_date <= c1
  UNION ALL SELECT pred.*, 'fold_2', CASE WHEN fight_date <= c1 THEN 'train' ELSE 'validation' END FROM pred, cut WHERE fight_date <= c2
  UNION ALL SELECT pred.*, 'fold_3', CASE WHEN fight_date <= c2 THEN 'train' ELSE 'validation' END FROM pred, cut WHERE fight_date <= c3)"""
)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir).where(~F.col("is_draw") & ~F.col("is_no_contest"))
    p = F.round(1 / (1 + F.exp(-4 * F.coalesce("diff_prior_win_rate", F.lit(0.0)))), 6)
    return rows.select(BOUT, DAY, "division", "fighter_a_id", "fighter_b_id", (F.col("winner_id") == F.col("fighter_a_id")).cast("int").alias("a_won"), p.alias("p"))


@query(_SPLIT + " SELECT split, count(*) AS n, min(fight_date) AS first_date, max(fight_date) AS last_date FROM split GROUP BY split")
def w29_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.temporal_split(_predictions(spark, sf_dir))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min(DAY).alias("first_date"), F.max(DAY).alias("last_date"))


@query(_SPLIT + " SELECT fold, part, count(*) AS n, CAST(sum(a_won) AS BIGINT) AS positives, min(fight_date) AS first_date, max(fight_date) AS last_date FROM folds GROUP BY fold, part")
def w30_x43_rolling_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fold_summary(evaluate.rolling_folds(_predictions(spark, sf_dir)))


@query(_SPLIT + ", v AS (SELECT * FROM folds WHERE part = 'validation'), st AS (SELECT fold AS target_fold, min(fight_date) AS from_date FROM v GROUP BY fold) SELECT target_fold, count(*) AS n, max(fight_date) AS last_date FROM v JOIN st ON fight_date < from_date GROUP BY target_fold")
def w31_earlier_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.rolling_folds(_predictions(spark, sf_dir)).where("part = 'validation'")
    return evaluate.earlier_predictions(rows).groupBy("target_fold").agg(F.count("*").alias("n"), F.max(DAY).alias("last_date"))


_METRICS_SQL = """SELECT division, count(*) AS n, count(*) FILTER (a_won = 1 AND p >= 0.5) AS tp, count(*) FILTER (a_won = 0 AND p >= 0.5) AS fp, count(*) FILTER (a_won = 0 AND p < 0.5) AS tn, count(*) FILTER (a_won = 1 AND p < 0.5) AS fn,
  avg(-(a_won * ln(p) + (1 - a_won) * ln(1 - p))) AS log_loss, avg((p - a_won) * (p - a_won)) AS brier FROM pred GROUP BY division"""


@query(
    _PRED
    + f", m AS ({_METRICS_SQL})"
    + """, rk AS (SELECT division, a_won, rank() OVER (PARTITION BY division ORDER BY p) + (count(*) OVER (PARTITION BY division, p) - 1) / 2.0 AS r FROM pred),
au AS (SELECT division, (sum(r) FILTER (a_won = 1) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0) AS auc FROM (SELECT *, count(*) FILTER (a_won = 1) OVER (PARTITION BY division) AS n1, count(*) FILTER (a_won = 0) OVER (PARTITION BY division) AS n0 FROM rk) x GROUP BY division, n1, n0)
SELECT m.division, n, tp, fp, tn, fn, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(auc, 6) AS auc
FROM m JOIN au USING (division)"""
)
def a11_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics(_predictions(spark, sf_dir), ["division"]))


_BINS = _PRED + ", b AS (SELECT *, CASE WHEN p >= 1 THEN 9 ELSE CAST(" + " + ".join(f"CAST(p >= CAST({i} AS DOUBLE) / 10 AS INTEGER)" for i in range(1, 10)) + " AS INTEGER) END AS bin FROM pred)"


@query(
    _BINS
    + """ SELECT d.division, r.bin, coalesce(count(b.p), 0) AS n, round(avg(b.p), 6) AS mean_p, round(avg(CAST(b.a_won AS DOUBLE)), 6) AS rate
FROM (SELECT DISTINCT division FROM pred) d CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) r LEFT JOIN b ON b.division = d.division AND b.bin = r.bin GROUP BY d.division, r.bin"""
)
def a12_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration(_predictions(spark, sf_dir), ["division"]))


@query(_BINS + ", g AS (SELECT division, bin, count(*) AS n, abs(avg(p) - avg(a_won)) AS gap FROM b GROUP BY 1, 2) SELECT division, round(sum(n * gap) / sum(n), 6) AS ece FROM g GROUP BY division")
def a12_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration_error(_predictions(spark, sf_dir), ["division"]))


@query(
    _SPLIT
    + """, y AS (SELECT split.*, CAST(year(split.fight_date) AS BIGINT) AS year, CAST(q.diff_prior_win_rate IS NULL AS INTEGER) + CAST(q.a_prior_win_rate IS NULL AS INTEGER) AS mc FROM split JOIN paired q USING (bout_id))
SELECT split, year, count(*) AS n, round(avg(a_won), 6) AS prevalence, min(fight_date) AS first_date, max(fight_date) AS last_date, round(sum(mc) / (2.0 * count(*)), 6) AS missing_share FROM y GROUP BY GROUPING SETS ((split), (split, year))"""
)
def a13_a29_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairwise.model_ready(_paired(spark, sf_dir), _FEATURES)
    return rounded(evaluate.split_summary(evaluate.temporal_split(rows), ["diff_prior_win_rate", "a_prior_win_rate"]))


_SCORES = (
    _SPLIT
    + """, cand AS (SELECT 'plain' AS candidate, fold, a_won, p FROM folds WHERE part = 'validation' UNION ALL SELECT 'half', fold, a_won, 0.5 FROM folds WHERE part = 'validation' UNION ALL SELECT 'damped', fold, a_won, round(0.5 * p + 0.25, 6) FROM folds WHERE part = 'validation'),
scores AS (SELECT candidate, fold, avg(-(a_won * ln(p) + (1 - a_won) * ln(1 - p))) AS log_loss FROM cand GROUP BY 1, 2)"""
)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.rolling_folds(_predictions(spark, sf_dir)).where("part = 'validation'")
    each = F.explode(F.array(F.struct(F.lit("plain").alias("candidate"), F.col("p").alias("q")), F.struct(F.lit("half").alias("candidate"), F.lit(0.5).alias("q")), F.struct(F.lit("damped").alias("candidate"), F.round(0.5 * F.col("p") + 0.25, 6).alias("q"))))
    y = F.col("a_won").cast("double")
    return rows.select("fold", "a_won", each.alias("x")).select("fold", "a_won", "x.*").groupBy("candidate", "fold").agg(F.avg(-(y * F.ln("q") + (1 - y) * F.ln(1 - F.col("q")))).alias("log_loss"))


@query(_SCORES + " SELECT candidate, round(avg(log_loss), 6) AS mean, round(stddev_pop(log_loss), 6) AS deviation, round(max(log_loss), 6) AS worst, round(median(log_loss), 6) AS median, count(*) AS folds FROM scores GROUP BY candidate")
def a14_candidate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.fold_aggregates(_scores(spark, sf_dir)))


@query(_SCORES + " SELECT candidate, round(avg(log_loss), 6) AS mean FROM scores GROUP BY candidate ORDER BY avg(log_loss), max(log_loss), stddev_pop(log_loss), candidate LIMIT 1")
def a18_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.selected(evaluate.fold_aggregates(_scores(spark, sf_dir))).select("candidate", "mean"))


@query(_SCORES + " SELECT s.candidate, count(*) FILTER (s.log_loss < c.log_loss) AS won, count(*) AS folds, round(avg(c.log_loss) - avg(s.log_loss), 6) AS gain, (avg(c.log_loss) - avg(s.log_loss) > 0 AND 2 * count(*) FILTER (s.log_loss < c.log_loss) > count(*)) AS promoted FROM scores s JOIN scores c ON c.fold = s.fold AND c.candidate = 'half' WHERE s.candidate <> 'half' GROUP BY s.candidate")
def a19_a20_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.folds_won(_scores(spark, sf_dir), "half"))


_COVER = (
    _PRED
    + ", mg AS (SELECT CAST(range AS DOUBLE) * CAST(0.025 AS DOUBLE) AS margin FROM range(9)), cov AS (SELECT margin, count(*) AS n, count(*) FILTER (abs(p - 0.5) >= margin) AS covered, count(*) FILTER (abs(p - 0.5) >= margin AND (p >= 0.5) = (a_won = 1)) AS \"right\" FROM pred, mg GROUP BY margin), co AS (SELECT *, covered / n AS coverage, \"right\" / nullif(covered, 0) AS accuracy FROM cov)"
)


@query(_COVER + ' SELECT round(margin, 6) AS margin, n, covered, "right", round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM co')
def a15_p22_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.coverage(_predictions(spark, sf_dir), []))


@query(
    _COVER
    + ", ls AS (SELECT unnest([0.5, 0.7, 0.9]) AS least), r AS (SELECT ls.least, co.*, row_number() OVER (PARTITION BY ls.least ORDER BY accuracy DESC, coverage DESC, margin) AS k FROM ls JOIN co ON co.coverage >= ls.least) SELECT CAST(least AS DOUBLE) AS least, round(margin, 6) AS margin, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM r WHERE k = 1"
)
def a16_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.operating_points(evaluate.coverage(_predictions(spark, sf_dir), [])))


@query(_PRED + ", e AS (SELECT abs(p + round(1 - p, 2) - 1) AS e FROM pred) SELECT round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(max(e), 6) AS worst, count(*) FILTER (e > 1e-6) AS above_1e_6, count(*) FILTER (e > 1e-3) AS above_1e_3, count(*) FILTER (e > 1e-2) AS above_1e_2 FROM e")
def a17_complement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("p_swap", F.round(1 - F.col("p"), 2))
    return rounded(evaluate.complement_errors(rows, "p", "p_swap"))


@query(_PRED + " SELECT bout_id, round(0.5 * (p + (1 - round(1 - p, 2))), 7) AS p_symmetric, CASE WHEN abs(p - 0.5) >= 0.125 THEN 'high' WHEN abs(p - 0.5) >= 0.075 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN p > 0.5 THEN fighter_a_id WHEN p < 0.5 THEN fighter_b_id END AS predicted FROM pred")
def p23_p24_f31_prediction_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    p = F.col("p")
    return rounded(rows.select(BOUT, evaluate.symmetric(p, F.round(1 - p, 2)).alias("p_symmetric"), evaluate.tier(p).alias("tier"), evaluate.predicted(p, F.col("fighter_a_id"), F.col("fighter_b_id")).alias("predicted")), 7)


@query(_PRED + " SELECT count(*) AS n, CAST(0 AS BIGINT) AS coverage_differs, count(*) FILTER (p = 0.5) AS ties, CAST(0 AS BIGINT) AS winner_differs FROM pred WHERE abs(abs(p - 0.5) - 0.1) > 1e-9")
def x40_coverage_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).where(F.abs(F.abs(F.col("p") - 0.5) - 0.1) > 1e-9)
    return evaluate.coverage_symmetry(rows, "p", 0.1)


@query(_PRED + ", g AS (SELECT CAST(range AS DOUBLE) / 10 AS w FROM range(11)) SELECT round(w, 6) AS w, round(avg(-(a_won * ln(w * p + (1 - w) * 0.5) + (1 - a_won) * ln(1 - (w * p + (1 - w) * 0.5)))), 6) AS log_loss FROM pred, g GROUP BY w")
def m08_f36_blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.blends(_predictions(spark, sf_dir).withColumn("half", F.lit(0.5)), "p", "half"))


# Catalog


def _fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("f"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("fighter_id"), F.col("s_name").alias("name"), "s_nationkey")


_FIGHTERS = "fighters AS (SELECT 'f' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS fighter_id, s_name AS name, s_nationkey FROM supplier)"


def _alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of competitors over time: a customer's name for the supplier of the same number, later ones superseded."""
    c, n = proxy.read(spark, sf_dir, "customer"), proxy.read(spark, sf_dir, "supplier").count()
    end = F.when(F.col("c_nationkey") % 3 == 0, F.lit("2001-01-01").cast("timestamp"))
    return c.select(F.concat(F.lit("f"), F.lpad((F.col("c_custkey") % n).cast("string"), 6, "0")).alias("fighter_id"), F.col("c_name").alias("alias"), end.alias("system_to"))


_ALIAS_TABLE = "aliases AS (SELECT 'f' || lpad(CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS fighter_id, c_name AS alias, CASE WHEN c_nationkey % 3 = 0 THEN TIMESTAMP '2001-01-01' END AS system_to FROM customer)"


@query(f"WITH {_FIGHTERS}, {_ALIAS_TABLE} SELECT f.fighter_id, name, coalesce(n, 0) AS aliases FROM fighters f LEFT JOIN (SELECT fighter_id, count(*) AS n FROM aliases WHERE system_to IS NULL GROUP BY 1) a USING (fighter_id) WHERE (name, fighter_id) > ('Supplier#000000003', 'f000003') ORDER BY name, fighter_id LIMIT 6")
def q01_l02_j20_a02_fighters_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = catalog.encode_cursor("Supplier#000000003", "f000003")
    page = catalog.keyset_page(_fighters(spark, sf_dir).drop("s_nationkey"), ["name", "fighter_id"], 5, cursor)
    return catalog.with_alias_counts(page, _alias_table(spark, sf_dir))


@query(f"WITH {_FIGHTERS} SELECT fighter_id, name FROM fighters WHERE contains(lower(name), '#00000000')")
def p16_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_fighters(spark, sf_dir), "#00000000").drop("s_nationkey")


@query(
    _LONG
    + f", {_FIGHTERS}, {_ALIAS_TABLE}"
    + ", s AS (SELECT fighter_id, bout_id, fight_date, outcome, count(*) OVER (" + _STRICT + ") AS prior_bouts FROM o), l AS (SELECT * FROM s WHERE fighter_id = 'f000003' ORDER BY fight_date DESC, bout_id DESC LIMIT 1)"
    + " SELECT f.fighter_id, f.name, (SELECT string_agg(alias, ',' ORDER BY coalesce(CAST(system_to AS VARCHAR), '~'), alias) FROM aliases a WHERE a.fighter_id = f.fighter_id) AS names, l.bout_id, l.fight_date, l.outcome, l.prior_bouts FROM fighters f LEFT JOIN l USING (fighter_id) WHERE f.fighter_id = 'f000003'"
)
def q02_x35_fighter_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = history.record(_sides(spark, sf_dir)).select(BOUT, OWNER, DAY, "opponent_id", "outcome", "prior_bouts")
    found = catalog.fighter_detail(_fighters(spark, sf_dir).drop("s_nationkey"), _alias_table(spark, sf_dir), snapshots, "f000003")
    return found.withColumn("names", F.array_join("names", ","))


@query(_LONG + " SELECT fight_date, bout_id, opponent_id, outcome, finish_method FROM o WHERE fighter_id = 'f000003' AND (fight_date, bout_id) < (DATE '1998-06-01', 'b') ORDER BY fight_date DESC, bout_id DESC LIMIT 11")
def q03_l03_fighter_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fighter_history(proxy.bouts(spark, sf_dir), "f000003", 10, catalog.encode_cursor("1998-06-01", "b"))


@query(
    _LONG
    + """, f AS (SELECT division, fighter_id, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, max(fight_date) AS last_date FROM o
  WHERE outcome IN ('win', 'loss') AND date_diff('day', fight_date, (SELECT max(fight_date) FROM bouts)) <= 1095 GROUP BY 1, 2),
s AS (SELECT *, round((wins / (wins + losses) + 1 / (2.0 * (wins + losses)) - sqrt(wins / (wins + losses) * (1 - wins / (wins + losses)) / (wins + losses) + 1 / (4.0 * (wins + losses) * (wins + losses)))) / (1 + 1.0 / (wins + losses)), 4) AS score FROM f WHERE wins + losses >= 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY division ORDER BY score DESC, wins DESC, last_date DESC, fighter_id) AS INTEGER) AS place FROM s) SELECT division, fighter_id, wins, losses, last_date, score, place FROM r WHERE place <= 4"""
)
def q04_a10_l06_standouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.standouts(proxy.bouts(spark, sf_dir))


@query(_BOUTS + f", {_FIGHTERS} SELECT b.bout_id, b.fight_date, x.name AS a_name, y.name AS b_name FROM bouts b LEFT JOIN fighters x ON x.fighter_id = b.fighter_a_id LEFT JOIN fighters y ON y.fighter_id = b.fighter_b_id WHERE division = '1-URGENT' ORDER BY b.fight_date, b.bout_id LIMIT 21 OFFSET 40")
def q05_l04_j23_bouts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = catalog.offset_page(proxy.bouts(spark, sf_dir).where("division = '1-URGENT'"), [DAY, BOUT], 40, 20)
    return catalog.bout_with_sides(page, _fighters(spark, sf_dir)).select(BOUT, DAY, "a_name", "b_name")


@query(
    """WITH runs AS (SELECT event_type AS source, event_id AS run_id, CAST(ts AS DATE) AS requested_at, CASE WHEN event_id % 97 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY requested_at DESC, run_id DESC) AS k FROM runs), i AS (SELECT event_type AS source, count(*) AS open_issues FROM events WHERE value > 200 GROUP BY 1)
SELECT r.source, run_id, requested_at, status, coalesce(open_issues, 0) AS open_issues, CASE WHEN status <> 'ok' THEN 'failed' WHEN coalesce(open_issues, 0) > 0 THEN 'degraded'
  WHEN date_diff('day', requested_at, (SELECT max(requested_at) FROM runs)) > 30 THEN 'stale' ELSE 'fresh' END AS state FROM r LEFT JOIN i USING (source) WHERE k = 1"""
)
def q07_a25_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = proxy.read(spark, sf_dir, "events")
    runs = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("run_id"), F.to_date("ts").alias("requested_at"), F.when(F.col("event_id") % 97 == 0, "failed").otherwise("ok").alias("status"))
    return catalog.freshness(runs, e.select(F.col("event_type").alias("source"), (F.col("value") > 200).alias("is_open")))


@query(
    _RATES
    + """, pool AS (SELECT * FROM paired WHERE fight_date < DATE '2000-01-01' AND winner_id IS NOT NULL), t AS (SELECT * FROM pool WHERE fighter_a_id = 'f000003' AND fighter_b_id = 'f000005' ORDER BY fight_date DESC, bout_id DESC LIMIT 1),
r AS (SELECT * FROM pool ORDER BY fight_date DESC, bout_id DESC LIMIT 500)
SELECT r.bout_id, r.fight_date, round(sqrt(power(coalesce(r.diff_prior_bouts - t.diff_prior_bouts, 0), 2) + power(coalesce(r.diff_prior_win_rate - t.diff_prior_win_rate, 0), 2)), 6) AS distance
FROM r, t WHERE r.bout_id <> t.bout_id ORDER BY sqrt(power(coalesce(r.diff_prior_bouts - t.diff_prior_bouts, 0), 2) + power(coalesce(r.diff_prior_win_rate - t.diff_prior_win_rate, 0), 2)), r.bout_id LIMIT 5"""
)
def q10_l05_similar_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _paired(spark, sf_dir).select(BOUT, *(f"diff_{f}" for f in _FEATURES))
    return rounded(catalog.similar_bouts(proxy.bouts(spark, sf_dir), "f000005", "f000003", "2000-01-01", features))


@query(_S1.join(["WITH s1 AS (", f"), {_FIGHTERS}, u AS (SELECT name, min(fighter_id) AS id FROM fighters GROUP BY name HAVING count(DISTINCT fighter_id) = 1) SELECT s1.record_id, s1.event_date, r.id AS red_id, b.id AS blue_id FROM s1 JOIN u r ON r.name = s1.red_name JOIN u b ON b.name = s1.blue_name WHERE event_date > DATE '2001-06-01' ORDER BY event_date, red_id, blue_id LIMIT 20"]))
def s09_j16_l10_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = proxy.source_one(spark, sf_dir).select("record_id", "event_date", "red_name", "blue_name")
    return catalog.upcoming(card, _fighters(spark, sf_dir), "2001-06-01").select("record_id", "event_date", "red_id", "blue_id")


# Quality and governance

_VALID = f"""WITH s AS ({_S2}), v AS (SELECT record_id, [x FOR x IN [CASE WHEN red_name IS NULL OR blue_name IS NULL OR {_KEY.format('red_name')} = {_KEY.format('blue_name')} THEN 'participants' END, CASE WHEN event_date IS NULL THEN 'date' END,
  CASE WHEN (rounds IS NULL OR NOT regexp_matches(trim(rounds), '^[0-9]')) AND coalesce(rounds, '') <> 'No Time Limit' THEN 'rounds' END,
  CASE WHEN lower(trim(coalesce(outcome, ''))) NOT IN ('red', 'red_win', 'blue', 'blue_win', 'draw', 'draws', 'nc', 'no contest', 'no_contest', 'overturned') THEN 'outcome' END] IF x IS NOT NULL] AS issues FROM s)"""


@query(_VALID + " SELECT record_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS accepted FROM v")
def p04_p05_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validated(proxy.source_two(spark, sf_dir)).select("record_id", F.array_join("issues", ",").alias("issues"), "accepted")


@query(_VALID + " SELECT rule, count(*) AS n FROM (SELECT unnest(issues) AS rule FROM v) u GROUP BY rule")
def p04_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(quality.validated(proxy.source_two(spark, sf_dir)))


@query(_VALID + " SELECT CAST(count(*) AS BIGINT) AS given, CAST(count(*) AS BIGINT) AS accounted, CAST(0 AS BIGINT) AS lost_keys, CAST(0 AS BIGINT) AS new_keys FROM v")
def p08_row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.validated(proxy.source_two(spark, sf_dir))
    return quality.accounting(rows, rows.where("accepted"), rows.where("NOT accepted"), "record_id")


@query(_LONG + " SELECT count(*) AS snapshots, CAST(0 AS BIGINT) AS not_in_bout, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS rate_out_of_range, CAST(0 AS BIGINT) AS not_two_a_bout, count(DISTINCT bout_id) AS bouts FROM o")
def p13_p14_j06_a03_a04_snapshot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bouts = proxy.bouts(spark, sf_dir)
    rows = history.record(history.sides(bouts)).drop("winner_id", "is_no_contest", "is_draw")
    return quality.snapshot_checks(rows, bouts)


@query("SELECT 'l_linestatus' AS column_name, count(DISTINCT l_linestatus) AS distinct_values FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem")
def a28_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.constant_columns(proxy.read(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag", "l_linenumber"])


@query(_RATES + " SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unmatched, count(*) FILTER (right(bout_id, 1) = '3') AS a_prior_bouts_differs, CAST(0 AS BIGINT) AS diff_prior_win_rate_differs FROM paired")
def g19_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir).select(BOUT, "a_prior_bouts", "diff_prior_win_rate")
    served = rows.withColumn("a_prior_bouts", F.col("a_prior_bouts") + F.when(F.col(BOUT).endswith("3"), 1).otherwise(0))
    return quality.parity(rows, served, [BOUT], ["a_prior_bouts", "diff_prior_win_rate"])


_AUTH = "auth AS (SELECT o_orderpriority AS scope, CASE WHEN o_orderkey % 3 = 0 THEN 'packet' ELSE 'legacy' END AS ledger, 'auth-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS authority_id, CASE WHEN o_orderkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS value FROM orders)"


def _authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = proxy.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_orderpriority").alias("scope"), F.when(k % 3 == 0, "packet").otherwise("legacy").alias("ledger"), F.concat(F.lit("auth-"), F.lpad(k.cast("string"), 9, "0")).alias("authority_id"), F.when(k % 2 == 0, "accept").otherwise("reject").alias("value"))


@query(f"WITH {_AUTH}, r AS (SELECT *, row_number() OVER w AS k, first_value(value) OVER w AS f FROM auth WINDOW w AS (PARTITION BY scope ORDER BY CASE WHEN ledger = 'packet' THEN 0 ELSE 1 END, authority_id)) SELECT scope, ledger, authority_id, value, CASE WHEN k = 1 THEN 'active' WHEN value = f THEN 'duplicate' ELSE 'superseded' END AS state FROM r")
def g01_g03_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.resolved_authorities(_authorities(spark, sf_dir), "packet")


@query(_AUTH.join(["WITH ", ", dv AS (" + proxy.duck(proxy.BOUTS) + ") SELECT a.scope, ledger, authority_id, value, CASE WHEN EXISTS (SELECT 1 FROM dv WHERE dv.division = a.scope AND dv.is_draw) THEN 'applicable' ELSE 'not_retained' END AS coverage FROM auth a"]))
def g02_j14_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.applicable(_authorities(spark, sf_dir), proxy.bouts(spark, sf_dir).where("is_draw"), "division")


@query(f"WITH {_ALIAS_TABLE}, d AS (SELECT alias, fighter_id, decided, decision_id FROM (SELECT substr(alias, 1, 17) AS alias, fighter_id, TIMESTAMP '2000-01-01' + to_days(CAST((7 * ascii(substr(md5(alias), 1, 1)) + ascii(substr(md5(alias), 2, 1))) % 50 AS INTEGER)) AS decided, alias AS decision_id FROM aliases) x) SELECT alias, fighter_id, decided AS system_from, decision_id, lead(decided) OVER w AS system_to, lead(decision_id) OVER w AS superseded_by, lead(decided) OVER w IS NULL AS is_current FROM d WINDOW w AS (PARTITION BY alias ORDER BY decided, decision_id)")
def g12_bitemporal_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alias_table(spark, sf_dir)
    n = (7 * F.ascii(F.substring(F.md5("alias"), 1, 1)) + F.ascii(F.substring(F.md5("alias"), 2, 1))) % 50
    rows = a.select(F.substring("alias", 1, 17).alias("alias"), "fighter_id", F.lit("2000-01-01").cast("timestamp").alias("t"), n.alias("n"), F.col("alias").alias("decision_id"))
    decided = rows.select("alias", "fighter_id", F.expr("t + make_interval(0, 0, 0, n)").alias("decided_at"), "decision_id")
    return identity.bitemporal(decided)


@query(_BOUTS + ", e AS (SELECT time_format AS value, count(*) AS affected FROM bouts GROUP BY 1), r AS (SELECT time_format AS value, bout_id, row_number() OVER (PARTITION BY time_format ORDER BY bout_id) AS k FROM bouts) SELECT e.value, affected, (SELECT string_agg(bout_id, ', ' ORDER BY bout_id) FROM r WHERE r.value = e.value AND k <= 3) AS examples, 'rounds' AS category, 'review-' || upper(substr(sha256('rounds' || chr(31) || e.value), 1, 12)) AS review_id FROM e")
def a23_a24_f28_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.review_items(proxy.bouts(spark, sf_dir), "rounds", F.col("time_format"), BOUT)


@query(_BOUTS + ", r AS (SELECT finish_method, bout_id, row_number() OVER (PARTITION BY finish_method ORDER BY bout_id) AS k FROM bouts) SELECT finish_method, bout_id FROM r WHERE k <= 6 ORDER BY finish_method, k LIMIT 30")
def l08_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.samples(proxy.bouts(spark, sf_dir).select("finish_method", BOUT), "finish_method", BOUT).select("finish_method", BOUT)


@query(_BOUTS + " SELECT 'bouts' AS artefact, 3 * count(*) - count(*) FILTER (winner_id IS NULL) AS links, count(*) AS rows_covered FROM bouts UNION ALL SELECT 'sides', 4 * count(*), 2 * count(*) FROM bouts")
def u03_g05_a06_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bouts = proxy.bouts(spark, sf_dir)
    tables = {"bouts": (bouts, [BOUT], ["fighter_a_id", "fighter_b_id", "winner_id"]), "sides": (history.sides(bouts).select(BOUT, OWNER, "opponent_id", "outcome"), [BOUT, OWNER], [BOUT, "opponent_id"])}
    return governance.lineage_coverage(governance.provenance(tables))


@query(_BOUTS + " SELECT bout_id, division FROM bouts WHERE bout_id NOT IN (SELECT bout_id FROM bouts WHERE is_draw)")
def j15_a07_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    bouts = proxy.bouts(spark, sf_dir)
    return quality.orphans(bouts.select(BOUT, "division"), bouts.where("is_draw"), BOUT)


# Functions


@query(
    _BOUTS
    + """ SELECT bout_id, TRY_CAST(regexp_extract(trim(time_format), '^([0-9]+)(\\s|$)', 1) AS INTEGER) AS leading,
  CASE time_format WHEN '5' THEN 5 WHEN '4' THEN 4 WHEN '3 Rnd (5-5-5)' THEN 3 WHEN '3 Rnd + OT (5-5-5-5)' THEN 4 END AS positive,
  CASE time_format WHEN '5' THEN 5 WHEN '4' THEN 4 WHEN '3 Rnd (5-5-5)' THEN 3 WHEN '3 Rnd + OT (5-5-5-5)' THEN 4 END AS formatted,
  contains(time_format, 'Rnd +') AND contains(time_format, 'OT') AS is_special, time_format IN ('4', '4.0') AS is_four,
  sha256(CAST(fight_date AS VARCHAR) || '|' || fighter_a_id || '|' || fighter_b_id) AS bout_sha, coalesce(finish_round > TRY_CAST(regexp_extract(trim(time_format), '^([0-9]+)(\\s|$)', 1) AS INTEGER), false) AS impossible FROM bouts"""
)
def f04_f19_f20_p10_p19_p20_p21_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("time_format")
    return proxy.bouts(spark, sf_dir).select(
        BOUT, parsing.leading_rounds(t).alias("leading"), parsing.positive_rounds(t).alias("positive"), parsing.time_format_rounds(t).cast("int").alias("formatted"),
        (t.contains("Rnd +") & t.contains("OT")).alias("is_special"), F.trim(t).isin("4", "4.0").alias("is_four"),
        names.digest(F.col(DAY).cast("string"), "fighter_a_id", "fighter_b_id").alias("bout_sha"), F.coalesce(F.col("finish_round") > parsing.leading_rounds(t), F.lit(False)).alias("impossible"),
    )


@query("SELECT event_id, props, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events")
def f40_json_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = proxy.read(spark, sf_dir, "events")
    return e.select("event_id", "props", parsing.whole(parsing.detail(F.col("props"), "k")).alias("k"), F.to_date("ts").alias("day"))


_LABELS = (
    "Women's Strawweight Bout", "UFC Women's Flyweight Title Bout", "women's bantamweight", "Women's Featherweight", "Light Heavyweight Bout", "UFC Heavyweight Title", "Middleweight", "WELTERWEIGHT Bout",
    "Interim Lightweight", "Featherweight", "Bantamweight", "Flyweight", "Catch Weight Bout", "Strawweight", "Openweight", "Catchweight",
)
_CODES = (
    "womens_strawweight", "womens_flyweight", "womens_bantamweight", "womens_featherweight", "light_heavyweight", "heavyweight", "middleweight", "welterweight",
    "lightweight", "featherweight", "bantamweight", "flyweight", "catch_weight", None, None, None,
)


def _sql_list(values: tuple[str | None, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"SELECT p_partkey, {_sql_list(_LABELS)}[1 + p_partkey % {len(_LABELS)}] AS label, {_sql_list(_CODES)}[1 + p_partkey % {len(_LABELS)}] AS division FROM part")
def f14_division_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label and its code, and labels that have none."""
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS)).cast("int"))
    return proxy.read(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("division", names.division_code(F.col("label")))


# What-ifs and models


@query(_PRED + ", x AS (SELECT p.bout_id, least(greatest(p.p, 1e-6), 1 - 1e-6) AS q, 0.3 * least(greatest(coalesce(d.diff_prior_win_rate, 0), -0.5), 0.5) + 0.01 * least(greatest(d.diff_prior_bouts, -20), 20) AS m FROM pred p JOIN paired d USING (bout_id)) SELECT bout_id, round(least(greatest(1 / (1 + exp(-(ln(q / (1 - q)) + m))), 0.01), 0.99), 4) AS p_shifted FROM x")
def f32_m13_q09_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).join(_paired(spark, sf_dir).select(BOUT, "diff_prior_win_rate", "diff_prior_bouts"), BOUT)
    return simulate.counterfactual(rows, "p", {"diff_prior_win_rate": (0.3, -0.5, 0.5), "diff_prior_bouts": (0.01, -20.0, 20.0)}).select(BOUT, "p_shifted")


@query()
def a27_m14_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.distribution(simulate.monte_carlo(spark, 0.6)))


@query(_RATES + " SELECT bout_id, 'record' AS feature_group, round(2.0 * (coalesce(diff_prior_win_rate, 0.0)), 6) AS contribution, round(abs(2.0 * (coalesce(diff_prior_win_rate, 0.0))), 6) AS size FROM paired UNION ALL SELECT bout_id, 'experience', round(0.01 * (diff_prior_bouts - 1), 6), round(abs(0.01 * (diff_prior_bouts - 1)), 6) FROM paired")
def a26_m12_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simulate.contributions(_paired(spark, sf_dir), BOUT, {"diff_prior_win_rate": (2.0, 0.0), "diff_prior_bouts": (0.01, 1.0)})
    return rounded(simulate.grouped_contributions(parts, BOUT))


@query(_RATES + " SELECT bout_id, round(least(greatest(diff_prior_bouts / 20, -1), 1), 3) + 0.0 AS gap, CASE WHEN round(least(greatest(diff_prior_bouts / 20, -1), 1), 3) >= 0.05 THEN 'a' WHEN round(least(greatest(diff_prior_bouts / 20, -1), 1), 3) <= -0.05 THEN 'b' ELSE 'even' END AS direction FROM paired")
def f34_display_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = simulate.display_gap(F.col("diff_prior_bouts"), 20.0)
    return rounded(_paired(spark, sf_dir).select(BOUT, gap.alias("gap"), simulate.direction(gap).alias("direction")))


@query()
def m01_m05_m11_symmetric_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringside.operators import models

    rows = shelve(pairwise.model_ready(_paired(spark, sf_dir), _FEATURES))
    model = models.symmetric_model(rows, _FEATURES)
    return rounded(models.symmetric_predictions(model, rows, _FEATURES, [BOUT]).select(BOUT, "p_forward", "p_swap", "p"))


_AS_OF = f"""WITH every AS ({proxy.duck(proxy.BOUTS)}), bouts AS (
  SELECT bout_id, fight_date, fighter_a_id, fighter_b_id, winner_id, is_no_contest, is_draw, finish_method, division FROM every
  WHERE (fighter_a_id IN ('f000003', 'f000005') OR fighter_b_id IN ('f000003', 'f000005')) AND fight_date < DATE '2000-01-01'
  UNION ALL SELECT '~target', DATE '2000-01-01', 'f000003', 'f000005', NULL, TRUE, FALSE, '', NULL)"""


@query(_history_sql(_AS_OF, "bout_id = '~target'"))
def w27_as_of_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.at_date(proxy.bouts(spark, sf_dir), "f000005", "f000003", "2000-01-01"))


# Further joins, sets and records


@query(
    _WALK
    + f""", nk AS (SELECT record_id, 'red' AS side, {_KEY.format('red_name')} AS name_key FROM ({_S1}) a UNION ALL SELECT record_id, 'blue', {_KEY.format('blue_name')} FROM ({_S1}) b)
SELECT w.bout_key, nk.record_id, nk.side, nk.name_key, s.s_name AS name FROM nk JOIN walk w ON w.record_id = nk.record_id AND w.source = 'one' LEFT JOIN supplier s ON {_KEY.format('s.s_name')} = nk.name_key"""
)
def j05_alias_crosswalk_fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _sources(spark, sf_dir)
    walk = reconcile.crosswalk(one, two).where("source = 'one'").drop("source", "role")
    people = proxy.read(spark, sf_dir, "supplier").select(names.ascii_name(F.col("s_name")).alias("name_key"), F.col("s_name").alias("name"))
    return identity.alias_rows(one).drop("raw").join(walk, "record_id").join(people, "name_key", "left")


@query(_PERF + " SELECT p.bout_id, p.fighter_id, count(q.bout_id) AS prior_rows, count(q.knockdowns) AS prior_observed FROM perf p LEFT JOIN perf q ON q.fighter_id = p.fighter_id AND q.fight_date < p.fight_date GROUP BY p.bout_id, p.fighter_id")
def j07_strict_prior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringside.functions.windows import prior

    rows = proxy.performance(spark, sf_dir)
    return rows.select(BOUT, OWNER, F.count("*").over(prior()).alias("prior_rows"), F.count("knockdowns").over(prior()).alias("prior_observed"))


@query(_RATES + ", pace AS (SELECT bout_id, CAST(finish_round AS BIGINT) AS finish_round FROM bouts) SELECT p.bout_id, p.a_prior_bouts, x.finish_round FROM paired p LEFT JOIN pace x USING (bout_id)")
def j12_feature_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = proxy.bouts(spark, sf_dir).select(BOUT, F.col("finish_round").cast("long").alias("finish_round"))
    return pairwise.one_to_one(_paired(spark, sf_dir).select(BOUT, "a_prior_bouts"), pack, [BOUT])


@query(f"WITH {_FIGHTERS}, {_ALIAS_TABLE}, rv AS (SELECT alias, min(fighter_id) AS fighter_id FROM aliases GROUP BY alias) SELECT o.o_orderkey, c.c_name AS alias, rv.fighter_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN rv ON rv.alias = c.c_name")
def j18_reviewed_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = proxy.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), proxy.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("alias"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "alias")
    return identity.looked_up(rows, _alias_table(spark, sf_dir), ["alias"])


@query(_LONG + " SELECT bout_id, string_agg(fighter_id || ':' || outcome, ',' ORDER BY fighter_id) AS participants FROM o GROUP BY bout_id")
def j21_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sides(spark, sf_dir).groupBy(BOUT).agg(F.array_sort(F.collect_list(F.concat_ws(":", OWNER, "outcome"))).alias("x"))
    return rows.select(BOUT, F.array_join("x", ",").alias("participants"))


@query("WITH m AS (SELECT o_orderkey AS merge_id, o_custkey AS from_id, o_orderkey % 50 AS into_id FROM orders), s AS (SELECT l_orderkey AS merge_id FROM lineitem WHERE l_returnflag = 'R') SELECT merge_id, from_id, into_id FROM m WHERE from_id <> into_id AND merge_id NOT IN (SELECT merge_id FROM s)")
def j22_g13_active_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = proxy.read(spark, sf_dir, "orders"), proxy.read(spark, sf_dir, "lineitem")
    merges = o.select(F.col("o_orderkey").alias("merge_id"), F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") % 50).alias("into_id"))
    return identity.active_merges(merges, line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("merge_id")))


@query(
    f"WITH one AS ({_keyed_sql(_S1)}), two AS ({_keyed_sql(_S2)}), sp AS (SELECT match_key, count(*) AS n, min(record_id) AS e FROM two WHERE contains(rounds, 'Rnd +') AND contains(rounds, 'OT') GROUP BY 1)"
    + " SELECT one.record_id, CASE WHEN n = 1 THEN 'confirmed' ELSE 'unresolved' END AS state, CASE WHEN n = 1 THEN e END AS evidence FROM one LEFT JOIN sp USING (match_key) WHERE trim(rounds) IN ('4', '4.0')"
)
def j24_x13_four_round_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.four_round_checks(*_sources(spark, sf_dir))


@query(
    f"WITH one AS ({_keyed_sql(_S1)}), two AS ({_keyed_sql(_S2)}) SELECT l.record_id AS left_id, r.record_id AS right_id, CASE WHEN l.division = r.division THEN 'exact' WHEN regexp_replace(lower(l.division), '[^a-z0-9]', '', 'g') = regexp_replace(lower(r.division), '[^a-z0-9]', '', 'g') THEN 'folded' ELSE 'differs' END AS division_agreement,"
    + " CASE WHEN l.method = r.method THEN 'exact' WHEN regexp_replace(lower(l.method), '[^a-z0-9]', '', 'g') = regexp_replace(lower(r.method), '[^a-z0-9]', '', 'g') THEN 'folded' ELSE 'differs' END AS method_agreement FROM one l JOIN two r USING (match_key) WHERE l.same = 1 AND r.same = 1"
)
def x27_metadata_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.metadata_agreement(*_sources(spark, sf_dir))


@query(f"WITH one AS ({_keyed_sql(_S1)}), two AS ({_keyed_sql(_S2)}) SELECT l.record_id AS left_id, r.record_id AS right_id, (l.winner IS NOT DISTINCT FROM r.winner AND l.method IS NOT DISTINCT FROM r.method AND l.clock IS NOT DISTINCT FROM r.clock AND l.round_no IS NOT DISTINCT FROM r.round_no) AS agree FROM one l JOIN two r USING (match_key) WHERE l.same = 1 AND r.same = 1")
def x05_outcome_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.outcome_tuples_agree(*_sources(spark, sf_dir))


@query(f"WITH s AS ({_S2}), k AS (SELECT *, row_number() OVER (PARTITION BY event_date, red_name ORDER BY record_id) AS place FROM s) SELECT record_id, event_date, red_name FROM k WHERE place = 1")
def u05_duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = reconcile.first_of_duplicates(proxy.source_two(spark, sf_dir), ["event_date", "red_name"], "record_id")
    return kept.select("record_id", "event_date", "red_name")


@query(f"WITH s AS ({_S2}) SELECT record_id, method, CASE lower(trim(method)) WHEN 'ko/tko' THEN 'knockout' WHEN 'submission' THEN 'submission' WHEN 'u-dec' THEN 'decision' END AS method_value, lower(trim(method)) IN ('ko/tko', 'submission', 'u-dec') AS accepted FROM s")
def p25_x18_taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("KO/TKO", "knockout"), (" Submission", "submission"), ("U-DEC ", "decision")], "label string, value string")
    return reconcile.mapped(proxy.source_two(spark, sf_dir), labels, "method").select("record_id", "method", "method_value", "accepted")


@query("SELECT o_custkey AS k, max(o_orderkey) AS v, count(*) AS occurrences FROM orders GROUP BY o_custkey")
def s18_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringside.plans.publish import upserted

    rows = proxy.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    part = lambda cond: rows.where(cond).groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("occurrences"))
    return upserted(part("v < 1000"), part("v >= 1000"), ["k"])


@query(f"WITH {_AUTH}, d AS (SELECT authority_id AS review_id, value AS decision FROM auth), i AS (SELECT DISTINCT review_id, right(review_id, 1) = '5' AS retired FROM d WHERE right(review_id, 1) <> '9'), lg AS (SELECT review_id, 'accept' AS decided FROM d WHERE right(review_id, 1) IN ('2', '3')) SELECT d.review_id, d.decision, CASE WHEN i.retired IS NULL THEN 'unknown' WHEN i.retired THEN 'retired' WHEN lg.decided = d.decision THEN 'repeated' WHEN lg.decided IS NOT NULL THEN 'contradictory' ELSE 'accepted' END AS state FROM d LEFT JOIN i USING (review_id) LEFT JOIN lg USING (review_id)")
def g09_g11_imported_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _authorities(spark, sf_dir).select(F.col("authority_id").alias("review_id"), F.col("value").alias("decision"))
    last = F.right("review_id", F.lit(1))
    items = d.where(last != "9").select("review_id", (last == "5").alias("retired")).distinct()
    return governance.imported(d, items, d.where(last.isin("2", "3")).select("review_id", F.lit("accept").alias("decision")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 3")
def g16_u04_append_only_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = proxy.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return governance.append_only(old, old.where("o_orderkey % 10 <> 3"))


@query(_BOUTS + " SELECT fight_date AS event_date, count(*) AS bouts, count(DISTINCT division) AS divisions FROM bouts GROUP BY fight_date ORDER BY fight_date DESC LIMIT 12")
def q06_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxy.bouts(spark, sf_dir).groupBy(DAY).agg(F.count("*").alias("bouts"), F.count_distinct("division").alias("divisions"))
    return rows.orderBy(F.desc(DAY)).limit(12).select(F.col(DAY).alias("event_date"), "bouts", "divisions")


@query(
    _SPLIT
    + """, u AS (SELECT p AS x, avg(a_won) AS y, count(*) AS w FROM split WHERE split = 'validation' GROUP BY p),
n AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(w * y) OVER (ORDER BY x) AS cy FROM u),
jk AS (SELECT j.i AS j, k.i AS k, (k.cy - j.cy + j.w * j.y) / (k.cw - j.cw + j.w) AS a FROM n j JOIN n k ON k.i >= j.i),
m AS (SELECT j, k AS i, min(a) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM jk),
fit AS (SELECT n.x, max(m.a) AS y FROM m JOIN n USING (i) GROUP BY n.x), test AS (SELECT bout_id, p FROM split WHERE split = 'test'),
met AS (SELECT t.bout_id, t.p, f.x AS lx, f.y AS ly, g.x AS hx, g.y AS hy FROM test t ASOF LEFT JOIN fit f ON t.p >= f.x ASOF LEFT JOIN fit g ON t.p <= g.x)
SELECT bout_id, round(p, 6) AS p, round(CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly WHEN hx = lx THEN ly ELSE ly + (p - lx) * (hy - ly) / (hx - lx) END, 6) AS p_calibrated FROM met"""
)
def m07_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringside.operators import models

    rows = evaluate.temporal_split(_predictions(spark, sf_dir))
    fitted = models.isotonic(rows.where("split = 'validation'"), "p")
    return rounded(fitted.transform(rows.where("split = 'test'")).select(BOUT, "p", F.col("prediction").alias("p_calibrated")))


def _digest_sql(name: str, columns: list[str], sql: str) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in sorted(columns))
    return f"SELECT '{name}' AS table_name, count(*) AS n, CAST(sum(('0x' || substr(sha256(concat_ws('|', {text})), 1, 15))::BIGINT) AS VARCHAR) AS digest_sum FROM ({sql}) {name}"


@query(
    " UNION ALL ".join((
        _digest_sql("bouts", proxy.BOUT_NAMES, proxy.duck(proxy.BOUTS)), _digest_sql("performance", proxy.PERFORMANCE_NAMES, proxy.duck(proxy.PERFORMANCE))
    ))
)
def s14_s15_generation_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    bouts = proxy.bouts(spark, sf_dir)
    tables = {"bouts": bouts, "performance": proxy.performance(spark, sf_dir)}
    one = [governance.table_digest(df).select(F.lit(n).alias("table_name"), "n", "digest_sum") for n, df in tables.items()]
    return one[0].unionByName(one[1])
