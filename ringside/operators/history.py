"""Records of competitors as they stood before each bout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.windows import BOUT, DAY, OWNER, in_order, last_prior, ordered, prior, share, with_columns

OUTCOMES = ("win", "loss", "draw", "no_contest")


def sides(bouts: DataFrame, *keep: str) -> DataFrame:
    """Two rows a bout, one for each competitor, with the opponent and the outcome."""
    pair = F.explode(F.array(F.struct(F.col("fighter_a_id").alias(OWNER), F.col("fighter_b_id").alias("opponent_id")), F.struct(F.col("fighter_b_id").alias(OWNER), F.col("fighter_a_id").alias("opponent_id"))))
    long = bouts.select(BOUT, DAY, "winner_id", "is_no_contest", "is_draw", *keep, pair.alias("side")).select("*", "side.*").drop("side")
    return long.withColumn("outcome", outcome())


def met(meetings: DataFrame, metrics: tuple[str, ...], *keep: str) -> DataFrame:
    """sides() of meetings (a bout with what both did as structs p and q), with the metrics and the opponent's as opp_<metric>: no join."""
    turned = lambda own, other: F.struct(F.col(own).alias("own"), F.col(other).alias("opp"))
    long = meetings.select(BOUT, DAY, "winner_id", "is_no_contest", "is_draw", *keep, F.explode(F.array(turned("p", "q"), turned("q", "p"))).alias("s"))
    said = [F.col(f"s.own.{OWNER}"), F.col(f"s.opp.{OWNER}").alias("opponent_id"), *(F.col(f"s.own.{m}") for m in metrics), *(F.col(f"s.opp.{m}").alias(f"opp_{m}") for m in metrics)]
    return long.select("*", *said).withColumn("outcome", outcome()).drop("s", "winner_id", "is_no_contest", "is_draw")


def outcome() -> Column:
    """no_contest before draw before win before loss; a row that is none of these fails."""
    return (
        F.when(F.col("is_no_contest"), "no_contest").when(F.col("is_draw"), "draw").when(F.col("winner_id") == F.col(OWNER), "win")
        .when(F.col("winner_id") == F.col("opponent_id"), "loss").otherwise(F.raise_error(F.concat(F.lit("no outcome for bout "), F.col(BOUT))))
    )


def checked_winner() -> Column:
    """The winner of a bout whose sides aren't apart yet; fails for one that isn't of the bout, as outcome() does."""
    known = F.col("is_no_contest") | F.col("is_draw") | F.col("winner_id").isin(F.col("fighter_a_id"), F.col("fighter_b_id"))
    return F.when(known, F.col("winner_id")).otherwise(F.raise_error(F.concat(F.lit("no outcome for bout "), F.col(BOUT))))


def finish_category(method: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(method, F.lit(""))))
    return F.when(low.contains("ko") | low.contains("tko"), "ko_tko").when(low.contains("sub"), "submission").when(low.contains("dec"), "decision").otherwise("other")


def is_outcome(*names: str) -> Column:
    return F.col("outcome").isin(*names)


def n_prior(condition: Column | None = None, days: int | None = None) -> Column:
    counted = F.count("*") if condition is None else F.count_if(condition)
    return counted.over(prior(days))


def record(long: DataFrame) -> DataFrame:
    """Counts, rates, days since the last bout and the debut flag."""
    long = long.withColumns({
        "prior_bouts": n_prior(), "prior_wins": n_prior(is_outcome("win")), "prior_losses": n_prior(is_outcome("loss")),
        "prior_draws": n_prior(is_outcome("draw")), "prior_no_contests": n_prior(is_outcome("no_contest")),
        "days_since_last": F.datediff(DAY, F.max(DAY).over(prior())).cast("long"),
    })
    decisive = F.col("prior_wins") + F.col("prior_losses")
    return long.withColumns({
        "prior_decisive": decisive, "prior_win_rate": share(F.col("prior_wins"), decisive),
        "prior_loss_rate": share(F.col("prior_losses"), decisive), "is_debut": F.col("prior_bouts") == 0,
    })


def activity(long: DataFrame, days: tuple[int, ...] = (180, 365, 730)) -> DataFrame:
    """Bouts of the last so many days, the earliest of them included."""
    return long.withColumns({f"bouts_last_{n}d": n_prior(days=n) for n in days})


def recent(long: DataFrame, k: int = 5) -> DataFrame:
    """Outcomes of the last k bouts of any outcome; the win rate is over the decisive ones among them."""
    counts = {f"recent_{k}_{name}": last_prior(F.count_if(is_outcome(name)), k) for name in OUTCOMES}
    long = with_columns(long, **counts)
    wins, losses = F.col(f"recent_{k}_win"), F.col(f"recent_{k}_loss")
    return long.withColumn(f"recent_{k}_win_rate", share(wins, wins + losses))


#: Outcomes that a streak goes on with.
STREAKS = {"win_streak": ("win",), "loss_streak": ("loss",), "unbeaten_streak": ("win", "draw"), "winless_streak": ("loss", "draw")}


def streaks(long: DataFrame) -> DataFrame:
    """Lengths of the runs that the last earlier bout ends: bouts since the last one that broke the run."""
    long = long.withColumns({"seq": F.row_number().over(in_order()).cast("long"), "seen": n_prior()})
    broke = lambda names: F.max(F.when(~is_outcome(*names), F.col("seq"))).over(prior())
    return long.withColumns({n: F.col("seen") - F.coalesce(broke(names), F.lit(0)) for n, names in STREAKS.items()}).drop("seq", "seen")


def finishes(long: DataFrame) -> DataFrame:
    """Wins by how they came about, and the share that came before the judges."""
    kinds = ("ko_tko", "submission", "decision", "other")
    long = long.withColumn("category", finish_category(F.col("finish_method")))
    long = long.withColumns({f"prior_{k}_wins": n_prior(is_outcome("win") & (F.col("category") == k)) for k in kinds})
    wins = n_prior(is_outcome("win"))
    return long.withColumn("wins", wins).withColumn("finish_win_rate", share(F.col("wins") - F.col("prior_decision_wins"), F.col("wins"))).drop("wins", "category")


def evidence(long: DataFrame) -> DataFrame:
    """Digest of what a snapshot rests on: its owner, the number of earlier bouts, and all of them.

    Bouts bear their dates, so the set of them says their order too: it's told by the exclusive or of 240 bits of each
    bout's digest, which a window carries on; no list of earlier bouts is ever gathered.
    """
    own = F.sha2(F.concat_ws("|", BOUT, F.col(DAY).cast("string"), "outcome"), 256)
    parts = {f"part_{i}": F.conv(F.substring("own", 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)}
    long = long.withColumn("own", own).withColumns(parts)
    long = long.withColumns({n: F.coalesce(F.bit_xor(n).over(prior()), F.lit(0).cast("long")) for n in parts} | {"past": n_prior()})
    return long.withColumn("evidence_sha256", F.sha2(F.concat_ws("|", OWNER, *(F.col(c).cast("string") for c in ("past", *parts))), 256)).drop("own", "past", *parts)


def prefight_history(bouts: DataFrame) -> DataFrame:
    """Everything above, two rows a bout; one shuffle and one sort, by competitor."""
    long = ordered(sides(bouts, "finish_method"))
    return evidence(finishes(streaks(recent(activity(record(long)))))).drop("winner_id", "is_no_contest", "is_draw", "finish_method")


def latest(snapshots: DataFrame) -> DataFrame:
    """Each competitor's last snapshot, ties by bout."""
    columns = [c for c in snapshots.columns if c != OWNER]
    return snapshots.groupBy(OWNER).agg(F.max_by(F.struct(*columns), F.struct(DAY, BOUT)).alias("x")).select(OWNER, "x.*")


def at_date(bouts: DataFrame, fighter_a: str, fighter_b: str, date: str) -> DataFrame:
    """The records of two competitors for a bout that isn't in the history: it joins as a last row and is picked again.

    Only the two competitors' bouts are read.
    """
    spark = bouts.sparkSession
    own = bouts.where(F.col("fighter_a_id").isin(fighter_a, fighter_b) | F.col("fighter_b_id").isin(fighter_a, fighter_b)).where(F.col(DAY) < F.lit(date).cast("date"))
    a, b = sorted((fighter_a, fighter_b))
    target = spark.range(1).select(
        F.lit("~target").alias(BOUT), F.lit(date).cast("date").alias(DAY), F.lit(a).alias("fighter_a_id"), F.lit(b).alias("fighter_b_id"),
        F.lit(None).cast("string").alias("winner_id"), F.lit(True).alias("is_no_contest"), F.lit(False).alias("is_draw"), F.lit("").alias("finish_method"),
    )
    return prefight_history(own.select(target.columns).unionByName(target)).where(F.col(BOUT) == "~target")


def bout_counts(bouts: DataFrame) -> DataFrame:
    """Earlier bouts of both sides and their difference, one row a bout."""
    long = sides(bouts).select(BOUT, OWNER, n_prior().alias("n"))
    a = long.select(F.col(BOUT), F.col(OWNER).alias("fighter_a_id"), F.col("n").alias("a_prior_bouts"))
    b = long.select(F.col(BOUT), F.col(OWNER).alias("fighter_b_id"), F.col("n").alias("b_prior_bouts"))
    joined = bouts.select(BOUT, "fighter_a_id", "fighter_b_id").join(a, [BOUT, "fighter_a_id"]).join(b, [BOUT, "fighter_b_id"])
    return joined.select(BOUT, "a_prior_bouts", "b_prior_bouts", (F.col("a_prior_bouts") - F.col("b_prior_bouts")).alias("diff_prior_bouts"))


def by_name(rows: DataFrame, values: tuple[str, ...], k: int = 3) -> DataFrame:
    """Counts, career means and means of the last k of values, where a missing value counts as zero, as does an empty past."""
    zero = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    rows = rows.withColumns({f"z_{v}": c for v, c in zero.items()}).withColumn("prior_rows", n_prior())
    rows = rows.withColumns({f"career_{v}": F.coalesce(F.avg(f"z_{v}").over(prior()), F.lit(0.0)) for v in values})
    rows = with_columns(rows, **{f"rolling_{v}": last_prior(F.avg(f"z_{v}"), k) for v in values})
    return rows.withColumns({f"rolling_{v}": F.coalesce(f"rolling_{v}", F.lit(0.0)) for v in values}).drop(*(f"z_{v}" for v in values))


def at_timestamps(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value", won: Column | None = None) -> DataFrame:
    """The same on a finer clock: whatever is earlier by a microsecond is past.

    win_rate over all earlier rows, days since the last (-1 without one), career mean, means of the last 1, 3 and 5
    earlier rows, and the trend: that of 3 less the career's.
    """
    won = F.col(value) > 0 if won is None else won
    clock = F.unix_micros(F.col(ts).cast("timestamp"))
    strict = Window.partitionBy(key).orderBy("clock").rangeBetween(Window.unboundedPreceding, -1)
    rows = Window.partitionBy(key).orderBy("clock", "event_id")
    same = Window.partitionBy(key, "clock").orderBy("event_id")
    out = events.withColumn("clock", clock).withColumn("won", won.cast("int"))
    out = out.withColumns({
        "prior_rows": F.count("*").over(strict), "win_rate": share(F.sum("won").over(strict), F.count("*").over(strict)),
        "layoff_days": F.coalesce((F.col("clock") - F.max("clock").over(strict)) / F.lit(86_400_000_000.0), F.lit(-1.0)), "career_mean": F.avg(value).over(strict),
    })
    out = out.withColumns({f"mean_last_{k}": F.avg(value).over(rows.rowsBetween(-k, -1)) for k in (1, 3, 5)})
    out = out.withColumns({f"mean_last_{k}": F.first(f"mean_last_{k}").over(same) for k in (1, 3, 5)})
    return out.withColumn("trend", F.col("mean_last_3") - F.col("career_mean")).drop("clock", "won")
