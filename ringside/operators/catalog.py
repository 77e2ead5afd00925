"""Read queries over competitors, bouts and sources: pages, details, boards."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.windows import BOUT, DAY, OWNER
from ringside.operators.history import sides


def encode_cursor(*values: str) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values)).encode()).decode()


def decode_cursor(cursor: str) -> list[str]:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()))


def keyset_page(rows: DataFrame, keys: list[str], limit: int, cursor: str | None = None, descending: bool = False) -> DataFrame:
    """The next `limit` rows in the order of keys, and one more by which the caller sees whether there's another page.

    The condition on the keys is pushed to the scan; the page is a top-k, never a full sort.
    """
    if cursor:
        values = decode_cursor(cursor)
        beyond: Column = F.lit(False)
        for i, k in enumerate(keys):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(keys[j]) == F.lit(values[j]).cast(rows.schema[keys[j]].dataType))
            edge = F.lit(values[i]).cast(rows.schema[k].dataType)
            beyond = beyond | (same & ((F.col(k) < edge) if descending else (F.col(k) > edge)))
        rows = rows.where(beyond)
    order = [F.desc_nulls_last(k) if descending else F.asc_nulls_last(k) for k in keys]
    return rows.orderBy(*order).limit(limit + 1)


def offset_page(rows: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*keys).offset(offset).limit(limit + 1)


def search(fighters: DataFrame, text: str) -> DataFrame:
    """Names that contain a text, whatever its case; no part of it is a pattern."""
    return fighters.where(F.lower("name").contains(text.lower()))


def with_alias_counts(fighters: DataFrame, aliases: DataFrame) -> DataFrame:
    """Number of current aliases (those that nothing has superseded) of each competitor, zero included."""
    current = aliases.where(F.col("system_to").isNull()).groupBy("fighter_id").agg(F.count("*").alias("aliases"))
    return fighters.join(current, "fighter_id", "left").withColumn("aliases", F.coalesce("aliases", F.lit(0)))


def fighter_detail(fighters: DataFrame, aliases: DataFrame, snapshots: DataFrame, fighter_id: str) -> DataFrame:
    """One competitor, all aliases in order of their ends and names, and the last snapshot."""
    one = fighters.where(F.col("fighter_id") == fighter_id)
    named = aliases.where(F.col("fighter_id") == fighter_id).groupBy("fighter_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("system_to").cast("string"), F.lit("~")).alias("until"), "alias"))), lambda x: x["alias"]).alias("names")
    )
    last = snapshots.where(F.col(OWNER) == fighter_id).orderBy(F.desc(DAY), F.desc(BOUT)).limit(1)
    return one.join(named, "fighter_id", "left").join(last.drop("opponent_id"), "fighter_id", "left")


def fighter_history(bouts: DataFrame, fighter_id: str, limit: int, cursor: str | None = None) -> DataFrame:
    """A competitor's bouts, newest first, a page at a time."""
    own = bouts.where((F.col("fighter_a_id") == fighter_id) | (F.col("fighter_b_id") == fighter_id))
    rows = sides(own, "finish_method").where(F.col(OWNER) == fighter_id)
    return keyset_page(rows.select(DAY, BOUT, "opponent_id", "outcome", "finish_method"), [DAY, BOUT], limit, cursor, descending=True)


def bout_with_sides(bouts: DataFrame, fighters: DataFrame) -> DataFrame:
    """Bouts with both names; names are joined by whatever way their size suggests."""
    name = lambda s: fighters.select(F.col("fighter_id").alias(f"fighter_{s}_id"), F.col("name").alias(f"{s}_name"))
    return bouts.join(name("a"), "fighter_a_id", "left").join(name("b"), "fighter_b_id", "left")


def wilson(wins: Column, n: Column, z: float = 1.0) -> Column:
    """Lower end of the score interval of a share."""
    p, zz = wins / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def standouts(bouts: DataFrame, days: int = 3 * 365, least: int = 3, top: int = 4) -> DataFrame:
    """Best form in each division over the days before the newest bout: Wilson bound over decisive bouts, then wins, then the last date."""
    newest = bouts.agg(F.max(DAY).alias("newest"))
    recent = bouts.crossJoin(F.broadcast(newest)).where(F.datediff("newest", DAY) <= days)  # one row on the right
    long = sides(recent, "division").where(F.col("outcome").isin("win", "loss"))
    form = long.groupBy("division", OWNER).agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"), F.max(DAY).alias("last_date"))
    n = F.col("wins") + F.col("losses")
    form = form.where(n >= least).withColumn("score", F.round(wilson(F.col("wins"), n), 4))
    place = F.row_number().over(Window.partitionBy("division").orderBy(F.desc("score"), F.desc("wins"), F.desc("last_date"), OWNER))
    return form.withColumn("place", place).where(F.col("place") <= top)


def freshness(runs: DataFrame, issues: DataFrame, stale_days: int = 30) -> DataFrame:
    """Of each source: its last run, open issues, and a state. runs: source, run_id, requested_at, status; issues: source, is_open."""
    last = runs.groupBy("source").agg(F.max_by(F.struct("run_id", "requested_at", "status"), F.struct("requested_at", "run_id")).alias("x"), F.max("requested_at").alias("m")).select("source", "x.*")
    newest = runs.agg(F.max("requested_at").alias("newest"))
    opened = issues.where("is_open").groupBy("source").agg(F.count("*").alias("open_issues"))
    rows = last.join(opened, "source", "left").withColumn("open_issues", F.coalesce("open_issues", F.lit(0))).crossJoin(F.broadcast(newest))  # one row
    late = F.datediff("newest", "requested_at") > stale_days
    state = F.when(F.col("status") != "ok", "failed").when(F.col("open_issues") > 0, "degraded").when(late, "stale").otherwise("fresh")
    return rows.withColumn("state", state).drop("newest")


def similar_bouts(bouts: DataFrame, fighter_a: str, fighter_b: str, date: str, features: DataFrame, k: int = 5, tail: int = 500) -> DataFrame:
    """The k decisive bouts nearest to a pair of competitors by the distance of their differences, among the last `tail` before a date.

    features: bout and diff_ columns. The bout to compare with is these competitors' last one before the date.
    """
    past = bouts.where((F.col(DAY) < F.lit(date).cast("date")) & F.col("winner_id").isNotNull())
    recent = past.orderBy(F.desc(DAY), F.desc(BOUT)).limit(tail).select(BOUT, DAY, "fighter_a_id", "fighter_b_id").join(features, BOUT)
    a, b = sorted((fighter_a, fighter_b))
    names = [c for c in features.columns if c.startswith("diff_")]
    own = past.where((F.col("fighter_a_id") == a) & (F.col("fighter_b_id") == b)).orderBy(F.desc(DAY), F.desc(BOUT)).limit(1)
    own = own.select(BOUT).join(features, BOUT).select(F.col(BOUT).alias("target"), *(F.col(n).alias(f"t_{n}") for n in names))
    gap = sum((F.pow(F.coalesce(F.col(n) - F.col(f"t_{n}"), F.lit(0.0)), F.lit(2.0)) for n in names), F.lit(0.0))
    near = recent.crossJoin(F.broadcast(own)).where(F.col(BOUT) != F.col("target")).withColumn("distance", F.sqrt(gap))  # at most one row on the right
    return near.orderBy("distance", BOUT).limit(k).select(BOUT, DAY, "distance")


def unique_names(fighters: DataFrame) -> DataFrame:
    """Names that belong to one competitor alone."""
    return fighters.groupBy("name").agg(F.count_distinct("fighter_id").alias("n"), F.min("fighter_id").alias("fighter_id")).where("n = 1").drop("n")


def upcoming(card: DataFrame, fighters: DataFrame, today: str, top: int = 20) -> DataFrame:
    """Bouts of a card after today whose two names each resolve to one competitor, soonest first. card: event_date, red_name, blue_name."""
    names = unique_names(fighters)
    rows = card.where(F.col("event_date") > F.lit(today).cast("date"))
    for side in ("red", "blue"):
        rows = rows.join(names.select(F.col("name").alias(f"{side}_name"), F.col("fighter_id").alias(f"{side}_id")), f"{side}_name")
    return rows.orderBy("event_date", "red_id", "blue_id").limit(top)
