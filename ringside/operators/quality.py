"""Gates: what is wrong with a record, whether all rows are accounted for, whether a table keeps its promises."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.names import ascii_name
from ringside.functions.parsing import positive_rounds, side_outcome

#: Columns by name that tell what came of a bout, and parts of names that do.
OUTCOME_COLUMNS = ("winner", "winner_id", "outcome", "finish", "finish_method", "finish_round", "finish_time", "is_draw", "is_no_contest", "result")


def leakage_class(column: str) -> str:
    """Of a column by its name alone: identity, schedule, outcome, corner_statistic, difference or unclassified, which is closed out too."""
    low = column.lower()
    if low in OUTCOME_COLUMNS or low.startswith("finish"):
        return "outcome"
    if low.endswith(("_dif", "_diff")):
        return "difference"
    if low.endswith(("_id", "_name", "_fighter")) or low in ("fighter", "opponent"):
        return "identity"
    if low.startswith(("r_", "b_", "red_", "blue_")):
        return "corner_statistic"
    return "schedule" if low in ("date", "fight_date", "event_date", "location", "country", "weight_class", "division", "title_bout", "no_of_rounds", "rounds") else "unclassified"


def forbid(columns: list[str]) -> None:
    bad = [c for c in columns if leakage_class(c) in ("outcome", "difference", "corner_statistic")]
    if bad:
        raise ValueError(f"columns that a model may not see: {', '.join(bad)}")


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256("\n".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)).encode()).hexdigest()


def fingerprint_gate(df: DataFrame, allowed: set[str]) -> DataFrame:
    if (found := schema_fingerprint(df)) not in allowed:
        raise ValueError(f"schema {found} is not an accepted one")
    return df


def issues() -> Column:
    """Rules that a source record breaks, in order: an array, empty for a sound one."""
    same = ascii_name(F.col("red_name")) == ascii_name(F.col("blue_name"))
    rules = {
        "participants": F.col("red_name").isNull() | F.col("blue_name").isNull() | same, "date": F.col("event_date").isNull(),
        "rounds": positive_rounds(F.col("rounds")).isNull() & (F.coalesce(F.col("rounds"), F.lit("")) != "No Time Limit"),
        "outcome": side_outcome(F.coalesce(F.col("outcome"), F.lit(""))).startswith("uninterpreted:"),
    }
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def validated(source: DataFrame) -> DataFrame:
    """All rows, with the rules they break and whether they're accepted."""
    rows = source.withColumn("issues", issues())
    return rows.withColumn("accepted", F.size("issues") == 0)


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("issues").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def accounting(given: DataFrame, accepted: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """Counts of all three, and how many keys appear or vanish: as a multiset, given = accepted + quarantined."""
    parts = [given.select(key, F.lit(1).alias("g"), F.lit(0).alias("o"))] + [d.select(key, F.lit(0).alias("g"), F.lit(1).alias("o")) for d in (accepted, quarantined)]
    by_key = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(key).agg(F.sum("g").alias("g"), F.sum("o").alias("o"))
    return by_key.agg(F.sum("g").alias("given"), F.sum("o").alias("accounted"), F.count_if(F.col("g") > F.col("o")).alias("lost_keys"), F.count_if(F.col("g") < F.col("o")).alias("new_keys"))


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def snapshot_checks(snapshots: DataFrame, bouts: DataFrame) -> DataFrame:
    """In one pass: both competitors named in the bout and different, two rows a bout, counts never negative, rates within 0 and 1."""
    joined = snapshots.join(bouts.select("bout_id", "fighter_a_id", "fighter_b_id"), "bout_id", "left")
    named = F.array(F.col("fighter_a_id"), F.col("fighter_b_id"))
    member = F.array_contains(named, F.col("fighter_id")) & F.array_contains(named, F.col("opponent_id")) & (F.col("fighter_id") != F.col("opponent_id"))
    rates = [c for c in snapshots.columns if c.endswith("_rate")]
    numbers = [c for c in snapshots.columns if c.startswith(("prior_", "bouts_", "recent_")) and c not in rates]
    bad_rate = [(F.col(c) < 0) | (F.col(c) > 1) | F.isnan(c) for c in rates]
    worst = joined.withColumns({
        "_member": ~F.coalesce(member, F.lit(False)), "_negative": F.least(*numbers) < 0 if len(numbers) > 1 else F.lit(False),
        "_rate": F.coalesce(sum((F.coalesce(b, F.lit(False)).cast("int") for b in bad_rate), F.lit(0)) > 0, F.lit(False)), "_n": F.count("*").over(Window.partitionBy("bout_id")),
    })
    return worst.agg(
        F.count("*").alias("snapshots"), F.count_if("_member").alias("not_in_bout"), F.count_if("_negative").alias("negative"), F.count_if("_rate").alias("rate_out_of_range"),
        F.count_if(F.col("_n") != 2).alias("not_two_a_bout"), F.count_distinct("bout_id").alias("bouts"),
    )


def orphans(lineage: DataFrame, artefact: DataFrame, key: str) -> DataFrame:
    """Lineage whose key its table doesn't have."""
    return lineage.join(artefact.select(key), key, "left_anti")


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column, its distinct values (a null is one): those with one teach nothing."""
    one = rows.agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in columns))).alias("x")).select("x.*")


def parity(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows and columns of two versions of a table: how many cells differ, by column, and rows that one alone has."""
    r = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in columns), F.lit(1).alias("_r"))
    met = left.select(*keys, *columns, F.lit(1).alias("_l")).join(r, keys, "full_outer")
    differs = lambda c: ~(F.col(c).eqNullSafe(F.col(f"r_{c}")) | (F.abs(F.col(c) - F.col(f"r_{c}")) <= tolerance))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return met.agg(F.count_if(both).alias("rows"), F.count_if(~both).alias("unmatched"), *(F.count_if(both & F.coalesce(differs(c), F.lit(True))).alias(f"{c}_differs") for c in columns))
