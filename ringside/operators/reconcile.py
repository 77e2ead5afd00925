"""Two sources of the same bouts, matched and compared field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.names import ascii_name, method_code, pair_key, weight_class
from ringside.functions.parsing import clock_seconds, leading_rounds, side_outcome, text_or_null

FIELDS = ("outcome", "method", "rounds", "division", "clock", "round_no")
#: Fields whose difference is one of spelling or detail.
MINOR = ("method", "rounds", "division", "clock", "round_no")


def keyed(source: DataFrame) -> DataFrame:
    """Adds normal names, the match key and the winner's name in place of a corner."""
    red, blue = ascii_name(F.col("red_name")), ascii_name(F.col("blue_name"))
    label = side_outcome(F.col("outcome"))
    winner = F.when(label == "red", F.col("red_key")).when(label == "blue", F.col("blue_key")).otherwise(label)
    keyed = source.withColumns({"red_key": red, "blue_key": blue}).withColumns({"match_key": pair_key(F.col("event_date"), F.col("red_key"), F.col("blue_key")), "winner": winner})
    return keyed.withColumn("n_same_key", F.count("*").over(Window.partitionBy("match_key")))


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on the match key: struct columns l and r, and how it went.

    ambiguous where either source has the key more than once (all of its rows are reported, none is compared).
    """
    ls, rs = keyed(left), keyed(right)
    l_one = ls.select(F.col("match_key"), F.struct("*").alias("l"))
    r_one = rs.select(F.col("match_key"), F.struct("*").alias("r"))
    joined = l_one.join(r_one, "match_key", "full_outer")
    how = (
        F.when((F.col("l.n_same_key") > 1) | (F.col("r.n_same_key") > 1), "ambiguous").when(F.col("r.record_id").isNull(), "only_left")
        .when(F.col("l.record_id").isNull(), "only_right").otherwise("both")
    )
    return joined.withColumn("matching", how)


def _comparable(field: str, side: str) -> tuple[Column, Column]:
    """The raw value of a field, and the form in which it's compared."""
    raw = F.col(f"{side}.winner" if field == "outcome" else f"{side}.{field}").cast("string")
    normal = {
        "outcome": raw, "method": method_code(raw), "rounds": leading_rounds(raw).cast("string"), "division": weight_class(raw),
        "clock": clock_seconds(raw).cast("string"), "round_no": raw,
    }[field]
    return text_or_null(raw), normal


def field_status(field: str) -> Column:
    (l_raw, l_key), (r_raw, r_key) = _comparable(field, "l"), _comparable(field, "r")
    return (
        F.when(l_raw.isNull() & r_raw.isNull(), "missing_both").when(l_raw.isNull(), "missing_left").when(r_raw.isNull(), "missing_right")
        .when(l_raw == r_raw, "equal").when(l_key == r_key, "equivalent").otherwise("differs")
    )


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Match, status of each field, and the class: the outcome's conflict stands above that of any other field."""
    rows = matched(left, right)
    both = F.col("matching") == "both"
    rows = rows.withColumns({f"{f}_status": F.when(both, field_status(f)) for f in FIELDS})
    differing = F.filter(F.array(*(F.when(F.col(f"{f}_status") == "differs", F.lit(f)) for f in FIELDS)), lambda x: x.isNotNull())
    only_spelling = F.forall(F.array(*(F.col(f"{f}_status") for f in FIELDS)), lambda s: s.isin("equal", "missing_both"))
    rows = rows.withColumn("differing", F.when(both, differing))
    kind = (
        F.when(F.col("matching") != "both", F.col("matching")).when(F.array_contains("differing", "outcome"), "outcome_conflict")
        .when(F.size("differing") > 1, "several_differ").when(F.size("differing") == 1, F.concat(F.get("differing", F.lit(0)), F.lit("_differs")))
        .when(only_spelling, "exact").otherwise("equivalent")
    )
    return rows.withColumn("class", kind)


def reconciliation(left: DataFrame, right: DataFrame) -> DataFrame:
    statuses = [f"{f}_status" for f in FIELDS]
    return compared(left, right).select("match_key", F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), "matching", *statuses, "class")


def report(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of each class, of each combination of differing fields, and of each status of a field: one pass, one sum."""
    rows = compared(left, right)
    told = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    names = [told("class", F.col("class")), F.when(F.size("differing") > 0, told("combination", F.array_join("differing", "+")))]
    names += [F.when(F.col("matching") == "both", told("field", F.concat(F.lit(f"{f}:"), F.col(f"{f}_status")))) for f in FIELDS]
    found = rows.select(F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("x"))
    return found.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def for_review(left: DataFrame, right: DataFrame) -> DataFrame:
    """What a person has to decide: ambiguous keys, conflicting outcomes, several differences."""
    return reconciliation(left, right).where(F.col("class").isin("ambiguous", "outcome_conflict", "several_differ"))


def crosswalk(left: DataFrame, right: DataFrame) -> DataFrame:
    """source, record and bout of all rows: the second source's bouts come first, the first source's attach or open new ones."""
    rows = matched(left, right)
    bout = F.sha2(F.col("match_key"), 256)
    both = F.array(
        F.when(F.col("l.record_id").isNotNull(), F.struct(F.lit("one").alias("source"), F.col("l.record_id").alias("record_id"), F.when(F.col("r.record_id").isNull(), "opens").otherwise("attaches").alias("role"))),
        F.when(F.col("r.record_id").isNotNull(), F.struct(F.lit("two").alias("source"), F.col("r.record_id").alias("record_id"), F.lit("opens").alias("role"))),
    )
    return rows.select(bout.alias("bout_key"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("bout_key", "x.*").distinct()


def semantic_groups(walk: DataFrame) -> DataFrame:
    """Of each bout, its sources and its records, each list sorted for itself."""
    return walk.groupBy("bout_key").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("records"))


def first_of_duplicates(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by `order`, and all others with the first one's: nothing is lost unseen."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumns({"place": F.row_number().over(w), "first": F.first(order).over(w)})
    return numbered.where("place = 1").drop("place", "first"), numbered.where("place > 1")


def division_of(walk: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """A bout's division: the first source's, or else the second's, blank ones left out."""
    pick = lambda df, s: walk.where(F.col("source") == s).join(df.select("record_id", "division"), "record_id").groupBy("bout_key").agg(F.min(text_or_null(weight_class(F.col("division")))).alias(s))
    return pick(one, "one").join(pick(two, "two"), "bout_key", "full_outer").select("bout_key", F.coalesce("one", "two").alias("division"))


def resolved_outcomes(left: DataFrame, right: DataFrame, authorities: DataFrame) -> DataFrame:
    """Winner of each matched bout: agreed by both sources, or as a decision for just these two records says.

    authorities (left_id, right_id, winner, decision_id): small by nature, but joined by whatever way its size suggests.
    """
    rows = compared(left, right).where("matching = 'both'").select(F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), F.col("l.winner").alias("l_winner"), F.col("r.winner").alias("r_winner"))
    met = rows.join(authorities.withColumnRenamed("winner", "decided"), ["left_id", "right_id"], "left")
    agreed = F.col("l_winner") == F.col("r_winner")
    return met.select("left_id", "right_id", F.when(agreed, F.col("l_winner")).otherwise(F.col("decided")).alias("winner"), F.when(agreed, "agreed").when(F.col("decided").isNotNull(), "decided").otherwise("open").alias("basis"))


def metadata_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """How matched records agree in division and method: in the text, in letters and digits alone, or not; null-safe."""
    rows = matched(left, right).where("matching = 'both'")
    folded = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    how = lambda f: F.when(F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), "exact").when(folded(F.col(f"l.{f}")) == folded(F.col(f"r.{f}")), "folded").otherwise("differs")
    return rows.select(F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), how("division").alias("division_agreement"), how("method").alias("method_agreement"))


def outcome_tuples_agree(left: DataFrame, right: DataFrame) -> DataFrame:
    """Null-safe equality of all that says how a bout ended, as one tuple."""
    rows = matched(left, right).where("matching = 'both'")
    both = [F.struct(F.col(f"{s}.winner"), F.col(f"{s}.method"), F.col(f"{s}.clock"), F.col(f"{s}.round_no")) for s in "lr"]
    return rows.select(F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), both[0].eqNullSafe(both[1]).alias("agree"))


def four_round_checks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left records of four rounds: confirmed where exactly one matched right record has a special format, else unresolved."""
    four = keyed(left).where(F.trim("rounds").isin("4", "4.0")).select("record_id", "match_key")
    special = keyed(right).where(F.col("rounds").contains("Rnd +") & F.col("rounds").contains("OT")).groupBy("match_key").agg(F.count("*").alias("n"), F.min("record_id").alias("evidence"))
    met = four.join(special, "match_key", "left")
    return met.select("record_id", F.when(F.col("n") == 1, "confirmed").otherwise("unresolved").alias("state"), F.when(F.col("n") == 1, F.col("evidence")).alias("evidence"))


def mapped(rows: DataFrame, labels: DataFrame, field: str) -> DataFrame:
    """A label's canonical value by its exact text, trimmed and in one case; unknown labels put the row aside. labels: label, value."""
    table = labels.select(F.lower(F.trim("label")).alias("_label"), F.col("value").alias(f"{field}_value")).distinct()
    met = rows.withColumn("_label", F.lower(F.trim(field))).join(table, "_label", "left").drop("_label")
    return met.withColumn("accepted", F.col(f"{field}_value").isNotNull())


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def _corner(label: Column) -> Column:
    """The winner's corner as written, or how the bout ended without one; null for any other label."""
    low = F.lower(label)
    return F.when(low.isin("red", "red_win"), "red").when(low.isin("blue", "blue_win"), "blue").when(low.isin("draw", "nc", "no_contest", "no contest"), low)


def source_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each pair of records: which fields both sources fill and fill differently, and whether the older rule sees a conflict.

    conflicts: winner (the person), method, finish_round, finish_time, scheduled_rounds as written, division without
    case and signs. legacy_conflict compares corners, methods without case and signs, and scheduled rounds.
    """
    rows = matched(left, right).where("matching = 'both'")
    value = {
        "winner": lambda s: F.col(f"{s}.winner"), "method": lambda s: F.col(f"{s}.method"), "finish_round": lambda s: F.col(f"{s}.round_no").cast("string"), "finish_time": lambda s: F.col(f"{s}.clock"),
        "scheduled_rounds": lambda s: leading_rounds(F.col(f"{s}.rounds")).cast("string"), "division": lambda s: _folded(F.col(f"{s}.division")),
    }
    both_differ = lambda a, b: F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    names = [F.when(both_differ(v("l"), v("r")), F.lit(n)) for n, v in value.items()]
    corner = lambda s: _corner(F.col(f"{s}.outcome"))
    known = lambda a, b: F.coalesce(a != b, F.lit(False))
    legacy = known(corner("l"), corner("r")) | known(_folded(F.col("l.method")), _folded(F.col("r.method"))) | known(leading_rounds(F.col("l.rounds")), leading_rounds(F.col("r.rounds")))
    return rows.select(F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), F.array_join(F.array(*names), ",").alias("conflicts"), legacy.alias("legacy_conflict"))


def conflict_counters(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with each conflict, all pairs, and those in which the older rule and the list of conflicts disagree."""
    rows = source_conflicts(left, right).withColumn("x", F.explode(F.concat(F.split("conflicts", ","), F.array(F.lit("pairs")), F.when(F.col("legacy_conflict"), F.array(F.lit("legacy"))).otherwise(F.array()), F.when(F.col("legacy_conflict") != (F.col("conflicts") != ""), F.array(F.lit("rules disagree"))).otherwise(F.array()))))
    return rows.where("x <> ''").groupBy(F.col("x").alias("name")).agg(F.count("*").alias("n"))


def outcome_categories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose outcomes differ, and what kind of difference a person has to settle."""
    rows = matched(left, right).where("matching = 'both'").where(field_status("outcome") == "differs")
    values, methods = F.array("l.winner", "r.winner"), F.array(F.lower("l.method"), F.lower("r.method"))
    kind = (
        F.when(F.exists(values, lambda v: v.startswith("uninterpreted:")), "outcome.source_parsing").when(F.array_contains(values, "no_contest"), "outcome.no_contest_vs_winner")
        .when(F.array_contains(values, "draw"), "outcome.draw_vs_winner").when(F.array_contains(methods, "overturned"), "outcome.overturned_result").otherwise("outcome.winner_disagreement")
    )
    return rows.select(F.col("l.record_id").alias("left_id"), F.col("r.record_id").alias("right_id"), kind.alias("category"))
