"""Review of source values: rules by field, formats of bouts, and what a person is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.names import ascii_name, short_id
from ringside.functions.parsing import time_format_rounds

#: Fields in the order in which they are looked at, and the reason under which a value is put to a person.
REASONS = {
    "country": "country whitespace",
    "stance": "stance whitespace or missing",
    "weight_class": "division naming, Catch Weight, or women's division",
    "title_bout": "title-bout semantics",
    "no_of_rounds": "four-round or scheduled-round review",
    "finish_round": "finish round exceeds scheduled rounds",
    "height": "implausible measurement",
    "reach": "implausible measurement",
    "finish": "unknown finish method",
    "event": "event-name consistency",
    "location": "location consistency",
}
#: Finish methods that need no review.
KNOWN_FINISHES = ("ko/tko", "submission", "decision", "draw", "nc")
MEASURES = (120, 260)


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def needs_review(field: str, value: Column, rounds: Column) -> Column:
    """Whether a field's text (empty for null) has to be reviewed; rounds: the row's scheduled rounds as text."""
    padded = value != F.trim(value)
    if field in ("country", "stance"):
        return (value == "") | padded
    if field == "weight_class":
        low = F.lower(value)
        return low.contains("catch") | low.contains("women") | padded
    if field == "no_of_rounds":
        return F.trim(value) == "4"
    if field == "finish_round":
        return F.coalesce(_number(value) > _number(rounds), F.lit(False))
    if field in ("height", "reach"):
        return F.coalesce(~_number(value).between(*MEASURES), F.lit(False))
    if field == "finish":
        return (value != "") & ~F.lower(value).isin(*KNOWN_FINISHES)
    return (value != "") & padded


def review_queue(rows: DataFrame, source: str, key: str, examples: int = 3) -> DataFrame:
    """One item for each reason and raw value: category, action proposed, rows concerned and the first few keys.

    All fields that the rows have are unpivoted in one pass, and only values that a rule holds for go on. Counts are
    summed before they are dealt; of a value's keys each task sends on no more than `examples`, as Spark limits groups
    below a rank before the exchange.
    """
    there = [f for f in REASONS if f in rows.columns]
    text = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in there}
    rounds = text.get("no_of_rounds", F.lit(None).cast("string"))
    cells = [F.when(needs_review(f, text[f], rounds), F.struct(F.lit(f).alias("field"), F.lit(REASONS[f]).alias("reason"), text[f].alias("raw_value"))) for f in there]
    found = rows.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("key", "x.*")
    by = ["reason", "raw_value"]
    counts = found.groupBy(*by).agg(F.count("*").alias("affected"), F.count_distinct("field").alias("fields"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    shown = found.select(*by, "key").distinct().withColumn("place", place).where(F.col("place") <= examples)
    named = shown.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("key")), "; ").alias("examples"))
    items = counts.join(named, by)
    proposed = F.nullif(F.trim("raw_value"), F.lit(""))
    action = F.coalesce(F.concat(F.lit("review exact taxonomy mapping to: "), proposed), F.lit("defer; no canonical value proposed"))
    category = F.concat(F.lit("taxonomy."), F.replace(ascii_name(F.col("reason")), F.lit(" "), F.lit("_")))
    items = items.withColumns({"source": F.lit(source), "proposed_value": proposed, "action": action, "category": category})
    return items.withColumn("review_id", short_id("review-", "source", "category", "raw_value"))


def _formats(rows: DataFrame) -> DataFrame:
    rounds = F.col("rounds")
    return rows.withColumns({"time_format": F.trim(rounds), "scheduled": time_format_rounds(F.trim(rounds)).cast("long"), "finish": F.col("round_no").cast("long")})


def special_formats(rows: DataFrame, bout: str, key: str, examples: int = 3) -> DataFrame:
    """Overtime formats: scheduled rounds, rows, bouts, finishes beyond the schedule, and the first few keys.

    rows: rounds (a time format), round_no, and the two columns named.
    """
    special = _formats(rows).where(F.col("time_format").contains("Rnd +") & F.col("time_format").contains("OT"))
    found = special.groupBy("time_format").agg(F.max("scheduled").alias("scheduled"), F.count("*").alias("rows"), F.count_distinct(bout).alias("bouts"), F.count_if(F.col("finish") > F.col("scheduled")).alias("violations"))
    place = F.row_number().over(Window.partitionBy("time_format").orderBy(key))
    shown = special.select("time_format", key).withColumn("place", place).where(F.col("place") <= examples)
    return found.join(shown.groupBy("time_format").agg(F.array_join(F.array_sort(F.collect_list(key)), "; ").alias("examples")), "time_format")


def format_combinations(rows: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent combinations of time format, scheduled and finish round, and whether they can be."""
    found = _formats(rows).groupBy("time_format", "scheduled", "finish").agg(F.count("*").alias("rows"))
    found = found.withColumn("result", F.when(F.col("finish") > F.col("scheduled"), "flag").otherwise("valid"))
    return found.orderBy(F.desc("rows"), "time_format", F.asc_nulls_first("scheduled"), F.asc_nulls_first("finish")).limit(most)


def format_items(rows: DataFrame, four: DataFrame, bout: str, key: str) -> DataFrame:
    """Items of both kinds that a reviewer gets for formats: overtime formats, and four-round bouts of the other source.

    four: reconcile.four_round_checks(): record_id, state, evidence.
    """
    special = special_formats(rows, bout, key).select(
        F.lit("bout_format.special_format").alias("category"), F.col("time_format").alias("subject"), F.concat(F.lit("preserve explicit special format; scheduled rounds="), F.col("scheduled").cast("string")).alias("action"), "rows", "bouts"
    )
    action = F.when(F.col("state") == "confirmed", F.concat(F.lit("confirmed by "), F.col("evidence"))).otherwise(F.lit("review scheduled rounds"))
    rounds = four.select(F.lit("bout_format.four_rounds").alias("category"), F.col("record_id").alias("subject"), action.alias("action"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("bouts"))
    return special.unionByName(rounds).withColumn("review_id", short_id("BOUT-", "category", "subject"))


def _text(value: Column) -> Column:
    """Trimmed text; null for an empty one."""
    return F.nullif(F.trim(value), F.lit(""))


#: Rules of the coercions below.
REQUIRED, BAD_DATE, BAD_ROUNDS, BAD_TITLE = "CAN-001.required_source_field", "CAN-001.invalid_fight_date", "CAN-001.invalid_scheduled_rounds", "CAN-001.invalid_title_bout"


def coerced(rows: DataFrame, required: tuple[str, ...], date: str, rounds: str, title: str, labels: tuple[str, ...]) -> DataFrame:
    """rows with typed fields, the rules they break in order, and the labels that were observed, as they were written.

    An ISO date, a whole number above zero, true or false in any case; required fields may not be empty. A field that
    breaks a rule is null.
    """
    value = {n: _text(F.col(n)) for n in {*required, date, rounds, title, *labels}}
    iso = F.when(value[date].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value[date].try_cast("date"))
    whole = F.when(value[rounds].rlike("^[0-9]+$"), value[rounds].try_cast("int"))
    flag = F.when(F.lower(value[title]) == "true", True).when(F.lower(value[title]) == "false", False)
    rules = [F.when(value[n].isNull(), F.lit(f"{REQUIRED}:{n}")) for n in required]
    rules += [F.when(value[date].isNotNull() & iso.isNull(), F.lit(BAD_DATE)), F.when(F.coalesce(whole < 1, F.lit(True)), F.lit(BAD_ROUNDS)), F.when(value[title].isNotNull() & flag.isNull(), F.lit(BAD_TITLE))]
    seen = F.array_compact(F.array(*(F.when(value[n].isNotNull(), F.concat(F.lit(f"{n}="), value[n])) for n in labels)))
    return rows.withColumns({"fight_date_value": iso, "rounds_value": F.when(whole > 0, whole), "title_value": flag, "issues": F.array_compact(F.array(*rules)), "labels": seen})


def authority_scopes(authorities: DataFrame, primary: str, supplemental: str, first_source: str) -> DataFrame:
    """What each decision on taxonomy is about, and whether it's in force.

    authorities: category, ledger, kind, record_type, decision, source_values ('source: value', further ones behind ' || '),
    proposed. A null policy has no value; an unknown category has no field.
    """
    category, one = F.col("category"), F.split_part("source_values", F.lit(" || "), F.lit(1))
    source = F.split_part(one, F.lit(": "), F.lit(1))
    policy = category == "taxonomy.missing_stance_policy"
    by_source = lambda here, there: F.when(source == first_source, here).otherwise(there)
    field = (
        F.when(policy, "stance").when(category.contains("country_whitespace"), "country").when(category.contains("division"), by_source("weight_class", "bout_type"))
        .when(category.contains("stance"), "stance").when(category.contains("finish"), by_source("finish", "method"))
    )
    is_taxonomy = category.startswith("taxonomy.") & ((F.col("ledger") == primary) | F.coalesce(F.col("kind") == "taxonomy", F.lit(False)))
    active = F.when(F.col("ledger") == supplemental, F.col("record_type") == "supplemental_authority").otherwise(F.col("decision").isin("approve_corrected_mapping", "preserve_null"))
    raw = F.when(~policy, F.substring(one, F.length(source) + 3, F.length(one)))
    return authorities.withColumns({
        "source_name": F.when(policy, first_source).otherwise(source), "field_name": field, "raw_value": raw,
        "canonical_value": F.when(~policy, F.regexp_replace("proposed", "^review exact taxonomy mapping to: ", "")), "is_taxonomy": is_taxonomy, "is_active": F.coalesce(active, F.lit(False)),
    })


def composition(items: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Each category's items against how many a package has to have, either way round."""
    wanted = items.sparkSession.createDataFrame(sorted(expected.items()), "category string, expected long")
    counts = items.groupBy("category").agg(F.count("*").alias("actual"))
    met = counts.join(F.broadcast(wanted), "category", "full_outer").fillna(0, ["expected", "actual"])
    return met.withColumn("agrees", F.col("expected") == F.col("actual"))
