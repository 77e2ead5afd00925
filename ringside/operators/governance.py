"""Authorities, reviews and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.names import row_digest, short_id


def resolved_authorities(authorities: DataFrame, primary: str) -> DataFrame:
    """Of decisions on one scope: the primary ledger's first, then by id; others are duplicates of it or superseded by it.

    authorities: scope, ledger, authority_id, value; an id stands once in a ledger.
    """
    rank = F.struct(F.when(F.col("ledger") == primary, 0).otherwise(1), F.col("authority_id"))
    # summed before it's dealt: a scope may hold any share of the rows
    best = authorities.groupBy("scope").agg(F.min_by(F.struct("ledger", "authority_id", "value"), rank).alias("best"))
    rows = authorities.join(best, "scope")
    first = (F.col("authority_id") == F.col("best.authority_id")) & (F.col("ledger") == F.col("best.ledger"))
    state = F.when(first, "active").when(F.col("value") == F.col("best.value"), "duplicate").otherwise("superseded")
    return rows.withColumn("state", state).drop("best")


def duplicate_ids(authorities: DataFrame) -> DataFrame:
    return authorities.groupBy("authority_id").agg(F.count("*").alias("n")).where("n > 1")


def applicable(authorities: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """Decisions on values of a field that the retained rows have (a semi join), and the rest as not retained."""
    values = rows.select(F.col(field).cast("string").alias("scope")).distinct()
    met = authorities.join(values.withColumn("there", F.lit(True)), "scope", "left")
    return met.withColumn("coverage", F.when(F.col("there"), "applicable").otherwise("not_retained")).drop("there")


def unused(decisions: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions that no row asks for: a build with any has to fail."""
    return decisions.join(rows.select(*keys), keys, "left_anti")


def review_items(rows: DataFrame, category: str, value: Column, evidence: str, examples: int = 3) -> DataFrame:
    """One item for each value: rows concerned and the first few records as evidence. Each task sends on no more of a
    value's records than are shown, so a frequent value gathers no list."""
    kept = rows.withColumn("value", value).where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("value").orderBy(evidence))
    shown = kept.select("value", evidence).withColumn("place", place).where(F.col("place") <= examples)
    names = shown.groupBy("value").agg(F.array_join(F.array_sort(F.collect_list(evidence)), ", ").alias("examples"))
    counts = kept.groupBy("value").agg(F.count("*").alias("affected"))
    items = counts.join(names, "value").withColumn("category", F.lit(category))
    return items.withColumn("review_id", short_id("review-", "category", F.col("value").cast("string")))


def samples(rows: DataFrame, kind: str, key: str, each: int = 6, most: int = 30) -> DataFrame:
    """The first few rows of each kind, for a reader."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(key))
    return rows.withColumn("place", place).where(F.col("place") <= each).orderBy(kind, "place").limit(most)


def imported(decisions: DataFrame, items: DataFrame, ledger: DataFrame) -> DataFrame:
    """What becomes of decisions: unknown, retired, contradictory, repeated, or accepted, one state each.

    decisions: review_id, decision; items: review_id, retired; ledger: review_id, decision as decided before.
    """
    w = Window.partitionBy("review_id")
    rows = decisions.withColumn("variants", F.size(F.collect_set("decision").over(w)))
    met = rows.join(items, "review_id", "left").join(ledger.withColumnRenamed("decision", "decided"), "review_id", "left")
    state = (
        F.when(F.col("retired").isNull(), "unknown").when(F.col("retired"), "retired").when(F.col("variants") > 1, "contradictory")
        .when(F.col("decided") == F.col("decision"), "repeated").when(F.col("decided").isNotNull(), "contradictory").otherwise("accepted")
    )
    return met.withColumn("state", state).drop("variants", "retired", "decided")


def append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that a later version of an append-only table has lost."""
    return old.exceptAll(new)


def provenance(artefacts: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """artefact, row key, lineage (which table, which key) and the row's digest, for several tables.

    artefacts: name -> (rows, key columns, lineage columns). One select and explode a table, and a union.
    """
    def one(name: str, rows: DataFrame, keys: list[str], lineage: list[str]) -> DataFrame:
        links = F.explode(F.array(*(F.struct(F.lit(c).alias("lineage"), F.col(c).cast("string").alias("lineage_key")) for c in lineage)))
        out = rows.select(F.lit(name).alias("artefact"), F.concat_ws(":", *keys).alias("row_key"), row_digest(*rows.columns).alias("row_sha256"), links.alias("x"))
        return out.select("artefact", "row_key", "x.*", "row_sha256").where("lineage_key IS NOT NULL")

    return reduce(DataFrame.unionByName, (one(n, *x) for n, x in artefacts.items()))


def lineage_coverage(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("artefact").agg(F.count("*").alias("links"), F.count_distinct("row_key").alias("rows_covered"))


def table_digest(rows: DataFrame) -> DataFrame:
    """Row count and a digest of a table's content that doesn't depend on order: for replays to compare.

    A row is told by its values as text, in order of the columns' names; the sum of 60 bits of all rows' digests counts
    repeated rows, too.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(rows.columns)))
    parts = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(parts), F.lit(0)).cast("string").alias("digest_sum"))
