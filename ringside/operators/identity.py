"""Who is who: aliases, candidates, reviewed decisions that replace one another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.names import ascii_name, name_uuid
from ringside.operators.graph import components, followed


def alias_rows(source: DataFrame) -> DataFrame:
    """Both names of each record, with their normal forms."""
    two = F.explode(F.array(F.struct(F.lit("red").alias("side"), F.col("red_name").alias("raw")), F.struct(F.lit("blue").alias("side"), F.col("blue_name").alias("raw"))))
    return source.select("record_id", two.alias("x")).select("record_id", "x.*").withColumn("name_key", ascii_name(F.col("raw")))


def canonical_fighters(aliases: DataFrame) -> DataFrame:
    """One row a key: a name-based id, the most frequent spelling (ties to the first), and how many there are."""
    counted = aliases.groupBy("name_key", "raw").agg(F.count("*").alias("n"))
    # of equally frequent spellings the first by name: the negative place of a reversed order needs no window
    best = counted.groupBy("name_key").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("name"), F.count("*").alias("spellings"), F.sum("n").alias("records"))
    return best.withColumn("fighter_id", name_uuid(F.concat(F.lit("fighter:"), "name_key")))


def candidate_pairs(aliases: DataFrame) -> DataFrame:
    """Spellings that share a key, each with its key's first one: a star in place of all pairs, which links the same ones."""
    spellings = aliases.groupBy("name_key", "raw").agg(F.min("record_id").alias("record_id"))
    first = spellings.groupBy("name_key").agg(F.min("raw").alias("first_raw"))
    return spellings.join(first, "name_key").where("raw <> first_raw").select("name_key", "first_raw", "raw", F.lit("review_required").alias("state"), F.lit(1.0).alias("score"))


def review_queue(aliases: DataFrame) -> DataFrame:
    """Keys with more than one spelling: the spellings in order, the records concerned."""
    spellings = aliases.groupBy("name_key", "raw").agg(F.count("*").alias("n"))
    return spellings.groupBy("name_key").agg(F.array_join(F.array_sort(F.collect_list("raw")), "; ").alias("spellings"), F.sum("n").alias("records"), F.count("*").alias("k")).where("k > 1").drop("k")


def homonyms(aliases: DataFrame, divisions: DataFrame, apart: int = 2) -> DataFrame:
    """Keys seen in `apart` divisions and more: one name may be several people. divisions: record_id, division."""
    met = aliases.join(divisions, "record_id").groupBy("name_key").agg(F.count_distinct("division").alias("divisions"))
    return met.where(F.col("divisions") >= apart)


def looked_up(rows: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewed identity by an exact key of several parts; fails on keys with conflicting decisions, null where none is."""
    decided = reviewed.groupBy(*keys).agg(F.min("fighter_id").alias("fighter_id"), F.count_distinct("fighter_id").alias("n"))
    checked = decided.withColumn("fighter_id", F.when(F.col("n") > 1, F.raise_error(F.lit("conflicting reviewed aliases"))).otherwise(F.col("fighter_id"))).drop("n")
    return rows.join(checked, keys, "left")


def bitemporal(decisions: DataFrame) -> DataFrame:
    """Append-only decisions to versions: each is current until the next of its alias. decisions: alias, fighter_id, decided_at, decision_id."""
    next_ = Window.partitionBy("alias").orderBy("decided_at", "decision_id")
    rows = decisions.withColumns({"system_to": F.lead("decided_at").over(next_), "superseded_by": F.lead("decision_id").over(next_)})
    return rows.withColumnRenamed("decided_at", "system_from").withColumn("is_current", F.col("system_to").isNull())


def as_of(versions: DataFrame, moment: str) -> DataFrame:
    """Versions that were current at a moment."""
    t = F.lit(moment).cast("timestamp")
    return versions.where((F.col("system_from") <= t) & (F.col("system_to").isNull() | (F.col("system_to") > t)))


def active_merges(merges: DataFrame, splits: DataFrame) -> DataFrame:
    """Merges that no split has undone."""
    if {"from_id", "into_id"} - set(merges.columns):
        raise ValueError("merges need from_id and into_id")
    return merges.where("from_id <> into_id").join(splits.select("merge_id"), "merge_id", "left_anti")


def _replayed(events: pd.DataFrame) -> pd.DataFrame:
    """Events of one component in order -> each with its state."""
    events, into, by, states = events.sort_values("event_id"), {}, {}, []
    for event, kind, one, other in zip(events.event_id, events.kind, events.from_id, events.into_id, strict=True):
        if kind == "merge":
            applied = one != other and one not in into and other not in into
            if applied:
                into[one], by[one] = other, event
        else:
            applied = into.pop(one, None) is not None
            by.pop(one, None)
        states.append("applied" if applied else "quarantined")
    return events.assign(state=states, active=events.event_id.isin(set(by.values())))


def replayed(events: DataFrame) -> DataFrame:
    """Merges and splits of identities in the order of event_id, each with its state and whether it's a merge still in force.

    events: event_id (unique), kind (merge or split), from_id, into_id (null for a split, which makes from_id active
    again). A merge is applied if both identities are active, that is not merged into another one, at its turn; a split
    if its identity is merged; anything else is quarantined and changes nothing. What no merge connects is replayed in
    parallel; a task holds the events of one connected set of identities.
    """
    links = events.where("kind = 'merge' AND from_id <> into_id").select(F.lit(0).alias("slice"), F.col("from_id").alias("a"), F.col("into_id").alias("b"))
    parts = components(links).select(F.col("node").alias("from_id"), "part")
    placed = events.join(parts.hint("merge"), "from_id", "left").withColumn("part", F.coalesce("part", "from_id"))
    schema = "event_id long, kind string, from_id long, into_id long, state string, active boolean"
    fold = lambda own: _replayed(own[["event_id", "kind", "from_id", "into_id"]])
    # without nulls ids stay whole numbers
    filled = placed.select("part", "event_id", "kind", F.col("from_id").cast("long"), F.coalesce("into_id", "from_id").cast("long").alias("into_id"))
    return filled.groupBy("part").applyInPandas(fold, schema).withColumn("into_id", F.when(F.col("kind") == "merge", F.col("into_id")))


def present_identities(ids: DataFrame, events: DataFrame) -> DataFrame:
    """Each id and the identity that it stands for after all events: chains of merges in force are followed to their ends.

    ids: a column id. An id that nothing merges stands for itself.
    """
    ends = followed(events.where("active").select(F.col("from_id").alias("node"), F.col("into_id").alias("to")))
    return ids.join(ends.withColumnsRenamed({"node": "id", "end": "present_id"}).hint("merge"), "id", "left").withColumn("present_id", F.coalesce("present_id", "id"))


def evidence_as_of(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Each piece of evidence with the version of its alias that was current when it was seen: an as-of join.

    evidence: evidence_id, alias, seen_at; versions: bitemporal(). Both are put in one order by alias and time, and a
    version is carried on to the evidence behind it; a version of the same moment is current. No pairs are made. Evidence
    older than every version has none.
    """
    told = versions.select("alias", F.col("system_from").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("evidence_id"), F.struct("decision_id", "fighter_id").alias("version"))
    seen = evidence.select("alias", F.col("seen_at").alias("at"), F.lit(1).alias("turn"), F.col("evidence_id").cast("string").alias("evidence_id"), F.lit(None).cast(told.schema["version"].dataType).alias("version"))
    order = Window.partitionBy("alias").orderBy("at", "turn", F.col("version.decision_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = told.unionByName(seen).withColumn("version", F.last("version", ignorenulls=True).over(order)).where("turn = 1")
    return rows.select("evidence_id", "alias", F.col("at").alias("seen_at"), "version.decision_id", "version.fighter_id")


def lineage_differences(claimed: DataFrame, retained: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Where two multisets of lineage tuples aren't equal: by, the tuple, and how often it's claimed and retained.

    A signed count of both sides needs no join, and repeats count.
    """
    both = claimed.select(by, *columns, F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(retained.select(by, *columns, F.lit(0).alias("c"), F.lit(1).alias("r")))
    return both.groupBy(by, *columns).agg(F.sum("c").alias("claimed"), F.sum("r").alias("retained")).where("claimed <> retained")


def applied_links(requests: DataFrame, evidence: DataFrame, claimed: DataFrame, retained: DataFrame, columns: list[str]) -> DataFrame:
    """Reviewed links of aliases to fighters, each applied or quarantined with the first reason that holds.

    requests: link_id, alias, fighter_id, evidence_id; evidence: evidence_as_of(); claimed and retained: lineage tuples by
    link_id. A link is applied if its evidence is of its alias, was seen when a version of it was current, that version
    doesn't name another fighter, and the lineage it claims is just the one retained.
    """
    wrong = lineage_differences(claimed, retained, "link_id", columns).select("link_id").distinct().withColumn("wrong", F.lit(True))
    of = evidence.select(F.col("evidence_id"), F.col("alias").alias("seen_alias"), F.col("fighter_id").alias("seen_fighter"), "decision_id")
    met = requests.join(of, "evidence_id", "left").join(wrong, "link_id", "left")
    reason = (
        F.when(F.col("seen_alias").isNull(), "no evidence").when(F.col("seen_alias") != F.col("alias"), "evidence of another alias").when(F.col("decision_id").isNull(), "no current version")
        .when(F.col("seen_fighter") != F.col("fighter_id"), "another fighter").when(F.col("wrong"), "lineage differs")
    )
    return met.select("link_id", "alias", "fighter_id", F.when(reason.isNull(), "applied").otherwise("quarantined").alias("state"), reason.alias("reason"))
