"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Every source is a queue of blocks of about BLOCK_CHARS characters. One slot of the mixed stream takes one block. Of a
source that has c of a period's n slots, block j (from 0) is released at slot floor(j * n / c) and due by slot
ceil((j + 1) * n / c); the earliest deadline among the released ones goes first. So after any number of slots each
source is less than one block away from its share.

Weights that are multiples of one measure, at most PERIOD of them in all, have a period in which each source gets its
exact share: its schedule is computed once and repeated, and there are at most two schedules a source, however large the
corpus. Other weights are rounded to whole slots of each period, and what a period rounds off is carried to the next: a
source is less than one block away from its share at a period's end, less than two inside it, and there is a schedule
for each period. When a source runs out, the next phase shares its slots among the others.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import shelve

#: Characters of a block, slots of a period, salts that share out a source while its documents are numbered.
BLOCK_CHARS, PERIOD, SALTS = 1 << 16, 840, 1024
#: Name of what no weight is given for, null sources included.
OTHER = "(other)"


def whole_slots(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of each source, one at least, that sum to the period or, with more sources, to their number."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in by_rest[: max(0, period - sum(slots.values()))]:
        slots[s] += 1
    while sum(slots.values()) > max(period, len(slots)):
        slots[max(slots, key=lambda s: (slots[s], s))] -= 1
    return slots


def exact_slots(weights: dict[str, float], period: int) -> dict[str, int] | None:
    """Slots of each source in the shortest period that has the weights exactly; None where it's longer than `period`."""
    total = sum(map(Fraction, weights.values()))
    wanted = {s: Fraction(w) / total for s, w in weights.items()}
    shares = {s: x.limit_denominator(period) for s, x in wanted.items()}
    length = math.lcm(*(x.denominator for x in shares.values()))
    if length > period or any(not x or abs(x - wanted[s]) > x / 10**12 for s, x in shares.items()):
        return None
    return {s: int(x * length) for s, x in shares.items()}


def carried_slots(weights: dict[str, float], period: int, given: dict[str, int]) -> dict[str, int]:
    """Slots of the next period that bring each source, after those given, next to its share of all of them."""
    total, slots = sum(weights.values()), sum(given.values()) + period
    owed = {s: w / total * slots - given[s] for s, w in weights.items()}
    found = {s: max(0, math.floor(x)) for s, x in owed.items()}
    for s in sorted(owed, key=lambda s: (found[s] - owed[s], s))[: max(0, period - sum(found.values()))]:
        found[s] += 1
    return found


def phases(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[dict]:
    """Runs of equal periods: repeats, slots of each source, first block of each source, first slot."""
    left, done, slot, found, given = dict(blocks), dict.fromkeys(blocks, 0), 0, [], {}
    while active := {s: weights[s] for s, n in left.items() if n}:
        slots = exact_slots(active, period)
        exact = slots is not None
        if not exact:
            given = given if given.keys() == active.keys() else dict.fromkeys(active, 0)
            slots = carried_slots(active, period, given)
            given = {s: given[s] + n for s, n in slots.items()}
        for repeats in (min(left[s] // n for s, n in slots.items()), 1) if exact else (1,):
            # whole periods first, then one in which the sources that run out give what they have
            counts = {s: min(left[s], n) for s, n in slots.items() if left[s] and n}
            if repeats and counts:
                found.append({"repeats": repeats, "counts": counts, "first": {s: done[s] for s in counts}, "slot": slot})
                for s, n in counts.items():
                    left[s], done[s] = left[s] - n * repeats, done[s] + n * repeats
                slot += repeats * sum(counts.values())
    return found


def earliest_deadline(counts: Column) -> Column:
    """The sources (by their place in counts) of one period's slots: an array as long as the counts' sum."""
    n = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    places = F.sequence(F.lit(0), F.size(counts) - 1)

    def step(state: Column, slot: Column) -> Column:
        done = state["done"]
        ready = F.filter(places, lambda i: (F.get(done, i) < F.get(counts, i)) & (F.floor(F.get(done, i) * n / F.get(counts, i)) <= slot))
        due = F.transform(ready, lambda i: F.struct(F.ceil((F.get(done, i) + 1) * n / F.get(counts, i)).alias("due"), i.alias("i")))
        best = F.array_min(due)["i"]
        return F.struct(
            F.transform(done, lambda x, i: F.when(i == best, x + 1).otherwise(x)).alias("done"), F.concat(state["out"], F.array(best)).alias("out")
        )

    start = F.struct(F.transform(counts, lambda c: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])


def schedule(docs: DataFrame, weights: dict[str, float], block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """All rows and columns of docs, and mix_source, mix_block, mix_release, mix_slot, mix_deadline and mix_key.

    Columns of docs whose names begin with mix_ make way for these.

    Ordered by (mix_slot, mix_key) the rows are the mixed stream. A row belongs to the block in which its first
    character falls, the documents of a source being in the order of a hash, mix_key; a document longer than a block
    uses up the blocks that it covers. Sources without a weight, and null ones, share the weight of OTHER (the mean of
    the others unless given). A null or empty text counts as one character. Rows that are alike in id and text may
    change places; an empty table stays empty.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if not c.lower().startswith("mix_")))
    weights = {OTHER: sum(weights.values()) / len(weights)} | weights
    names = sorted(weights)
    named = F.when(F.col("source").isin(names), F.col("source")).otherwise(OTHER)
    chars = F.greatest(F.coalesce(F.char_length("text"), F.lit(1)), F.lit(1)).cast("long")
    key = F.xxhash64("doc_id", "text")
    rows = docs.withColumn("mix_source", named).withColumn("mix_key", key).withColumn("mix_salt", F.pmod("mix_key", F.lit(SALTS))).withColumn("mix_chars", chars)

    # characters before each group of a source: one row for each source and salt at most
    groups = rows.groupBy("mix_source", "mix_salt").agg(F.sum("mix_chars").alias("mix_sum"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = shelve(groups.select("mix_source", "mix_salt", "mix_sum", F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0)).alias("mix_start")))
    totals = {r.mix_source: r.n for r in starts.groupBy("mix_source").agg(F.sum("mix_sum").alias("n")).collect()}
    runs = phases({s: -(-n // block_chars) for s, n in totals.items()}, weights, period)

    # runs as a table: a row for each source that takes part in one
    values = [
        f"({k}, {names.index(s)}, '{_quoted(s)}', {r['slot']}L, {r['repeats']}L, {sum(r['counts'].values())}, {r['first'][s]}L, {n})"
        for k, r in enumerate(runs) for s, n in r["counts"].items()
    ]
    parts = spark.sql("SELECT * FROM VALUES " + ", ".join(values or ["(0, 0, '', 0L, 0L, 1, 0L, 1)"]) + " AS t(run, place, mix_source, slot, repeats, length, first, count)")
    counts = parts.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", "count"))).alias("given"))
    places = counts.select("run", F.posexplode(earliest_deadline(F.transform("given", lambda x: x["count"]))).alias("at", "turn"), "given")
    places = places.select("run", "at", F.get("given", F.col("turn"))["place"].alias("place"))
    nth = F.row_number().over(Window.partitionBy("run", "place").orderBy("at")) - 1
    # bounded by 2 * sources * (period + sources) rows, whatever the corpus, where the weights have an exact period
    slots = parts.join(places.withColumn("nth", nth), ["run", "place"])

    within = Window.partitionBy("mix_source", "mix_salt").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("mix_chars").over(within), F.lit(0))
    numbered = rows.withColumn("mix_before", before).join(F.broadcast(starts.drop("mix_sum")), ["mix_source", "mix_salt"])
    block = F.floor((F.col("mix_start") + F.col("mix_before")) / block_chars)
    numbered = numbered.withColumn("mix_block", block).drop("mix_salt", "mix_before", "mix_start", "mix_chars")
    # runs of a source, at most two for each source there is where periods are exact: which one has the block
    bounds = parts.groupBy("mix_source").agg(F.collect_list(F.struct("run", "slot", "length", "first", "count", (F.col("first") + F.col("repeats") * F.col("count")).alias("end"))).alias("mix_runs"))
    having = F.get(F.filter("mix_runs", lambda r: (r["first"] <= F.col("mix_block")) & (F.col("mix_block") < r["end"])), F.lit(0))
    placed = numbered.join(F.broadcast(bounds), "mix_source").withColumn("mix_run", having).drop("mix_runs")
    turn, of = F.col("mix_block") - F.col("mix_run.first"), F.col("mix_run.count")
    placed = placed.withColumn("mix_nth", turn % of).withColumn("mix_first", F.col("mix_run.slot") + F.floor(turn / of) * F.col("mix_run.length"))
    slots = slots.select(F.col("run").alias("mix_r"), F.col("mix_source").alias("mix_s"), F.col("nth").alias("mix_n"), F.col("at").alias("mix_at"))
    met = placed.join(F.broadcast(slots), (F.col("mix_run.run") == F.col("mix_r")) & (F.col("mix_source") == F.col("mix_s")) & (F.col("mix_nth") == F.col("mix_n")))
    n, j, c = F.col("mix_run.length"), F.col("mix_nth"), F.col("mix_run.count")
    return (
        met.withColumn("mix_release", F.col("mix_first") + F.floor(j * n / c)).withColumn("mix_slot", F.col("mix_first") + F.col("mix_at"))
        .withColumn("mix_deadline", F.col("mix_first") + F.ceil((j + 1) * n / c))
        .select(*docs.columns, "mix_source", "mix_block", "mix_release", "mix_slot", "mix_deadline", "mix_key")
    )


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def mixed_stream(docs: DataFrame, weights: dict[str, float], block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """The rows and columns of docs in the order of the mixed stream, in partitions that follow one another.

    Nulls, repeated rows and empty tables are as in schedule(), and so is the order of equal rows; columns may have any
    names. Once written, the order is read back by in_written_order().
    """
    own = {c: c if c in ("doc_id", "text", "source") else f"column_{i}" for i, c in enumerate(docs.columns)}
    found = schedule(docs.toDF(*own.values()), weights, block_chars, period)
    ordered = found.repartitionByRange("mix_slot", "mix_key").sortWithinPartitions("mix_slot", "mix_key")
    return ordered.select(*(F.col(new).alias(old) for old, new in own.items()))


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows of a written table in partitions that follow the order in which they were written.

    Spark numbers files by partitions, so the numbers in their names, five digits or more, and the rows' numbers in them
    tell the order, which reading doesn't keep: it deals files out by size. The rows of a table that isn't read from files are in order as they are.
    """
    if not docs.inputFiles():
        return docs
    number = F.try_to_number(F.nullif(F.regexp_extract("_metadata.file_path", r"part-(\d{1,18})[^/]*$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    placed = docs.select(F.struct("*").alias("row"), number.alias("number"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    order = ("number", "file", "place")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
