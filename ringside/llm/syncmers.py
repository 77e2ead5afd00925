"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text is a sequence of words; one of more than LONG characters, as texts without spaces have, counts by its characters,
so that nothing depends on where it begins. Of each run of K words all runs of S words inside are
hashed; the run is an anchor if the least hash stands at its first or last place. Whether a run is an anchor depends on
nothing outside it, so texts that share a passage share its anchors wherever it stands. A fingerprint holds all distinct
anchors of its text, in text order, and likeness is taken over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import shelve

#: Words of a run, words of the runs inside, characters of the longest word that is taken whole.
K, S, LONG = 5, 2, 16
#: A word of LONG characters at most between white space, or else one character of a longer word.
_WORD = f"(?<![^ \\t-\\r])[^ \\t-\\r]{{1,{LONG}}}(?![^ \\t-\\r])|[^ \\t-\\r]"
#: Neighbouring keys are found in groups of 2**BITS keys, then of 2**BITS groups and so on; texts lie in groups of 2**GROUP_BITS ids.
BITS, GROUP_BITS = 8, 5


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds all anchors of a text column, an array of long: empty for a text without words."""
    words, inner, runs = (f"{out}_{x}" for x in ("words", "inner", "runs"))
    n = F.size(words)
    pair = lambda a, b: F.xxhash64(a, b)
    at = lambda i: F.get(inner, i)

    def anchor(i: Column) -> Column:
        ends = F.least(at(i), at(i + K - S))
        middle = F.least(*(at(i + j) for j in range(1, K - S)))
        return F.when(ends <= middle, F.xxhash64(*(at(i + j) for j in range(K - S + 1))))

    df = df.withColumn(words, F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    df = df.withColumn(words, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(inner, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), pair))
    df = df.withColumn(runs, F.when(n >= K, F.sequence(F.lit(0), n - K)))
    found = F.filter(F.transform(runs, anchor), lambda x: x.isNotNull())
    few = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.array_distinct(F.when(n >= K, found).otherwise(few))).drop(words, inner, runs)


def written(anchors: str) -> Column:
    """Fingerprint: 16 hex digits for each anchor, in text order."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of all anchors in common (Dice); 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)).cast("double") / both)


def with_lower_neighbour(keys: DataFrame, low: int, high: int) -> DataFrame:
    """Adds to distinct keys between low and high the greatest smaller key as `below`; null for the least.

    Keys that agree in all but their last BITS bits form a group, in which a window finds the neighbour. For the least
    of a group it's the greatest key of the next lower group, found by the same means among the groups. So no window
    ever holds more than 2 * 2**BITS rows, and nothing is assumed of how the keys lie.
    """
    group = Window.partitionBy("group").orderBy("key")
    last = (high >> BITS) - (low >> BITS) <= 1  # one group, or two that zero lies between, at any number of steps
    found = keys.withColumn("group", F.lit(0).cast("long") if last else F.shiftright("key", BITS)).withColumn("below", F.lag("key").over(group))
    if last:
        return found.drop("group")
    tops = keys.groupBy(F.shiftright("key", BITS).alias("group")).agg(F.max("key").alias("top"))
    groups = with_lower_neighbour(tops.select(F.col("group").alias("key")), low >> BITS, high >> BITS)
    cross = groups.join(tops.withColumnRenamed("group", "below"), "below").select(F.col("key").alias("group"), "top")
    return found.join(cross, "group", "left").select("key", F.coalesce("below", "top").alias("below"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs and of its edited text.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, by descending doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; a fingerprint without anchors is an empty string. A text of fewer than K words has one
    anchor, all its words. Rows that share a doc_id share the next document, and are the next one by the least of their
    texts. A row without a doc_id has no next document: its edited text only loses its last third, near_next is 0, or 1
    if the row's own text has no words. A single document follows itself. Further columns are ignored.

    Texts are dealt once, by groups of 2**GROUP_BITS ids; anchors are made after that. What a document borrows comes
    from the row before it in its group; for the least id of a group, the last row of the next lower group sends it.
    Ids that lie far apart make groups of one row, so every text's beginning is sent: a second, smaller shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    alone = docs.where(F.col("id").isNull()).withColumns({"next_text": F.lit(None).cast("string"), "next_anchors": F.lit(None).cast("array<bigint>")})
    # both uses of the dealt texts share one exchange: no filter for null groups comes under it, no alias is redundant
    docs = docs.where(F.col("id").isNotNull()).withColumn("group", F.coalesce(F.shiftright("id", GROUP_BITS), F.lit(0).cast("long")))

    # who sends the least id of a group what it borrows: one row for each group
    longest_least = F.min(F.struct("id", -F.char_length("text")))
    groups = shelve(docs.groupBy("group").agg(longest_least.alias("least")).select("group", (-F.col("least")["col2"]).alias("longest")))
    ends = groups.agg(F.min("group"), F.max("group")).first()
    low, high = (0, 0) if ends[0] is None else ends
    below = with_lower_neighbour(groups.select(F.col("group").alias("key")), low, high)
    borrows = below.join(groups.select(F.col("group").alias("key"), "longest"), "key").select(
        F.coalesce("below", F.lit(high)).alias("group"), F.col("key").alias("to"), F.floor(F.col("longest") / 3).cast("int").alias("lent")
    )

    dealt = docs.repartition("group")
    same, line = Window.partitionBy("group", "id").orderBy("text"), Window.partitionBy("group").orderBy("id", "text")
    first = F.row_number().over(same) == 1
    top = dealt.withColumn("first", first).withColumn("top", F.max("id").over(Window.partitionBy("group"))).where(F.col("first") & (F.col("id") == F.col("top")))
    sent = with_anchors(top.select("group", "text"), "text", "sent_anchors").join(borrows, "group")
    sent = sent.select(F.col("to").alias("group"), F.left("text", F.col("lent")).alias("sent_text"), "sent_anchors")

    own = with_anchors(dealt, "text", "anchors").withColumn("first", first)
    before = F.last(F.when(F.col("first"), F.struct("text", "anchors")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", before).withColumn("before", F.first("before").over(same))
    own = own.join(sent, "group", "left").select(
        "id", "text", F.coalesce("before.text", "sent_text").alias("next_text"), "anchors", F.coalesce("before.anchors", "sent_anchors").alias("next_anchors")
    )
    return _compared(own).unionByName(_compared(with_anchors(alone, "text", "anchors")))


def _compared(met: DataFrame) -> DataFrame:
    """The result's columns from id, text, anchors, next_text and next_anchors (null: there is no next document)."""
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.coalesce(F.left("next_text", third), F.lit("")))
    met = met.select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", F.coalesce("next_anchors", F.array().cast("array<bigint>")).alias("next_anchors"))
    met = with_anchors(met, "edited", "edited_anchors")
    return met.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        written("anchors").alias("fingerprint"), written("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"), likeness("anchors", "next_anchors").alias("near_next"),
    )
