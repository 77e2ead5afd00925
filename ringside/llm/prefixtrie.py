"""The prefix trie of conversations by partition refinement.

All conversations begin as one class. A round reads the next turns of those still active and splits each class by them,
so that classes are the trie's nodes; rounds take 1, 1, 2, 4 and at most 64 turns, so a long shared beginning takes few.
A conversation alone in its class retires: the rest of its turns is a unary chain, written without a round. A node is
named by its depth and its smallest member; nodes of one name at successive depths form a chain, and each chain but the
root's hangs from a node of another. Sums over subtrees are folded back chain by chain: what hangs at a node, then one
running sum along each chain. Texts never leave the scan: a turn is a digest and a number of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import discard, shelve, small_batches

#: Turns that a round reads at most.
MOST_TURNS = 64
#: Bits of a member's id that stay within one piece of a list of members.
PIECE_BITS = 10
#: Conversations of one block borrow from its first; at most this many turns less one.
BLOCK, BORROWED = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), digest and words of every turn of a conversation.

    A null role or text is empty; a null turn comes first; turns of one number stand in the order of their digests. Rows
    without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "digest", "words")


def borrow(own: DataFrame, block: int = BLOCK, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) and (conv_id, depth, digest, words) after each conversation took its first turns from its block's first.

    Conversation c takes crc32(c) mod `borrowed` turns of c - c mod `block`, or all if there are fewer, in place of as
    many of its own.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed
    base = F.col("conv_id") - F.col("conv_id") % block
    heads = own.where((F.col("conv_id") % block == 0) & (F.col("place") < borrowed)).withColumnRenamed("conv_id", "base")
    n_heads = heads.groupBy("base").agg(F.max("place").alias("n_heads"))
    convs = own.groupBy("conv_id").agg(F.max("place").alias("n_own")).withColumns({"h": h, "base": base})
    convs = convs.join(n_heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_heads", F.lit(0))))
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("n_turns"))
    lent = convs.join(heads.withColumnRenamed("place", "depth"), "base").where("depth <= h").select("conv_id", F.col("depth").cast("long"), "digest", "words")
    rest = own.withColumns({"h": h, "base": base}).where("place > h").join(n_heads, "base", "left")
    depth = (F.col("place") - F.col("h") + F.least("h", F.coalesce("n_heads", F.lit(0)))).cast("long")
    return lengths, lent.unionByName(rest.select("conv_id", depth.alias("depth"), "digest", "words"))


def _chained(turns: Column) -> Column:
    """For an array of (depth, digest, words): depth, words and a digest of all up to there."""

    def upto(x: Column, i: Column) -> Column:
        joined = F.aggregate(F.slice(turns, F.lit(1), i + 1), F.lit(b""), lambda acc, t: F.concat(acc, t["digest"]))
        return F.struct(x["depth"].alias("depth"), x["words"].alias("words"), F.unhex(F.md5(joined)).alias("chain"))

    return F.transform(turns, upto)


def refine(lengths: DataFrame, turns: DataFrame, root: int) -> list[DataFrame]:
    """(conv_id, depth, least, n, words) of every turn that a round read: its class's smallest member and size; a frame a round."""
    rounds, done, most = [], 0, 1
    active = lengths.where("n_turns > 0").select("conv_id", F.lit(root).cast("long").alias("class"))
    while True:
        met = turns.where((F.col("depth") > done) & (F.col("depth") <= done + most)).join(active, "conv_id")
        if most == 1:
            keyed = met.select("conv_id", "class", "depth", "words", F.col("digest").alias("chain"))
        else:  # at most MOST_TURNS turns of a conversation
            along = met.groupBy("conv_id", "class").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"))
            keyed = along.select("conv_id", "class", F.inline(_chained(F.col("turns"))))
        keyed = shelve(keyed)
        classes = keyed.groupBy("class", "depth", "chain").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
        split = shelve(keyed.join(classes, ["class", "depth", "chain"]).select("conv_id", "depth", "least", "n", "words"))
        discard(keyed)
        rounds.append(split)
        done += most
        active = split.where((F.col("depth") == done) & (F.col("n") > 1)).select("conv_id", F.col("least").alias("class"))
        if active.isEmpty():
            return rounds
        most = min(done, MOST_TURNS)


def ends_digest(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of the members that end at a node, ascending, joined by commas.

    Members are joined in pieces of neighbouring ids, in parallel; only the pieces of one node pass one after the other
    through the digest, as its definition asks for, and none is held.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    pieces = shelve(ends.groupBy("conv_id", "depth", F.shiftright("member", PIECE_BITS).alias("part")).agg(piece.alias("piece")))
    counted = pieces.groupBy("conv_id", "depth").agg(F.count("*").alias("n"), F.min("piece").alias("only"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv_id, depth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (conv_id, depth):
                    if node:
                        yield told()
                    node, digest = (conv_id, depth), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if node:
            yield told()

    many = pieces.join(counted.where("n > 1").select("conv_id", "depth"), ["conv_id", "depth"]).repartition("conv_id", "depth")
    many = many.sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "piece")
    streamed = many.mapInArrow(stream, "conv_id long, depth long, ends_sha256 string")
    return counted.where("n = 1").select("conv_id", "depth", F.sha2("only", 256).alias("ends_sha256")).unionByName(streamed)


def fold_back(nodes: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens of their subtrees, from `leaf` and `saving` of each node.

    Round k brings the sums of chains to those k chains above; a chain sends on one row, whatever hangs from it.
    """
    tops = shelve(nodes.where("depth > 0 AND parent_conv_id != conv_id").select("conv_id", "parent_conv_id", (F.col("depth") - 1).alias("at")))
    carried = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    hung = []
    while True:
        got = shelve(carried.join(tops, "conv_id").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        if got.isEmpty():
            break
        hung.append(got)
        carried = got.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.select("*", F.col("leaf").alias("leaves"), F.col("saving").alias("saved"))
    if hung:
        # one row for each node that something hangs from: the sums of all rounds
        added = reduce(DataFrame.unionByName, hung).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        own = nodes.join(added, ["conv_id", "depth"], "left").withColumns({"leaves": F.col("leaf") + F.coalesce("l", F.lit(0)), "saved": F.col("saving") + F.coalesce("s", F.lit(0))})
    return own.withColumns({"n_leaves": F.sum("leaves").over(below), "saved_tokens": F.sum("saved").over(below)})


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the conversations, the empty one included.

    lengths: conv_id (distinct, not null) and n_turns; turns: conv_id, depth (1 to n_turns), digest, words. Gives conv_id
    (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (words that need not be read again: (n_convs - 1) x words of the last turn, over the subtree)
    and ends_sha256. A conversation without turns is a member of the root alone. No conversation, no row.
    """
    spark = lengths.sparkSession
    small_batches(spark)
    least, n_convs = lengths.agg(F.min("conv_id"), F.count("*")).first()
    if not n_convs:
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], schema)
    walked = reduce(DataFrame.unionByName, refine(lengths, turns, least))
    read = walked.groupBy("conv_id").agg(F.max("depth").alias("read"))
    tails = turns.join(read, "conv_id", "left").where("depth > coalesce(read, 0)").select("conv_id", "depth", F.lit(1).cast("long").alias("n_convs"), "words")
    shared = walked.where("conv_id = least").select("conv_id", "depth", F.col("n").alias("n_convs"), "words")
    top = spark.createDataFrame([(least, 0, n_convs, 0)], "conv_id long, depth long, n_convs long, words long")
    above = walked.select("conv_id", (F.col("depth") + 1).alias("depth"), "least")
    parent = F.when(F.col("depth") > 1, F.coalesce("least", "conv_id")).when(F.col("depth") == 1, F.lit(least))
    named = shelve(shared.unionByName(tails).unionByName(top).join(above, ["conv_id", "depth"], "left").withColumn("parent_conv_id", parent.cast("long")).drop("least"))
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = named.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = shelve(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("words")}))
    last = lengths.withColumnRenamed("n_turns", "depth").join(walked.select("conv_id", "depth", "least"), ["conv_id", "depth"], "left")
    ends = last.select(F.when(F.col("depth") == 0, F.lit(least)).otherwise(F.coalesce("least", "conv_id")).cast("long").alias("at"), "depth", F.col("conv_id").alias("member"))
    ended = ends_digest(ends.withColumnRenamed("at", "conv_id"))
    full = fold_back(nodes).join(ended, ["conv_id", "depth"], "left")
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    return full.select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie of the conversations after each borrowed its first turns from its block's first.

    Null roles and texts are empty, null turns come first, turns of one number stand by their digest; rows without a
    conv_id are left out; an empty table gives no row; further columns are ignored. Long texts only cost their digest.
    """
    own = shelve(turns_in_order(conversations))
    lengths, turns = borrow(own)
    return prefix_trie(shelve(lengths), shelve(turns))
