"""Graphs as tables of links: components, and where chains of pointers lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.plans.shared import discard, shelve


def components(links: DataFrame) -> DataFrame:
    """(slice, node, part) of links (slice, a, b): in each slice, the least node that a node is linked with, all slices at once.

    A round takes the least label among a node's neighbours, then the label of that label; labels of all slices settle
    in about the logarithm of the longest path. Joins are merges, as labels sent to all tasks in each round would go through
    the driver.
    """
    pairs = shelve(links.select("slice", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("slice", F.col("p.a").alias("node"), F.col("p.b").alias("other")).distinct())
    labels = shelve(pairs.groupBy("slice", "node").agg(F.least(F.first("node"), F.min("other")).alias("part")))
    while True:
        told = pairs.join(labels.hint("merge"), ["slice", "node"]).groupBy("slice", F.col("other").alias("node")).agg(F.min("part").alias("told"))
        near = labels.join(told.hint("merge"), ["slice", "node"]).select("slice", "node", "part", F.least("part", "told").alias("best"))
        of = labels.select("slice", F.col("node").alias("best"), F.col("part").alias("its"))
        new = shelve(near.join(of.hint("merge"), ["slice", "best"]).select("slice", "node", F.least("best", "its").alias("part"), (F.least("best", "its") < F.col("part")).alias("moved")))
        discard(labels)
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            discard(pairs)
            return labels


def followed(pointers: DataFrame) -> DataFrame:
    """(node, end) of pointers (node, to): where each chain ends, by doubling: a chain of n pointers takes log2(n) rounds.

    A node points to one other at most; pointers may not run in a circle.
    """
    now = shelve(pointers.select("node", F.col("to").alias("end")))
    while True:
        on = now.select(F.col("node").alias("end"), F.col("end").alias("next"))
        new = shelve(now.join(on.hint("merge"), "end", "left").select("node", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now
