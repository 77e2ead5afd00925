"""Digests of ordered tables as Merkle trees: any change and any change of order shows, and where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.plans.shared import numbered, shelve

#: Children of a node.
FANOUT = 1024


def text_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text with their lengths, in order of the columns' names; null has no length."""
    texts = (F.col(c).cast("string") for c in sorted(columns))
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts)), 256)


def merkle_levels(rows: DataFrame, keys: list[str], fanout: int = FANOUT, height: int | None = None) -> DataFrame:
    """level, node, n (children) and sha256 of every node of the tree over rows in the order of keys.

    Rows are put in order by ranges and numbered over all of them, so nodes hold the same rows at any partitioning; ties
    of the keys are ordered by the rows' own digests. A leaf is the SHA-256 of its rows' digests, an inner node that of
    its children's; the last level has one node, the root. A node gathers `fanout` digests, however many rows there are.
    `height`: levels at most; the root of the last of them gathers all digests of the level below, which for two levels
    are 64 bytes for each `fanout` rows. An empty table has no node.
    """
    told = rows.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), text_digest(rows.columns).alias("sha256"))
    order = [F.asc_nulls_first(f"key_{i}") for i in range(len(keys))] + [F.asc("sha256")]
    at = numbered(told, order).select("number", "sha256")
    levels: list[DataFrame] = []
    while True:
        last = height is not None and len(levels) == height - 1
        parent = F.lit(0) if last else F.floor(F.col("number") / fanout)
        group = F.array_sort(F.collect_list(F.struct("number", "sha256")))
        node = at.groupBy(parent.cast("long").alias("node")).agg(F.count("*").alias("n"), group.alias("x"))
        node = shelve(node.select("node", "n", F.sha2(F.array_join(F.transform("x", lambda r: r["sha256"]), ""), 256).alias("sha256")))
        levels.append(node.withColumn("level", F.lit(len(levels))))
        if last or node.count() <= 1:
            return reduce(DataFrame.unionByName, levels).select("level", "node", "n", "sha256")
        at = node.select(F.col("node").alias("number"), "sha256")


def merkle_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Leaves in which two trees of merkle_levels() differ: node and how many rows each has there, null where it has none."""
    leaf = lambda df, side: df.where("level = 0").select("node", F.col("n").alias(f"n_{side}"), F.col("sha256").alias(f"sha_{side}"))
    return leaf(one, "one").join(leaf(other, "other"), "node", "full_outer").where("NOT (sha_one <=> sha_other)").select("node", "n_one", "n_other")
