"""Connected components of a graph whose edges and nodes never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import discard, shelve


class Forest(dict):
    """Union-find whose roots are the least of their trees."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while self.get(x, x) != top:
            self[x], x = top, self[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(a, b)
    nodes = list(forest)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["a", "b"])


def spanning_edges(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: each partition keeps a star for each of its trees."""
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest_of, "a long, b long").where("a != b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root: the least node of the component.

    Each round takes the least label over a node and its neighbours, then the label of that label; nodes at the ends of
    a long path come together in about log(length) rounds. Labels are written to the shared folder after each step. The
    joins are between plain tables, so that Spark can split a hub's edges; the sums are partial before they are dealt.
    """
    kept = shelve(spanning_edges(edges))
    both = kept.union(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
    labels = shelve(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label")))
    while True:
        told = both.join(labels, "node").select(F.col("other").alias("node"), "label")
        least = shelve(labels.withColumn("old", F.col("label")).unionByName(told.withColumn("old", F.lit(None).cast("long"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        of = least.select(F.col("node").alias("label"), F.col("label").alias("least"))
        new = shelve(least.join(of, "label").select("node", F.col("least").alias("label"), "old"))
        done = new.where("label != old").isEmpty()
        discard(labels, least)
        labels = new
        if done:
            discard(kept)
            return labels.select("node", F.col("label").alias("root"))
