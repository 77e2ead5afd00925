"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A document is the set of its two-word shingles. SuperMinHash gives each element a random order of the signature's
places, correlated so that every place is served early: the j-th place of the order gets rank j + r, 0 <= r < 1, and a
place keeps the least rank. Once all ranks are below j, no later step can change anything, and the work stops, for most
texts after two or three steps. Signatures are cut into bands; documents that agree in one are candidates.

Exact copies are one class from the start, by a digest of the set. Candidate classes form clusters, whose documents are
compared on their full sets inside blocks bounded in documents and in shingles; larger clusters first meet a central document in every
block, and then, block by block, only those that are not in the cluster's largest component yet meet the rest. Pairs are
never rows: a block gives the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import WordHashes, discard, shelve, slices, small_batches
from ringside.llm.components import Forest, connected_components

#: At a similarity of 0.8, a pair is missed with a probability of (1 - 0.8**ROWS)**BANDS, 1.5 in 100,000.
BANDS, ROWS, SHINGLE = 28, 5, 2
#: A pair is linked if 100 * intersection >= LEAST * union.
LEAST = 80
#: Documents, and distinct shingles of all of them, that are compared with each other in one task, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
#: Shingles that are ranked at once: bounds the memory for a text of any length.
RANKED_AT_ONCE = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; a shorter text's words are one shingle."""
    out = []
    for text in texts:
        own = (text or "").encode().lower().split()
        h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
        width = min(size, len(h))
        grams = mix(h[: len(h) - width + 1]) if width else h
        for i in range(1, width):
            grams = mix(grams * _ODD + h[i : len(h) - width + 1 + i])
        out.append(np.unique(grams))
    return out


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set, a row of ranks (step * 2**24 + a random fraction); empty sets have the greatest ones."""
    ranks = np.full((len(sets), places), 0xFFFFFFFF, np.uint32)
    flat = ranks.reshape(-1)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    # the least ranks of some elements only get less with further ones: a text's elements may come in several turns
    for start in range(0, len(elements), RANKED_AT_ONCE):
        element, owner = elements[start : start + RANKED_AT_ONCE], owners[start : start + RANKED_AT_ONCE]
        order = np.tile(np.arange(places, dtype=np.uint16 if places > 256 else np.uint8), (len(element), 1))
        for step in range(places):
            if not len(element):
                break
            random = mix(element + np.uint64((step + 1) * int(_ODD) & _WORD))
            other = step + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
            line = np.arange(len(element))
            place = order[line, other]
            order[line, other] = order[:, step]
            np.minimum.at(flat, owner * places + place, (np.uint64(step << 24) | (random >> np.uint64(40))).astype(np.uint32))
            first, last = owner[0], owner[-1] + 1
            open_ = (ranks[first:last].max(axis=1) >= np.uint32((step + 1) << 24))[owner - first]
            if not open_.all():
                element, owner, order = element[open_], owner[open_], order[open_]
    return ranks


def bands_of(ranks: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit number for each band, different from band to band."""
    out = np.empty((len(ranks), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(ranks), b + 1, np.uint64)
        for r in range(rows):
            x = mix(x * _ODD + ranks[:, b * rows + r].astype(np.uint64))
        out[:, b] = x
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], words)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                bands = bands_of(signatures(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1), pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def with_sets(rows: DataFrame) -> DataFrame:
    """cluster, block, doc, and set (its hashes as bytes) from cluster, block, doc and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "block", "doc")), pa.array(sets, pa.binary())], ["cluster", "block", "doc", "set"])

    return rows.select("cluster", "block", "doc", "text").mapInArrow(run, "cluster long, block long, doc long, set binary")


def linked(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges (a, b) of the links in a group of doc, set, part (rows of one part are known to belong together).

    Where rows are marked as probes, only pairs with a probe are compared.
    """
    group = group.sort_values(["probe", "doc"], ascending=[False, True], kind="stable")
    docs, probes = group["doc"].tolist(), int(group["probe"].sum())
    sets = [np.frombuffer(s, np.uint64) for s in group["set"]]
    sizes = np.array([len(s) for s in sets])
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(places.max()) + 1 if len(places) else 1, np.int64)
    forest, known = Forest(), Forest()
    for doc, part in zip(docs, group["part"].tolist(), strict=True):
        known.link(doc, part)
    edges = []
    for i in range(probes or len(docs)):
        mine = known.root(docs[i])
        apart = np.fromiter((known.root(d) != mine for d in docs), bool, len(docs))
        apart[: i + 1] = False
        apart &= (100 * np.minimum(sizes, sizes[i]) >= LEAST * np.maximum(sizes, sizes[i])) & (sizes > 0)
        if not apart.any():
            continue
        own = places[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[places], np.minimum(starts, len(places) - 1))
        mark[own] = 0
        for j in np.flatnonzero(apart & (100 * shared >= LEAST * (sizes + sizes[i] - shared))).tolist():
            known.link(docs[i], docs[j])
            if forest.root(docs[i]) != forest.root(docs[j]):
                forest.link(docs[i], docs[j])
                edges.append((docs[i], docs[j]))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Texts are lower-cased (A-Z) and cut at ASCII white space. component_id is the least doc_id that links reach; kept
    is true for the row with that id. A null text, or one without words, has an empty set: it is its own component and
    kept. A row without a doc_id belongs to the component of its equals and is not kept; if no row with an id equals it,
    its component_id is null and it is kept. Rows that repeat an id link by their texts, like any others. Further columns
    are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = shelve(signed(docs))
    classes = shelve(rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles")))
    ours = [F.col("r.set_key") == F.col("c.set_key"), F.col("r.doc_id") == F.col("c.doc")]
    banded = rows.alias("r").join(classes.alias("c"), ours, "left_semi").select(F.col("doc_id").alias("doc"), F.explode("bands").alias("band"))
    shared = shelve(banded.groupBy("band").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1"))
    met = shelve(banded.join(shared, "band").select("doc", "least", "n"))
    # a document meets the least of its buckets' least ones, and these meet each other: hardly more edges than documents
    known = met.withColumn("top", F.min("least").over(Window.partitionBy("doc")))
    edges = known.select(F.col("doc").alias("a"), F.col("top").alias("b")).union(known.select("least", "top")).where("a != b").distinct()
    clusters = connected_components(edges)
    clusters = clusters.select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    held = clusters.join(classes.groupBy("doc").agg(F.sum("n_shingles").alias("held")), "doc")
    sizes = held.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = shelve(clusters.join(shelve(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    members = shelve(with_sets(dealt.join(texts, "doc")).where(F.length("set") > 0))

    # of each cluster of several blocks, the document with the most candidates meets every block
    wide = dealt.where("blocks > 1")
    many = not wide.isEmpty()
    probe = members.withColumn("probe", F.lit(False)).withColumn("part", F.col("doc"))
    if many:
        degree = met.groupBy("doc").agg(F.sum("n").alias("degree"))
        centres = wide.join(degree, "doc").groupBy("cluster").agg(F.max_by("doc", F.struct("degree", "doc")).alias("doc"), F.first("blocks").alias("blocks"))
        centres = centres.join(members.select("doc", "set"), "doc").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        probe = probe.unionByName(centres.select("cluster", "block", "doc", "set", F.lit(False).alias("probe"), F.col("doc").alias("part")))
    links = shelve(probe.groupBy("cluster", "block").applyInPandas(linked, "a long, b long"))
    parts = connected_components(links)
    if many:
        links2 = shelve(_across_blocks(wide, members, parts))
        parts = connected_components(links.union(links2))

    roots = parts.select(F.col("node").alias("doc"), "root")
    named = shelve(classes.join(roots, "doc", "left").select("set_key", F.coalesce("root", "doc").alias("component_id")))
    own = rows.drop("bands").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    own = own.select("doc_id", "n_shingles", component.alias("component_id"))
    discard(shared, met, members)
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, one of each group; columns stay as they are, whatever their names.

    Of rows that agree in doc_id and text one stays. Rows without a doc_id stay but for such repetitions. An empty table
    stays empty.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), F.struct("*").alias("row"))
    named = rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi").unionByName(rows.where(F.col("id").isNull()))
    once = Window.partitionBy("id", "text_key").orderBy(F.lit(0))
    return named.withColumn("place", F.row_number().over(once)).where("place = 1").select("row.*")


def _across_blocks(wide: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between documents of clusters of several blocks: those outside the cluster's largest component meet every block."""
    placed = wide.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("root", "doc")).drop("root")
    placed = shelve(placed)
    counts = placed.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    largest = shelve(counts.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")))
    placed = shelve(placed.join(largest, "cluster").withColumn("chunks", F.ceil(F.col("rest") / BLOCK)))
    full = members.join(placed.drop("cluster", "block"), "doc").select("cluster", "block", "doc", "set", "part", "main", "chunks", "blocks")
    full = shelve(full.where("chunks > 0"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asking = full.where("part != main").withColumn("chunk", F.pmod(F.xxhash64("doc"), "chunks")).withColumn("block", everywhere(F.col("blocks")))
    asked = full.withColumn("chunk", everywhere(F.col("chunks")))
    columns = ["cluster", "block", "chunk", "doc", "set", "part"]
    both = asking.select(*columns, F.lit(True).alias("probe")).unionByName(asked.select(*columns, F.lit(False).alias("probe")))
    return both.groupBy("cluster", "block", "chunk").applyInPandas(linked, "a long, b long")
