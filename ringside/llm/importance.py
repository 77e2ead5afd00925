"""Importance resampling towards a target: hashed n-grams of words, gains by bucket, a Gumbel draw without replacement.

Long texts are skewed work, so they are cut into chunks at word boundaries. A chunk carries the n-1 words that follow it
and owns the features that start in its own words; so every feature of the text is counted once, in one chunk, whatever
the cut. Chunks of long texts are dealt out over all tasks; their counts and weights are summed by document. Texts of one
chunk stay where they are read. What is kept of the corpus is one count for each bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import shelve, small_batches

#: Production parameters: longest run of words, buckets, words that a document needs, percentage drawn, seed of the draw.
LONGEST_RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: Bytes of a chunk; a text of more is cut.
CHUNK_BYTES = 1 << 16
#: Features whose bucket a worker remembers.
CACHE = 1 << 19
#: What stands between words becomes a space, A to Z become a to z; every byte beyond ASCII belongs to a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PART = "row long, doc_id long, own binary, carry binary"


class Buckets(dict):
    """feature -> its bucket, remembered up to a bound."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.n
        return bucket


def cut(letters: bytes, carried: int, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of a text of words and spaces, of about `size` bytes, each with the `carried` words behind it.

    A chunk ends between words; a word that is longer than a chunk stays whole.
    """
    behind = re.compile(rb" *[^ ]+" * carried if carried else b"")
    few = re.compile(rb"(?: *[^ ]+){0,%d}" % carried)
    at = 0
    while at < len(letters):
        end = letters.find(b" ", min(at + size, len(letters)))
        end = len(letters) if end < 0 else end
        follow = (behind.match(letters, end) or few.match(letters, end)) if carried else None
        yield letters[at:end], follow[0] if follow else b""
        at = end


def features(own: bytes, carry: bytes | None, longest: int) -> tuple[int, list[bytes]]:
    """How many words a part owns, and all runs of 1 to `longest` words that start in them."""
    own = own.translate(WORD_BYTES).split()
    found = list(own)
    every = own + carry.split() if carry else own
    for n in range(2, longest + 1):
        found += [b" ".join(every[i : i + n]) for i in range(min(len(own), len(every) - n + 1))]
    return len(own), found


def _parts(docs: DataFrame, longest: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk where they are read, and the chunks of long ones dealt out; each part has its row's number."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for own, carry in cut(text.translate(WORD_BYTES), longest - 1, size):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([own]), pa.array([carry])], ["row", "doc_id", "own", "carry"])

    short = numbered.where(F.octet_length("text") <= size).select("row", "doc_id", F.col("text").alias("own"), F.lit(None).cast("binary").alias("carry"))
    long = shelve(numbered.where(F.octet_length("text") > size).mapInArrow(chunks, PART))
    return short, long.repartition(docs.sparkSession.sparkContext.defaultParallelism)


def bucket_counts(parts: DataFrame, longest: int, n_buckets: int) -> DataFrame:
    """(bucket, n): how many features of all parts lie in each bucket; each task sends its own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, n = Buckets(n_buckets), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for own, carry in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                _, found = features(own, carry, longest)
                n += np.bincount(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), minlength=n_buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], ["bucket", "n"])

    return parts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """Thousandths of log-likelihood ratio of each bucket, target over source, each count plus one."""
    counts = []
    for frame in (source, target):
        n = np.zeros(n_buckets)
        for r in frame.collect():  # at most n_buckets rows
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))).astype(np.int64)


def weighed(parts: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """row, doc_id, n_words, n_features and total gain of each part."""
    shared = parts.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(len(shared.value))
        for batch in batches:
            words, n_found, totals = [], [], []
            for own, carry in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n_words, found = features(own, carry, longest)
                words.append(n_words)
                n_found.append(len(found))
                totals.append(int(shared.value[np.fromiter(map(buckets.__getitem__, found), np.int64, len(found))].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (words, n_found, totals))], ["row", "doc_id", "n_words", "n_features", "total"])

    return parts.mapInArrow(weigh, "row long, doc_id long, n_words long, n_features long, total long")


def luck(doc_id: Column, seed: str) -> Column:
    """Thousandths of a standard Gumbel variate, from a hash of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, n_drawn: int) -> DataFrame:
    """scored with rank: 1 to n_drawn by falling score, then doc_id, among rows that are `eligible`; null for all others.

    Rows at least as high as the last drawn score are sorted by ranges; a row's rank is its place in its range plus the
    sizes of the ranges before. No task holds more than a range.
    """
    if not n_drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # scores are whole thousandths of logarithms: some hundred thousand different ones at any size
    least, left = None, n_drawn
    for r in scored.where("eligible").groupBy("score").count().orderBy(F.desc("score")).toLocalIterator():
        least, left = r.score, left - r["count"]
        if left <= 0:
            break
    high = F.col("eligible") & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    spread = scored.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shelve(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1)))
    before, offsets = 0, []
    for r in placed.groupBy("range").count().orderBy("range").collect():  # one row for each range
        offsets.append((r["range"], before))
        before += r["count"]
    first = scored.sparkSession.createDataFrame(offsets, "range long, before long")
    numbered = placed.join(F.broadcast(first), "range").withColumn("rank", F.col("place") + F.col("before") + 1).drop("at", "range", "place", "before")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return scored.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(numbered)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: a draw of `percent` in a hundred towards target's texts.

    A null or empty text has no features and weight 0. Rows with fewer than least_words words are scored, not drawn.
    Repeated ids are rows of their own with the same luck; a null id has the luck of the bare seed and comes last among
    ties. Ties beyond the id go to the greater weight, then to more features; rows alike in these are alike. An empty
    target gives every bucket its add-one share; an empty docs gives no row. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    short, long = _parts(docs, longest, chunk_bytes)
    wanted = _parts(target.select(F.lit(0).alias("doc_id"), "text"), longest, chunk_bytes)
    gain = gains(bucket_counts(short.unionByName(long), longest, n_buckets), bucket_counts(wanted[0].unionByName(wanted[1]), longest, n_buckets), n_buckets)
    summed = weighed(long, gain, longest).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    summed = summed.unionByName(weighed(short, gain, longest))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    scored = summed.withColumn("weight", weight).withColumn("score", F.col("weight") + luck(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    scored = shelve(scored.select("doc_id", "n_features", "weight", "score", "eligible"))
    n_drawn = percent * scored.where("eligible").count() // 100
    return ranked(scored, n_drawn).select("doc_id", "n_features", "weight", "score", "rank")
