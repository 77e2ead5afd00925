"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: shifted by one bit for each byte and a random number for the byte's value
added, its 16 bits depend on the last 16 bytes. Where it's small, a chunk ends; so chunks depend on nothing but the text
nearby, and an insertion shifts none but its own. Chunks are told apart by a 64-bit digest. Runs of chunks that occur
elsewhere too are passages, once they are long enough and a good part of them shares its first document. Within a run
each stretch of chunks with one first document is told apart, for each document keeps what it's the first to have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import shelve, small_batches

#: Bytes of a chunk: a cut each CUT_EACH on average beyond SHORTEST, and none after LONGEST.
SHORTEST, CUT_EACH, LONGEST = 12, 20, 1024
#: Characters of a passage, and of its chunks that one document has first.
PASSAGE_CHARS, SHARED_CHARS = 96, 64


def gear_table() -> np.ndarray:
    """A random 16-bit number for each byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(48)).astype(np.uint16)


def rolled(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of gear[byte i places back] << i, by doubling the reach four times."""
    h = gear[data]
    for reach in (1, 2, 4, 8):
        earlier = h[:-reach] << np.uint16(reach)
        h[reach:] += earlier
    return h


def chunks(raw: bytes, gear: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Start and length in characters, and digest, of each chunk; chunks end between characters and cover the text."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return [], [], []
    first = (data & 0xC0) != 0x80  # of a character
    before = np.concatenate([[0], np.cumsum(first)])
    ends = np.flatnonzero(rolled(data, gear) < 65536 // CUT_EACH) + 1
    ends = ends[ends < len(data)]
    cuts, last = [0], 0
    for end in [*ends[first[ends]].tolist(), len(data)]:
        if end - last < SHORTEST and end < len(data):
            continue
        while end - last > LONGEST:
            last += LONGEST
            while not first[last]:
                last -= 1
            cuts.append(last)
        cuts.append(end)
        last = end
    places = before[cuts]
    digests = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return places[:-1].tolist(), np.diff(places).tolist(), digests


def chunked(docs: DataFrame) -> DataFrame:
    """row (a number of the document's own), doc_id, start, length, digest of all chunks of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, row = gear_table(), TaskContext.get().partitionId() << 40
        for batch in batches:
            starts, lengths, digests, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                s, n, d = chunks((text or "").encode(), gear)
                starts += s
                lengths += n
                digests += d
                counts.append(len(s))
            owner = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner + row), batch.column("doc_id").take(pa.array(owner)), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()),
                    pa.array(np.array(digests, np.uint64).view(np.int64)),
                ],
                ["row", "doc_id", "start", "length", "digest"],
            )
            row += len(counts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, start int, length int, digest long")


def repeated_passages(docs: DataFrame, passage_chars: int = PASSAGE_CHARS, shared_chars: int = SHARED_CHARS) -> DataFrame:
    """The passages of docs that stand in another document too, one row for each stretch with one first document.

    doc_id, start and length (code points), n_chunks, first_doc_id (the least doc_id that has the stretch's chunks),
    n_copies (the most places that one of its chunks has, those in one text included) and kept: true where the stretch
    is the one to keep, in its first document, and false where it may go. What is repeated in one document alone is not
    reported. Adjacent repeated chunks are one passage, which has to be long enough as a whole; so a stretch may be
    short. Null and empty texts have none. Rows that repeat a doc_id count as places of their own, and so do rows without an id, which
    are first only where no row with an id has the chunk. Further columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    every = shelve(chunked(docs))
    counts = [F.count("*").alias("places"), F.min("doc_id").alias("first_doc_id"), F.min("row").alias("least"), F.max("row").alias("most")]
    repeats = shelve(every.groupBy("digest").agg(*counts).where("least != most").drop("least", "most"))
    met = every.join(repeats, "digest")
    along = Window.partitionBy("row").orderBy("start")
    met = met.withColumn("new", (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("length")).over(along), F.lit(-1))).cast("int"))
    met = met.withColumn("turn", F.when(F.col("first_doc_id").eqNullSafe(F.lag("first_doc_id").over(along)), F.col("new")).otherwise(1))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("run", F.sum("new").over(so_far)).withColumn("stretch", F.sum("turn").over(so_far))
    found = met.groupBy("row", "doc_id", "run", "stretch", "first_doc_id").agg(
        F.min("start").cast("long").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_chunks"), F.max("places").alias("n_copies")
    )
    found = found.withColumn("shared", F.sum("length").over(Window.partitionBy("row", "run", "first_doc_id")))
    whole = Window.partitionBy("row", "run")
    found = found.withColumn("whole", F.sum("length").over(whole)).withColumn("shared", F.max("shared").over(whole))
    found = found.where((F.col("whole") >= passage_chars) & (F.col("shared") >= shared_chars))
    return found.select("doc_id", "start", "length", "n_chunks", "first_doc_id", "n_copies", F.coalesce(F.col("doc_id") == F.col("first_doc_id"), F.lit(False)).alias("kept"))
