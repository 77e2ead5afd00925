"""Repeated substrings by a logarithmic family of sparse suffix arrays.

A window is `length` bytes of a text. It's owned by the least of its first `reach` positions, by a hash of the eight bytes
there; so equal windows have equal owners, wherever they stand, and neighbours mostly share theirs. An owner stands for
the run of windows that it owns. Only the suffixes that begin at owners are sorted: by their first three bytes, then by a
digest of the bytes that all windows of an owner share (the stem), then by a digest of all bytes of the run. Windows can
only repeat where the stem does, and all of a run's windows repeat where the run does. Stem and run are compared together,
by 104 bits of digests and three bytes.

New documents come in batches. A batch gets its own suffix array, which is merge-scanned against each level of the family
for stems that both have; then it becomes a level, and two levels of one size are merged into one of twice the size, with
equal runs counted. So each suffix is rewritten a logarithmic number of times, and a batch meets a logarithmic number of
levels. A run that isn't repeated as a whole though its stem is, at an end of a long match, is split into blocks of windows,
which are judged in the same way, and what is left of these window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import discard, shelve, small_batches

#: Production parameters: bytes of a repeated string, positions among which a window's owner is chosen, batches of a table.
LENGTH, REACH, BATCHES = 400, 256, 4
#: Bytes that a position is judged by, and windows of a text that are looked at together.
GRAM, SLICE = 8, 1 << 18
#: Windows of the pieces into which an unsettled run is split, before single windows.
BLOCK_WINDOWS = 16
ENTRY = "row long, at int, lo int, hi int, stem long, run long"
PIECE_NAMES = ["row", "at", "lo", "hi", "stem", "run", "n"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def byte_numbers(seed: int) -> np.ndarray:
    """A random odd 32-bit number for each byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_NUMBERS, _FACTOR = byte_numbers(1), 0x9E3779B1


def grams(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the eight bytes from each position on."""
    h, factor = _NUMBERS[data], _FACTOR
    for reach in (1, 2, 4):
        h = h[:-reach] * np.uint32(factor) + h[reach:]
        factor = factor * factor & 0xFFFFFFFF
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: a running minimum from either end of blocks of that width."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def runs(raw: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, first and last window of each run of windows with one owner; the leftmost of equal hashes owns."""
    n = len(raw) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    data, owners, starts = np.frombuffer(raw, np.uint8), [], []
    for at in range(0, n, SLICE):
        some = min(SLICE, n - at)
        h = grams(data[at : at + some + reach - 1 + GRAM - 1])
        least = sliding_least((h.astype(np.uint64) << np.uint64(32)) | np.arange(at, at + len(h), dtype=np.uint64), reach)
        own = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(own, prepend=owners[-1][-1] if owners and len(owners[-1]) else -1))
        owners.append(own[new] if len(new) else owners[-1][-1:][:0])
        if not len(new):
            owners.pop()
        starts.append(new + at)
    owner, first = np.concatenate(owners), np.concatenate(starts)
    return owner, first, np.append(first[1:] - 1, n - 1)


def packed(docs: DataFrame) -> DataFrame:
    """row (a number of the document's own), doc_id and the compressed UTF-8 bytes of every text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [small.compress(t or b"") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["row", "doc_id", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "row long, doc_id long, text binary")


def unpacked(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text)


def place(raw: bytes, start: int, end: int) -> int:
    """A string's place in the order of suffixes: its first three bytes, then a digest of the whole, as a signed number."""
    return (int.from_bytes(raw[start : start + 3], "big") << 40 | xxhash.xxh3_64_intdigest(raw[start:end]) >> 24) - (1 << 63)


def suffixes(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """The owners of all texts as entries of a suffix array, not sorted yet."""
    stem = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpacked(text)
                owner, first, last = runs(raw, length, reach)
                for i in range(0, len(owner), SLICE):
                    some = slice(i, i + SLICE)
                    at, lo, hi = owner[some].tolist(), first[some].tolist(), last[some].tolist()
                    stems = [place(raw, a, a + stem) for a in at]
                    whole = [xxhash.xxh3_64_intdigest(raw[a : b + length]) - (1 << 63) for a, b in zip(lo, hi, strict=True)]
                    columns = [pa.array(np.full(len(at), row)), pa.array(at, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(stems, pa.int64()), pa.array(whole, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "at", "lo", "hi", "stem", "run"])

    return texts.select("row", "text").mapInArrow(run, ENTRY).withColumn("n", F.lit(1).cast("long"))


def counted(entries: DataFrame) -> DataFrame:
    """A suffix array: entries in order, equal runs as one entry with their number and the least that has it."""
    least = F.min(F.struct("row", "at", "lo", "hi")).alias("least")
    found = entries.groupBy("stem", "run").agg(F.sum("n").alias("n"), least).select("stem", "run", "n", "least.*")
    return found.sortWithinPartitions("stem", "run")


class SuffixFamily:
    """Suffix arrays of batches, in levels of 1, 2, 4, ... batches; each level is a table, in order within partitions."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Take in the entries of new documents: stems that they share, among them or with any level, are written to `met`."""
        if batch.isEmpty():
            return
        new, rank = shelve(counted(batch)), 0
        self.met.append(shelve(new.groupBy("stem").agg(F.sum("n").alias("n")).where("n > 1").select("stem")))
        for _, level in self.levels:
            self.met.append(shelve(new.join(level.select("stem"), "stem", "left_semi").select("stem").distinct()))
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            merged = shelve(counted(level.unionByName(new)))
            discard(level, new)
            new, rank = merged, rank + 1
        self.levels.append((rank, new))

    def repeated(self) -> DataFrame | None:
        """The entries, over all levels, whose stem stands in two places at least."""
        if not self.levels:
            return None
        every = reduce(DataFrame.unionByName, (level for _, level in self.levels))
        stems = reduce(DataFrame.unionByName, self.met).distinct()
        found = every.join(stems, "stem", "left_semi")
        return counted(found) if len(self.levels) > 1 else found


def settled(pieces: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (row, lo, hi) that are known to repeat, and the entries that have to be looked at more closely.

    Those are all entries of a stem that has several, one at least of which stands alone: the rest are its witnesses.
    The open stems are written first: then the join with them is one of plain tables, and Spark can split a hot stem.
    """
    sure = pieces.join(entries.where("n > 1").select("stem", "run"), ["stem", "run"]).select("row", "lo", "hi")
    open_stems = entries.groupBy("stem").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("alone")).where("k > 1 AND alone > 0")
    return sure, entries.join(shelve(open_stems.select("stem")), "stem", "left_semi")


def by_row(windows: DataFrame, *columns: str) -> DataFrame:
    """One row for each text, with its windows: no more than the text has."""
    return windows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("windows"))


def split(texts: DataFrame, entries: DataFrame, length: int, block: int) -> DataFrame:
    """Entries of `block` windows in place of longer ones, counted from the owner, so that equal windows share blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, found = unpacked(text), []
                for w in windows:
                    at, lo, hi = w["at"], w["lo"], w["hi"]
                    for k in range((at - hi) // block, (at - lo) // block + 1):
                        top = at - block * k  # the block's last window, and its first by `block` less one
                        a, b = max(lo, top - block + 1), min(hi, top)
                        found.append((row, at, a, b, place(raw, top, top - block + 1 + length), xxhash.xxh3_64_intdigest(raw[a : b + length]) - (1 << 63), w["n"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), PIECE_TYPES, strict=True)], PIECE_NAMES)

    met = texts.select("row", "text").join(by_row(entries, "at", "lo", "hi", "n").hint("shuffle_hash"), "row")
    return met.mapInArrow(run, f"{ENTRY}, n long")


def without(texts: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw, found = unpacked(text), batch.column(2)[i].values
                starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if found is not None and len(found):
                    lo, hi = (np.asarray(found.field(x), np.int64) for x in ("lo", "hi"))
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order] + length)
                    new = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
                    starts, ends = lo[new], reach[np.append(new[1:] - 1, len(lo) - 1)]
                digest, at = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((doc_id, len(raw), int((ends - starts).sum()), len(starts), digest.hexdigest(), [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), spans)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    met = texts.join(by_row(windows, "lo", "hi").hint("shuffle_hash"), "row", "left").select("doc_id", "text", "windows")
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, reach: int = REACH, batches: int = BATCHES, block: int = BLOCK_WINDOWS) -> DataFrame:
    """What is left of every text without the bytes covered by a `length`-byte string that starts anywhere else too.

    doc_id, n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept_sha256 (of the remaining bytes) and spans
    (start and end in bytes). Strings are judged on the input: all copies go, the first one too; overlapping starts in one
    text count. Null and empty texts have 0 bytes. Each row is a text of its own, so rows that repeat an id or have none
    count as elsewhere. Texts shorter than `length` stay whole. Further columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    texts = shelve(packed(docs))
    part = F.pmod(F.shiftright("row", 33), F.lit(batches)).cast("int")
    every = shelve(suffixes(texts, length, reach).withColumn("batch", part), "batch")
    family = SuffixFamily()
    for i in range(batches):
        family.add(every.where(F.col("batch") == i).drop("batch"))
    entries = family.repeated()
    if entries is None:
        return without(texts, docs.sparkSession.createDataFrame([], "row long, lo int, hi int"), length)
    entries = shelve(entries)
    known, unsettled = settled(every, entries)
    sure = [shelve(known)]
    discard(every, *family.met, *(level for _, level in family.levels))
    for size in (block, 1):
        pieces = shelve(split(texts, unsettled, length, size))
        discard(entries)
        entries = shelve(counted(pieces))
        known, unsettled = settled(pieces, entries)
        sure.append(shelve(known))
    return without(texts, reduce(DataFrame.unionByName, sure), length)
