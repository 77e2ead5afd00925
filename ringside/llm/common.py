"""What the corpus operators share: reading, shelving intermediates, batching texts."""

from __future__ import annotations

from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.plans.shared import discard as discard
from ringside.plans.shared import shared_folder as shared_folder
from ringside.plans.shared import shelve as shelve
from ringside.session import ship

#: Rows and bytes of an Arrow batch that goes to a Python worker: they bound its memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 26
#: Characters of text that a worker takes apart at once.
SLICE_CHARS = 1 << 20
#: Characters of a text that a sample for estimates holds at most.
SAMPLE_CHARS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches of few rows and bytes, for workers that can import this package; a longer text is a batch of its own."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sample_texts(docs: DataFrame, rows: int) -> list[str]:
    """A few non-null texts for estimates that steer the work and never a result; each by its first SAMPLE_CHARS characters.

    The rows come from the first partitions that have enough: no partition beyond them is read.
    """
    found = docs.where(F.col("text").isNotNull()).select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).limit(rows).collect()
    return [r.text for r in found]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `most` characters each; a longer text is a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    MOST = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
