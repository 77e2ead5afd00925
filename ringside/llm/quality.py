"""Quality rules as a short-circuit cascade.

Every document gets its base counts. Then the rules run one after the other, each on the rows that all earlier ones
kept. Their order comes from a bounded sample: a rule's rejections per second of work, greatest first. As a document is
kept only if every rule keeps it, the order changes the work and never a verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import sample_texts, small_batches

#: Rows on which cost and selectivity of the rules are estimated.
SAMPLE_DOCS = 500
WINDOW = 8
MIN_WORDS = 20
#: Longer texts find their repeated windows by ranks in arrays, in little memory; both ways are exact.
LONG_WORDS = 1 << 15
SYMBOLS = "#*$%&|<>"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Doc:
    """A text taken apart once, for all rules."""

    text: str
    words: list[bytes]
    word_chars: int
    n_symbols: int
    lines: list[str]
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return len(self.words) < MIN_WORDS or 100 * self.n_repeat_words > 30 * len(self.words)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n > LONG_WORDS:
        number: dict[bytes, int] = {}
        ranks = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        width = 1
        while width < window:  # equal ranks at width: equal windows of that many words
            step = min(width, window - width)
            pairs = ranks[: len(words) - width - step + 1] * len(words) + ranks[step : len(words) - width + 1]
            ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            width += step
        again = np.bincount(ranks)[ranks] > 1
    else:
        windows = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def take_apart(text: str | None) -> Doc:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return Doc(text, words, word_chars, sum(map(text.count, SYMBOLS)), lines, len(lines) - len(set(lines)), repeated_words(words))


def symbols(d: Doc) -> bool:
    return 10 * d.n_symbols <= len(d.words)


def duplicate_lines(d: Doc) -> bool:
    return 10 * d.n_dup_lines <= 3 * len(d.lines)


def word_length(d: Doc) -> bool:
    return 2 * len(d.words) <= d.word_chars <= 25 * len(d.words)


def lettered(d: Doc) -> bool:
    """At least seven in ten words hold a letter."""
    return 10 * sum(1 for w in d.words if w.isalpha() or LETTER.search(w.decode())) >= 7 * len(d.words)


def marks(d: Doc) -> bool:
    """Few shouting or asking marks: at most one for two words."""
    return 2 * (d.text.count("!") + d.text.count("?")) <= len(d.words)


def varied(d: Doc) -> bool:
    """No word makes up more than three tenths of a text."""
    return 10 * max(Counter(d.words).values(), default=0) <= 3 * len(d.words)


#: A rule says whether a document that passed the base may stay.
RULES: dict[str, Callable[[Doc], bool]] = {
    f.__name__: f for f in (symbols, duplicate_lines, word_length, lettered, marks, varied)
}


def order_of_rules(docs: DataFrame) -> list[str]:
    """The rules, most rejections per second first, as a bounded sample of rows has them; ties by name."""
    parts = [d for d in map(take_apart, sample_texts(docs, SAMPLE_DOCS)) if not d.base_failed]
    gain = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejected = sum(not rule(d) for d in parts)
        gain[name] = (rejected + 0.5) / (time.perf_counter() - began + 1e-9)
    return sorted(RULES, key=lambda name: (-gain[name], name))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every row of docs.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule (the rule of
    the cascade that rejected the row, or null). A null text counts as empty: no words, base_failed. Repeated rows and
    null ids each give a row, further columns are ignored, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    order = order_of_rules(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed = [], []
            for text in batch.column("text").to_pylist():
                d = take_apart(text)
                counts.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed))
                failed.append(None if d.base_failed else next((r for r in order if not RULES[r](d)), None))
            columns = list(zip(*counts, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_()),
                    pa.array([f is None and not b for f, b in zip(failed, columns[5], strict=True)], pa.bool_()), pa.array(failed, pa.string()),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
    )
