"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

A text is cut at ASCII white space. Word-wise tokenizers never build a token across white space, so a text has the tokens
of its words in a row; with any other, which a few probes tell, every text goes to the library whole. Tier one is a broadcast table of the lengths of frequent words, encoded once on the
driver; tier two is a bounded cache in each Python worker, whose misses go to the tokenizer library.
A text that holds the marker of a special token goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import sample_texts, small_batches

#: Rows whose words are counted for the broadcast table, and the table's greatest size: they only affect speed.
SAMPLE_DOCS, TABLE_WORDS, TABLE_WORD_BYTES = 500, 1 << 15, 32
#: Words that a worker remembers, and the longest that it does.
CACHE_WORDS, CACHE_WORD_BYTES = 1 << 19, 64
#: Window of the over_limit flag.
LIMIT = 2048
#: Single marks that stand apart from the letters before them in every word-wise vocabulary.
MARKS = ".,;:!?"
#: No letter before this one becomes a letter and a mark in normal form or lower case.
PLAIN_BELOW = "\u0130"
#: A mark that ends a word and follows an ASCII letter or digit is a pre-token of its own.
MARK_AFTER = re.compile(rb"([.,;:!?])(?<=[a-z0-9].)(?=[ \t-\r]|$)")
#: Words of the table: no capitals, ASCII signs alone.
PLAIN_WORD = re.compile(rb"[\x21-\x40\x5b-\x7e]+")
SPECIAL_MARK = b"<|"
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next sign from U+0100 on.
BYTE_SIGNS = {b: 0x100 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Words for which the short way must agree with the library, or else it isn't taken.
PROBES = ("the", "Tokens", "\u00e9t\u00e9", "stra\u00dfenbahn", "\u00c0\u00e8\u00ed\u00f1", "internationalisation")
#: Texts whose ids by words must be the library's, or else a vocabulary builds tokens across words and all texts go to the library whole.
PROBE_TEXTS = ("Two words, and  more.\n\tNext line!", " lead the x1 2nd ALL CAPS; trail ", "\u00e9t\u00e9 \u00c0\u00e8, caf\u00e9?")


class WordCodes(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes: a fixed table, then a bounded cache over the library."""

    def __init__(self, vocabulary: str, table: dict[bytes, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(table)
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.table = table
        self.whole_words = all(self.encode_word(w) == self.encode(w) for w in PROBES)
        self.by_words = True
        self.by_words = all(self.document(t) == self.encode(t) for t in PROBE_TEXTS)

    def encode(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def encode_word(self, letters: str) -> bytes:
        """Letters by the model alone, without the library's normal forms and patterns: several times as fast."""
        return pack([t.id for t in self.library.model.tokenize(letters.lower().encode().decode("latin-1").translate(BYTE_SIGNS))])

    def __missing__(self, word: bytes) -> bytes:
        if self.whole_words and word.isalpha():  # ASCII letters, lower case already
            code = pack([t.id for t in self.library.model.tokenize(word.decode())])
        else:
            text = word.decode()
            # letters, then one mark: two pre-tokens, and the letters are known more often without it
            if len(text) > 1 and text[-1] in MARKS and text[:-1].isalpha() and max(text) < PLAIN_BELOW:
                return self[word[:-1]] + self[word[-1:]]
            if self.whole_words and text.isalpha() and max(text) < PLAIN_BELOW:
                code = self.encode_word(text)
            else:
                code = self.encode(text)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self.update(self.table)
            self[word] = code
        return code

    def document(self, text: str) -> bytes:
        """The ids of a whole text."""
        raw = text.encode()
        if not self.by_words or SPECIAL_MARK in raw:
            return self.encode(text)
        return b"".join(map(self.__getitem__, MARK_AFTER.sub(rb" \1", raw.lower()).split()))


_codes: dict[str, WordCodes] = {}


def word_codes(vocabulary: str, table: dict[bytes, bytes]) -> WordCodes:
    """The worker's own, kept from task to task."""
    if vocabulary not in _codes:
        _codes[vocabulary] = WordCodes(vocabulary, table)
    return _codes[vocabulary]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def frequent_words(docs: DataFrame, vocabulary: str) -> dict[bytes, bytes]:
    """Codes of the words most frequent in a bounded sample of rows; at most TABLE_WORDS short words."""
    seen = Counter(w for t in sample_texts(docs, SAMPLE_DOCS) for w in t.lower().encode().split() if len(w) <= TABLE_WORD_BYTES and PLAIN_WORD.fullmatch(w))
    words = [w.decode() for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_WORDS]]
    codes = WordCodes(vocabulary, {})
    return {w.encode(): codes.encode(w) for w in words}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row; further columns are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(vocabulary, table.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            n_tokens = [len(codes.document(t)) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
