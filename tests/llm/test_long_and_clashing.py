"""Near duplicates and the mix where texts are very long, and where columns have the names that they use themselves."""

import random

import numpy as np
from pyspark.sql import functions as F

from ringside.llm import mixing, superminhash
from ringside.llm.common import WordHashes, shelve

WEIGHTS = {"a": 0.5, "b": 0.5}


def test_signatures_do_not_depend_on_the_turns(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(str(r.randrange(500)) for _ in range(n)) for n in (0, 1, 2, 40, 900, 3000, 7)]
    sets = superminhash.shingle_sets(texts, WordHashes())
    whole = superminhash.signatures(sets)
    monkeypatch.setattr(superminhash, "RANKED_AT_ONCE", 37)
    assert np.array_equal(whole, superminhash.signatures(sets))


def test_a_text_of_ten_million_characters(docs_of):
    r = random.Random(6)
    long = " ".join(str(r.randrange(10**6)) for _ in range(1_500_000))
    assert len(long) > 10**7
    docs = docs_of((1, long + " and an end"), (2, long), (3, "a short one of five words"))
    found = {x.doc_id: (x.component_id, x.kept) for x in superminhash.near_duplicates(docs).collect()}
    assert found == {1: (1, True), 2: (1, False), 3: (3, True)}


def test_blocks_bounded_by_shingles(docs_of, monkeypatch):
    r = random.Random(7)
    words = [str(r.randrange(10**6)) for _ in range(200)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(30)] + [(100 + i, f"{i} is alone with {i * i} words") for i in range(5)]
    whole = {x.doc_id: x.component_id for x in superminhash.near_duplicates(docs_of(*rows)).collect()}
    monkeypatch.setattr(superminhash, "BLOCK_SHINGLES", 1000)
    assert whole == {x.doc_id: x.component_id for x in superminhash.near_duplicates(docs_of(*rows)).collect()}
    assert set(whole.values()) == {0, *range(100, 105)}


def test_clashing_names(docs_of):
    clashing = ("kept_id", "_text_key", "_place", "text_key", "row", "id", "place", "file", "mix_key", "mix_slot", "mix_source", "MIX_N", "column_1")
    docs = docs_of((1, "one two three", "en", "a"), (2, "one two three", "en", "b"), (3, "four five", "en", "a"), (None, None, None, None))
    docs = docs.withColumns({c: F.lit(c) for c in clashing})
    once = superminhash.without_near_duplicates(docs)
    assert once.columns == docs.columns and {(r.doc_id, r.kept_id, r.row) for r in once.collect()} == {(i, "kept_id", "row") for i in (1, 3, None)}
    mixed = shelve(mixing.mixed_stream(docs, WEIGHTS))
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, docs.collect()))
    assert mixing.in_written_order(mixed).columns == docs.columns and mixing.in_written_order(mixed).count() == 4
    assert mixing.schedule(docs, WEIGHTS).count() == 4
