"""Each stage of the pipeline on what the one before it kept, against plain versions, and the whole on edge cases."""

import collections
import zlib

import public_tokenizers
import pytest
from test_corpus import plain_components
from test_per_document import spans
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ringside.llm import mixing
from ringside.llm.common import shelve
from ringside.llm.tokens import pack


@pytest.fixture(scope="module")
def stages(spark, sample, data):
    """Inputs and outputs of all stages."""
    own = [(10**6 + i, f"a note of some words with token = {i:x}abcdef0123456789 and more of them, {i}", "en", "src1", 70) for i in range(3)]
    docs, found = sample.unionByName(spark.createDataFrame(own, sample.schema)), {}
    for name, stage in pipeline.STAGES:
        out = shelve(stage(spark, docs, data))
        found[name] = docs, out
        docs = out
    return found


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_stay(stages, sample):
    for name, (_, out) in stages.items():
        assert name == "pack" or out.columns == sample.columns


def test_language(stages):
    docs, out = stages["language"]
    assert rows(out) == [tuple(r) for r in sorted(docs.collect(), key=lambda r: repr(tuple(r))) if r.text and any(c.isalpha() for c in r.text)]


def test_near_duplicates(stages):
    docs, out = stages["near_duplicates"]
    kept = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in docs.collect()])}
    assert rows(out) == [tuple(r) for r in sorted(docs.collect(), key=lambda r: repr(tuple(r))) if r.doc_id in kept]
    assert out.count() < docs.count()


def test_secrets(stages):
    docs, out = stages["secrets"]
    after = {r.doc_id: r for r in out.collect()}
    assert after.keys() == {r.doc_id for r in docs.collect()}
    changed = 0
    for r in docs.collect():
        text, at = "", 0
        for start, _, end, kind in spans(r.text):
            if start >= at:
                text += r.text[at:start] + f"[{kind}]"
            at = max(at, end)
        assert after[r.doc_id].text == text + r.text[at:] and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        changed += text != ""
    assert changed


def test_mix_and_its_order_in_the_sequences(stages, spark):
    docs, out = stages["mix"]
    assert rows(out) == rows(docs)
    slot = {r.doc_id: (r.mix_slot, r.mix_key) for r in mixing.schedule(docs, pipeline.WEIGHTS).collect()}
    order = [r.doc_id for r in mixing.in_written_order(out).select("doc_id").collect()]
    assert order == sorted(slot, key=slot.get)
    parts = collections.defaultdict(list)  # of the packing, by the upper bits of sequence ids
    for r in stages["pack"][1].collect():
        parts[r.sequence_id >> 32].append(slot[r.doc_id])
    bounds = [x for _, own in sorted(parts.items()) for x in (min(own), max(own))]
    assert bounds == sorted(bounds)


def test_pack(stages):
    docs, out = stages["pack"]
    library = Tokenizer.from_file(public_tokenizers.path(pipeline.VOCABULARY))
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces, sequences = collections.defaultdict(list), collections.Counter()
    for p in out.collect():
        assert p.ids_crc32 == zlib.crc32(pack(ids[p.doc_id][p.start : p.start + p.length])) and p.doc_tokens == len(ids[p.doc_id])
        pieces[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id] += p.length
    for doc_id, own in pieces.items():
        own.sort()
        assert all(start == sum(n for _, n in own[:i]) for i, (start, _) in enumerate(own)) and sum(n for _, n in own) == len(ids[doc_id])
    assert pieces.keys() == ids.keys() and max(sequences.values()) <= 2048


def test_edges(spark, edges, empty, data):
    """Nulls, empty texts, repeated rows, rows without an id, clashing names: through all stages without a crash."""
    for docs in (edges, empty):
        for _, stage in pipeline.STAGES:
            docs = shelve(stage(spark, docs, data))
    docs = edges
    for name, stage in pipeline.STAGES[:-1]:
        docs = shelve(stage(spark, docs, data))
        assert docs.columns == edges.columns, name
