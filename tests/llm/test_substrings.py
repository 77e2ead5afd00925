"""Repeated substrings against a plain search of all of them."""

import collections
import hashlib
import random

import numpy as np
import pytest

from ringside.llm import suffixlevels

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(docs, length=400):
    raws = [(d, (t or "").encode()) for d, t in docs]
    starts = collections.Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    rows = []
    for doc_id, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rows.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def mutated(n, length, seed):
    """Texts that share pieces just below, at and above `length` bytes, with edits, copies and periods."""
    r = random.Random(seed)
    fresh = lambda k: "".join(r.choices("abcdeé ", k=k))
    shared = [fresh(k) for k in (length - 1, length, length + 1, 2 * length, 3 * length)] + ["ab" * length, "x" * (length + 5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(4)):
            piece = r.choice(shared)
            if r.random() < 0.4:
                at = r.randrange(len(piece))
                piece = piece[:at] + "#" + piece[at + 1 :]
            a = r.randrange(5)
            parts += [fresh(r.randrange(2 * length)), piece[a:]]
        texts.append("".join(parts))
    return list(enumerate(texts)) + [(n, texts[0]), (n + 1, texts[1] + "!")]


def test_owners_are_the_least_of_their_windows(monkeypatch):
    monkeypatch.setattr(suffixlevels, "SLICE", 100)
    r = np.random.default_rng(3)
    for raw in (r.bytes(2000), b"a" * 1500, b"ab" * 700, bytes(r.integers(97, 99, 1500, np.uint8)), r.bytes(60), r.bytes(59)):
        h = suffixlevels.grams(np.frombuffer(raw, np.uint8))
        owner, first, last = suffixlevels.runs(raw, 60, 40)
        assert np.repeat(owner, last - first + 1).tolist() == [p + int(np.argmin(h[p : p + 40])) for p in range(len(raw) - 59)]
        assert all(owner[1:] != owner[:-1]) and first.tolist() == [0, *(last[:-1] + 1)][: len(first)]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_every_repeat_and_no_other(docs_of, batches):
    docs = mutated(60, 50, batches)
    table = docs_of(*docs).repartition(9)
    assert found(suffixlevels.remove_repeats(table, 50, 30, batches, 8)) == plain(docs, 50)


def test_sample(sample):
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    out = found(suffixlevels.remove_repeats(sample))
    assert out == plain(docs) and sum(r[2] for r in out) > 10_000


def test_edges(edges, empty, docs_of):
    """Nulls, short texts, rows that repeat an id or have none, repeats within one text, very long texts, more than one code point's bytes."""
    assert found(suffixlevels.remove_repeats(edges)) == plain([(r.doc_id, r.text) for r in edges.collect()])
    assert found(suffixlevels.remove_repeats(empty)) == []
    own = "".join(random.Random(5).choices("abcdefgh ", k=500_000))
    long = [(1, own), (1, "é" * 300), (None, "é" * 150), (2, own[1000:1399]), (3, own[2000:2400]), (4, None)]
    out = {r.doc_id: r for r in suffixlevels.remove_repeats(docs_of(*long)).where("n_bytes != 600").collect()}
    assert (out[1].n_removed, out[1].n_spans, [tuple(s) for s in out[1].spans]) == (400, 1, [(2000, 2400)])
    assert (out[2].n_removed, out[3].n_removed, out[4].n_bytes) == (0, 400, 0)


def test_levels_double(docs_of):
    family, sizes = suffixlevels.SuffixFamily(), []
    texts = suffixlevels.packed(docs_of(*mutated(16, 50, 1)))
    every = suffixlevels.suffixes(texts, 50, 30).withColumn("n", suffixlevels.F.lit(1).cast("long"))
    for i in range(7):
        family.add(every.where(suffixlevels.F.pmod(suffixlevels.F.hash("row"), suffixlevels.F.lit(7)) == i))
        sizes.append([rank for rank, _ in family.levels])
    full = sum(1 for i in range(7) if not every.where(suffixlevels.F.pmod(suffixlevels.F.hash("row"), suffixlevels.F.lit(7)) == i).isEmpty())
    assert sizes[-1] == [b for b in reversed(range(3)) if full >> b & 1]
    assert sum(level.agg({"n": "sum"}).first()[0] for _, level in family.levels) == every.count()
