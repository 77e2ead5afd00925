"""Hashes of words without Python objects, against words."""

import random

import numpy as np
import pyarrow as pa

from ringside.llm import wordhash


def plain(texts):
    return [(t or "").encode().lower().split() for t in texts]


def test_hashes_follow_words(monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK", 64)
    r = random.Random(1)
    texts = ["", None, " ", "a", "A", " a\x0bB\x1cc\x85 ", "é É ß", "x" * 300, "X" * 300 + " b", *(" ".join("".join(r.choices("abAB\t é", k=r.randrange(1, 9))) for _ in range(40)) for _ in range(60))]
    column = pa.array(["skipped", *texts]).slice(1)
    words, seen, n = plain(texts), {}, 0
    for start, part in wordhash.column_slices(column, 200):
        hashes, counts = wordhash.word_hashes(part, 5)
        own = words[start : start + len(part)]
        assert counts.tolist() == [len(w) + 1 for w in own]
        flat = [x for w in own for x in [*w, None]]
        assert all((h == 5) == (w is None) for w, h in zip(flat, hashes.tolist(), strict=True))
        assert all(seen.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True))
        n += len(part)
    assert n == len(texts) and len(set(seen.values())) == len(seen)


def test_empty_columns():
    for texts in ([], [""], [None, None]):
        parts = list(wordhash.column_slices(pa.array(texts, pa.string())))
        assert sum(len(p) for _, p in parts) == len(texts)
        assert all(len(wordhash.word_hashes(p)[0]) == 0 for _, p in parts)


def test_places():
    hashes = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64))
    hashes[:2000] &= np.uint64((1 << 40) - 1)  # many in one part of the table
    hashes = np.unique(hashes)
    known = np.random.default_rng(4).permutation(hashes)[:3000]
    at = wordhash.Places(known).find(hashes)
    assert ((at >= 0) == np.isin(hashes, known)).all() and (known[at[at >= 0]] == hashes[at >= 0]).all()
    assert (wordhash.Places(hashes[:0]).find(hashes) == -1).all()
