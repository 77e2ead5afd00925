"""Operators over the whole corpus, against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ringside.llm import chunkdedup, katz, mixing, superminhash, syncmers
from ringside.llm.common import WordHashes
from ringside.llm.components import connected_components


@pytest.fixture(params=["sample", "edges"])
def docs(request):
    return request.getfixturevalue(request.param)


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates(docs):
    found = superminhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id if r.doc_id is not None else r.component_id is None) for r in found)


def test_near_duplicates_across_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 8)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = base[:]
        for _ in range(r.randrange(0, 14)):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = superminhash.near_duplicates(docs_of(*rows)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in found), key=repr) == plain_components(rows)


def test_signatures_estimate_similarity():
    words = WordHashes()
    texts = [" ".join(f"w{i}" for i in range(a, a + 300)) for a in (0, 30, 150)]
    ranks = superminhash.signatures(superminhash.shingle_sets(texts, words), 512)
    true = lambda a, b: (300 - abs(a - b) - 1) / (300 + abs(a - b) - 1)
    assert abs((ranks[0] == ranks[1]).mean() - true(0, 30)) < 0.08 and abs((ranks[0] == ranks[2]).mean() - true(0, 150)) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 9), (9, 5), (7, 8), (200, 8)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    assert found == {**{i: 100 for i in range(100, 161)}, 1: 1, 9: 1, 5: 1, 7: 7, 8: 7, 200: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_scores(rows):
    """Base counts and scores, and Katz probabilities from dictionaries."""
    texts = [(d, [w for w in (t or "").encode().lower().split()] + [b" "]) for d, t in rows]
    train = [w for d, w in texts if d is not None and zlib.crc32(str(d).encode()) % 10 != 0]
    c = collections.Counter(x for w in train for x in w)
    total, whole = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    pairs = collections.Counter((a, b) for w in train for a, b in zip(["start", *w], w, strict=False))
    d = katz.discounts(collections.Counter(pairs.values()))
    p = lambda w: (c[w] + 0.1) / whole
    mass, seen = collections.defaultdict(float), collections.defaultdict(float)
    reduced = lambda r: d[r - 1] * r if r <= katz.K else r
    for (a, b), r in pairs.items():
        mass[a], seen[a] = mass[a] + reduced(r), seen[a] + p(b)

    def prob(a, b):
        n = len(train) if a == "start" else c[a]
        n = n if n - mass[a] > 1e-9 * n else n + 1
        if (a, b) in pairs:
            return reduced(pairs[a, b]) / n
        return (n - mass[a]) / n / (1 - seen[a]) * p(b) if a in mass else p(b)

    out = []
    for doc, w in texts:
        out.append((doc, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10(p(x)) for x in w), sum(math.log10(prob(a, b)) for a, b in zip(["start", *w], w, strict=False))))
    return out, prob, c, mass, p


@pytest.mark.parametrize("share", [katz.TABLE_SHARE, 1000, 20])
def test_language_model(docs, share, monkeypatch):
    """Whatever lies in the workers' tables, of words and pairs, and whatever is dealt."""
    monkeypatch.setattr(katz, "TABLE_SHARE", share)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, prob, c, mass, p = plain_scores(rows)
    found = katz.score_documents(docs).collect()
    key = lambda r: (repr(r[0]), r[1], round(r[4], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    rare = [w for w in mass if w != "start" and c[w] == 1]
    for context in sorted(mass, key=repr)[:20] + sorted(rare)[:20]:  # all words and the unknown one sum to one
        left = prob(context, b"never seen")
        assert sum(prob(context, w) for w in c) + left == pytest.approx(1)


def test_language_model_without_training(docs_of):
    found = katz.score(docs_of((1, "a b"), (2, None)), F.col("doc_id").isNull()).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found) == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]


def test_fingerprints(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    first = {}
    for d, t in rows:
        if d is not None:
            first[d] = min(t, first.get(d, t))
    order = sorted(first, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    expected = []
    for d, t in rows:
        third = len(t) // 3
        edited = t[: len(t) - third] + (first[after[d]][:third] if d is not None else "")
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    found = syncmers.fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    prints = collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in found:
        if len(texts[r.doc_id]) == 1:
            prints[texts[r.doc_id][0]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_tell_texts_apart(sample):
    found = syncmers.fingerprints(sample).where("n_chars > 1000").collect()
    assert np.median([r.near_edited for r in found]) > 0.55 > 0.1 > np.median([r.near_next for r in found])


def test_fingerprints_of_far_ids(docs_of):
    """Ids on both sides of zero, in groups of one and of many, repeated ones too: all borrow from the right document."""
    r = random.Random(6)
    ids = [*range(-40, 40), 10**12, 10**12 + 1, -(10**15), 77, 77, 10**12]
    rows = [(d, " ".join(r.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=r.randrange(0, 60)))) for d in ids]
    first = {}
    for d, t in rows:
        first[d] = min(t, first.get(d, t))
    order = sorted(first, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    found = syncmers.fingerprints(docs_of(*rows)).collect()
    edited = [(d, hashlib.sha256((t[: len(t) - len(t) // 3] + first[after[d]][: len(t) // 3]).encode()).hexdigest()) for d, t in rows]
    assert sorted((x.doc_id, x.edited_sha256) for x in found) == sorted(edited)
    anchors = lambda f: {f[i : i + 16] for i in range(0, len(f), 16)}
    of = {x.doc_id: anchors(x.fingerprint) for x in found if ids.count(x.doc_id) == 1}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for x in found:
        assert x.near_edited == pytest.approx(dice(anchors(x.fingerprint), anchors(x.edited_fingerprint)))
        if after[x.doc_id] in of:
            assert x.near_next == pytest.approx(dice(anchors(x.fingerprint), of[after[x.doc_id]]))


def plain_fingerprint(text):
    """All closed syncmers of a text by a plain search, as Spark's hashes name them."""
    def h(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [h(piece) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for piece in ([w] if len(w) <= syncmers.LONG else w)]
    inner = [h(a, b) for a, b in zip(words, words[1:], strict=False)]
    found = []
    for i in range(len(words) - syncmers.K + 1):
        own = [signed(x) for x in inner[i : i + syncmers.K - syncmers.S + 1]]
        if min(own) in (own[0], own[-1]):
            found.append(h(*inner[i : i + syncmers.K - syncmers.S + 1]))
    if 0 < len(words) < syncmers.K:
        found = [h(*words)]
    return "".join(f"{x:016X}" for x in dict.fromkeys(found))


def test_fingerprints_are_all_closed_syncmers(docs):
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(plain_fingerprint(r.text))
    for x in syncmers.fingerprints(docs).collect():
        assert x.fingerprint in texts[x.doc_id]


def test_fingerprints_hold_their_anchors(docs_of):
    """All anchors of a text, however long; a passage keeps its own wherever it stands."""
    words = [f"word{i}" for i in range(2000)]
    found = {x.doc_id: x.fingerprint for x in syncmers.fingerprints(docs_of((1, " ".join(words[:100])), (2, " ".join(words)), (3, "x y z " + " ".join(words[:100])))).collect()}
    anchors = {d: [f[i : i + 16] for i in range(0, len(f), 16)] for d, f in found.items()}
    assert 800 < len(anchors[2]) < 1200 and 30 < len(anchors[1]) < 70
    assert anchors[3][-len(anchors[1]) :] == anchors[1] == anchors[2][: len(anchors[1])]


def test_unspaced_texts_keep_their_anchors(docs_of):
    """In a text without spaces nothing depends on what stands before: one character in front costs one run at most."""
    r = random.Random(8)
    text = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000))
    found = {x.doc_id: x.fingerprint for x in syncmers.fingerprints(docs_of((1, text), (2, "\u4e00" + text), (3, "ab " + text[:1000] + "\u4e01" + text[1000:]))).collect()}
    assert found[1] == plain_fingerprint(text)
    anchors = {d: {f[i : i + 16] for i in range(0, len(f), 16)} for d, f in found.items()}
    assert len(anchors[1]) > 600 and anchors[1] <= anchors[2] and len(anchors[1] & anchors[3]) >= len(anchors[1]) - syncmers.K


def test_lower_neighbours(spark):
    keys = sorted({random.Random(1).randrange(-(1 << 40), 1 << 40) for _ in range(300)} | {0, 1, 255, 256, 257})
    found = syncmers.with_lower_neighbour(spark.createDataFrame([(k,) for k in keys], "key long"), keys[0], keys[-1]).collect()
    assert sorted(map(tuple, found), key=lambda r: r[0]) == [(k, keys[i - 1] if i else None) for i, k in enumerate(keys)]


def test_chunks_cover_and_resist_shifts():
    gear = chunkdedup.gear_table()
    r = random.Random(2)
    text = " ".join("".join(r.choices("abcdeé", k=r.randrange(2, 9))) for _ in range(400))
    s, n, d = chunkdedup.chunks(text.encode(), gear)
    assert s == [sum(n[:i]) for i in range(len(n))] and sum(n) == len(text)
    moved = chunkdedup.chunks(("zz " + text).encode(), gear)[2]
    assert len(set(d) - set(moved)) <= 2
    assert max(chunkdedup.chunks(b"q" * 5000, gear)[1]) <= chunkdedup.LONGEST and chunkdedup.chunks(b"", gear) == ([], [], [])


def test_repeated_passages(docs_of):
    r = random.Random(3)
    words = lambda k: " ".join("".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(k))
    passage = words(60)
    rows = [(i, words(200)) for i in range(8)] + [(20, f"{words(50)} {passage} {words(30)}"), (21, f"{words(20)}\n{passage}\n{words(80)}"), (22, None), (23, "")]
    found = chunkdedup.repeated_passages(docs_of(*rows)).collect()
    assert {x.doc_id for x in found} == {20, 21} and {x.first_doc_id for x in found} == {20}
    text = dict(rows)
    for x in found:
        assert text[x.doc_id][x.start : x.start + x.length] in passage + "\n" + " " + text[x.doc_id] and x.length > 150 and x.kept == (x.doc_id == 20)


def test_repeated_passages_edges(edges, empty):
    assert {r.doc_id for r in chunkdedup.repeated_passages(edges).collect()} <= {d for d, *_ in [(r.doc_id,) for r in edges.collect()]}
    assert chunkdedup.repeated_passages(empty).count() == 0


WEIGHTS = {"a": 0.6, "b": 0.3, "c": 0.1}


def test_mix_keeps_to_the_weights(docs_of):
    r = random.Random(4)
    rows = [(i, "x" * r.randrange(1, 40), "en", r.choice("aaaaaaabbbcd") if i % 50 else None) for i in range(3000)]
    found = mixing.schedule(docs_of(*rows), WEIGHTS, block_chars=50, period=40).collect()
    assert sorted(x.doc_id for x in found) == list(range(3000))
    blocks = sorted({(x.mix_slot, x.mix_source, x.mix_block, x.mix_release, x.mix_deadline) for x in found})
    assert len({b[0] for b in blocks}) == len(blocks) == len({b[1:3] for b in blocks})
    assert all(release <= slot < due for slot, _, _, release, due in blocks)
    for source in {b[1] for b in blocks}:  # a source's blocks come in their own order
        own = [b[2] for b in blocks if b[1] == source]
        assert own == sorted(own)
    weights = mixing.whole_slots({mixing.OTHER: 1 / 3} | WEIGHTS, 40)
    count = collections.Counter()
    for slot, source, *_ in blocks[:400]:  # while no source has run out, each is less than a block from its share
        count[source] += 1
        assert all(abs(count[s] - weights[s] * (slot + 1) / 40) < 1 for s in weights)


def test_mix_edges(edges, empty):
    assert mixing.schedule(edges, WEIGHTS).count() == edges.count() and mixing.schedule(empty, WEIGHTS).count() == 0
    assert mixing.mixed_stream(edges, WEIGHTS).columns == edges.columns


@pytest.mark.parametrize("run", [superminhash.near_duplicates, syncmers.fingerprints, katz.score_documents])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
