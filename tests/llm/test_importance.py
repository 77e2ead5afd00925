"""The importance draw against a plain version, with chunks of every size."""

import hashlib
import math
import re
import zlib

import pytest

from ringside.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def runs_of(text, longest):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest=1, buckets=10_000, least_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs_of(text, longest)[1]:
                counts[bucket(f)] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1.0) * (ss + buckets) / ((a + 1.0) * (tt + buckets)))) for a, b in zip(s, t, strict=True)]
    rows, able = [], []
    for doc_id, text in docs:
        n_words, found = runs_of(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= least_words:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet")


def test_draw_of_the_sample(sample, target):
    docs, texts = [(r.doc_id, r.text) for r in sample.collect()], [r.text for r in target.collect()]
    expected = plain(docs, texts)
    assert found(importance.resample(sample, target)) == expected
    assert max(r[4] or 0 for r in expected) > 10


@pytest.mark.parametrize("chunk", [1, 40, 1000])
def test_runs_of_words_across_chunks(sample, target, chunk):
    docs, texts = [(r.doc_id, r.text) for r in sample.limit(60).collect()], [r.text for r in target.collect()]
    few = sample.where(sample.doc_id.isin([d for d, _ in docs]))
    assert found(importance.resample(few, target, longest=3, n_buckets=500, percent=40, chunk_bytes=chunk)) == plain(docs, texts, 3, 500, 20, 40)


def test_edges(edges, empty, docs_of, target):
    """Nulls, no words, repeated rows and ids, long texts, ties; more than all words of a text are carried."""
    texts = [r.text for r in target.collect()]
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    for least in (0, 20):
        assert found(importance.resample(edges, target, longest=2, least_words=least, percent=50)) == plain(docs, texts, 2, 10_000, least, 50)
    assert found(importance.resample(empty, target)) == []
    assert found(importance.resample(edges, empty)) == plain(docs, [])
    long = [(1, "Ünder the sun " * 200_000), (2, "x" * 300_000), (3, "-" * 300_000), (None, "a b c " * 30), (4, "a b c " * 30), (4, "a b c " * 30)]
    assert found(importance.resample(docs_of(*long), target, longest=2, percent=100)) == plain(long, texts, 2, percent=100)
    assert found(importance.resample(docs_of(*long), target, percent=0)) == plain(long, texts, percent=0)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(0, 30_000, 1, 7).selectExpr("id AS doc_id", "id % 3 AS n_features", "0L AS weight", "pmod(id * 7919, 50) AS score", "id % 10 > 0 AS eligible")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = importance.ranked(rows, 5000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    able = sorted((r for r in out if r.eligible), key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in able] == [*range(1, 5001), *[None] * (27_000 - 5000)] and all(r["rank"] is None for r in out if not r.eligible)
