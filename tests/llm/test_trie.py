"""The prefix trie of conversations against a plain one."""

import hashlib
import random
import re
import zlib

import pytest

from ringside.llm import prefixtrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, class long, depth string, n string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))
    own = {c: [t[1:] for t in turns] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + ((len(members[path]) - 1) * len(WORDS.findall(path[-1][1])) if path else 0)
    name = {path: min(c for c, _ in m) for path, m in members.items()}
    ends = {path: hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest() for path, m in members.items()}
    return sorted(((name[p], len(p), name[p[:-1]] if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], ends[p]) for p, m in members.items()), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def check(spark, rows):
    table = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert found(prefixtrie.conversation_trie(table)) == plain(rows)


def test_sample(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    assert found(prefixtrie.conversation_trie(table)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


def test_edges(spark):
    """No row, no id, nulls, ties, repeated rows, negative ids, no base, no turn left, columns of the operator's own names."""
    check(spark, [])
    check(spark, [(None, 1, "user", "a b")])
    check(spark, [(7, 1, "user", "a b")])
    rows = [(c, t, role, text) for c in (-21, -20, -1, 0, 1, 2, 20, 23, 45, 46) for t, role, text in ((None, "user", None), (2, None, "b c"), (2, "user", "a"), (2, "user", "a"), (3, "x", f"own {c}"))]
    rows += [(60 + i, 1, "user", "one") for i in range(8)] + [(None, 1, "user", "lost"), (90, 5, "user", "z " * 100_000), (99, 5, "user", "z " * 100_000)]
    check(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_long_shared_beginnings(spark, seed):
    """Copies that part late, copies of whole conversations, many that end at one node."""
    r, rows = random.Random(seed), []
    story = [("user", f"{i} {'w ' * r.randrange(4)}") for i in range(90)]
    for c in range(40):
        cut = r.choice([3, 4, 40, 70, 90])
        turns = story[:cut] + [("user", r.choice("pq")) for _ in range(r.randrange(3))]
        rows += [(c * 20, t, *x) for t, x in enumerate(turns)]
    check(spark, rows)


def test_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE_BITS", 2)
    check(spark, [(20 * c + c % 3, 1, "user", "same") for c in range(-30, 60)])
