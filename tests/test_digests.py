"""Merkle digests: the same at any partitioning, and every change shows."""

import hashlib

from ringside.operators import digests


def plain(rows, fanout):
    level = [hashlib.sha256("|".join("~" if v is None else f"{len(str(v))}:{v}" for v in r).encode()).hexdigest() for r in rows]
    out, k = [], 0
    while True:
        groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        level = [hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
        out += [(k, i, len(g), h) for i, (g, h) in enumerate(zip(groups, level, strict=True))]
        if len(level) <= 1:
            return sorted(out)
        k += 1


def tree(df, fanout=8):
    return sorted(map(tuple, digests.merkle_levels(df, ["a"], fanout).collect()))


def test_tree(spark):
    rows = [(i, f"x{i % 7}" if i % 5 else None) for i in range(300)]
    make = lambda r: spark.createDataFrame(r, "a int, b string")
    expected = plain(rows, 8)
    assert tree(make(rows).repartition(7)) == expected == tree(make(rows[::-1]).coalesce(1))
    assert max(x[0] for x in expected) == 2
    changed = [*rows[:150], (150, "other"), *rows[151:]]
    assert tree(make(changed))[-1] != expected[-1]
    different = digests.merkle_differences(digests.merkle_levels(make(rows), ["a"], 8), digests.merkle_levels(make(changed), ["a"], 8)).collect()
    assert [(r.node, r.n_one, r.n_other) for r in different] == [(150 // 8, 8, 8)]
    assert tree(make([])) == [] and len(tree(make(rows[:3]))) == 1


def test_two_levels_at_any_size(spark):
    rows = [(i, f"x{i % 7}") for i in range(300)]
    leaves = [r for r in plain(rows, 8) if r[0] == 0]
    root = (1, 0, len(leaves), hashlib.sha256("".join(r[3] for r in leaves).encode()).hexdigest())
    make = lambda r: spark.createDataFrame(r, "a int, b string")
    assert sorted(map(tuple, digests.merkle_levels(make(rows), ["a"], 8, height=2).collect())) == [*leaves, root]
    assert [(r.level, r.n) for r in digests.merkle_levels(make(rows[:8]), ["a"], 8, height=2).collect()] == [(0, 8)]
    assert digests.merkle_levels(make([]), ["a"], 8, height=2).collect() == []
