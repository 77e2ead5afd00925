"""Replay of merges and splits, evidence as of a moment, lineage."""

import datetime
import random

from ringside.operators import graph, identity


def plain(events):
    into, states, by = {}, {}, {}
    for e, kind, a, b in sorted(events):
        if kind == "merge":
            ok = a != b and a not in into and b not in into
            if ok:
                into[a], by[a] = b, e
        else:
            ok = into.pop(a, None) is not None
            by.pop(a, None)
        states[e] = "applied" if ok else "quarantined"
    return states, set(by.values()), into


def end(into, x):
    while x in into:
        x = into[x]
    return x


def test_replay_and_present_identities(spark):
    r = random.Random(3)
    chain = [(i, "merge", 30 - i, 31 - i) for i in range(25)] + [(25, "split", 18, None), (26, "merge", 18, 40), (27, "split", 18, None), (28, "split", 18, None), (29, "merge", 18, 19)]
    some = [(100 + i, *(("split", r.randrange(50, 80), None) if r.random() < 0.3 else ("merge", r.randrange(50, 80), r.randrange(50, 80)))) for i in range(120)]
    events = chain + some
    table = spark.createDataFrame(r.sample(events, len(events)), "event_id long, kind string, from_id long, into_id long").repartition(5)
    out = identity.replayed(table).cache()
    states, active, into = plain(events)
    assert {x.event_id: x.state for x in out.collect()} == states and {x.event_id for x in out.where("active").collect()} == active
    assert sorted((x.event_id, x.kind, x.from_id, x.into_id) for x in out.collect()) == sorted(events)
    ids = spark.range(0, 90)
    assert {x.id: x.present_id for x in identity.present_identities(ids, out).collect()} == {x: end(into, x) for x in range(90)}


def test_no_merge_at_all(spark):
    events = spark.createDataFrame([(1, "split", 5, None)], "event_id long, kind string, from_id long, into_id long")
    out = identity.replayed(events)
    assert [x.state for x in out.collect()] == ["quarantined"]
    assert [x.present_id for x in identity.present_identities(spark.range(2), out).orderBy("id").collect()] == [0, 1]


def test_long_chains_are_followed(spark):
    pointers = spark.range(0, 1000).selectExpr("id AS node", "id + 1 AS to")
    assert {x.end for x in graph.followed(pointers).collect()} == {1000}


def test_evidence_and_lineage(spark):
    at = lambda d: datetime.datetime(2020, 1, d)
    versions = identity.bitemporal(spark.createDataFrame([("a", 1, at(5), 10), ("a", 2, at(8), 11), ("b", 3, at(1), 12)], "alias string, fighter_id int, decided_at timestamp, decision_id int"))
    seen = spark.createDataFrame([("e1", "a", at(4)), ("e2", "a", at(5)), ("e3", "a", at(7)), ("e4", "a", at(9)), ("e5", "c", at(9)), ("e6", "b", at(9))], "evidence_id string, alias string, seen_at timestamp")
    asof = identity.evidence_as_of(seen, versions).cache()
    assert {r.evidence_id: r.decision_id for r in asof.collect()} == {"e1": None, "e2": 10, "e3": 10, "e4": 11, "e5": None, "e6": 12}
    lineage = "link_id int, row string, n int"
    claimed = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "y", 1), (4, "z", 1)], lineage)
    retained = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "y", 1), (2, "y", 1), (4, "z", 1)], lineage)
    asked = spark.createDataFrame([(1, "a", 1, "e2"), (2, "a", 1, "e3"), (3, "a", 1, "e4"), (4, "a", 1, "e9"), (5, "a", 1, "e6"), (6, "a", 1, "e1")], "link_id int, alias string, fighter_id int, evidence_id string")
    out = {r.link_id: (r.state, r.reason) for r in identity.applied_links(asked, asof, claimed, retained, ["row", "n"]).collect()}
    assert out == {1: ("applied", None), 2: ("quarantined", "lineage differs"), 3: ("quarantined", "another fighter"), 4: ("quarantined", "no evidence"), 5: ("quarantined", "evidence of another alias"), 6: ("quarantined", "no current version")}
