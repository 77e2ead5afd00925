"""Rounds over a graph send no table through the driver; publication makes its tables once."""

from ringside import review_queries
from ringside.operators import graph, identity
from ringside.plans import shared


def joins(monkeypatch, module, run):
    found, shelve = [], shared.shelve
    monkeypatch.setattr(module, "shelve", lambda df, *by: found.append(df._jdf.queryExecution().executedPlan().toString()) or shelve(df, *by))
    found.append(run()._jdf.queryExecution().executedPlan().toString())
    return [p for p in found if "Join" in p]


def test_components_and_chains(spark, monkeypatch):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(5)], "slice int, a long, b long")
    plans = joins(monkeypatch, graph, lambda: graph.components(links))
    plans += joins(monkeypatch, graph, lambda: graph.followed(links.selectExpr("a AS node", "b AS to")))
    assert plans and not any("Broadcast" in p for p in plans)


def test_replay(spark, data):
    events = review_queries._identity_events(spark, data)
    found = identity.present_identities(events.selectExpr("from_id AS id").distinct(), identity.replayed(events))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in identity.replayed(events)._jdf.queryExecution().executedPlan().toString()


def test_publication_reads_the_lines_once(spark, data, monkeypatch):
    staged, prepare = [], review_queries.publish.prepare
    monkeypatch.setattr(review_queries.publish, "prepare", lambda s, root, tables, *a: staged.extend(tables.values()) or prepare(s, root, tables, *a))
    review_queries.s14_s15_g15_g17_publication(spark, data)
    assert len(staged) >= 6 and not any("lineitem" in f for df in staged for f in df.inputFiles())
