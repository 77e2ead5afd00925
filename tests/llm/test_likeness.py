"""Likeness of fingerprints over all anchors."""

from ringside.llm import syncmers


def test_likeness_of_long_texts_sees_a_short_passage(docs_of):
    shared = " ".join(f"s{i}" for i in range(60))
    text = lambda own: " ".join(f"{own}{i}" for i in range(20_000)) + " " + shared
    found = {x.doc_id: x for x in syncmers.fingerprints(docs_of((1, text("a")), (2, text("b")))).collect()}
    assert 0.001 < found[2].near_next == found[1].near_next < 0.006
