"""The pipeline's language stage where nothing can be learnt."""

from ringside.llm import langid


def test_lettered_documents_stay_without_a_language(docs_of):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "слово", None), (5, "", None)]
    docs = docs_of(*rows)
    assert sorted(r.doc_id for r in langid.in_known_language(docs).collect()) == [1, 4]
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}


def test_a_script_of_no_learnt_language_goes(spark, sample, docs_of):
    strange = [(10**6, "слово за словом, и ещё одно слово", None), (10**6 + 1, "λέξη προς λέξη", None), (10**6 + 2, "42 !", None), (10**6 + 3, "so it is", None)]
    own = docs_of(*strange).select(*sample.columns)
    found = {r.doc_id for r in langid.in_known_language(sample.where("text IS NOT NULL").unionByName(own)).collect()}
    lettered = {r.doc_id for r in sample.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert found == lettered | {10**6 + 3}
