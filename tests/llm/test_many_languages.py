"""Languages beyond the first by name, and texts that show theirs late."""

from ringside.llm import langid


def test_every_language_is_learnt(docs_of):
    """Each of 70 languages has an alphabet of its own, one letter in a script of many."""
    letter = lambda k: chr(0x4E00 + k) if k >= 26 else chr(97 + k)
    text = lambda k, i: " ".join(letter(k % 26) * (1 + (i + j) % 3) + letter(26 + k // 26) for j in range(20))
    found = langid.identify(docs_of(*((100 * k + i, text(k, i), f"l{k:03}") for k in range(70) for i in range(12)))).collect()
    assert {r.lang_pred for r in found} == {f"l{k:03}" for k in range(70)}
    assert sum(r.lang_pred == f"l{r.doc_id // 100:03}" for r in found) / len(found) > 0.98


def test_whole_texts_teach(docs_of):
    """What tells two languages apart stands after 25,000 characters."""
    rows = [(i, "a " * 12_500 + "bcd efg "[:: 1 if i % 2 else -1] * 40, "xy"[i % 2]) for i in range(40)]
    found = langid.identify(docs_of(*rows)).collect()
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in found)
