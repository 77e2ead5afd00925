"""What is repeated is kept in one place."""

import collections
import random

from ringside.llm import chunkdedup


def test_every_repeated_character_is_kept_once(docs_of):
    """A document that adds text to a shared passage, and its copy: what it adds is kept in it, the passage before it."""
    r = random.Random(8)
    words = lambda k: " ".join("".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(k))
    q, own = words(300), words(150)
    rows = {1: q, 2: q + " " + own, 4: q + " " + own}
    found = chunkdedup.repeated_passages(docs_of(*rows.items())).collect()
    kept = collections.Counter()
    for x in found:
        assert x.kept == (x.doc_id == x.first_doc_id)
        if x.kept:
            kept[x.doc_id] += x.length
    gone = collections.Counter()
    for x in found:
        if not x.kept:
            gone[x.doc_id] += x.length
    assert gone[4] == len(rows[4]) and not kept[4]  # all of the copy may go
    assert gone[2] + kept[2] == len(rows[2]) and kept[2] >= len(own) - 100
    assert kept[1] + kept[2] >= len(rows[2]) - 100  # but the chunk at the end of q
