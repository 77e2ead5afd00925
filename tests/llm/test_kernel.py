"""The presence kernel against sets of n-grams."""

import numpy as np
import pytest

from ringside.llm import langid


def plain_kernel(a, b):
    def grams(text, n):
        signs = "".join(c if c.isalpha() else "\0" for c in text.lower())
        return {signs[i : i + n] for i in range(len(signs) - n + 1)}

    total = 0
    for n in (1, 2, 3):
        x, y = grams(a, n), grams(b, n)
        total += len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0
    return total


def test_kernel_is_that_of_real_n_grams(sample):
    """Any script; the hash of n-grams changes next to nothing."""
    texts = [r.text for r in sample.where("length(text) > 50").limit(12).collect()]
    texts += ["съешь ещё этих мягких французских булок", "да выпей чаю, французских", "他们在图书馆里读书", "图书馆里的书很多", "ab", "a", "𐐨𐐩 word", "Ünïcödé straße"]
    letters = langid.letter_table()
    found = [langid.present(langid.signs_of(t, letters)) for t in texts]
    for a, x in zip(texts, found, strict=True):
        for b, y in zip(texts, found, strict=True):
            own = sum(len(np.intersect1d(g, h)) / (len(g) * len(h)) ** 0.5 for g, h in zip(x, y, strict=True) if len(g) and len(h))
            assert own == pytest.approx(plain_kernel(a, b), abs=0.01)
