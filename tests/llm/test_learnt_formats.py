"""Spans that only the learnt automata find, through the whole operator."""

import collections
import functools
import itertools
import math
import random
import re
import string

import pytest

from ringside.llm import credentials

SIGNS = string.ascii_letters + string.digits


def corpus(words, sizes=(24, 24), n=300):
    """Documents with labelled credentials, some with bare ones, and clean prose; and the bare ones."""
    r = random.Random(9)
    prose = lambda k: " ".join(r.choices(words, k=k))
    fresh = lambda: "".join(r.choices(SIGNS, k=r.randrange(sizes[0], sizes[1] + 1)))
    rows = [(i, f"{prose(30)} api_key = {fresh()} {prose(20)}") for i in range(n)]
    bare = {1000 + i: fresh() for i in range(12)}
    rows += [(i, f"{prose(30)} {v}, {prose(20)}") for i, v in bare.items()]
    rows += [(2000 + i, prose(200)) for i in range(100)]
    return rows, bare


def prose_words(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select("text").collect()]
    return sorted({w for t in texts for w in re.findall("[a-z]{3,20}", t)})


def format_spans(found):
    return {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("format")] for r in found}


def test_bare_secrets_are_found_and_prose_is_left_alone(spark, data, docs_of):
    for sizes in ((24, 24), (16, 40)):
        rows, bare = corpus(prose_words(spark, data), sizes)
        found = credentials.find_secrets(docs_of(*rows)).collect()
        spans, text = format_spans(found), dict(rows)
        caught = sum(any(text[d][s:e] == v for s, e in spans[d]) for d, v in bare.items())
        assert caught >= 0.7 * len(bare)
        assert not any(s for d, s in spans.items() if d >= 2000)
        assert {r.doc_id: r.n_format for r in found} == {d: len(s) for d, s in spans.items()}


def own_bits(automaton, value):
    """log2 likelihood under an automaton, from its counts alone."""
    sizes = {"d": 10, "h": 6, "l": 20, "U": 26}
    kind = lambda c: "d" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "U" if c.isupper() else c
    at, total = 0, 0.0
    for c in value:
        n, k = sum(automaton.n_sign[at].values()), kind(c)
        go = (n + automaton.loose * (1 - automaton.ends)) / (n + automaton.n_final[at] + automaton.loose)
        size, own = sizes.get(k, 1), {x: m for x, m in automaton.n_sign[at].items() if kind(x) == k}
        p = go * (sum(own.values()) + 4 * automaton.usual[k]) / (n + 4) / size
        shares = [m / sum(own.values()) for m in own.values()] + [0.0] * (size - len(own))
        if own and max(abs(x - 1 / size) for x in shares) > math.sqrt(0.5 * math.log(200) / sum(own.values())):
            p = (go * automaton.n_sign[at][c] + p) / (n + 1)
        total += math.log2(p)
        ways = automaton.to[at]
        at = ways[k] if k in ways else ways[max(ways, key=lambda x: automaton.n_class[at][x])] if ways else at
    return total + math.log2((automaton.n_final[at] + automaton.loose * automaton.ends) / (automaton.n_final[at] + sum(automaton.n_sign[at].values()) + automaton.loose))


def own_plain_bits(ordinary, value):
    """log2 likelihood under a bigram model of tokens, counted here."""
    pairs, signs = collections.Counter(), ["", *SIGNS, *"+/_.=-"]
    for t in ordinary:
        pairs.update(itertools.pairwise(["", *t, ""]))
    after, before = collections.Counter(), collections.Counter()
    for (x, y), n in pairs.items():
        before[x] += n
        after[y] += n
    whole = sum(after.values()) + len(signs) / 2
    usual = {y: 256 * (after[y] + 0.5) / whole for y in signs}
    return sum(math.log2((pairs[x, y] + usual[y]) / (before[x] + 256)) for x, y in itertools.pairwise(["", *value, ""]))


def own_chance(value):
    size = 10 * bool(re.search("[0-9]", value)) + 6 * bool(re.search("[a-f]", value)) + 20 * bool(re.search("[g-z]", value)) + 26 * bool(re.search("[A-Z]", value))
    return -(5 + 2 * math.log2(len(value)) + len(value) * math.log2(size + len(set(re.findall("[^A-Za-z0-9]", value)))))


def test_spans_are_those_of_a_plain_scan(spark, data, docs_of):
    """Every token of eight characters or more outside base spans is scored, whatever it's made of, by a scorer of the test's own."""
    rows, _ = corpus(prose_words(spark, data))
    docs = docs_of(*rows, (3000, "x" * 3000 + " ü12345678ü " + "Zq9" * 400))
    labelled = credentials.labelled(docs)
    formats = credentials.Formats.learn(labelled)
    assert formats.by_kind.keys() == {"assign"}
    automaton, least = formats.by_kind["assign"]
    ordinary, expected = labelled["other"][::2], {}
    likely = functools.cache(lambda v: own_bits(automaton, v) >= max(own_chance(v), own_plain_bits(ordinary, v) + least))
    seen = set()
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()]:
        base = [m.span() for m in re.finditer(r"api_key = [A-Za-z0-9+/_.=-]{8,}", text)]
        tokens = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", text)]
        tokens = [(s, e) for s, e in tokens if not any(s < y and x < e for x, y in base)]
        if doc_id % 20 == 1 or 1000 <= doc_id < 2010 or doc_id == 3000:
            expected[doc_id] = [(s, e) for s, e in tokens if likely(text[s:e])]
            seen |= {text[s:e] for s, e in tokens}
    found = format_spans(credentials.find_secrets(docs).collect())
    assert {d: found[d] for d in expected} == expected and sum(map(len, expected.values())) >= 8
    for v in sorted(seen)[::50]:
        assert math.isclose(formats.letters.bits(v), own_plain_bits(ordinary, v)) and math.isclose(automaton.bits(v), own_bits(automaton, v))


HEX = "0123456789abcdef"
FORMATS = {
    "hex": (lambda w: w(HEX, 40), 41),
    "access": (lambda w: "AKIA" + w(string.ascii_uppercase + string.digits, 16), 21),
    "uuid": (lambda w: "-".join(w(HEX, k) for k in (8, 4, 4, 4, 12)), 37),
}


@pytest.mark.parametrize("name", FORMATS)
def test_automata_keep_lengths_and_orders(name):
    r = random.Random(4)
    make, n_states = FORMATS[name]
    fresh = lambda: make(lambda signs, k: "".join(r.choices(signs, k=k)))
    automaton = credentials.Automaton([fresh() for _ in range(300)])
    assert len(automaton.states) == n_states
    fits = lambda v: automaton.bits(v) >= credentials.chance_bits(v)
    values = [fresh() for _ in range(200)]
    assert sum(map(fits, values)) >= 190
    for wrong in (lambda v: v[:-1], lambda v: v[: len(v) // 2], lambda v: v + v[-1], lambda v: v + v):
        assert sum(fits(wrong(v)) for v in values) <= 10
    if name != "hex":
        assert sum(fits(v[::-1]) for v in values) <= 10


def test_open_lengths_become_loops():
    r = random.Random(6)
    values = ["".join(r.choices(SIGNS, k=8 + int(r.expovariate(1 / 20)))) for _ in range(500)]
    automaton = credentials.Automaton(values)
    assert 5 <= len(automaton.states) < 30
    assert automaton.bits("".join(r.choices(SIGNS, k=150))) > -6.2 * 150
    assert len(credentials.Automaton(["x" * 5000, "y" * 3000] * 4).states) <= 2 * credentials.TAUGHT_CHARS + 1


def test_bare_tokens_of_three_formats(spark, data, docs_of):
    """16, 20 and 40 characters, of formats that the patterns find elsewhere; what is found beyond them is counted."""
    r, words = random.Random(12), prose_words(spark, data)
    word = lambda signs, k: "".join(r.choices(signs, k=k))
    forms = [lambda: word(SIGNS, 16), lambda: "sk_" + word(SIGNS, 17), lambda: word(string.ascii_uppercase + string.digits, 40)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    rows = [(i, f"{prose(20)} secret: {forms[i % 3]()} {prose(20)}") for i in range(450)]
    bare = {1000 + i: forms[i % 3]() for i in range(60)}
    rows += [(i, f"{prose(30)} ({v}) {prose(20)}") for i, v in bare.items()]
    clean = [prose(40).title(), prose(30).upper(), "4556737586899855 or 555-0134 on 2024-05-17", "internationalisation2024 state-of-the-art read_the_docs", "x" * 200, "=" * 60, "0" * 40, "ab" * 100]
    rows += [(2000 + i, f"{prose(60)} {clean[i % len(clean)]} {prose(20)}") for i in range(400)]
    text, spans = dict(rows), format_spans(credentials.find_secrets(docs_of(*rows)).collect())
    for k in range(3):
        own = {i: v for i, v in bare.items() if (i - 1000) % 3 == k}
        assert sum(any(text[i][s:e] == v for s, e in spans[i]) for i, v in own.items()) >= 0.8 * len(own)
    false = [text[i][s:e] for i, own in spans.items() for s, e in own if text[i][s:e] not in bare.values()]
    assert len(false) == 0, false


def test_least_hashes_do_not_depend_on_the_partitions(docs_of, spark, data):
    rows, _ = corpus(prose_words(spark, data), n=40)
    one, many = (credentials.labelled(docs_of(*rows).repartition(k)) for k in (1, 7))
    assert one == many and len(one["other"]) > 1000
