"""The mix against the weights as given, over many periods."""

import collections
import math
from fractions import Fraction

from ringside.llm import mixing


def off_target(found, weights, active):
    """Greatest distance in blocks of a source from its share of the slots so far, while no source has run out."""
    blocks = sorted({(x.mix_slot, x.mix_source, x.mix_block) for x in found})
    last = {s: max(t for t, own, _ in blocks if own == s) for s in active}
    total, count, worst = sum(weights[s] for s in active), collections.Counter(), 0
    for slot, source, _ in blocks[: min(last.values()) - 150]:
        count[source] += 1
        worst = max(worst, *(abs(count[s] - weights[s] / total * (slot + 1)) for s in active))
    return worst, min(last.values())


def test_mix_keeps_to_unrounded_weights(docs_of):
    rows = [(i, "x" * 40, "en", "abc"[i % 3]) for i in range(3000)]
    for weights, most in (({"a": 0.8 / 19, "b": 0.8 / 19, "c": 0.8 / 19}, 1), ({"a": 0.5**0.5, "b": 0.7, "c": 0.65}, 2)):
        worst, slots = off_target(mixing.schedule(docs_of(*rows), weights, block_chars=50, period=40).collect(), weights, "abc")
        assert slots > 1500 and worst < most  # some 40 periods


def plain_order(weights, slots):
    """Earliest deadline first over exact weights, one slot after the other."""
    total = sum(map(Fraction, weights.values()))
    share = {s: (Fraction(w) / total).limit_denominator(1000) for s, w in weights.items()}
    done, out = dict.fromkeys(sorted(weights), 0), []
    for slot in range(slots):
        ready = [s for s in done if math.floor(done[s] / share[s]) <= slot]
        best = min(ready, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s))
        done[best] += 1
        out.append(best)
    return out


def test_mix_is_earliest_deadline_first(docs_of):
    rows = [(i, "x" * 40, "en", "abbcc"[i % 5]) for i in range(3000)]
    for weights in ({"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 1 / 7, "b": 3 / 7, "c": 3 / 7}):
        own = weights | {mixing.OTHER: sum(weights.values()) / 3}
        found = mixing.schedule(docs_of(*rows), own, block_chars=50).collect()
        blocks = sorted({(x.mix_slot, x.mix_source) for x in found})
        left = min(max(t for t, s in blocks if s == name) for name in "abc")
        assert left > 500 and [s for _, s in blocks[: left - 20]] == plain_order(weights, left - 20)


def test_written_order_beyond_five_digits(spark, tmp_path):
    """Files are read in the order of their numbers, not of their names."""
    for n, name in ((3, "part-100000-x.parquet"), (2, "part-99999-x.parquet"), (1, "part-00002-x.parquet")):
        spark.range(10 * n, 10 * n + 10, 1, 1).write.parquet(str(tmp_path / f"t{n}"))
        (tmp_path / "all").mkdir(exist_ok=True)
        next((tmp_path / f"t{n}").glob("part-*.parquet")).rename(tmp_path / "all" / name)
    rows = mixing.in_written_order(spark.read.parquet(str(tmp_path / "all"))).collect()
    assert [r.id for r in rows] == list(range(10, 40))
