"""Repeated passages against a plain version, and how much of what is repeated they cover."""

import collections
import re

import xxhash

from ringside.llm import chunkdedup


def plain_chunks(text, gear):
    """(start, end, digest) in characters, by one byte after the other."""
    raw, h, last, cuts = text.encode(), 0, 0, []
    before = {0: 0}  # characters before each byte that begins one
    for c in text:
        last += len(c.encode())
        before[last] = len(before)
    last = 0
    for i in range(len(raw) + 1):
        if i == len(raw) or (i in before and h < 65536 // chunkdedup.CUT_EACH and i - last >= chunkdedup.SHORTEST):
            while i - last > chunkdedup.LONGEST:
                last = max(x for x in range(last, last + chunkdedup.LONGEST + 1) if x in before)
                cuts.append(last)
            cuts.append(i)
            last = i
        if i < len(raw):
            h = (2 * h + gear[raw[i]]) % 65536
    return [(before[x], before[y], xxhash.xxh3_64_intdigest(raw[x:y])) for x, y in zip([0, *cuts], cuts, strict=False) if y > x]


def plain_passages(rows):
    gear = [int(x) for x in chunkdedup.gear_table()]
    chunks = {d: plain_chunks(t or "", gear) for d, t in rows}
    owners, places = collections.defaultdict(set), collections.Counter()
    for d, own in chunks.items():
        for *_, digest in own:
            owners[digest].add(d)
            places[digest] += 1
    found = set()
    for d, own in chunks.items():
        run = []
        for start, end, digest in [*own, (None, None, None)]:
            if digest is not None and len(owners[digest]) > 1:
                run.append((start, end, min(owners[digest]), places[digest]))
                continue
            of_first = collections.Counter()
            for s, e, first, _ in run:
                of_first[first] += e - s
            if sum(of_first.values()) >= chunkdedup.PASSAGE_CHARS and max(of_first.values()) >= chunkdedup.SHARED_CHARS:
                stretches = []
                for s, e, first, n in run:
                    if stretches and stretches[-1][2] == first:
                        stretches[-1] = [stretches[-1][0], e, first, stretches[-1][3] + 1, max(n, stretches[-1][4])]
                    else:
                        stretches.append([s, e, first, 1, n])
                found |= {(d, s, e - s, k, first, n, d == first) for s, e, first, k, n in stretches}
            run = []
    return found


def test_against_a_plain_version(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    found = chunkdedup.repeated_passages(sample).collect()
    assert {tuple(r) for r in found} == plain_passages(rows) and len(found) > 20


def test_what_is_repeated_is_covered(sample):
    """Of all runs of fifty words that stand in two documents, nearly every character lies in a passage."""
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    windows = collections.defaultdict(set)
    spans = {d: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for d, t in texts.items()}
    of = lambda d, i: texts[d][spans[d][i][0] : spans[d][i + 49][1]]
    for d, own in spans.items():
        for i in range(len(own) - 49):
            windows[of(d, i)].add(d)
    covered = {d: bytearray(len(t)) for d, t in texts.items()}
    for r in chunkdedup.repeated_passages(sample).collect():
        covered[r.doc_id][r.start : r.start + r.length] = b"\1" * r.length
    wanted = {d: bytearray(len(t)) for d, t in texts.items()}
    for d, own in spans.items():
        for i in range(len(own) - 49):
            if len(windows[of(d, i)]) > 1:
                wanted[d][own[i][0] : own[i + 49][1]] = b"\1" * (own[i + 49][1] - own[i][0])
    total = sum(map(sum, wanted.values()))
    both = sum(a & b for d in texts for a, b in zip(wanted[d], covered[d], strict=True))
    assert total > 50_000 and both / total > 0.96  # the rest lies in chunks that reach over a run's ends
