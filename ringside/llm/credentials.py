"""Secret scans: fixed patterns, and formats learnt from the credentials that these find.

Each kind's labelled credentials (a bounded sample of what the patterns match) grow a prefix tree over character classes,
level by level. A new state joins one of its own depth where nothing tells the two apart: what comes next, what makes up
the rest, how long the rest is, each held against a Hoeffding bound. It joins one of its forebears, which makes a loop,
only where both have been seen often and strings end in them so evenly that the mean length of the rest stays as it is.
So fixed lengths and orders survive as states, and open lengths become loops. A sample of the other tokens gives a plain
model of letters that follow each other. Every token of SHORTEST characters or more outside the patterns' spans is a
candidate. Its score for a kind is the likelihood of its format under the automaton, its length included, over that under
the plain model, in bits; so a dozen random characters can pass, as one token in a million is taken to be a credential.
It becomes a span of kind `format` from LEAST_BITS on, if the format explains it better than chance does, too: characters
drawn evenly from the classes that it has, at any length. So a card number is no hexadecimal key, and a key of another
length than any labelled one isn't found. Two in a hundred of a second sample of ordinary tokens may be credentials
themselves; where more of them would be found, only those are that score more than all but these two.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import slices, small_batches
from ringside.llm.wordhash import mixed, powers

KINDS = ("assign", "access", "hex")
FOUND = "format"
#: Stands for tokens that are no credentials among what is learnt from.
ORDINARY_KIND = "other"
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: Shortest candidate, as in the patterns.
SHORTEST = 8
#: The characters of credentials; candidates end at a full stop.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Bounds of what is learnt from: credentials of each kind, ordinary tokens, and how far into a string (what is scored has none).
LABELLED, ORDINARY, TAUGHT_CHARS = 512, 8192, 1024
#: Least labelled ones for an automaton; the share of ordinary tokens that may be credentials; the least score of one.
LEAST_LABELLED, STRAY, LEAST_BITS = 5, 0.02, 20.0
#: Confidence of the merge tests; characters of the rest that they look at; how often states of a loop must have been met,
#: how far back a loop may lead, and by how much the mean rest may change along it.
ALPHA, AHEAD, MET_OFTEN, BACK, EVEN = 0.01, 64, 20, 8, 0.25
#: What a state's own counts of classes, ends and, where they are uneven, characters are weighed against: all classes and
#: ends met, and an even share of the class. Of ends it's the share of lengths met once, if that is more.
CLASS_WEIGHT, END_WEIGHT, SIGN_WEIGHT = 4.0, 1e-9, 1.0
#: What it costs by chance to have just these classes.
CLASS_BITS = 4
#: Parts in which the least hashes are looked for; lengths for which the best score is known beforehand.
PARTS, KNOWN_LENGTHS = 16, 128
#: Characters that a class stands for.
CLASS_SIZES = {"d": 10, "h": 6, "l": 20, "U": 26}
_CLASS_OF = {c: "d" if c in "0123456789" else "h" if c in "abcdef" else "l" if "g" <= c <= "z" else "U" if "A" <= c <= "Z" else c for c in SIGNS}
_IN_TOKEN = np.isin(np.arange(256), [ord(c) for c in SIGNS if c != "."])
_BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def classes(value: str) -> str:
    return "".join(map(_CLASS_OF.__getitem__, value))


class State:
    """Where strings stand after the same or like beginnings; items: (string, how far it's read)."""

    def __init__(self, depth: int, above: State | None):
        self.depth, self.above = depth, above
        self.items: list[tuple[int, int]] = []
        self.to: dict[str, State] = {}
        self.kept = False


@dataclass
class Seen:
    """What the merge tests know of a state."""

    n: int
    final: int
    next: Counter
    ahead: Counter
    rests: np.ndarray


class Automaton:
    """Built from strings over SIGNS; state 0 starts. Strings of more than TAUGHT_CHARS teach that much, and no end."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.strings = [s[:TAUGHT_CHARS] for s in strings]
        self.read = [classes(s) for s in self.strings]
        self.cut = [len(s) > TAUGHT_CHARS for s in strings]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.states = [State(0, None)]
        self.grow()
        self.weigh()
        del self.strings, self.read

    def seen(self, *states: State) -> Seen:
        """What is known of one state, or of several as if they were one."""
        items = [x for s in states for x in s.items]
        follow, ahead, final = Counter(), Counter(), 0
        for i, at in items:
            if at < len(self.read[i]):
                follow[self.read[i][at]] += 1
                ahead.update(self.read[i][at : at + AHEAD])
            else:
                final += not self.cut[i]
        return Seen(len(items), final, follow, ahead, np.sort([len(self.read[i]) - at for i, at in items]))

    def shares_differ(self, a: Counter, n: int, b: Counter, m: int) -> bool:
        most = self.bound * (n**-0.5 + m**-0.5)
        return any(abs(a[c] / n - b[c] / m) > most for c in a.keys() | b.keys())

    def compatible(self, a: Seen, b: Seen) -> bool:
        """Nothing known tells a from b: what follows, ends, what the rest is made of, and its length."""
        if self.shares_differ(a.next + Counter({"": a.final}), a.n, b.next + Counter({"": b.final}), b.n):
            return False
        n, m = a.ahead.total(), b.ahead.total()
        if n and m and self.shares_differ(a.ahead, n, b.ahead, m):
            return False
        at = np.union1d(a.rests, b.rests)
        apart = np.abs(a.rests.searchsorted(at, "right") / a.n - b.rests.searchsorted(at, "right") / b.n).max()
        return apart <= self.bound * (a.n**-0.5 + b.n**-0.5)

    def loops(self, old: Seen, new: Seen) -> bool:
        rest = new.rests.mean()
        even = max(EVEN, 2 * (rest + 1) * math.sqrt(old.final) / old.n)  # two standard errors of what its ends make of the mean
        return min(old.n, new.n) >= MET_OFTEN and abs(old.rests.mean() - rest) <= even and self.compatible(old, new)

    def walk(self, i: int, at: int, state: State, border: list[State]) -> None:
        """Take a string on from a kept state to its end or to a state that isn't judged yet."""
        while True:
            state.items.append((i, at))
            if at == len(self.read[i]) or not state.kept:
                return
            sign = self.read[i][at]
            if sign not in state.to:
                state.to[sign] = State(state.depth + 1, state)
                border.append(state.to[sign])
            state, at = state.to[sign], at + 1

    def grow(self) -> None:
        start, border = self.states[0], []
        start.kept = True
        for i in range(len(self.read)):
            self.walk(i, 0, start, border)
        while border:
            depth = min(s.depth for s in border)
            level = sorted((s for s in border if s.depth == depth), key=lambda s: -len(s.items))
            border = [s for s in border if s.depth != depth]
            groups = [([s], self.seen(s)) for s in self.states if s.depth == depth]
            for new in level:
                known = self.seen(new)
                for k, (own, all_) in enumerate(groups):
                    if self.compatible(all_, known):
                        groups[k] = [*own, new], self.seen(*own, new)
                        break
                else:
                    groups.append(([new], known))
            goes, moved = {}, []
            for own, known in groups:
                head = own[0]
                if not head.kept:
                    back = [head.above]
                    while len(back) < BACK and back[-1].above:
                        back.append(back[-1].above)
                    head = next((s for s in back if self.loops(self.seen(s), known)), head)
                goes |= {id(s): head for s in own}
                moved += [(i, at, head) for s in own if not s.kept for i, at in s.items]
                if not head.kept:
                    head.items, head.kept = [], True
                    self.states.append(head)
            for state in self.states:
                state.to = {sign: goes.get(id(to), to) for sign, to in state.to.items()}
            for i, at, head in moved:
                self.walk(i, at, head, border)

    def weigh(self) -> None:
        """Bits of every sign, where it leads, and bits of the end, for each state; then the best score of each length."""
        number = {id(s): k for k, s in enumerate(self.states)}
        met, ends = Counter(), 0
        for s in self.states:
            for i, at in s.items:
                if at < len(self.read[i]):
                    met[self.read[i][at]] += 1
                else:
                    ends += not self.cut[i]
        kinds = set(_CLASS_OF.values())
        usual = {c: (met[c] + 1) / (met.total() + len(kinds)) for c in kinds}
        self.n_final, self.n_class, self.n_sign, self.to = [], [], [], []
        for s in self.states:
            signs = Counter(self.strings[i][at] for i, at in s.items if at < len(self.strings[i]))
            self.n_final.append(sum(not self.cut[i] for i, at in s.items if at == len(self.read[i])))
            self.n_sign.append(signs)
            self.n_class.append(Counter(_CLASS_OF[c] for c in signs.elements()))
            self.to.append({c: number[id(t)] for c, t in s.to.items()})
        # how likely a length is that none has: as many as there are lengths of a single string
        alone = sum(1 for n in Counter(map(len, self.read)).values() if n == 1)
        self.loose = max(END_WEIGHT, alone / max(1, len(self.read)))
        self.usual, self.ends = usual, max(ends, 1) / (met.total() + max(ends, 1))
        self.steps, self.end_bits = [], []
        for k, ended in enumerate(self.n_final):
            n = self.n_class[k].total()
            go = (n + self.loose * (1 - self.ends)) / (n + ended + self.loose)
            most = max(self.to[k], key=lambda c: self.n_class[k][c], default=None)  # the way that a sign never met here takes
            step, uneven = {}, self.uneven(k)
            for c, kind in _CLASS_OF.items():
                p = go * (self.n_class[k][kind] + CLASS_WEIGHT * usual[kind]) / (n + CLASS_WEIGHT) / CLASS_SIZES.get(kind, 1)
                if kind in uneven:
                    p = (go * self.n_sign[k][c] + SIGN_WEIGHT * p) / (n + SIGN_WEIGHT)
                step[c] = math.log2(p), self.to[k].get(kind, self.to[k].get(most, k))
            self.steps.append(step)
            self.end_bits.append(math.log2((ended + self.loose * self.ends) / (n + ended + self.loose)))
        self.states = list(range(len(self.states)))
        ways = [list({to: max(b for b, t in step.values() if t == to) for to in {t for _, t in step.values()}}.items()) for step in self.steps]
        best = [self.end_bits]
        for _ in range(KNOWN_LENGTHS):
            best.append([max(b + best[-1][to] for to, b in way) for way in ways])
        self.best = [b[0] for b in best]

    def uneven(self, k: int) -> set[str]:
        """Classes whose characters aren't met evenly in a state, as in a fixed beginning."""
        found = set()
        for kind, n in self.n_class[k].items():
            size = CLASS_SIZES.get(kind, 1)
            if any(abs(self.n_sign[k][c] / n - 1 / size) > self.bound * n**-0.5 for c, other in _CLASS_OF.items() if other == kind):
                found.add(kind)
        return found

    def bits(self, value: str) -> float:
        """log2 likelihood of a string and its end."""
        at, total = 0, 0.0
        for c in value:
            b, at = self.steps[at][c]
            total += b
        return total + self.end_bits[at]


class Letters:
    """How likely signs follow each other, and end, in ordinary tokens.

    Every sign counts half before any is met; how often it's met anywhere counts as much as SPREAD signs that follow.
    """

    SPREAD = 256.0

    def __init__(self, tokens: list[str]):
        signs = ["", *SIGNS]
        counts = {a: Counter() for a in signs}
        for t in tokens:
            for a, b in zip(["", *t], [*t, ""], strict=True):
                counts[a][b] += 1
        anywhere = Counter(dict.fromkeys(signs, 0.5))
        for row in counts.values():
            anywhere.update(row)
        usual = {b: self.SPREAD * n / anywhere.total() for b, n in anywhere.items()}
        #: bits of byte b after byte a; 0 stands for either end
        self.table = np.zeros((256, 256))
        for a, row in counts.items():
            for b in signs:
                self.table[ord(a or "\0"), ord(b or "\0")] = math.log2((row[b] + usual[b]) / (row.total() + self.SPREAD))

    def bits(self, value: str) -> float:
        letters = np.frombuffer(b"\0" + value.encode() + b"\0", np.uint8)
        return float(self.table[letters[:-1], letters[1:]].sum())

    def all_bits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """bits() of many tokens of one string of bytes, by differences of a running sum."""
        sums = np.zeros(len(data))
        np.cumsum(self.table[data[:-1], data[1:]], out=sums[1:])
        return self.table[0, data[starts]] + sums[ends - 1] - sums[starts] + self.table[data[ends - 1], 0]


def chance_bits(value: str) -> float:
    """log2 likelihood of a string whose classes, then length, then characters come by chance."""
    size = sum(CLASS_SIZES.get(c, 1) for c in set(map(_CLASS_OF.__getitem__, value)))
    return -(CLASS_BITS + 2 * math.log2(len(value)) + 1 + len(value) * math.log2(size))


@dataclass
class Formats:
    """An automaton and its least score, by kind, and the model of ordinary tokens."""

    by_kind: dict[str, tuple[Automaton, float]]
    letters: Letters
    #: By length, the bits that an ordinary model may give at most to a token that some automaton could still find.
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def learn(cls, labelled: dict[str, list[str]]) -> Formats:
        """From credentials by kind, and ordinary tokens under ORDINARY_KIND: every second one teaches, the others set the thresholds."""
        ordinary = labelled.get(ORDINARY_KIND, [])
        letters, found = Letters(ordinary[::2]), {}
        for kind, values in labelled.items():
            values = [v for v in values if set(v) <= set(SIGNS)]
            if kind == ORDINARY_KIND or len(values) < LEAST_LABELLED:
                continue
            automaton = Automaton(values)
            scores = ((b, b - letters.bits(v), v) for v, b in ((v, automaton.bits(v)) for v in ordinary[1::2]))
            alike = sorted((score for b, score, v in scores if score >= LEAST_BITS and b >= chance_bits(v)), reverse=True)
            found[kind] = automaton, max([LEAST_BITS, *alike[int(STRAY * len(ordinary[1::2])) :]])
        most = [max((a.best[n] - least for a, least in found.values()), default=-math.inf) for n in range(KNOWN_LENGTHS + 1)]
        return cls(found, letters, np.array([*most, math.inf]))

    def likely(self, value: str) -> bool:
        plain, chance = self.letters.bits(value), chance_bits(value)
        return any(b >= chance and b - plain >= least for b, least in ((a.bits(value), least) for a, least in self.by_kind.values()))

    def candidates(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which tokens an automaton could find at all: those that the plain model makes unlikely enough for their length."""
        plain = self.letters.all_bits(data, starts, ends)
        return np.flatnonzero(plain <= self.most[np.minimum(ends - starts, KNOWN_LENGTHS + 1)] + 0.01)


def base_spans(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind's number, end, the credential itself) in bytes, as the patterns have them."""
    found = []
    if b"=" in raw or b":" in raw:
        # keywords count in either case; ASCII letters keep their places
        found += [(m.start(), 0, m.end(), raw[m.start(2) : m.end(2)]) for m in ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(raw)]
    return sorted(found)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of SHORTEST or more characters of credentials."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_TOKEN[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= SHORTEST
    return starts[long], ends[long]


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit hashes of tokens."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_HASHES[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) >> np.uint64(1)


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one array of bytes, with a byte between them that no token has, and where each begins."""
    at = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=at[1:])
    return np.frombuffer(b"\n".join(raws) + b"\n", np.uint8), at


def apart(base: list[tuple[int, int, int, bytes]], start: int, end: int) -> bool:
    """The token overlaps no base span."""
    return not any(s < end and start < e for s, _, e, _ in base)


def scan_all(raws: list[bytes], formats: Formats) -> list[list[tuple[int, int, int]]]:
    """(start, kind's number, end) of all spans of each text, in bytes; learnt ones (kind number 3) overlap no other."""
    base = [base_spans(r) for r in raws]
    found = [[(s, k, e) for s, k, e, _ in b] for b in base]
    if formats.by_kind:
        data, at = joined(raws)
        starts, ends = tokens(data)
        some = formats.candidates(data, starts, ends)
        owners = at.searchsorted(starts[some], "right") - 1
        for i, s, e in zip(owners.tolist(), (starts[some] - at[owners]).tolist(), (ends[some] - at[owners]).tolist(), strict=True):
            if apart(base[i], s, e) and formats.likely(raws[i][s:e].decode()):
                found[i].append((s, len(KINDS), e))
    return [sorted(f) for f in found]


def scanned(texts: list[str | None], formats: Formats) -> Iterator[tuple[str | None, bytes, list[tuple[int, int, int]]]]:
    """Each text, its bytes and its spans; texts are taken together up to a bound of characters."""
    for a, b in slices(texts):
        raws = [(t or "").encode() for t in texts[a:b]]
        yield from zip(texts[a:b], raws, scan_all(raws, formats), strict=True)


class Least(dict):
    """The `most` strings of least hash among those added, each once: hash -> string."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.bound = most, 1 << 63

    def add(self, value: bytes, h: int) -> None:
        if h <= self.bound:
            self[h] = value
            if len(self) >= 2 * self.most:
                self.cut()

    def cut(self) -> None:
        kept = sorted(self)
        for h in kept[self.most :]:
            del self[h]
        if len(kept) >= self.most:
            self.bound = kept[self.most - 1]


def value_hash(value: bytes) -> int:
    data = np.frombuffer(value, np.uint8)
    return int(token_hashes(data, np.array([0]), np.array([len(data)]))[0])


def labelled(docs: DataFrame) -> dict[str, list[str]]:
    """Distinct credentials that the patterns find in any document, the LABELLED ones of least hash for each kind, and
    ORDINARY other tokens likewise. Each task hands on no more than these, each by as many characters as teach and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {k: Least(LABELLED) for k in KINDS} | {ORDINARY_KIND: Least(ORDINARY)}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                raws = [(t or "").encode() for t in texts[a:b]]
                base = [base_spans(r) for r in raws]
                for _, k, _, v in (x for own in base for x in own):
                    kept[KINDS[k]].add(v[: TAUGHT_CHARS + 1], value_hash(v))
                data, at = joined(raws)
                starts, ends = tokens(data)
                hashes = token_hashes(data, starts, ends)
                for j in np.flatnonzero(hashes <= np.uint64(kept[ORDINARY_KIND].bound)).tolist():
                    i = int(at.searchsorted(starts[j], "right")) - 1
                    s, e = int(starts[j] - at[i]), int(ends[j] - at[i])
                    if apart(base[i], s, e):
                        kept[ORDINARY_KIND].add(raws[i][s : min(e, s + TAUGHT_CHARS + 1)], int(hashes[j]))
        for least in kept.values():
            least.cut()
        rows = [(k, v.decode(), h) for k, least in kept.items() for h, v in least.items()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "hash"])

    rows = docs.select("text").mapInArrow(run, "kind string, value string, hash long").distinct()
    most = F.when(F.col("kind") == ORDINARY_KIND, ORDINARY).otherwise(LABELLED)
    # the least of all are among the least of each part
    part = Window.partitionBy("kind", F.col("hash") % PARTS).orderBy("hash", "value")
    near = rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= F.lit(ORDINARY)).where(F.col("place") <= most)
    found: dict[str, list[str]] = {}
    for r in sorted(near.collect(), key=lambda r: (r.kind, r.hash, r.value)):
        own = found.setdefault(r.kind, [])
        if len(own) < (ORDINARY if r.kind == ORDINARY_KIND else LABELLED):
            own.append(r.value)
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of every row of docs, in code points, end exclusive.

    doc_id, n_assign, n_access, n_hex, base_sha256 and spans; then n_format (learnt spans). Null and empty texts have
    none: zero counts, the digest of an empty string, empty spans. Repeated rows and null ids each give a row, further
    columns are ignored. Where fewer than LEAST_LABELLED credentials of a kind are found, it has no automaton.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Formats.learn(labelled(docs)))
    names = (*KINDS, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column("text").to_pylist()
            for text, raw, spans in scanned(texts, shared.value):
                if spans and len(raw) != len(text):
                    spans = [(len(raw[:s].decode()), k, len(raw[:e].decode())) for s, k, e in spans]
                named = [(k, f"{names[k]}:{s}:{e}") for s, k, e in spans]
                n = [sum(1 for k, _ in named if k == i) for i in range(4)]
                base = ",".join(x for k, x in named if k < len(KINDS))
                rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in named), n[3]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret replaced by a mark of its kind; n_chars, where there is one, follows the text.

    All rows stay, with their columns. A null text stays null. Spans that overlap are replaced together, under the kind
    of the first.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Formats.learn(labelled(docs)))
    names = (*KINDS, FOUND)

    def clean(raw: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [raw[at:start], b"[" + names[kind].encode() + b"]"]
            at = max(at, end)
        return b"".join([*out, raw[at:]])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t and clean(raw, spans).decode() if spans else t for t, raw, spans in scanned(batch.to_pylist(), shared.value)], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.arrow_udf(run, "string")(F.col("text"))
    done = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return done
