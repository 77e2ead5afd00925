"""Katz back-off scoring.

The model is a bigram model over all words, the start of a text and its end, that backs off to smoothed word
frequencies. Counts up to K are discounted by Good and Turing; what this frees goes to the back-off of the context, with a weight
that makes the probabilities of all words sum to one exactly. A context whose counts are all greater than K frees
nothing and is taken to have been met once more.

Words are frequent (at least one in TABLE_SHARE training tokens, so at most so many) or rare. A frequent word has a
number, a rare one a hash. Every count is a sum over occurrences that Spark deals by a key that no hot word or pair has:

* a rare word's occurrences lie together with the tokens before and after them; so the word's count, the counts of what
  follows it and those of the frequent words before it are windows over one exchange;
* a pair of frequent words lies with its like, but for hot pairs, at least one in TABLE_SHARE tokens, whose counts each
  task adds up before it hands them on.

Windows give additive sums by text and by context, tables in the shared folder; word counts are one too. Frequent words,
hot pairs and frequent contexts are arrays in every worker, bounded by TABLE_SHARE. A last pass over the texts adds what
these say to the sums. Back-off weights of rare contexts are worked out, from all that follows them in training, for
those that a held-out text asks for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import remainder, shelve, small_batches
from ringside.llm.wordhash import Places, column_slices, word_hashes

#: Most words, contexts or pairs of an array in a worker; bits of a frequent word's number; greatest discounted count.
TABLE_SHARE, NUMBER_BITS, K = 1 << 20, 20, 5
#: Added to each count of the word frequencies, and to their sum for each distinct word and one unknown.
ADDED = 0.1
#: Tokens whose counts a worker adds up before it hands them on.
HELD_TOKENS = 1 << 22
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: Occurrences of rare words that a worker looks at together.
HELD_ROWS = 1 << 18
RARE = 1 << 63
#: The hash of the token that ends a text.
END = RARE - 2
#: Stands for the token after the end of a text.
NONE = np.iinfo(np.int64).min
#: What a row of sums is about: a text; a frequent context; pairs never seen, of a text and a frequent or rare context;
#: a rare word that a text backs off to; what follows a rare context that is asked for; a hot pair.
TEXT, CONTEXT, UNSEEN, UNSEEN_RARE, RARE_WORD, FOLLOWING, HOT = range(7)
CLASSES = [f"k{r}" for r in range(1, K + 2)]


#: The workers' tables of frequent words, kept from task to task: the last one, by a name for it.
_places: dict[str, Places] = {}


def places_of(name: str, hashes: np.ndarray) -> Places:
    if name not in _places:
        _places.clear()
        _places[name] = Places(hashes)
    return _places[name]


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches with a text column; row numbers, hashes of all tokens and tokens of each text."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for a, texts in column_slices(batch.column("text")):
            yield batch.slice(a, len(texts)), np.arange(row + a, row + a + len(texts)), *word_hashes(texts, END)
        row += len(batch)


def numbered(hashes: np.ndarray, counts: np.ndarray, places: Places, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of tokens and of their contexts (start: before a text)."""
    place = places.find(hashes)
    word = np.where(place >= 0, place.astype(np.uint64), hashes | np.uint64(RARE))
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(counts) - counts] = start
    return word, context


def pair_keys(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens and their contexts are both frequent, and the pairs' keys."""
    both = (word < RARE) & (context < RARE)
    return both, ((context[both] << np.uint64(NUMBER_BITS)) | word[both]).astype(np.int64)


def summed(held: list[np.ndarray], least: float) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
    often = counts >= least
    return pa.RecordBatch.from_arrays([pa.array(values[often].astype(np.int64), pa.int64()), pa.array(counts[often], pa.int64())], ["key", "n"])


def counted(docs: DataFrame, keys_of, share: int | None = None) -> DataFrame:
    """(key, n) over all docs: keys_of makes a function from hashes of tokens, and tokens of each text, to keys, once in each task.

    With a share, a count that is less than one in so many of the tokens it was taken over isn't handed on: all such
    counts of a key are less than one in so many of all tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n = keys_of(), [], 0
        for _, _, hashes, counts in walked(batches):
            held.append(keys(hashes, counts))
            n += len(hashes)
            if n > HELD_TOKENS:
                yield summed(held, n / share if share else 1)
                held, n = [], 0
        yield summed(held, n / share if share else 1)

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(of_counts: dict[int, int]) -> list[float]:
    """Good-Turing discounts of the counts 1 to K; 1 - 1 / 2r for a count r to which they give none between 0 and 1."""
    plain = [1 - 0.5 / r for r in range(1, K + 1)]
    if not all(of_counts.get(r) for r in range(1, K + 2)):
        return plain
    beyond = (K + 1) * of_counts[K + 1] / of_counts[1]
    if beyond >= 1:
        return plain
    found = [((r + 1) * of_counts[r + 1] / (r * of_counts[r]) - beyond) / (1 - beyond) for r in range(1, K + 1)]
    return [d if 0 < d < 1 else p for d, p in zip(found, plain, strict=True)]


def entry(when: Column, kind: int, id_: Column, other=None, m=None, counts=(), x=0.0, y=0.0, n=0) -> Column:
    """A row of sums, or null: m occurrences of a pair with each of some counts, and further sums x, y, n."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    classes = []
    for k, name in enumerate(CLASSES, 1):
        own = [F.when(r == k, m).otherwise(0) for r in counts]
        classes.append((sum(own[1:], own[0]) if own else F.lit(0)).cast("long").alias(name))
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("kind"), id_.cast("long").alias("id"), as_column(other).cast("long").alias("other"), *classes,
            as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"), as_column(n).cast("long").alias("n"),
        ),
    )


def sums_of(df: DataFrame, usual: list[Column], seldom: list[Column], when_seldom: Column) -> DataFrame:
    """kind, id, other and the sums over the entries of all rows that aren't null, written to the shared folder."""
    rows = df.select(F.inline(F.when(when_seldom, F.array(*seldom)).otherwise(F.array(*usual)))).where(F.col("kind").isNotNull())
    conf = df.sparkSession.conf
    before = conf.get(METHOD_LIMIT)
    conf.set(METHOD_LIMIT, "8000")  # longer methods than this the JVM doesn't compile, so these wide expressions go in parts
    try:
        return shelve(rows.groupBy("kind", "id", "other").agg(*(F.sum(c).alias(c) for c in (*CLASSES, "x", "y", "n"))))
    finally:
        conf.set(METHOD_LIMIT, before)


def log_of_large(r: Column, m: Column) -> Column:
    """m times the logarithm of a count that has no class of its own."""
    return F.when(r > K + 1, m * F.log10(r)).otherwise(0.0)


def frequent_pairs(texts: DataFrame, places, hot, words: DataFrame, start: int) -> DataFrame:
    """Sums over pairs of frequent words: all but the hot ones, whose counts alone are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = hot.value
        hot_counts = np.zeros(len(hot_keys), np.int64)
        for batch, rows, hashes, counts in walked(batches):
            both, keys = pair_keys(*numbered(hashes, counts, places(), start))
            doc = np.repeat(rows, counts)[both]
            learnt = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), counts)[both]
            at, here = found_in(hot_keys, keys)
            np.add.at(hot_counts, at[here & learnt], 1)
            columns = [pa.array(keys[~here]), pa.array(doc[~here]), pa.array(np.where(learnt[~here], 1, -1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "row", "n"])
        some = np.flatnonzero(hot_counts)
        yield pa.RecordBatch.from_arrays([pa.array(hot_keys[some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(hot_counts[some], pa.int32())], ["key", "row", "n"])

    met = texts.mapInArrow(run, "key long, row long, n int")
    met = met.withColumn("r", F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))).over(Window.partitionBy("key")), F.lit(0)))
    met = met.withColumn("word", F.col("key").bitwiseAND((1 << NUMBER_BITS) - 1)).join(F.broadcast(words), "word")
    row, r, n, context = F.col("row"), F.col("r"), F.col("n"), F.shiftright("key", NUMBER_BITS)
    m, own, train = F.abs("n"), row.isNotNull(), F.col("n") > 0
    of_text = entry(own & (r > 0), TEXT, row, (~train).cast("int"), m, [r], x=log_of_large(r, m))
    of_context = entry(own & train, CONTEXT, context, None, m, [r], y=m * F.col("p") / F.greatest(r, F.lit(1)))
    unseen = entry(own & (r == 0), UNSEEN, row, context, y=m * F.col("log_p"), n=m)
    return sums_of(met, [of_text, of_context], [of_text, unseen, entry(~own, HOT, F.col("key"), n=n)], ~own | ~train)


def sums_by(group: np.ndarray, other: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row, the sum of n over the rows that share group and other with it."""
    order = np.lexsort((other, group))
    g, o = group[order], other[order]
    new = np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1]))
    sums = np.add.reduceat(n[order], np.flatnonzero(new))
    out = np.empty_like(n)
    out[order] = sums[np.cumsum(new) - 1]
    return out


SUMS = "kind int, id long, other long, " + ", ".join(f"{c} long" for c in CLASSES) + ", x double, y double, n long"
MET = "key long, row long, before int, after long, m int, r long, c long, q long, frees boolean, asked boolean"


def grouped(kind: int, ids: np.ndarray, other: int | None, values: list[np.ndarray], x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.Table:
    """Rows of sums of one kind by id: how many of `values` are in each class, and x, y, n."""
    names, place = np.unique(ids, return_inverse=True)
    total = lambda w: np.bincount(place, w, len(names))
    classes = [sum(total(v == k) for v in values).astype(np.int64) for k in range(1, K + 2)]
    columns = [pa.array(np.full(len(names), kind), pa.int32()), pa.array(names.astype(np.int64)), pa.array([other] * len(names), pa.int64()), *map(pa.array, classes), pa.array(total(x)), pa.array(total(y)), pa.array(total(n).astype(np.int64))]
    return pa.Table.from_arrays(columns, ["kind", "id", "other", *CLASSES, "x", "y", "n"])


def rare_sums(whole: float):
    """Occurrences of rare words in the order of their keys -> sums over what training alone says, and the other rows as they are.

    r: training occurrences with the same token behind; c: of the word; q: with the same token before; frees: any of its
    pairs that is seen gives weight up; asked: a held-out pair of it is new. Rows of words that are asked for, and held-out
    rows, go on with these; all others are summed here. A word's rows are few, by what rare means.
    """

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, row, before, n = (rows.column(c).to_numpy() for c in ("key", "row", "before", "n"))
        after = rows.column("after").fill_null(NONE).to_numpy()
        group = np.cumsum(np.append(0, key[1:] != key[:-1]))
        learnt, follows = np.maximum(n, 0).astype(np.int64), after != NONE
        r, q = sums_by(group, after, learnt), sums_by(group, before, learnt)
        in_group = lambda x: np.bincount(group, x)[group]
        c = in_group(learnt).astype(np.int64)
        frees = in_group(follows & (n > 0) & (r <= K)) > 0
        asked = (in_group(follows & (n < 0) & (r == 0)) > 0) & (c > 0)
        here = (n > 0) & ~asked
        large = lambda v: np.where(v > K + 1, np.log10(np.maximum(v, 1)), 0.0)
        f, u = follows[here], before[here] >= 0
        pairs = [np.where(f, r[here], 0), np.where(u, q[here], 0)]
        given = np.where(f, large(r[here]) - np.log10(np.where(frees[here], c[here], c[here] + 1)), 0.0) + np.where(u, large(q[here]), 0.0)
        p = (c[here] + ADDED) / whole
        sums = [
            grouped(TEXT, row[here], 0, pairs, given, np.log10(p), np.ones(len(p))),
            grouped(CONTEXT, before[here][u], None, [q[here][u]], np.zeros(u.sum()), (p / np.maximum(q[here], 1))[u], np.zeros(u.sum())),
        ]
        rest = np.flatnonzero(~here)
        columns = {"key": key, "row": row, "before": before, "m": n, "r": r, "c": c, "q": q, "frees": frees, "asked": asked}
        left = pa.table({k: pa.array(v[rest]) for k, v in columns.items()} | {"after": pa.array(after[rest], mask=after[rest] == NONE)})
        yield from pa.concat_tables([*sums, left], promote_options="default").select(COLUMNS).cast(SCHEMA).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD_ROWS:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                done = int(key.searchsorted(key[-1]))  # the last key may go on
                if done:
                    yield from told(rows.slice(0, done))
                held, n = rows.slice(done).to_batches(), len(rows) - done
        if n:
            yield from told(pa.Table.from_batches(held))

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in f"{SUMS}, {MET}".split(", ")])
COLUMNS = SCHEMA.names


def rare_words(texts: DataFrame, places, words: DataFrame, start: int, whole: float) -> DataFrame:
    """Sums over the occurrences of rare words, the tokens after them, and before them where these are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(RARE - 1)
        for batch, rows, hashes, counts in walked(batches):
            word, context = numbered(hashes, counts, places(), start)
            after = np.full(len(word), NONE)
            # a rare word after the context: -1 less its hash
            after[:-1] = np.where(word[1:] < RARE, word[1:].astype(np.int64), -1 - (word[1:] & low).astype(np.int64))
            after[np.cumsum(counts) - 1] = NONE
            at = np.flatnonzero(word >= RARE)
            before = np.where(context[at] < RARE, context[at].astype(np.int64), -1)
            learnt = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), counts)[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((word[at] & low).astype(np.int64)), pa.array(np.repeat(rows, counts)[at]), pa.array(before.astype(np.int32)),
                    pa.array(after[at], mask=after[at] == NONE), pa.array(np.where(learnt, 1, -1).astype(np.int32)),
                ],
                ["key", "row", "before", "after", "n"],
            )

    dealt = texts.mapInArrow(run, "key long, row long, before int, after long, n int").repartition("key").sortWithinPartitions("key")
    met = dealt.mapInArrow(rare_sums(whole), f"{SUMS}, {MET}")
    n = F.col("m")
    follows = F.col("after").isNotNull()
    unseen = follows & (n < 0) & (F.col("r") == 0)
    met = met.join(F.broadcast(words.select(F.col("word").alias("after"), F.col("p").alias("p_after"), F.col("log_p").alias("log_after"))), "after", "left")
    key, row, before, r, c, q, m = (*map(F.col, ("key", "row", "before", "r", "c", "q")), F.abs("m"))
    held, log_after = (n < 0).cast("int"), F.col("log_after")
    rare_after = F.when(F.col("after") < 0, -1 - F.col("after"))
    log_p, part = F.log10((c + ADDED) / whole), m / F.greatest(r, F.lit(1))
    # what the pair of this word and the next gives: seen; not seen; or a context without any count
    given = F.when(r > 0, log_of_large(r, m) - m * F.log10(F.when(F.col("frees"), c).otherwise(c + 1))).otherwise(m * F.coalesce(log_after, F.lit(0.0)))
    given = F.when(follows, given).otherwise(0.0) + F.when(before >= 0, log_of_large(q, m)).otherwise(0.0)
    pairs = [F.when(follows, r).otherwise(0), F.when(before >= 0, q).otherwise(0)]
    of_text = entry(F.lit(True), TEXT, row, held, m, pairs, x=given, y=m * log_p, n=F.when(c > 0, m).otherwise(0))
    of_context = entry((before >= 0) & (n > 0), CONTEXT, before, None, m, [q], y=m / F.greatest(q, F.lit(1)) * (c + ADDED) / whole)
    there = F.struct("kind", "id", "other", *CLASSES, "x", "y", "n")
    return sums_of(met, [there], [
        of_text, of_context,
        entry((before >= 0) & (q == 0), UNSEEN, row, before, y=m * log_p, n=m),
        entry(unseen & (c > 0), UNSEEN_RARE, row, key, n=m),
        entry(unseen & (F.col("after") < 0), RARE_WORD, row, rare_after, n=m),
        entry(F.col("asked") & follows & (n > 0), FOLLOWING, key, rare_after, m, [r], x=part * F.coalesce("p_after", F.lit(0.0)), y=F.when(F.col("after") < 0, part).otherwise(0.0), n=m),
    ], F.col("kind").isNull())


def found_in(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted keys those asked for are, and which are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(keys.searchsorted(asked), len(keys) - 1)
    return at, keys[at] == asked


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of every row of docs under a model learnt from the rows that `train` holds for.

    doc_id, n_tokens, n_known, train_tokens, base_score, score; logarithms to the base 10. A null or empty text is its
    end alone. Rows that repeat an id are learnt from and scored each for itself; further columns are ignored. Without
    training rows every token has the probability 1 of the one unknown word. docs is read several times and has to give
    the same rows in the same partitions each time, as a table does.
    """
    spark = docs.sparkSession
    small_batches(spark)
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    learnt = texts.where("train")

    words = shelve(counted(learnt, lambda: lambda hashes, counts: hashes.astype(np.int64)))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = total + ADDED * (distinct + 1)
    often = words.where(F.col("n") >= max(1, total / TABLE_SHARE)).orderBy(F.desc("n"), "key").toArrow()
    frequent, model_name = share(often.column("key").to_numpy().astype(np.uint64)), uuid.uuid4().hex
    often_counts, start = often.column("n").to_numpy(), len(often)
    log_p = np.log10((often_counts + ADDED) / whole)
    by_word = spark.createDataFrame(pa.table({"word": np.arange(start, dtype=np.int64), "p": (often_counts + ADDED) / whole, "log_p": log_p}))

    def places() -> Places:
        return places_of(model_name, frequent.value)

    def both_frequent():
        return lambda hashes, counts: pair_keys(*numbered(hashes, counts, places(), start))[1]

    # the sums of what is handed on are at most the true counts: no pair that isn't hot has twice the least count
    hot_pairs = counted(learnt, both_frequent, TABLE_SHARE).where(F.col("n") >= max(1, total / TABLE_SHARE)).select("key").orderBy("key")
    hot_keys = hot_pairs.toArrow().column("key").to_numpy()
    hot = share(hot_keys)

    sums = frequent_pairs(texts, places, hot, by_word, start).unionByName(rare_words(texts, places, by_word, start, whole))
    of_kind = lambda kind: sums.where(F.col("kind") == kind)
    found = of_kind(HOT).select("id", "n").toArrow()
    hot_counts = np.zeros(len(hot_keys), np.int64)
    hot_counts[hot_keys.searchsorted(found.column("id").to_numpy())] = found.column("n").to_numpy()

    # how many pairs have each count; m occurrences of pairs with the count r are m / r pairs
    met = of_kind(TEXT).where("other = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES)).first()
    weights = discounts({r: met[c] // r + int((hot_counts == r).sum()) for r, c in enumerate(CLASSES, 1)})
    log_reduced = [math.log10(d * r) for r, d in enumerate([*weights, 1.0], 1)]

    # frequent contexts and the start, at most TABLE_SHARE + 1 rows
    stats = of_kind(CONTEXT).groupBy("id").agg(*(F.sum(c).alias(c) for c in (*CLASSES[:K], "y"))).toArrow()
    at = stats.column("id").to_numpy()
    of_class, p = np.zeros((K, start + 1)), np.zeros(start + 1)
    for k in range(K):
        of_class[k, at] = stats.column(CLASSES[k]).to_numpy()
        np.add.at(of_class[k], hot_keys[hot_counts == k + 1] >> NUMBER_BITS, k + 1)
    p[at] = stats.column("y").to_numpy()
    np.add.at(p, hot_keys >> NUMBER_BITS, 10.0 ** log_p[hot_keys & ((1 << NUMBER_BITS) - 1)])
    ends = words.where(F.col("key") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = np.concatenate([often_counts, [ends]]).astype(float)
    freed = np.tensordot(1 - np.array(weights), of_class, 1)
    of = np.where(freed > 0, seen, seen + 1)
    left = np.where(freed > 0, freed, 1.0)
    known = p > 0
    log_of = np.where(known, np.log10(of), 0.0)
    log_backoff = np.where(known, np.log10(left / of / (1 - np.where(known, p, 0.0))), 0.0)
    model = share((log_p, log_of, np.log10(np.maximum(hot_counts, 1)) + np.where(hot_counts <= K, np.log10([1.0, *weights, 1.0])[np.minimum(hot_counts, K + 1)], 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (log_p, log_of, log_hot), hot_keys = model.value, hot.value
        for batch, rows, hashes, counts in walked(batches):
            word, context = numbered(hashes, counts, places(), start)
            starts, known = np.cumsum(counts) - counts, word < RARE
            base, value = np.zeros(len(word)), np.zeros(len(word))
            base[known] = log_p[word[known].astype(np.int64)]
            value[context < RARE] = -log_of[context[context < RARE].astype(np.int64)]
            both, keys = pair_keys(word, context)
            at, here = found_in(hot_keys, keys)
            value[np.flatnonzero(both)[here]] += log_hot[at[here]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), batch.column("doc_id"), pa.array(counts), pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(value, starts)),
                ],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    local = texts.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    classed = sum((F.col(c) * x for c, x in zip(CLASSES, log_reduced, strict=True)), F.lit(0.0))
    by_text = of_kind(TEXT).select(F.col("id").alias("row"), F.col("n").alias("n_known"), F.col("y").alias("base_score"), (F.col("x") + classed).alias("score"))

    contexts = spark.createDataFrame(pa.table({"other": np.arange(start + 1, dtype=np.int64), "more": log_of + log_backoff}))
    unseen = of_kind(UNSEEN).join(F.broadcast(contexts), "other").select(F.col("id").alias("row"), (F.col("n") * F.col("more") + F.col("y")).alias("score"))

    # rare words that are asked for, by a text or as a part of what follows a context
    p_word = (F.coalesce(F.col("count"), F.lit(0)) + ADDED) / whole
    asked = sums.where(F.col("kind").isin(RARE_WORD, FOLLOWING)).join(words.select(F.col("key").alias("other"), F.col("n").alias("count")), "other", "left").withColumn("p", p_word)
    backed = asked.where(F.col("kind") == RARE_WORD).select(F.col("id").alias("row"), (F.col("n") * F.log10("p")).alias("score"))
    follow = asked.where(F.col("kind") == FOLLOWING).groupBy("id").agg(*(F.sum(c).alias(c) for c in (*CLASSES[:K], "n")), F.sum(F.col("x") + F.col("y") * F.col("p")).alias("p"))
    spare = sum((F.col(c) * (1 - d) for c, d in zip(CLASSES, weights, strict=False)), F.lit(0.0))
    left, of = F.when(spare > 0, spare).otherwise(1.0), F.when(spare > 0, F.col("n")).otherwise(F.col("n") + 1)
    backoff = follow.select(F.col("id").alias("other"), F.log10(left / of / (1 - F.col("p"))).alias("more"))
    unseen_rare = of_kind(UNSEEN_RARE).join(backoff, "other").select(F.col("id").alias("row"), (F.col("n") * F.col("more")).alias("score"))

    every = local
    for part in (by_text, unseen, backed, unseen_rare):
        every = every.unionByName(part, allowMissingColumns=True)
    plus = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *plus).select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from rows whose crc32(doc_id as text)
    mod 10 isn't 0. A row without an id is neither learnt from nor held out."""
    found = score(docs, remainder(F.col("doc_id"), 10) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
