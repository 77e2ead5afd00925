"""Language by string kernels.

Two texts are alike as far as the same character n-grams (n = 1, 2, 3) are present in both: the blended-spectrum
presence kernel k(x, y) = sum over n of |G_n(x) & G_n(y)| / sqrt(|G_n(x)| |G_n(y)|). Landmark texts of each language
give Nystroem features; one-versus-rest kernel ridge regression is solved in them on the driver, over a bounded sample
of labelled rows. As the kernel is linear in the presence vector, landmarks and coefficients fold into one matrix of
n-gram weights, and a batch of texts is scored by a product of its presence matrix with that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.llm.common import remainder, small_batches

#: Bounds of what the driver learns from: labelled rows and landmarks per language; rows that it weighs at once.
SAMPLE_PER_LANG, LANDMARKS_PER_LANG, WEIGHED_AT_ONCE = 200, 25, 512
RIDGE = 1e-2
UNKNOWN = "und"
#: A text of which landmarks know a smaller share of its distinct letters is in no learnt language.
LETTERS_KNOWN = 0.1
SCORED_AT_ONCE = 64
#: Bits of the places of 1-, 2- and 3-grams: a hash of their characters, so that few n-grams of any script share one.
BITS = (16, 20, 20)
#: Where the places of each n begin in one range of numbers.
BASE = (0, 1 << BITS[0], (1 << BITS[0]) + (1 << BITS[1]))
N_GRAMS = BASE[2] + (1 << BITS[2])
#: The place of the 1-gram that stands for whatever is no letter.
NO_LETTER = 0
#: Odd factors of a multiplicative hash, one for each character of an n-gram.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def letter_table() -> np.ndarray:
    """Which characters below U+10000 are letters."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def signs_of(text: str, letters: np.ndarray) -> np.ndarray | None:
    """The text as numbers of its lower-case letters, 0 for what is none; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letters[np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():
        letter[far] = [chr(c).isalpha() for c in codes[far]]
    return np.where(letter, codes, 0) if letter.any() else None


def present(signs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places of the distinct n-grams for each n, in order."""
    out = []
    mixed = np.zeros(len(signs), np.uint32)
    for n, factor in enumerate(FACTORS):
        mixed = (mixed[:-1] if n else mixed) + signs[n:].astype(np.uint32) * np.uint32(factor) if len(signs) > n else mixed[:0]
        places = np.sort(mixed >> np.uint32(32 - BITS[n]))
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1]
        out.append(places[new].astype(np.int64) + BASE[n])
    return tuple(out)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (n-grams of the landmarks, languages)
    column: np.ndarray  # row of weights of each n-gram, or -1


def learn(pairs: list[tuple[tuple[np.ndarray, ...], str]]) -> Model:
    """From n-grams and labels, in any order. Without any: a model that knows no language."""
    langs = sorted({y for _, y in pairs})
    if not langs:
        return Model([], np.zeros((0, 0), np.float32), np.full(N_GRAMS, -1, np.int32))
    marks: list[tuple] = []
    for lang in langs:
        marks += [p for p, y in pairs if y == lang][:LANDMARKS_PER_LANG]
    vocabulary = np.unique(np.concatenate([g for p in marks for g in p]))
    column = np.full(N_GRAMS, -1, np.int32)
    column[vocabulary] = np.arange(len(vocabulary))

    def features(rows: list[tuple]) -> np.ndarray:
        """Presence over the vocabulary, each n scaled to length one."""
        out = np.zeros((len(rows), len(vocabulary)), np.float32)
        for row, p in zip(out, rows, strict=True):
            for g in p:
                if len(g):
                    row[(c := column[g])[c >= 0]] = len(g) ** -0.5
        return out

    at_marks = features(marks)
    values, vectors = np.linalg.eigh((at_marks @ at_marks.T).astype(np.float64))
    use = values > 1e-6 * values[-1]
    whiten = vectors[:, use] / np.sqrt(values[use])
    square, product = RIDGE * len(pairs) * np.eye(whiten.shape[1]), np.zeros((whiten.shape[1], len(langs)))
    for start in range(0, len(pairs), WEIGHED_AT_ONCE):
        some = pairs[start : start + WEIGHED_AT_ONCE]
        x = (features([p for p, _ in some]) @ at_marks.T).astype(np.float64) @ whiten
        y = np.array([[1.0 if label == lang else -1.0 for lang in langs] for _, label in some])
        square += x.T @ x
        product += x.T @ y
    coefficients = np.linalg.solve(square, product)
    return Model(langs, (at_marks.T @ (whiten @ coefficients)).astype(np.float32), column)


def fit(docs: DataFrame, train: Column) -> Model:
    """From at most SAMPLE_PER_LANG rows of every language, which `train` holds for: those of the least hash of doc_id.

    n-grams are drawn from whole texts, where these lie; a text without a letter teaches nothing.
    """
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    key = F.xxhash64(F.col("doc_id").cast("long"))
    first = Window.partitionBy("lang").orderBy(key, "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE_PER_LANG)
    # one row for an id and a language, however often it's repeated
    rows = known.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            signs = [signs_of(t, letters) for t in batch.column("text").to_pylist()]
            grams = [None if s is None else np.concatenate(present(s)).astype(np.int32) for s in signs]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(grams, pa.list_(pa.int32()))], ["lang", "doc_id", "grams"])

    found = rows.select("lang", F.col("doc_id").cast("long"), "text").mapInArrow(run, "lang string, doc_id long, grams array<int>").where("grams IS NOT NULL").toArrow()
    labels, ids, grams = found.column("lang").to_pylist(), found.column("doc_id").to_pylist(), found.column("grams")
    pairs = []
    for i in sorted(range(len(labels)), key=lambda i: (labels[i], ids[i])):
        own = grams[i].values.to_numpy()
        pairs.append((tuple(np.split(own, own.searchsorted(BASE[1:]))), labels[i]))
    return learn(pairs)


def language_of(model: Model, text: str, spark: SparkSession) -> Column:
    """struct(lang_pred, score, letters_known) of a text column; the other columns of its rows never go to Python.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or the model knows no language. score is
    the greatest one-versus-rest value brought from [-1, 1] to [0, 1]; ties go to the first language by name.
    letters_known: the share of the text's distinct letters that landmarks hold, 1 where no language was learnt, and null
    for a text without a letter.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, letters = shared.value, letter_table()
        for batch in batches:
            texts = batch.to_pylist()
            langs, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for start in range(0, len(texts), SCORED_AT_ONCE):
                rows, where = np.zeros((SCORED_AT_ONCE, len(model.weights)), np.float32), []
                for i in range(start, min(start + SCORED_AT_ONCE, len(texts))):
                    if texts[i] and (signs := signs_of(texts[i], letters)) is not None:
                        grams = present(signs)
                        for g in grams:
                            if len(g):
                                rows[len(where), (c := model.column[g])[c >= 0]] = len(g) ** -0.5
                        where.append(i)
                        letters_here = grams[0][grams[0] != NO_LETTER]
                        shares[i] = float((model.column[letters_here] >= 0).mean()) if model.langs and len(letters_here) else 1.0
                if where and model.langs:
                    values = rows[: len(where)] @ model.weights
                    for i, best, value in zip(where, values.argmax(1), values.max(1), strict=True):
                        langs[i], scores[i] = model.langs[best], float(min(1.0, max(0.0, (value + 1) / 2)))
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "letters_known"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, score double, letters_known double")(F.col(text))


def fitted(docs: DataFrame) -> Model:
    """From the rows whose crc32(doc_id as text) mod 3 isn't 1."""
    return fit(docs, remainder(F.col("doc_id"), 3) != 1)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs: learnt from the rows whose crc32(doc_id as text) mod 3
    isn't 1. A row without an id is neither learnt from nor held out. Repeated rows each give a row, further columns
    are ignored, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    found = language_of(fitted(docs), "text", docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs that are in a learnt language; columns stay as they are.

    Texts without a letter, and null ones, go, and so do those of whose distinct letters the learnt landmarks know less
    than LETTERS_KNOWN: they are in a script of no learnt language. The score rejects nothing, for a text unlike all that was
    learnt scores about 0.5, and so do some labelled ones. Where no language was learnt every text with a letter stays.
    """
    small_batches(docs.sparkSession)
    found = language_of(fitted(docs), "text", docs.sparkSession)
    return docs.select(F.struct("*").alias("kept"), found["letters_known"].alias("known")).where(F.col("known") >= LETTERS_KNOWN).select("kept.*")
