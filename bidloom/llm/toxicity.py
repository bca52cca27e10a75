"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

The lexicon is learned: words and word beginnings whose log odds between toxic and clean labelled documents are high.
Text is folded first (lower case, homoglyphs to Latin letters, digits and signs that stand for letters to those letters).
Each word counts its heaviest entry once unless an exception phrase covers it. A logistic curve over the summed weight
and the weight per word gives the score; it is fitted on one half of the labelled rows with a lexicon from the other.

Labelled rows are a bounded sample (MOST_LABELLED, by hash of the id), so the join that finds them broadcasts a bounded
table and texts are never shuffled. The lexicon has at most MOST_ENTRIES entries.

Defined cases: null and empty texts have no hits and the lowest score; texts of any length are scanned whole; without
labels of both kinds a small built-in lexicon is used; labels that repeat count once, as toxic if any says so; an empty
table gives an empty result; other columns pass through untouched and are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table, tidy

MOST_LABELLED, MOST_ENTRIES, CALIBRATION = 200_000, 20_000, 20_000
#: Lengths of word beginnings that may become entries.
SHORTEST, LONGEST = 4, 12
#: An entry's log odds, less one standard error, must reach this; and it must stand in so many toxic documents.
LEAST_WEIGHT, LEAST_TOXIC = 2.0, 3
#: A document is rejected from this score on.
LIMIT = 0.7
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "pond scum")
#: Look-alike letters of other scripts, and digits and signs written for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁӏոտᴏαεορυιτκνο", "aeopcyxijsdlntoaeopuitkvo")
LEET = str.maketrans("013457@$!|", "oieastasil")
MIXED = re.compile(r"[^\W\d_][^\s]*[0-9@$!|][^\s]*[^\W\d_]|[0-9@$][^\W\d_]{2}[^\s]*")
WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Words of the folded text, framed and parted by single spaces."""
    text = text.lower().translate(HOMOGLYPHS) if not text.isascii() else text.lower()
    text = MIXED.sub(lambda m: m[0].translate(LEET), text)
    return f" {' '.join(WORDS.findall(text))} "


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each folded word, by half and label; flushed when many words are held."""
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held.values(), strict=True)) if held else [[]] * 4
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["word", "clean0", "toxic0", "clean1", "toxic1"])
        held.clear()
        return out

    for b in (part for whole in batches for part in slices(whole, 1000)):
        for text, slot in zip(b.column("text").to_pylist(), b.column("slot").to_pylist(), strict=True):
            for w in set(fold(text or "").split()):
                held.setdefault(w, [0, 0, 0, 0])[slot] += 1
        if len(held) > 400_000:
            yield flush()
    yield flush()


def labelled_documents(docs: DataFrame, labels: DataFrame, usable: Column, most: int) -> DataFrame:
    """text and slot (2 * half + toxic) of at most about `most` labelled documents."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = settle(marks.withColumn("hash", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("long")))
    if (n := marks.count()) > most:
        marks = marks.filter(F.col("hash") < int(most / n * (1 << 48)))
    slot = F.when(F.col("toxic") > 0, 1).otherwise(0) + 2 * F.pmod("hash", F.lit(2))
    return docs.select("doc_id", "text").join(F.broadcast(marks.select("doc_id", slot.cast("int").alias("slot"), "hash")), "doc_id")


def entries(words: DataFrame, clean: Column, toxic: Column, n_clean: int, n_toxic: int, most: int) -> list[tuple[str, float]]:
    """(entry, weight) by falling strength; an entry that ends in a space is a whole word, any other a beginning."""
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word") - 1, F.lit(LONGEST)))
    begun = F.when(F.length("word") > SHORTEST, F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    grouped = (
        words.select(clean.alias("c"), toxic.alias("t"), F.explode(F.concat(F.array(F.concat("word", F.lit(" "))), begun)).alias("entry"))
        .groupBy("entry").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).filter(F.col("t") >= LEAST_TOXIC)
    )
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1) * (n_clean + 1) / (F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = grouped.select("entry", weight.alias("weight"), (weight - error).alias("sure")).filter(F.col("sure") >= LEAST_WEIGHT).orderBy(F.desc("sure"), "entry").limit(most).collect()
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["entry"]), r["entry"])):  # a longer entry adds nothing to a beginning as heavy
        if all(kept.get(r["entry"][:k], -1e9) < r["weight"] - 0.25 for k in range(SHORTEST, len(r["entry"]))):
            kept[r["entry"]] = r["weight"]
    return sorted(kept.items())


def automaton(lexicon: list[tuple[str, float]], exceptions: tuple[str, ...] = EXCEPTIONS):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for entry, weight in lexicon:
        auto.add_word(" " + entry, (len(entry) + 1, weight))
    for phrase in exceptions:
        key = f" {phrase} "
        auto.add_word(key, (len(key), -1.0))
    auto.make_automaton()
    return auto


def weigh(auto, text: str | None) -> tuple[float, int]:
    """Summed weight of the words that the lexicon hits, and the number of words."""
    folded = fold(text or "")
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(auto):
        for end, (length, weight) in auto.iter(folded):
            at = end - length + 1
            if weight < 0:
                spared.append((at, end))
            elif best.get(at, 0.0) < weight:
                best[at] = weight
    for a, b in spared:
        for at in [x for x in best if a <= x < b]:
            del best[at]
    return sum(best.values()), folded.count(" ") - 1


def inputs(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with an L2 penalty, by Newton steps; slopes are kept from being negative."""
    if not len(y) or y.min() == y.max():
        return -3.0, 1.0, 1.0
    a = np.hstack([np.ones((len(y), 1)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.5, 0.5])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


class Model:
    """A lexicon with the curve that turns its weights into scores."""

    def __init__(self, lexicon: list[tuple[str, float]], bias: tuple[float, float, float]):
        self.lexicon, self.bias = lexicon, bias

    def scores(self, batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
        auto = automaton(self.lexicon)
        for b in (part for whole in batches for part in slices(whole, 1000)):
            x = np.array([inputs(*weigh(auto, t)) for t in b.column("text").to_pylist()]).reshape(-1, 2)
            z = self.bias[0] + x @ np.array(self.bias[1:])
            yield emit(b, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MOST_LABELLED) -> Model:
    """usable: which rows of labels may be learned from."""
    marked = labelled_documents(docs, labels, F.lit(True) if usable is None else usable, most)
    words = settle(
        marked.select("text", "slot").mapInArrow(tidy(_counted), "word string, clean0 long, toxic0 long, clean1 long, toxic1 long")
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean0", "toxic0", "clean1", "toxic1")])
    )
    n = Counter({r["slot"]: r["count"] for r in marked.groupBy("slot").count().collect()})
    n_clean, n_toxic = n[0] + n[2], n[1] + n[3]
    if not n_toxic or not n_clean:
        return Model([(f"{w} ", 6.0) for w in SEED], (-3.0, 1.0, 1.0))
    half = entries(words, F.col("clean0"), F.col("toxic0"), n[0], n[1], MOST_ENTRIES)
    whole = entries(words, F.col("clean0") + F.col("clean1"), F.col("toxic0") + F.col("toxic1"), n_clean, n_toxic, MOST_ENTRIES)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(half)
        for b in batches:
            x = np.array([inputs(*weigh(auto, t)) for t in b.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.array(b.column("slot").to_pylist(), float) - 2)], ["a", "b", "y"])

    other = marked.filter(F.col("slot") >= 2)
    if n[2] + n[3] > CALIBRATION:
        other = other.filter(F.pmod(F.shiftright("hash", 1), F.lit(1 << 20)) < int(CALIBRATION / (n[2] + n[3]) * (1 << 20)))
    got = np.array([tuple(r) for r in other.select("text", "slot").mapInArrow(tidy(measured), "a double, b double, y double").collect()]).reshape(-1, 3)
    return Model(whole, curve(got[:, :2], got[:, 2]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    emit = lambda b, s: pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(tidy(lambda it: shared.value.scores(it, emit)), f"doc_id {kind}, score double")


def clean_documents(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The documents whose score is below the limit, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(lambda it: shared.value.scores(it, lambda b, s: b.filter(pa.array(s < limit)))), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(3)) == 1
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
