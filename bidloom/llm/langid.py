"""Language identification: a byte convolutional network over fixed-length windows, trained in numpy on labelled text.

A text is lower-cased, read as UTF-8 bytes and cut into windows of WINDOW bytes; neighbouring windows share the bytes that
the widest filter needs, so every byte sequence of a text lies in one. A byte has a learned vector; filters of several
widths slide over them, each keeps its largest answer in a window (max pooling), and a softmax over those gives the
window's languages. A text's probabilities are the means over all its windows, weighted by their bytes: texts are read
whole. Nothing is shuffled for a prediction, and the model has a few thousand numbers.

Training. The network is fitted on the driver to a bounded sample: about SAMPLED labelled texts in all, shared evenly by
the languages and chosen by hash of the text (copies count once), of each at most FROM_EACH windows, evenly spaced. The
sample's size doesn't grow with the table. Part of the windows are cut short, so that short texts are known as well.

Defined cases: null texts and texts without a letter are `und` with score 0, as are all texts where no labelled text has a
letter; null labels teach nothing; ties go to the language that sorts first; repeated rows are predicted alike; texts of
any length are read whole; an empty table gives an empty result; only doc_id, text and, in training, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

WINDOW = 256
#: Filters of each width in bytes, and the size of a byte's vector.
WIDTHS, FILTERS, VECTOR = (2, 3, 4), 16, 8
WIDEST = max(WIDTHS)
#: Bounds of the training sample, the windows of a training step, how often the sample is passed, and the least number of steps.
SAMPLED, FROM_EACH, STEP, PASSES, LEAST_STEPS = 6_000, 3, 64, 5, 400
#: Windows that are evaluated at a time, and bytes of text that are cut into windows at a time.
BLOCK, HELD = 24, 1 << 20
UNKNOWN = "und"


class Network(NamedTuple):
    langs: tuple[str, ...]
    #: (256, VECTOR); (WIDEST * VECTOR, filters), zero below a filter's width; (filters,); (filters, languages); (languages,)
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    prior: np.ndarray


def windows_of(text: str) -> np.ndarray:
    """A text's windows as rows of bytes, the last one filled up with zeros; a text without bytes has one empty window."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    step = WINDOW - WIDEST + 1
    n = max(1, -(-(len(data) - WIDEST + 1) // step))
    out = np.zeros((n - 1) * step + WINDOW, np.uint8)
    out[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::step]


def unrolled(net: Network, x: np.ndarray) -> np.ndarray:
    """The vectors of the WIDEST bytes from each place of a window on: (windows, places, WIDEST * VECTOR)."""
    e = net.vectors[x].reshape(len(x), -1)
    return np.lib.stride_tricks.sliding_window_view(e, WIDEST * VECTOR, axis=1)[:, ::VECTOR]


def pooled(net: Network, rows: np.ndarray) -> np.ndarray:
    """Answers of all filters at all places."""
    n, places, width = rows.shape
    return (np.ascontiguousarray(rows).reshape(-1, width) @ net.filters).reshape(n, places, -1)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def languages(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities of the languages for each window. Places come first in the arrays, so that pooling runs over whole rows."""
    out, places = np.empty((len(x), len(net.langs)), np.float64), WINDOW - WIDEST + 1
    for k in range(0, len(x), BLOCK):
        e = net.vectors.take(x[k : k + BLOCK].T, axis=0)
        rows = np.concatenate([e[i : places + i] for i in range(WIDEST)], axis=2)
        top = (rows.reshape(-1, rows.shape[2]) @ net.filters).reshape(places, -1, net.filters.shape[1]).max(axis=0)
        out[k : k + BLOCK] = softmax(np.maximum(top + net.bias, 0) @ net.weights + net.prior)
    return out


def trained(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], seed: int = 7) -> Network:
    """Fits the network to windows x and the places y of their languages in langs, by Adam over shuffled steps."""
    rng = np.random.default_rng(seed)
    total, deep = FILTERS * len(WIDTHS), WIDEST * VECTOR
    used = np.concatenate([np.arange(deep)[:, None] < w * VECTOR for w in WIDTHS for _ in range(FILTERS)], axis=1)
    net = Network(langs, *(np.asarray(v, np.float32) for v in (rng.normal(0, 0.5, (256, VECTOR)), rng.normal(0, 0.25, (deep, total)) * used, np.zeros(total), rng.normal(0, 0.2, (total, len(langs))), np.zeros(len(langs)))))
    net.vectors[0] = 0
    held = net[1:]
    first, second, step = [np.zeros_like(v) for v in held], [np.zeros_like(v) for v in held], 0
    short = np.where(rng.random(len(x)) < 0.3, rng.integers(8, 64, len(x)), WINDOW)
    x = np.where(np.arange(WINDOW) < short[:, None], x, 0).astype(np.uint8)
    balance = len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1))
    passes = max(PASSES, LEAST_STEPS // -(-len(x) // STEP))
    for passed in range(passes):
        order = rng.permutation(len(x))
        for k in range(0, len(x), STEP):
            own = order[k : k + STEP]
            rows = unrolled(net, x[own])
            answers = pooled(net, rows)
            at = answers.argmax(axis=1)
            top = np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + net.bias
            live = np.maximum(top, 0)
            wrong = softmax(live @ net.weights + net.prior)
            wrong[np.arange(len(own)), y[own]] -= 1
            wrong *= balance[y[own]][:, None] / len(own)
            back = (wrong @ net.weights.T) * (top > 0)
            chosen = rows[np.arange(len(own))[:, None], at]  # (step, filters, deep): what each filter answered to
            to_bytes = np.zeros((256, VECTOR))
            parts = (back[:, :, None] * net.filters.T).reshape(-1, WIDEST, VECTOR)
            whose = x[own][np.arange(len(own))[:, None, None], at[:, :, None] + np.arange(WIDEST)].reshape(-1)
            for d in range(VECTOR):
                to_bytes[:, d] = np.bincount(whose, parts[:, :, d].reshape(-1), 256)
            to_bytes[0] = 0
            slopes = (to_bytes, np.einsum("nf,nfd->df", back, chosen) * used, back.sum(0), live.T @ wrong + 1e-4 * net.weights, wrong.sum(0))
            step += 1
            rate = 0.01 * (1 - passed / passes) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for v, g, a, b in zip(held, slopes, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def lettered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def learn(docs: DataFrame, sampled: int = SAMPLED) -> Network | None:
    """docs: text, lang. Fits the network to about `sampled` texts; None where no labelled text has a letter."""
    rows = lettered(docs.select("text", "lang").filter("lang is not null")).filter("__letter").select("text", "lang", F.xxhash64("text").alias("hash"))
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not texts:
        return None
    langs = tuple(sorted(texts, key=lambda v: v.encode()))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, sampled / len(langs) / max(texts[k], 1)))])[F.col("lang")]
    few = rows.filter(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)).groupBy("lang", "hash").agg(F.min("text").alias("text")).orderBy("hash", "lang").limit(2 * sampled)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, data = [], []
            for v, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = windows_of(text)
                for k in sorted({int(i) for i in np.linspace(0, len(w) - 1, FROM_EACH)}):
                    lang.append(v)
                    data.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(data, pa.binary())], ["lang", "window"])

    windows = sorted((r["window"], langs.index(r["lang"])) for r in few.mapInArrow(cut, "lang string, window binary").collect())
    return trained(np.frombuffer(b"".join(bytes(w) for w, _ in windows), np.uint8).reshape(-1, WINDOW), np.array([y for _, y in windows]), langs)


def predicted(net: Network, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, some bytes of windows at a time."""
    sums, weight = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    held, whose, size = [], [], 0

    def flush() -> None:
        x, who = np.concatenate(held), np.repeat(whose, [len(w) for w in held])
        bytes_in = np.maximum((x != 0).sum(axis=1), 1).astype(np.float64)
        p = languages(net, x) * bytes_in[:, None]
        for k in range(p.shape[1]):
            sums[:, k] += np.bincount(who, p[:, k], len(texts))
        weight[:] += np.bincount(who, bytes_in, len(texts))
        held.clear(), whose.clear()

    for k, t in enumerate(texts):
        w = windows_of(t)
        for start in range(0, len(w), HELD // WINDOW):
            held.append(w[start : start + HELD // WINDOW])
            whose.append(k)
            size += held[-1].size
            if size >= HELD:
                flush()
                size = 0
    if held:
        flush()
    share = sums / np.maximum(weight, 1)[:, None]
    best = share.argmax(axis=1) if len(texts) else np.zeros(0, int)
    return [net.langs[k] for k in best], np.clip(share[np.arange(len(texts)), best], 0, 1)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score: one row per document."""
    docs = lettered(docs.select("doc_id", "text"))
    if net is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            can = np.flatnonzero(b.column("__letter").to_numpy(zero_copy_only=False))
            langs, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            found, p = predicted(shared.value, b.column("text").take(pa.array(can)).to_pylist())
            for k, v in zip(can, found, strict=True):
                langs[k] = v
            scores[can] = p
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    net = learn(docs.filter(~held_out))
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
