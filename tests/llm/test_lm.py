"""The model against a slow one over dictionaries, and what every language model must hold."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(t):
    return [*[x.translate(LOWER) for x in WORD.findall(t or "")], "</s>"]


class Slow:
    def __init__(self, texts, least):
        triples = Counter()
        self.count = Counter()
        for t in texts:
            w = tokens(t)
            self.count.update(w)
            triples.update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
        pairs, words = Counter((v, w) for _, v, w in triples), Counter()
        words.update(w for _, w in pairs)
        self.least, self.triples, self.pairs, self.words = least, triples, pairs, words
        self.d3, self.d2, self.d1 = (lm.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)], n) for x, n in ((triples, least[1]), (pairs, least[0]), (words, 1)))
        self.after, self.total = defaultdict(list), defaultdict(list)
        for (v, _), c in pairs.items():
            self.after[v].append(c)
        for (u, v, _), c in triples.items():
            self.total[u, v].append(c)

    def mass(self, counts, d, least):
        return sum(d[min(c, 3)] if c >= least else c for c in counts) / sum(counts)

    def p(self, u, v, w):
        n = sum(self.words.values())
        p = 1 / (len(self.words) + 1)
        p = (self.words[w] - self.d1[min(self.words[w], 3)]) / n + p * self.mass(self.words.values(), self.d1, 1) if n else p
        for c, d, least, counts in ((self.pairs[v, w], self.d2, self.least[0], self.after[v]), (self.triples[u, v, w], self.d3, self.least[1], self.total[u, v])):
            if counts:
                p = (c - d[min(c, 3)] if c >= least else 0) / sum(counts) + self.mass(counts, d, least) * p
        return p


def made(n=120, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(40)]
    out = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 15, 40])]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*out, (1000, None), (None, "w1 w2 w1"), (None, None), (None, "x"), (2000, out[3][1]), (2000, out[3][1]), (2001, "wort " * 30_000), (2002, "é\x0bÉ é w1"), (2003, "  \n")]


@pytest.mark.parametrize("least, seed", [((2, 2), 4), ((1, 1), 5), ((1, 3), 6)])
def test_scores_equal_brute_force(spark, least, seed):
    rows = made(seed=seed)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    mark = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) != 1
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, shard int, kind string")
    got = lm.score(df, mark, least).collect()
    slow = Slow([t for d, t in rows if not held(d)], least)
    n, v, want = sum(slow.count.values()), len(slow.count), []
    for d, t in rows:
        w = tokens(t)
        s = sum(math.log10(slow.p(*x)) for x in zip(["<s>", "<s>", *w], ["<s>", *w], w))
        base = sum(math.log10((slow.count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((d, len(w), sum(slow.count[x] > 0 for x in w), n, base, s, 10 ** (-s / len(w))))
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[5])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5)


def test_probabilities_sum_to_one(spark):
    rows = [t for _, t in made(40)]
    model = lm.learn(spark.createDataFrame([(t,) for t in rows], "text string"))
    tables, words = lm.Tables(model), sorted({x for t in rows for x in tokens(t)} - {"</s>"})
    h = np.array([*[lm.Hashes()[w.encode()] for w in words], lm.END], np.uint64)
    for u, v in ((lm.BEGIN, lm.BEGIN), (int(h[0]), int(h[3])), (5, int(h[1])), (5, 6)):
        x = np.array([y for w in [*h.tolist(), 77] for y in (u, v, w)], np.uint64)
        p, _ = lm.probabilities(lm.Tokens(x, np.arange(2, len(x), 3), None), model, tables)
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()


def test_executors_can_fetch_the_tables(spark, monkeypatch):
    """As on a cluster whose shared folder is no mounted path."""
    df = spark.createDataFrame(made(30), "doc_id long, text string")
    want = sorted((r.n_tokens, round(r.score, 6)) for r in lm.score(df, F.lit(True)).collect())
    monkeypatch.setattr(lm, "urlparse", lambda url: type("Url", (), {"scheme": "hdfs", "path": url}))
    assert sorted((r.n_tokens, round(r.score, 6)) for r in lm.score(df, F.lit(True)).collect()) == want


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, F.lit(False)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == got[1].train_tokens == 0 and got[1].score == 0 and got[2].base_score == pytest.approx(0)


@pytest.mark.parametrize("least", [(2, 2), (1, 1)])
@pytest.mark.parametrize("rows", [
    [(1, "the cat sat on the mat")],
    [(k, " ".join(f"w{30 * k + j}" for j in range(30))) for k in range(5)],
    [(k, " ".join(f"w{(7 * k + j) % 200}" for j in range(200))) for k in range(20)],
    [(0, "x"), (None, None), (None, "x")],
    [(0, None)],
])
def test_small_tables(spark, rows, least):
    """Shards without a repeated trigram, and without any row."""
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), least).collect()
    slow = Slow([t for _, t in rows], least)
    want = [sum(math.log10(slow.p(*x)) for x in zip(["<s>", "<s>", *tokens(t)], ["<s>", *tokens(t)], tokens(t))) for _, t in rows]
    assert sorted(r.score for r in got) == pytest.approx(sorted(want), rel=1e-5)


def test_more_shards_than_files_may_be_open(tmp_path):
    import resource

    for s in range(300):
        for kind in (lm.PAIRS, lm.TRIPLES):
            lm.store(str(tmp_path), kind, s, lm.file_of(kind, np.array([s + 1], np.uint64), np.array([[s]])))
    model = lm.Model(0, 0, 0, None, None, None, 300, str(tmp_path), (), 1.0)
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 450, hard))
    try:
        tables = lm.Tables(model)
        for kind in (lm.PAIRS, lm.TRIPLES):
            assert [int(tables.shard(kind, s)[1][0]) for s in range(300)] == list(range(300))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_merged_parts_go_before_the_next(spark, monkeypatch):
    """What has become files doesn't stand as messages as well: before each merge one part fewer is there."""
    seen, publish = [], lm.publish

    def watched(rows, *rest):
        there = {(f.split("kind=")[1].split("/")[0], f.split("part=")[1].split("/")[0]) for f in rows.inputFiles()}
        seen.append(sum(kind in (str(lm.WORDS), str(lm.CONTEXTS)) for kind, _ in there))
        return publish(rows, *rest)

    monkeypatch.setattr(lm, "publish", watched)
    monkeypatch.setattr(lm, "released", lambda spark: None)
    texts = made(40)
    lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), shard_bytes=sum(len(t or "") for t in texts) // 12)
    assert seen == list(range(2 * lm.MERGES, 0, -1))


@pytest.mark.parametrize("shape", [(0,), (5,), (7, 3), (5, 0)])
def test_planes_are_undone(shape):
    x = np.random.default_rng(3).integers(0, 1 << 62, shape)
    assert np.array_equal(lm.unplaned(lm.planes(x), np.int64, *shape), x)


def test_messages_are_small():
    """Keys that lie 2^40 apart take five bytes of eight, and small counts little."""
    keys = np.cumsum(np.random.default_rng(5).integers(1, 1 << 40, 20_000).astype(np.uint64), dtype=np.uint64)
    row = lm.packed([(lm.CONTEXTS, 0, keys, np.ones((len(keys), 5), np.int64))])
    assert len(zlib.compress(row["keys"][0].as_py(), 1) + zlib.compress(row["sums"][0].as_py(), 1)) < 5.6 * len(keys)
    k, sums = lm.unpacked(lm.CONTEXTS, row["keys"][0].as_py(), row["sums"][0].as_py())
    assert np.array_equal(k, keys) and sums.shape == (len(keys), 5) and (sums == 1).all()
