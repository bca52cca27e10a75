import random
import re
import zlib
from collections import Counter

import pytest

from bidloom.llm import variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def slow(counts, ratio=5):
    """All pairs of words compared; by deletions of one letter where there are many."""
    holes = {}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    out, forms = {}, {}
    for w, n in counts.items():
        others = set().union(*(holes[w[:k], w[k + 1 :]] for k in range(len(w)))) - {w} if w else set()
        others |= {w[:k] + w[k + 1 :] for k in range(len(w))} & counts.keys() - {w}
        others |= set().union(*(holes.get((w[:k], w[k:]), set()) for k in range(len(w) + 1)))
        assert all(one_edit(w, o) for o in others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(others), forms[w], counts[forms[w]] if forms[w] is not None else None)
    roots = {}
    for w in counts:
        r = w
        while forms[r] is not None:
            r = forms[r]
        roots[w] = r
    return {w: (*v, roots[w]) for w, v in out.items()}


def fast(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)


def test_slow_version_compares_all_pairs():
    rng = random.Random(1)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): 1 for _ in range(40)}
    assert {w: v[1] for w, v in slow(counts).items()} == {w: sum(one_edit(w, o) for o in counts) for w in counts}


@pytest.mark.parametrize("letters,longest", [("ab", 7), ("abcé×", 5), ("a", 30), ("abcdefghijklmnopqrstuvwxyzß÷ÿ", 3)])
def test_equals_brute_force(spark, letters, longest):
    rng = random.Random(longest)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice([5, 5, 6, 25, 30, 150, 800, 4000]) for _ in range(400)}
    assert fast(variants.variants(table(spark, counts))) == slow(counts)


def test_small_nodes_are_joined_alike(spark, monkeypatch):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))): rng.choice([5, 30, 200]) for _ in range(300)}
    monkeypatch.setattr(variants, "TOP_SHARE", 30)
    assert fast(variants.variants(table(spark, counts))) == slow(counts)


def test_long_words_and_chains(spark):
    counts = {"a" * 30_000: 5, "a" * 29_999: 30, "a" * 15_000 + "b" + "a" * 14_999: 200, "ab" * 10: 7}
    counts |= {"chain" + "x" * k: 5 * 5**k for k in range(9)}
    assert fast(variants.variants(table(spark, counts))) == slow(counts)
    assert fast(variants.variants(table(spark, {"a": 5}).limit(0))) == {}
    assert fast(variants.variants(table(spark, {"word": 5}))) == {"word": (5, 0, None, None, "word")}


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else "".join(c for k, c in enumerate(run) if k != h % len(run))] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_counts_of_runs(spark):
    rng = random.Random(9)
    docs = [(k if k % 9 else None, " ".join(rng.choice(["Wordone", "wordtwo", "ÉTRANGE", "étrange", "a×b÷cdef", "short", "x-yzabcdef9qwertz"]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs += [(1, None), (2, ""), (3, "longer" * 5000), (3, "longer" * 5000)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word", "3 AS id", "4 AS node")
    assert {r["word"]: r["n"] for r in variants.counted(df, variants.slip).collect()} == words_of(docs)
    plain = Counter(r for _, t in docs for r in re.findall("[a-zÀ-ÿ]{6,}", "".join(c.lower() if c.isascii() else c for c in t or "")))
    assert {r["word"]: r["n"] for r in variants.counted(df).collect()} == {w: n for w, n in plain.items() if n >= 5}
    assert variants.counted(df.limit(0), variants.slip).count() == 0


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert fast(variants.op13_spelling_variants(spark, SF)) == slow(words_of(docs))
