import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from bidloom.llm import langid

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def slow(net, text):
    """Mean probabilities over windows, with loops over places, filters and bytes."""
    data = text.lower().encode()
    step = langid.WINDOW - langid.WIDEST + 1
    total, weight, start = np.zeros(len(net.langs)), 0, 0
    while True:
        w = data[start : start + langid.WINDOW]
        size, w = max(1, len(w)), w + bytes(langid.WINDOW - len(w))
        answers = []
        for f in range(net.filters.shape[1]):
            wide = langid.WIDTHS[f // langid.FILTERS]
            answers.append(max(sum(float(net.vectors[w[i + k]] @ net.filters[k * langid.VECTOR : (k + 1) * langid.VECTOR, f]) for k in range(wide)) for i in range(step)))
        z = np.maximum(np.array(answers) + net.bias, 0) @ net.weights + net.prior
        p = np.exp(z - z.max())
        total, weight = total + size * p / p.sum(), weight + size
        start += step
        if start + langid.WIDEST - 1 >= len(data):
            return total / weight


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(
        [(k, f"{a} {b} {'xyz'[k % 3]}", lang) for k, (a, b, lang) in enumerate([("the one and", "only of them", "en"), ("der eine und", "nur von denen", "de")] * 30)]
        + [(100, None, "en"), (101, "", "de"), (102, "12 34!", "en"), (103, "no label", None)], SCHEMA,
    )
    return langid.learn(docs), docs


def test_network_equals_loops_over_places(found):
    net, _ = found
    texts = ["the", "Der EINE", "und " * 200, "a" * langid.WINDOW, "ab" * (langid.WINDOW // 2) + "c", "ÄÖ ß" * 70]
    langs, scores = langid.predicted(net, texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        p = slow(net, text)
        assert net.langs[int(p.argmax())] == lang
        assert abs(p.max() - score) < 1e-4


def test_blocks_do_not_change_a_prediction(found, monkeypatch):
    net, _ = found
    texts = ["the one " * 400, "", "der " * 90, "x"]
    before = langid.predicted(net, texts)
    monkeypatch.setattr(langid, "HELD", 2 * langid.WINDOW)
    monkeypatch.setattr(langid, "BLOCK", 3)
    after = langid.predicted(net, texts)
    assert before[0] == after[0] and np.allclose(before[1], after[1], atol=1e-6)


def test_filters_keep_their_width(found):
    net, _ = found
    for f in range(net.filters.shape[1]):
        wide = langid.WIDTHS[f // langid.FILTERS]
        assert not net.filters[wide * langid.VECTOR :, f].any()
    assert not net.vectors[0].any()


def test_defined_cases(spark, found):
    net, docs = found
    more = docs.unionByName(spark.createDataFrame([(None, "the one", None), (7, "the one", "de"), (7, "the one", "de")], SCHEMA)).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS window", "4 AS hash")
    rows = langid.predict(more, net).collect()
    assert len(rows) == 67 and set(rows[0].asDict()) == {"doc_id", "lang_pred", "score"}
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and by_id[100]["score"] == 0
    assert by_id[None]["lang_pred"] == "en"
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 7 and r["lang_pred"] == "en"}) <= 2
    assert all(0 <= r["score"] <= 1 for r in rows)
    labelled = [r for r in docs.collect() if r["doc_id"] < 100]
    assert all(by_id[r["doc_id"]]["lang_pred"] == r["lang"] for r in labelled if r["doc_id"] != 7)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, "12", "en")], SCHEMA)
    assert langid.learn(docs) is None and langid.learn(docs.limit(0)) is None
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(docs, None).collect()] == [("und", 0.0)] * 2
    one = langid.learn(spark.createDataFrame([(1, "text", "en"), (1, "text", "en")], SCHEMA))
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(docs, one).collect()] == [("en", 1.0), ("und", 0.0)]
    assert langid.predict(docs.limit(0), one).count() == 0


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in langid.op11_language_id(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(rows) == len(docs)
    assert all(rows[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if rows[d["doc_id"]]["held_out"] and d["lang"]]
    right = sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right / len(held) > 0.98
