import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bidloom.operators import retrieval as T
from bidloom.operators import search_index as S

SCHEMA = "id long, terms array<string>"


def texts(seed, n, start=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shares = [1 / (k + 1) for k in range(400)]
    return [(start + k, rng.choices(words, shares, k=rng.randint(0, 25))) for k in range(n)]


def queries(spark, seed, n=12):
    rng = random.Random(seed)
    rows = [(q, t) for q in range(n) for t in {f"w{int(400 * rng.random() ** 3)}" for _ in range(rng.randint(1, 8))}]
    return spark.createDataFrame(rows, "query_id long, term string")


def rows(df):
    return {(r["query_id"], r["place"]): (r["id"], r["sim"]) for r in df.collect()}


@pytest.mark.parametrize("k,max_df", [(1, 0.3), (10, 0.9), (300, 0.3), (5000, 0.9)])
def test_finds_what_a_full_join_finds(spark, tmp_path, k, max_df):
    docs, asked = spark.createDataFrame(texts(1, 1500), SCHEMA), queries(spark, 2)
    plain, kept = T.fit(docs, 2, max_df), S.created(docs, str(tmp_path), 2, max_df)
    vectors = T.query_vectors(asked, plain.idf)
    assert rows(S.similar(T.query_vectors(asked, kept.idf), kept, k)) == rows(T.similar(vectors, plain, k))


def test_filters_hold_before_the_threshold(spark, tmp_path):
    docs, asked = spark.createDataFrame(texts(3, 800), SCHEMA), queries(spark, 4)
    plain, kept = T.fit(docs, 2, 0.9), S.created(docs, str(tmp_path), 2, 0.9)
    vectors = T.query_vectors(asked, plain.idf)
    eligible = docs.filter("id % 3 = 0").select("id", (F.col("id") % 2).alias("side"))
    sides = asked.select("query_id").distinct().withColumn("wanted", F.col("query_id") % 2)
    barred = spark.createDataFrame([(q, d) for q in range(12) for d in range(0, 800, 6)], "query_id long, id long")
    for more in ({"eligible": eligible}, {"eligible": eligible, "asked": sides, "pair_filter": F.col("side") == F.col("wanted")}, {"eligible": eligible, "barred": barred}):
        assert rows(S.similar(vectors, kept, 15, **more)) == rows(T.similar(vectors, plain, 15, **more))


def test_fewer_postings_are_read(spark, tmp_path):
    docs, asked = spark.createDataFrame(texts(5, 4000), SCHEMA), queries(spark, 6)
    kept = S.created(docs, str(tmp_path), 2, 0.9)
    blocks = S.bounds(T.query_vectors(asked, kept.idf), kept, 10).blocks
    read, every = (df.agg(F.sum("size")).first()[0] for df in (blocks.filter("read"), blocks))
    assert read < 0.7 * every
    assert kept.blocks.agg(F.max("size")).first()[0] <= 3 * S.BLOCK  # what any task gets of a common term at a time
    hot = kept.terms.orderBy(F.desc("df")).first()
    assert kept.blocks.filter(F.col("term") == hot["term"]).count() >= hot["df"] / S.BLOCK


def test_an_added_day_equals_a_refit(spark, tmp_path):
    """The new documents make terms common, rare ones known and a very common one unknown."""
    first, second, third = texts(7, 600), [(d, [*t, "w5", "new"]) for d, t in texts(8, 500, 600)], texts(9, 40, 1100)
    kept = S.created(spark.createDataFrame(first, SCHEMA), str(tmp_path), 2, 0.4)
    for more in (second, third):
        kept = S.added(kept, spark.createDataFrame(more, SCHEMA))
    asked = queries(spark, 10).unionByName(spark.createDataFrame([(3, "new"), (4, "w5")], "query_id long, term string"))
    plain = T.fit(spark.createDataFrame(first + second + third, SCHEMA), 2, 0.4)
    want = T.query_vectors(asked, plain.idf)
    assert {r["term"]: (r["df"], r["idf"]) for r in kept.idf.collect()} == {r["term"]: (r["df"], r["idf"]) for r in plain.idf.collect()}
    for k in (5, 100):
        assert rows(S.similar(T.query_vectors(asked, kept.idf), kept, k)) == rows(T.similar(want, plain, k))
    assert rows(S.similar(T.query_vectors(asked, kept.idf), S.opened(spark, str(tmp_path)), 5)) == rows(T.similar(want, plain, 5))
    with pytest.raises(ValueError):
        S.added(kept, spark.createDataFrame(third[:1], SCHEMA))


def test_empty_index_and_unknown_words(spark, tmp_path):
    nothing = S.created(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert S.similar(T.query_vectors(queries(spark, 1), nothing.idf), nothing, 5).count() == 0
    kept = S.added(nothing, spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, []), (4, ["d"]), (5, ["e"]), (6, ["f"]), (7, None)], SCHEMA))
    asked = spark.createDataFrame([(1, "a"), (2, "nowhere")], "query_id long, term string")
    assert rows(S.similar(T.query_vectors(asked, kept.idf), kept, 5)) == {(1, 1): (1, 1.0), (1, 2): (2, 1.0)}


def test_copies_are_weighed_once_and_found_as_a_search_of_every_document_finds_them(spark):
    rng = random.Random(9)
    kinds = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))] for _ in range(30)]
    rows = [(i, rng.sample(kinds[i % 30], len(kinds[i % 30]))) for i in range(600)]
    index = T.fit(spark.createDataFrame(rows, "id long, terms array<string>"), 2, 0.9)
    assert index.weights.select("cls").distinct().count() <= len({tuple(sorted(k)) for k in kinds})
    held = defaultdict(dict)
    for r in index.postings.collect():
        held[r["id"]][r["term"]] = r["w"]
    vectors = [(q, t, w) for q in range(3) for t, w in zip(rng.sample("abcdefgh", 3), (0.8, 0.5, 0.33))]
    barred = {(q, i) for q in range(3) for i in range(0, 600, 7)}
    eligible = spark.createDataFrame([(i, i % 2) for i, _ in rows if i % 5], "id long, side long")
    found = T.similar(spark.createDataFrame(vectors, "query_id long, term string, w double"), index, 40, eligible, F.col("side") == F.col("own"), spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "query_id long, own long"), spark.createDataFrame(sorted(barred), "query_id long, id long"))
    for q in range(3):
        scores = {i: round(sum(w * held[i].get(t, 0) for x, t, w in vectors if x == q), 9) for i, _ in rows if i % 5 and i % 2 == (q == 1) and (q, i) not in barred}
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:40]
        assert [r["id"] for r in found.filter(F.col("query_id") == q).orderBy("place").collect()] == [i for _, i in best]
