"""Registered queries against their SQL in DuckDB, on the smallest tables, and properties of the ranked lists."""

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from conftest import SF

from bidloom import plans
from bidloom.operators import companies, evaluation, marts, ranking, retrieval
from bidloom.streaming.bids import bidders_by_window

#: Run here; the others of the same kind are checked by the driver's own comparison.
NAMES = [
    "lot_docs", "supplier_profile_asof", "supplier_okpd_code8_distinct", "okpd_sample_names", "supplier_top_class_share", "supplier_card_okpd", "supplier_relevant_lots", "balanced_lot_pool", "okved_mapping", "role_scores",
    "eval_hit_mrr", "price_fit", "inn_normalise", "price_normalise", "tfidf_topk", "lemma_class_prob", "okpd_intent_filtered", "code_prefix_expand", "candidate_features", "rnp_penalty", "confidence_level", "supplier_evidence", "newcomer_recall", "kept_index_topk", "okpd_predicted", "new_company_capped", "supplier_evidence_own", "extract_lots",
    "batch_grouping", "batch_problems", "batch_merge_outer", "lemma_freq", "factor_contributions", "reasons_text",
    "platform_similar_lots", "smp_candidates", "status_reasons", "code_labels", "registry_merge", "short_names", "cleaned_subjects", "text_intents", "plural_forms", "pasted_items", "stacked_uploads", "batch_capped", "hash_sample", "stratified_sample",
    "company_cards", "batch_summary", "batch_recommendations",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.execute(plans.ORACLES[name])
    heading = [d[0] for d in found.description]
    assert sorted(heading) == columns
    assert got == Counter(tuple(plain(r[heading.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_is_registered_once():
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_diversity_equals_a_walk(spark):
    rows = [(q, f"c{i:03d}", f"a{i % 3}", i % 4 == 0, float((i * 37 + q) % 100)) for q in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "query_id int, inn string, okved5 string, local boolean, pool_score double")
    got = {q: [r.inn for r in companies.diverse(df).filter(f"query_id = {q}").orderBy("place").collect()] for q in range(3)}
    for q in range(3):
        taken, by, far = [], Counter(), 0
        for _, inn, ok, local, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[1])):
            if len(taken) < 10 and by[ok] < 6 and (local or far < 4):
                taken.append(inn)
                by[ok] += 1
                far += not local
        assert got[q] == taken


def test_short_codes_are_absorbed_in_order(spark):
    rows = [(1, "10.11", 1.0, None), (1, "10.11.1", 2.0, None), (1, "10.11.12", 3.0, None), (1, "10.1", 5.0, None), (2, "20.20", 1.0, None)]
    got = retrieval.absorbed(spark.createDataFrame(rows, "query_id int, code8 string, votes double, matched_item string")).collect()
    assert {(r.query_id, r.code8, r.votes) for r in got} == {(1, "10.1", 5.0), (1, "10.11.12", 6.0), (2, "20.20", 1.0)}


def test_balanced_pick_prefers_new_classes(spark):
    pool = spark.createDataFrame([(i, "A", "goods", "one", "07" if i < 20 else "08") for i in range(22)], "lot_id long, platform string, kind string, size_band string, class_code string")
    got = marts.balanced_pick(pool).collect()
    assert len(got) == 3 and {r.class_code for r in got if r.place <= 2} == {"07", "08"}


def test_poisson_interval_is_that_of_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    hits = (rng.random(1000) < 0.3).astype(float)
    means = np.array([hits[rng.integers(0, 1000, 1000)].mean() for _ in range(3000)])
    df = spark.createDataFrame([(k, float(h), 2 * float(h)) for k, h in enumerate(hits)], "key long, value double, twice double")
    got = evaluation.interval(df, 2000, ("value", "twice")).first()
    assert abs(got.value_low - np.quantile(means, 0.025)) < 0.005 and abs(got.value_high - np.quantile(means, 0.975)) < 0.005
    assert got.twice_low == pytest.approx(2 * got.value_low) and got.twice_high == pytest.approx(2 * got.value_high)
    assert evaluation.replicates(df.limit(0)).count() == 0 and evaluation.interval(df.limit(0)).first().value_low is None
    assert evaluation.POISSON[0] == pytest.approx(math.exp(-1)) and evaluation.POISSON[-1] == pytest.approx(1, abs=1e-6)


def test_learned_weights(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] > 0.7).astype(int)}))
    weights = evaluation.learned_weights(df, "y", ["a", "b"])
    assert weights["a"] > 0.8 and sum(weights.values()) == pytest.approx(1, abs=1e-3)


def test_contributions_sum_to_the_score(spark):
    """The points sum to the score itself, whatever the query lacks and however sure it is."""
    full = {f"f_{k}": 0.1 + 0.08 * i for i, k in enumerate(ranking.V.WEIGHTS)} | {"inn": "1", "customer_inn": "5", "has_history": True, "price": 7.0, "platform": "x"}
    rows = [full | {"query_id": 1}, full | {"query_id": 2, "customer_inn": None, "price": None}, full | {"query_id": 3, "has_history": False, "platform": None}]
    schema = ", ".join(f"{k} {'double' if k.startswith('f_') or k == 'price' else 'boolean' if k == 'has_history' else 'long' if k == 'query_id' else 'string'}" for k in rows[0])
    confidence = spark.createDataFrame([(1, "high"), (2, "medium"), (3, "low")], "query_id long, level string")
    scored = ranking.scored(spark.createDataFrame([tuple(r.values()) for r in rows], schema), confidence)
    scores = {r.query_id: r.raw_score * 100 for r in scored.collect()}
    for r in ranking.contributions(scored).collect():
        assert sum(f.points for f in r.factors) == pytest.approx(scores[r.query_id], abs=1e-4) and [f.points for f in r.factors] == sorted((f.points for f in r.factors), reverse=True)


def test_statuses_say_why(spark):
    rows = spark.createDataFrame([("verified", 3, 4, 3, 0, 0), ("experienced", 3, 20, 3, 0, 0), ("experienced", 0, 0, 0, 0, 5), ("participant", 0, 2, 0, 0, 0), ("category", 0, 0, 0, 0, 0), ("approx", 3, 4, 3, 1, 0)], "status string, wins int, em_parts int, em_wins int, ais_wins int, code_wins int")
    got = [r.status_reason for r in ranking.status_reason(rows).collect()]
    assert "3 из 4" in got[0] and got[1].endswith("ниже 25%") and got[2].startswith("5 побед") and got[3].endswith(": 2") and "категор" in got[4] + "категор" and "точных совпадений" in got[5]


def test_parsed_queries_weigh_their_terms(spark):
    synonym = "matched:array<string>,phrase:array<string>,kind:string,weight:double,idfs:array<struct<lemma:string,idf:double>>"
    schema = f"query_id long, tokens array<string>, terms array<struct<lemma:string,weight:double,added:boolean>>, keywords array<struct<lemma:string,role:string,weight:double>>, synonyms array<struct<{synonym}>>"
    rows = [(1, ["бумага", "белая", "прочее"], [("бумага", 2.0, False), ("картон", 1.0, True), ("техника", 0.8, True), ("24", 0.5, False)], [("бумага", "head", 2.0)], [(["бумага"], ["техника"], "broader", 0.4, [("техника", 1.0)])]), (2, ["стул"], [], [], [])]
    idf = spark.createDataFrame([("бумага", 5, 1.0), ("белая", 5, 1.0)], "term string, df long, idf double")
    items, exclude = spark.createDataFrame([(1, "ручка"), (1, "бумага")], "query_id long, term string"), spark.createDataFrame([(1, "Картон ")], "query_id long, term string")
    df = spark.createDataFrame(rows, schema)
    got = {(r.query_id, r.term): r.weight for r in retrieval.weighted_terms(df, idf, items, exclude).collect()}
    assert got == {(1, "бумага"): 1.0, (1, "белая"): 0.5, (1, "ручка"): 0.7, (2, "стул"): 1.0}
    terms = spark.createDataFrame([(1, "бумага"), (1, "белая"), (2, "стул")], "query_id long, term string")
    assert {(r.query_id, r.term) for r in retrieval.keyword_core(df, terms).collect()} == {(1, "бумага"), (2, "стул")}


def test_codes_get_the_nearest_name(spark):
    shares = spark.createDataFrame([("17.12.14",), ("17.99.01",), ("33.1",), ("40",)], "code8 string")
    official, samples = spark.createDataFrame([("17.12.14", "бумага"), ("17", "изделия")], "code string, name string"), spark.createDataFrame([("33.1", "ремонт", 3), ("33.1", "x", 1), ("17.12.14", "y", 9)], "code8 string, name string, n long")
    assert {r.code8: r.name for r in retrieval.labelled(shares, official, samples).collect()} == {"17.12.14": "бумага", "17.99.01": "изделия", "33.1": "ремонт", "40": ""}
    told = spark.createDataFrame([("low", 3, []), ("medium", 20, ["a", "b"]), ("medium", 20, []), ("high", 50, [])], "level string, similar_lots long, unmatched array<string>")
    assert [m[:12] for m in (r.message for r in retrieval.confidence_message(told).collect())] == ["В истории за", "В похожих за", "Похожих заку", ""]


def test_enrichment_puts_warnings_first(spark):
    cards = spark.createDataFrame([("1", ["a"]), ("2", ["b"]), ("3", ["c"])], "inn string, reasons array<string>")
    registry = spark.createDataFrame([("1", "ЗАКРЫТОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО Х", "малое", "01|one;02", "78")], "inn string, name string, msp_category string, products string, region_code string")
    roster = spark.createDataFrame([("2", "ПУБЛИЧНОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО Y", None, False)], "inn string, name string, head string, is_active boolean")
    unfair = spark.createDataFrame([("1", True, True, "01.01.2020"), ("2", False, True, None)], "inn string, in_rnp boolean, was_in_rnp boolean, since string")
    got = {r.inn: r for r in companies.enriched(cards, registry, roster, unfair).collect()}
    assert got["1"].company_name == "ЗАО Х" and got["1"].reasons == ["Внимание: состоит в реестре недобросовестных поставщиков с 01.01.2020", "a"] and got["1"].size_class == "small"
    assert got["2"].company_name == "ПАО Y" and got["2"].reasons[0] == "b" and len(got["2"].reasons) == 2 and not got["2"].is_active
    assert got["3"].company_name == "ИНН 3" and got["3"].sources == []


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:1{m}:00", f"s{m % 2}", m % 3 == 0) for h in range(3) for m in range(6)]
    batch = spark.createDataFrame(rows, "t string, inn string, is_winner boolean").selectExpr("timestamp(t) AS ts", "inn", "is_winner")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = bidders_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, bidders_by_window(batch).collect()))
