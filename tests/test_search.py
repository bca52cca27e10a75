"""A search over a user's own tables, and registers with missing parts."""

import json
from datetime import date

from pyspark.sql import functions as F

from bidloom.operators import search_index as S
from bidloom.operators.search import Search, lot_index
from bidloom.sources import registers

LOTS = [
    (1, date(2024, 1, 5), 100.0, "бумага офисная", "A", False, "c1"), (2, date(2024, 3, 5), 120.0, "бумага для принтера", "B", False, "c2"), (3, date(2024, 5, 5), 90.0, "картридж для принтера", "A", True, "c1"),
    (4, date(2024, 6, 5), 80.0, "ремонт кровли", "B", False, "c3"), (5, date(2025, 2, 1), 80.0, "бумага офисная", "A", False, "c9"), (6, date(2024, 2, 1), None, None, "A", None, None),
]
ITEMS = [(1, "бумага A4", "17.12.14.110"), (2, "бумага A4", "17.12.14.110"), (3, "картридж", "20.59.12.120"), (4, "работы", "43.91.19.000"), (5, "бумага A4", "17.12.14.110"), (6, None, None)]
BIDS = [(1, "i1", "78", True), (1, "i2", "78", False), (2, "i1", None, True), (3, "i3", "47", True), (4, "i4", "01", True), (5, "i5", "01", True), (6, "i6", None, True)]
CARDS = [(1, "бумага офисная", [("бумага", "17.12.14.110")], "c1", 100.0, "A"), (2, "картридж", [], "c7", None, None), (3, "", [], None, None, None)]


def tables(spark):
    return (
        spark.createDataFrame(CARDS, "query_id long, text string, spec array<struct<product_name:string,okpd2_code:string>>, customer_inn string, price double, platform string"),
        spark.createDataFrame(LOTS, "lot_id long, publish_date date, start_price double, subject string, platform string, is_smp boolean, customer_inn string"),
        spark.createDataFrame(ITEMS, "lot_id long, product_name string, okpd2_code string"), spark.createDataFrame(BIDS, "lot_id long, inn string, kpp string, is_winner boolean"),
    )


def test_search_over_own_tables(spark, tmp_path):
    cards, lots, items, bids = tables(spark)
    index = lot_index(lots, items, str(tmp_path), 1, 1.0)
    assert isinstance(index, S.Kept)
    kept = {r["query_id"]: r for r in Search(cards, lots, items, bids, "2025-01-01", index=index).responses().collect()}
    plain = {r["query_id"]: r for r in Search(cards, lots, items, bids, "2025-01-01", max_df=1.0).responses().collect()}
    assert set(kept) == {1, 2, 3} and kept[3]["suppliers"] is None and kept[3]["total_candidates"] == 0
    first = kept[1]["suppliers"][0]
    assert first["inn"] == "i1" and first["place"] == 1 and "i5" not in {s["inn"] for s in kept[1]["suppliers"]}  # later than the day
    assert first["evidence"][0]["lot_id"] == 1 and first["evidence"][0]["same_customer"]
    assert [c["code"] for c in kept[1]["okpd2"]] == ["17.12.14"]
    assert [s["inn"] for s in plain[1]["suppliers"]][:2] == ["i1", "i2"]


def test_own_lot_of_the_customer_comes_first(spark):
    """A supplier without similar lots whose bid for the card's customer was in the same class."""
    cards, lots, items, bids = tables(spark)
    lots = lots.unionByName(spark.createDataFrame([(7, date(2024, 4, 4), 5.0, "совсем иное", "A", False, "c1")], lots.schema))
    items = items.unionByName(spark.createDataFrame([(7, "прочее", "17.12.99")], items.schema))
    bids = bids.unionByName(spark.createDataFrame([(7, "i8", None, False), (7, "i4", None, True)], bids.schema))
    rows = {(r["query_id"], r["inn"]): r["evidence"] for r in Search(cards, lots, items, bids, "2025-01-01", max_df=1.0).evidence().collect()}
    assert [(e["lot_id"], e["is_winner"], e["similarity"]) for e in rows[1, "i8"]] == [(7, False, 0.0)] and rows[1, "i4"][0]["lot_id"] == 7


def test_responses_leave_out_nulls(spark):
    cards, lots, items, bids = tables(spark)
    rows = {r["query_id"]: json.loads(r["response"]) for r in Search(cards, lots, items, bids, "2025-01-01", max_df=1.0).response_json().collect()}
    assert "suppliers" not in rows[3] and rows[3]["total_candidates"] == 0 and rows[1]["suppliers"][0]["inn"] == "i1"


def test_registers(spark, tmp_path):
    spark.createDataFrame([("1", "a")], "inn string, name string").write.parquet(f"{tmp_path}/v=1")
    spark.createDataFrame([("2", "b", 7, True)], "inn string, name string, employees int, in_dataset boolean").write.parquet(f"{tmp_path}/v=2")
    rows = registers.registry_scan(spark, str(tmp_path), columns=("inn", "employees", "phone", "in_dataset"))
    assert sorted(map(tuple, rows.collect())) == [("1", None, None, False), ("2", 7, None, True)]
    assert "name" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    saved = spark.createDataFrame([('{"inn":"1","nptype":"IP","category":2,"cityname":"X"}',), ("no json",), (None,), ('{"name_ex":"n"}',)], "data string")
    assert [(r["inn"], r["kind"], r["msp_category"], r["city"], r["phone"], r["is_hitech"]) for r in registers.registry_records(saved).collect()] == [("1", "ИП", "малое", "X", None, False)]
    stripped = registers.without_nulls(spark.createDataFrame([("1", None, float("nan"), 0.5)], "inn string, a string, b double, c double")).first()
    assert json.loads(stripped["record"]) == {"c": 0.5}
    asked = spark.createDataFrame([("a", 1), ("b", 5), ("b", 2), ("c", 5), ("d", 9)], "inn string, wins int")
    seen = spark.createDataFrame([("d", None)], "inn string, data string")
    assert {r["inn"]: r["place"] for r in registers.to_fetch(asked, seen, F.col("wins")).collect()} == {"b": 1, "c": 2, "a": 3}
