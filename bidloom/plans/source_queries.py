"""Queries over extracts: the stand-in tables written as separated text and read back, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.lineage import fresh_folder
from bidloom.plans.mart_queries import with_
from bidloom.plans.search_queries import _CONFIDENCE, _FEATURES, _RANKED, _SEARCH, _STATUS, Scene
from bidloom.sources import extracts as X
from bidloom.sources import registers as G
from bidloom.sources import standin as D
from bidloom.sources.split_csv import read_split
from bidloom.sources.standin import MARKET, REGISTRY_SQL


def _reread(df: DataFrame) -> DataFrame:
    """All columns as text, from quoted files that many tasks read."""
    path = fresh_folder(df.sparkSession)
    df.write.options(sep=";", quote='"', escape='"', header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_split(df.sparkSession, path, df.columns)


def extract_lots(spark: SparkSession, d: str) -> DataFrame:
    lots, none = D.lots(spark, d), F.lit("")
    raw = lots.select(
        "lot_id", F.col("lot_id").alias("procedure_id"), "publish_date", "start_price", F.concat(F.lit(" "), "subject", F.lit(" ")).alias("subject"), F.lit("-").alias("procedure_name"),
        F.col("platform").alias("is_eshop_or_aisgz"), "is_smp", "customer_inn", none.alias("customer_kpp"), none.alias("reqnum"),
    )
    return X.lots(_reread(raw), MARKET).select("lot_id", "publish_date", "start_price", "subject", "platform", "is_smp", "customer_inn", "reqnum")


def extract_items(spark: SparkSession, d: str) -> DataFrame:
    return X.items(_reread(D.items(spark, d)))


def extract_bids(spark: SparkSession, d: str) -> DataFrame:
    """Bids whose bidder has no valid number go: here those whose number ends in 3 lose a digit."""
    short = F.when(F.col("inn").endswith("3"), F.substring("inn", 1, 9)).otherwise(F.col("inn"))
    return X.bids(_reread(D.bids(spark, d).select("lot_id", short.alias("supplier_inn"), F.col("kpp").alias("supplier_kpp"), "is_winner")))


def split_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with line breaks and quotes, through quoted files."""
    docs = D.read(spark, d, "documents").select("doc_id", "lang", "text")
    return _reread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")


def registry_scan(spark: SparkSession, d: str) -> DataFrame:
    """Companies of two versions of the register, the older without activities and sizes."""
    rows, path = D.registry(spark, d), fresh_folder(spark)
    old = F.col("inn").cast("long") % 2 == 0
    rows.filter(old).select("inn", "name", "region_code").write.parquet(f"{path}/v=1")
    rows.filter(~old).select("inn", "name", "region_code", "okved_main", "msp_category", "employees", "phone", F.lit(True).alias("in_dataset")).write.parquet(f"{path}/v=2")
    return G.registry_scan(spark, path, columns=("inn", "name", "ogrn", "okved_main", "employees", "in_dataset"))


def registry_records(spark: SparkSession, d: str) -> DataFrame:
    """Saved look-ups of companies as registry rows, nulls left out of the record."""
    c = D.read(spark, d, "customer")
    key = F.col("c_custkey")
    record = F.struct(
        key.cast("string").alias("inn"), F.col("c_name").alias("name_ex"), F.when(key % 2 == 0, "IP").otherwise("UL").alias("nptype"), F.col("c_nationkey").cast("string").alias("regioncode"),
        F.when(key % 3 == 0, "г").alias("citytype"), F.when(key % 5 > 0, F.col("c_mktsegment")).alias("cityname"), (key % 4).cast("string").alias("category"), F.when(key % 7 > 0, (key % 100)).alias("od2_sschr"),
        (key % 2 == 0).alias("is_hitech"), F.when(key % 4 > 0, "2016-08-10T00:00:00").alias("dtregistry"),
    )
    rows = G.registry_records(c.select(F.to_json(record).alias("data")))
    return G.without_nulls(rows.select("inn", "name", "kind", "city", "msp_category", "employees", "is_hitech", "has_licenses", "msp_since"))


def lookups_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Bidders whose number was never looked up, those with most wins first."""
    bids = D.bids(spark, d)
    wins = bids.groupBy("inn").agg(F.count_if("is_winner").alias("wins"))
    return G.to_fetch(wins, wins.filter(F.col("inn").endswith("5")).select("inn"), F.col("wins"))


def supplier_key_figures(spark: SparkSession, d: str) -> DataFrame:
    """What stands above a list of suppliers: candidates, verified and flagged ones."""
    every = Scene(spark, d).ranked(None)
    totals = every.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    return G.key_figures(every.filter("place <= 20").withColumn("in_rnp", F.col("inn").endswith("7")), totals)


def suppliers_shown(spark: SparkSession, d: str) -> DataFrame:
    """The second page of five among the verified suppliers of each procurement."""
    ranked = Scene(spark, d).ranked().withColumn("role", F.col("status"))
    return G.shown(ranked, role="verified", most=5, page=1).select("query_id", "at", "inn")


QUERIES = {f.__name__: f for f in (extract_lots, extract_items, extract_bids, split_texts, registry_scan, registry_records, lookups_to_fetch, supplier_key_figures, suppliers_shown)}

ORACLES = {
    "extract_lots": with_() + " SELECT lot_id, publish_date, start_price, subject, platform, is_smp, customer_inn, CAST(NULL AS VARCHAR) AS reqnum FROM lots",
    "extract_items": with_() + " SELECT lot_id, trim(product_name) AS product_name, okpd2_code FROM items",
    "extract_bids": with_() + " SELECT lot_id, inn, kpp, is_winner FROM bids WHERE inn NOT LIKE '%3'",
    "registry_scan": with_(REGISTRY_SQL) + """ SELECT inn, name, CAST(NULL AS VARCHAR) AS ogrn, CASE WHEN CAST(inn AS BIGINT) % 2 = 1 THEN okved_main END AS okved_main, CASE WHEN CAST(inn AS BIGINT) % 2 = 1 THEN employees END AS employees, CAST(inn AS BIGINT) % 2 = 1 AS in_dataset FROM registry""",
    "registry_records": """SELECT CAST(c_custkey AS VARCHAR) AS inn, '{"name":"' || c_name || '","kind":"' || CASE WHEN c_custkey % 2 = 0 THEN 'ИП' ELSE 'ЮЛ' END || '"' || coalesce(',"city":"' || nullif(concat_ws(' ', CASE WHEN c_custkey % 3 = 0 THEN 'г' END, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END), '') || '"', '')
  || CASE c_custkey % 4 WHEN 1 THEN ',"msp_category":"микро"' WHEN 2 THEN ',"msp_category":"малое"' WHEN 3 THEN ',"msp_category":"среднее"' ELSE '' END || CASE WHEN c_custkey % 7 > 0 THEN ',"employees":' || c_custkey % 100 ELSE '' END
  || ',"is_hitech":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"has_licenses":false' || CASE WHEN c_custkey % 4 > 0 THEN ',"msp_since":"2016-08-10"' ELSE '' END || '}' AS record FROM customer""",
    "lookups_to_fetch": with_("w AS (SELECT inn, count(*) FILTER (WHERE is_winner) AS wins FROM bids GROUP BY inn)") + " SELECT inn, row_number() OVER (ORDER BY wins DESC, inn) AS place FROM w WHERE inn NOT LIKE '%5'",
    "supplier_key_figures": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + f" SELECT query_id, count(*) AS total_candidates, count(*) FILTER (WHERE place <= 20 AND {_STATUS} = 'verified') AS verified, count(*) FILTER (WHERE place <= 20 AND inn LIKE '%7') AS flagged, count(*) FILTER (WHERE place <= 20) AS listed FROM ranked GROUP BY query_id",
    "suppliers_shown": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + f" SELECT query_id, CAST(at_ AS INTEGER) AS at, inn FROM (SELECT query_id, inn, row_number() OVER (PARTITION BY query_id ORDER BY place) AS at_ FROM ranked WHERE place <= 20 AND {_STATUS} = 'verified') WHERE at_ BETWEEN 6 AND 10",
    "split_texts": "SELECT doc_id, lang, text FROM documents",
}
