"""Upload and word-count queries, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators import batch as B
from bidloom.operators import language as L
from bidloom.plans.mart_queries import with_
from bidloom.plans.search_queries import tokens
from bidloom.sources import standin as D

#: Words are cut to so many letters where a dictionary would give their lemma.
STEM = 5


def _upload(spark: SparkSession, d: str) -> DataFrame:
    """An upload with a row for each part: sizes are procedures, some names, codes and customers are missing or no good."""
    row = F.col("l_partkey")
    return D.parts(spark, d).select(
        row.cast("int").alias("row"), F.col("p_size").cast("string").alias("procedure_id"), F.when(row % 3 == 0, F.concat(F.lit("закупка "), F.col("p_size").cast("string"))).otherwise("").alias("procedure_name"), "product_name",
        F.when(row % 7 == 0, "x").otherwise(F.col("okpd2_code")).alias("okpd2_code"), F.concat(row.cast("string"), F.lit(",50")).alias("start_price"), F.when(row % 4 == 0, F.lpad(row.cast("string"), 10, "0")).otherwise("").alias("customer_inn"),
        F.when(row % 2 == 0, "ЭМ").otherwise("АИС ГЗ").alias("platform"), F.when(row % 5 == 0, "да").otherwise("нет").alias("is_smp"),
    )


def batch_grouping(spark: SparkSession, d: str) -> DataFrame:
    """The procurements of the upload: first name and customer given, price, platform and flag of the first row, bad codes blank."""
    procs, _ = B.procurements(_upload(spark, d))
    return procs.select("query_id", "procedure_id", "text", F.size("items").alias("n_items"), F.array_join("okpd_codes", ";").alias("codes"), "price", "customer_inn", "platform", "is_smp")


def batch_problems(spark: SparkSession, d: str) -> DataFrame:
    """What the upload's procurements are told: here, the codes that are none."""
    return B.procurements(_upload(spark, d))[1].select("row", "procedure_id", "problem")


def batch_merge_outer(spark: SparkSession, d: str) -> DataFrame:
    """Heads (lots of small business) and positions (items of the shop's lots) of two files, joined by lot."""
    lots = D.lots(spark, d)
    key = F.col("lot_id").cast("string").alias("lot_id")
    heads = lots.filter("is_smp").select(F.col("lot_id").cast("int").alias("row"), key, F.col("subject").alias("procedure_name"))
    shop = lots.filter(F.col("platform") == D.MARKET.shop).select("lot_id")
    positions = D.items(spark, d).join(shop, "lot_id").select(F.col("lot_id").cast("int").alias("row"), key, "product_name", "okpd2_code")
    return B.merged([heads, positions]).select("lot_id", "procedure_name", "product_name", "okpd2_code")


def lemma_freq(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of the distinct texts, rolled up by the beginnings of words that stand for lemmas here."""
    counts = L.vocabulary(D.read(spark, d, "documents").select("text"))
    return L.lemma_frequencies(counts, counts.filter(F.length("word") > STEM).select("word", F.substring("word", 1, STEM).alias("lemma")))


QUERIES = {f.__name__: f for f in (batch_grouping, batch_problems, batch_merge_outer, lemma_freq)}

_UPLOAD = """up AS (SELECT p_partkey AS row, CAST(p_size AS VARCHAR) AS procedure_id, CASE WHEN p_partkey % 3 = 0 THEN 'закупка ' || CAST(p_size AS VARCHAR) END AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE okpd2_code END AS code FROM parts)"""
ORACLES = {
    "batch_grouping": with_(_UPLOAD) + """ SELECT CAST(row_number() OVER (ORDER BY min(row)) AS INTEGER) AS query_id, procedure_id, coalesce(arg_min(name, row) FILTER (WHERE name IS NOT NULL), '') AS text, CAST(count(*) AS INTEGER) AS n_items,
      string_agg(code, ';' ORDER BY row) AS codes, min(row) + 0.5::DOUBLE AS price, lpad(CAST(min(row) FILTER (WHERE row % 4 = 0) AS VARCHAR), 10, '0') AS customer_inn, CASE WHEN min(row) % 2 = 0 THEN 'ЭМ' ELSE 'АИС ГЗ' END AS platform, min(row) % 5 = 0 AS is_smp
      FROM up GROUP BY procedure_id""",
    "batch_problems": with_(_UPLOAD) + """ SELECT CAST(min(row) AS INTEGER) AS row, procedure_id, 'некорректные коды ОКПД2 (' || array_to_string(list_slice(list('x') FILTER (WHERE code = ''), 1, 3), ', ') || ') — определим по названию' AS problem
      FROM up GROUP BY procedure_id HAVING count(*) FILTER (WHERE code = '') > 0""",
    "batch_merge_outer": with_("h AS (SELECT lot_id, subject FROM lots WHERE is_smp)", "b AS (SELECT i.* FROM items i JOIN lots l USING (lot_id) WHERE l.platform = 'ESHOP')")
      + " SELECT CAST(coalesce(h.lot_id, b.lot_id) AS VARCHAR) AS lot_id, coalesce(h.subject, '') AS procedure_name, coalesce(b.product_name, '') AS product_name, coalesce(b.okpd2_code, '') AS okpd2_code FROM h FULL JOIN b ON h.lot_id = b.lot_id",
    "lemma_freq": f"SELECT CASE WHEN length(token) > {STEM} THEN substr(token, 1, {STEM}) ELSE token END AS lemma, CAST(sum(n) AS BIGINT) AS n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM (SELECT DISTINCT text FROM documents)) WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 3) GROUP BY ALL",
}
