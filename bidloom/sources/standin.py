"""Lots, items, bids and registry rows read off the star-schema tables, so that every operator runs on them.

orders are lots, line items the items and bids, suppliers the bidders, customers the registry. Codes are hierarchical:
size, type, brand group, brand; one part in twenty has its code cut to five characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators.marts import Market

MARKET = Market(shop="ESHOP", tender="GZ", home="01", near="02")
CUTOFF = "2000-01-01"
KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("lot_id"), F.to_date("o_orderdate").alias("publish_date"), F.col("o_totalprice").alias("start_price"), F.concat(F.lit("order "), F.col("o_orderpriority")).alias("subject"),
        F.when(F.col("o_orderstatus") == "F", MARKET.shop).otherwise(MARKET.tender).alias("platform"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_smp"), F.col("o_custkey").cast("string").alias("customer_inn"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    kind = F.coalesce(*[F.when(F.col("p_type").startswith(k), f"{n:02d}") for n, k in enumerate(KINDS, 1)], F.lit("06"))
    code = F.concat_ws(".", F.lpad(F.col("p_size").cast("string"), 2, "0"), kind, F.lpad((brand % 5).cast("string"), 2, "0"), F.lpad(brand.cast("string"), 3, "0"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("product_name"), F.when(F.col("p_partkey") % 20 == 0, F.substring(code, 1, 5)).otherwise(code).alias("okpd2_code"), F.col("p_size"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lot_id"), "l_partkey").join(parts(spark, sf_dir), "l_partkey").select("lot_id", "product_name", "okpd2_code")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's nation, as two digits and more, stands for its tax office code."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("kpp"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lot_id"), "l_suppkey", (F.col("l_returnflag") == "A").alias("is_winner")).join(suppliers, "l_suppkey").select("lot_id", F.lpad(F.col("l_suppkey").cast("string"), 10, "0").alias("inn"), "kpp", "is_winner")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of the registry: a customer each; the first hundredth of the suppliers' numbers are among them."""
    key, n = F.col("c_custkey"), F.col("c_custkey") % 50 + 1
    return read(spark, sf_dir, "customer").select(
        F.lpad(key.cast("string"), 10, "0").alias("inn"), F.col("c_name").alias("name"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("region_code"),
        F.concat_ws(".", F.lpad(n.cast("string"), 2, "0"), F.lpad((key % 6 + 1).cast("string"), 2, "0")).alias("okved_main"),
        F.concat_ws(";", F.concat_ws(".", F.lpad(((key + 7) % 50 + 1).cast("string"), 2, "0"), F.lpad(((key + 1) % 6 + 1).cast("string"), 2, "0")), F.concat_ws(".", F.lpad(((key + 13) % 50 + 1).cast("string"), 2, "0"), F.lit("03"))).alias("okved_extra"),
        F.greatest(F.floor("c_acctbal").cast("int"), F.lit(0)).alias("employees"), F.when(key % 3 == 0, "01.01|own;02.02|more").alias("products"),
        F.element_at(F.array(F.lit("микро"), F.lit("малое"), F.lit("среднее")), (key % 3 + 1).cast("int")).alias("msp_category"), F.when(key % 4 != 0, F.concat(F.lit("10.08."), (2016 + key % 10).cast("string"))).alias("msp_since"),
        F.when(key % 5 == 0, F.concat(F.lit("+7"), key.cast("string"))).alias("phone"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One procurement a nation: its first customer, the mean price of its orders, and as items the parts of one size."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("query_id")).agg(F.min("o_custkey").cast("string").alias("customer_inn"), F.round(F.avg("o_totalprice"), 2).alias("price"))
    held = parts(spark, sf_dir).groupBy((F.col("p_size") - 1).alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("product_name", "okpd2_code"))).alias("spec"))
    return buyers.join(held, "query_id").select("query_id", F.concat(F.lit("order "), F.array_join(F.slice(F.array_distinct(F.col("spec.product_name")), 1, 2), " ")).alias("text"), "spec", "customer_inn", "price", F.when(F.col("query_id") % 2 == 0, MARKET.shop).otherwise(MARKET.tender).alias("platform"))


#: The same tables as common table expressions of SQL.
SQL = """
lots AS (SELECT o_orderkey AS lot_id, CAST(o_orderdate AS DATE) AS publish_date, o_totalprice AS start_price, 'order ' || o_orderpriority AS subject,
  CASE WHEN o_orderstatus = 'F' THEN 'ESHOP' ELSE 'GZ' END AS platform, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_smp, CAST(o_custkey AS VARCHAR) AS customer_inn FROM orders),
part0 AS (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS b FROM part),
part1 AS (SELECT *, lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CASE WHEN p_type LIKE 'ECONOMY%' THEN '01' WHEN p_type LIKE 'LARGE%' THEN '02' WHEN p_type LIKE 'MEDIUM%' THEN '03'
  WHEN p_type LIKE 'PROMO%' THEN '04' WHEN p_type LIKE 'SMALL%' THEN '05' ELSE '06' END || '.' || lpad(CAST(b % 5 AS VARCHAR), 2, '0') || '.' || lpad(CAST(b AS VARCHAR), 3, '0') AS code FROM part0),
parts AS (SELECT p_partkey, p_size, p_name AS product_name, CASE WHEN p_partkey % 20 = 0 THEN substr(code, 1, 5) ELSE code END AS okpd2_code FROM part1),
items AS (SELECT l_orderkey AS lot_id, product_name, okpd2_code FROM lineitem JOIN parts ON l_partkey = p_partkey),
bids AS (SELECT l_orderkey AS lot_id, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS inn, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS kpp, l_returnflag = 'A' AS is_winner FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

REGISTRY_SQL = """
registry AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS inn, c_name AS name, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS region_code,
  lpad(CAST(c_custkey % 50 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c_custkey % 6 + 1 AS VARCHAR), 2, '0') AS okved_main,
  lpad(CAST((c_custkey + 7) % 50 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST((c_custkey + 1) % 6 + 1 AS VARCHAR), 2, '0') || ';' || lpad(CAST((c_custkey + 13) % 50 + 1 AS VARCHAR), 2, '0') || '.03' AS okved_extra,
  greatest(CAST(floor(c_acctbal) AS INTEGER), 0) AS employees, CASE WHEN c_custkey % 3 = 0 THEN '01.01|own;02.02|more' END AS products,
  CASE c_custkey % 3 WHEN 0 THEN 'микро' WHEN 1 THEN 'малое' ELSE 'среднее' END AS msp_category,
  CASE WHEN c_custkey % 4 <> 0 THEN '10.08.' || CAST(2016 + c_custkey % 10 AS VARCHAR) END AS msp_since, CASE WHEN c_custkey % 5 = 0 THEN '+7' || CAST(c_custkey AS VARCHAR) END AS phone FROM customer)"""

CARDS_SQL = """
buyers AS (SELECT c_nationkey AS query_id, CAST(min(o_custkey) AS VARCHAR) AS customer_inn, round(avg(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
spec AS (SELECT p_size - 1 AS query_id, product_name, okpd2_code FROM parts),
card_text AS (SELECT query_id, 'order ' || array_to_string(list_slice(list_sort(list(DISTINCT product_name)), 1, 2), ' ') AS text FROM spec GROUP BY query_id),
cards AS (SELECT query_id, text, customer_inn, price, CASE WHEN query_id % 2 = 0 THEN 'ESHOP' ELSE 'GZ' END AS platform FROM buyers JOIN card_text USING (query_id))"""
