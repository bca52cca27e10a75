"""Queries over the marts, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import scalars as S
from bidloom.operators import companies as C
from bidloom.operators import evaluation as E
from bidloom.operators import marts as M
from bidloom.sources import standin as D
from bidloom.sources.standin import CUTOFF, MARKET, REGISTRY_SQL, SQL

PREFIXES = ["07.03", "12.01.02"]


def with_(*ctes: str) -> str:
    return "WITH " + ",".join([SQL, *ctes])


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return D.lots(spark, d), D.items(spark, d), D.bids(spark, d)


def lots_projection(spark: SparkSession, d: str) -> DataFrame:
    return D.lots(spark, d)


def items_projection(spark: SparkSession, d: str) -> DataFrame:
    return D.items(spark, d).select("lot_id", F.trim("product_name").alias("product_name"), "okpd2_code")


def participations_filtered(spark: SparkSession, d: str) -> DataFrame:
    return D.bids(spark, d).filter(F.length("inn").isin(10, 12)).select("lot_id", "inn", F.nullif("kpp", F.lit("")).alias("kpp"), "is_winner")


def lot_docs(spark: SparkSession, d: str) -> DataFrame:
    lots, items, _ = _three(spark, d)
    return M.lot_docs(lots, items).select("lot_id", "subject", "items", F.array_join("okpd2_codes", ",").alias("okpd2_codes"))


def supplier_profile(spark: SparkSession, d: str, cutoff: str | None = None) -> DataFrame:
    lots, _, bids = _three(spark, d)
    return M.supplier_profile(bids, lots, cutoff, MARKET).withColumn("sum_won", F.round("sum_won", 2))


def supplier_profile_asof(spark: SparkSession, d: str) -> DataFrame:
    return supplier_profile(spark, d, CUTOFF).drop("first_date", "sum_won")


def _profile_sql(where: str, columns: str) -> str:
    return with_(
        f"p AS (SELECT bids.*, publish_date, start_price, platform, customer_inn FROM bids JOIN lots USING (lot_id) {where})",
        "k AS (SELECT inn, kpp, row_number() OVER (PARTITION BY inn ORDER BY count(*) DESC, kpp) AS rn FROM p WHERE kpp IS NOT NULL GROUP BY inn, kpp)",
        """a AS (SELECT inn, count(DISTINCT lot_id) AS n_lots, count(DISTINCT lot_id) FILTER (WHERE is_winner) AS n_wins, count(DISTINCT customer_inn) AS n_customers,
  count(DISTINCT lot_id) FILTER (WHERE platform = 'ESHOP') AS n_eshop, count(DISTINCT lot_id) FILTER (WHERE platform = 'GZ') AS n_aisgz, count(DISTINCT lot_id) FILTER (WHERE platform = 'ESHOP' AND is_winner) AS n_eshop_wins,
  min(publish_date) AS first_date, max(publish_date) AS last_date, round(sum(start_price) FILTER (WHERE is_winner), 2) AS sum_won, median(start_price) AS median_price FROM p GROUP BY inn)""",
        """f AS (SELECT a.*, kpp, CASE WHEN length(inn) = 12 THEN 'ИП' ELSE 'ЮЛ' END AS entity_type,
  CASE WHEN length(inn) = 12 THEN substr(inn, 1, 2) WHEN kpp IS NOT NULL AND substr(kpp, 1, 2) <> '00' THEN substr(kpp, 1, 2) ELSE substr(inn, 1, 2) END AS region_code,
  round(n_wins / n_lots, 3) AS win_rate FROM a LEFT JOIN (SELECT inn, kpp FROM k WHERE rn = 1) USING (inn))""",
    ) + f" SELECT {columns} FROM f"


_PROFILE = "inn, kpp, entity_type, region_code, n_lots, n_wins, win_rate, n_customers, n_eshop, n_aisgz, n_eshop_wins, last_date, median_price"


def supplier_okpd(spark: SparkSession, d: str) -> DataFrame:
    lots, items, bids = _three(spark, d)
    return M.supplier_codes(bids, items, lots)


def _codes_sql(where: str = "", code: str = "okpd2_code", name: str = "okpd2_code") -> str:
    return f"""SELECT b.inn, li.c AS {name}, count(DISTINCT b.lot_id) AS n_lots, count(DISTINCT b.lot_id) FILTER (WHERE b.is_winner) AS n_wins, max(l.publish_date) AS last_date
 FROM bids b JOIN (SELECT DISTINCT lot_id, {code} AS c FROM items WHERE okpd2_code IS NOT NULL) li USING (lot_id) JOIN lots l USING (lot_id) {where} GROUP BY b.inn, li.c"""


def supplier_okpd_code8_sum(spark: SparkSession, d: str) -> DataFrame:
    return M.rolled_up(supplier_okpd(spark, d))


def supplier_okpd_code8_distinct(spark: SparkSession, d: str) -> DataFrame:
    lots, items, bids = _three(spark, d)
    return M.supplier_codes(bids, items, lots, CUTOFF, 8)


def okpd_sample_names(spark: SparkSession, d: str) -> DataFrame:
    return M.code_names(D.items(spark, d))


def item_name_code_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.item_counts(D.items(spark, d))


def supplier_class_breadth(spark: SparkSession, d: str) -> DataFrame:
    return M.class_breadth(supplier_okpd(spark, d))


def supplier_top_class_share(spark: SparkSession, d: str) -> DataFrame:
    return M.top_class(supplier_okpd(spark, d)).withColumn("share", F.round("share", 6))


def supplier_class_wins(spark: SparkSession, d: str) -> DataFrame:
    return M.class_wins(supplier_okpd(spark, d))


def customer_class_suppliers(spark: SparkSession, d: str) -> DataFrame:
    lots, items, bids = _three(spark, d)
    return M.customer_class_suppliers(bids, items, lots, CUTOFF)


def lot_bidder_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.bidder_counts(D.bids(spark, d))


def lots_with_winner_semi(spark: SparkSession, d: str) -> DataFrame:
    lots, _, bids = _three(spark, d)
    return M.lots_with_winner(lots, bids).select("lot_id", "platform", "publish_date")


def unregistered_suppliers_anti(spark: SparkSession, d: str) -> DataFrame:
    lots, _, bids = _three(spark, d)
    small = D.registry(spark, d).filter("msp_category <> 'микро'")
    return M.not_in(M.supplier_profile(bids, lots, None, MARKET), small, "inn").select("inn", "n_lots").orderBy(F.desc("n_lots"), "inn")


def supplier_card_okpd(spark: SparkSession, d: str) -> DataFrame:
    return M.supplier_card_codes(supplier_okpd(spark, d), okpd_sample_names(spark, d), PREFIXES)


def supplier_relevant_lots(spark: SparkSession, d: str) -> DataFrame:
    lots, items, bids = _three(spark, d)
    return M.supplier_lots(bids, lots, items, PREFIXES)


def lot_participants(spark: SparkSession, d: str) -> DataFrame:
    lots, _, bids = _three(spark, d)
    return M.grouped_bids(lots, bids, CUTOFF).select("lot_id", F.array_join("winners", ",").alias("winners"), F.array_join("participants", ",").alias("participants"))


def balanced_lot_pool(spark: SparkSession, d: str) -> DataFrame:
    lots, items, bids = _three(spark, d)
    return M.balanced_pool(lots, bids, items, CUTOFF)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.balanced_pick(balanced_lot_pool(spark, d))


def customer_history(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's bidders: lots, wins and weight before the cutoff."""
    lots, _, bids = _three(spark, d)
    rows = M.before(lots, CUTOFF).select("lot_id", "customer_inn").join(bids, "lot_id")
    return rows.groupBy("customer_inn", "inn").agg(F.count("*").alias("lots"), F.count_if("is_winner").alias("wins"), F.sum(F.when(F.col("is_winner"), 1.0).otherwise(0.5)).alias("any_w"))


def okved_mapping(spark: SparkSession, d: str) -> DataFrame:
    return C.okved_mapping(supplier_class_wins(spark, d), D.registry(spark, d))


def role_scores(spark: SparkSession, d: str) -> DataFrame:
    """The market role of every company of the registry, with what history adds."""
    codes = supplier_okpd(spark, d)
    history = M.class_breadth(codes).join(M.top_class(codes).select("inn", F.col("cls").alias("top_cls")), "inn", "left")
    out = C.roles(D.registry(spark, d).join(history, "inn", "left"))
    return out.select("inn", *[F.round(f"role_{r}", 6).alias(f"role_{r}") for r in ("manufacturer", "distributor", "supplier", "contractor", "service")], "role", "role_confidence", "role_level", "role_alt")


def _role_sql() -> str:
    def role(c: str) -> str:
        n = f"TRY_CAST(split_part({c}, '.', 1) AS INTEGER)"
        return f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} BETWEEN 1 AND 3 OR {n} BETWEEN 5 AND 9 THEN 'manufacturer' WHEN {n} = 33 THEN CASE WHEN {c} LIKE '33.%' THEN 'service' ELSE 'manufacturer' END WHEN {n} BETWEEN 10 AND 32 THEN 'manufacturer' WHEN {n} BETWEEN 41 AND 43 THEN 'contractor' WHEN {n} = 45 THEN CASE WHEN {c} LIKE '45.2%' THEN 'service' ELSE 'distributor' END WHEN {n} = 46 THEN 'distributor' WHEN {n} = 47 THEN 'supplier' ELSE 'service' END"

    names = ("manufacturer", "distributor", "supplier", "contractor", "service")
    return (
        with_(
            REGISTRY_SQL,
            f"so AS ({_codes_sql()})",
            "br AS (SELECT inn, count(DISTINCT substr(okpd2_code, 1, 2)) AS n_classes FROM so GROUP BY inn)",
            f"ex AS (SELECT inn, x, {role('x')} AS r FROM (SELECT inn, unnest(string_split(okved_extra, ';')) AS x FROM registry) WHERE x <> '')",
            "exn AS (SELECT inn, r, count(*) AS n FROM ex GROUP BY inn, r)",
            "ext AS (SELECT inn, count(*) AS m FROM ex GROUP BY inn)",
            f"g AS (SELECT r.inn, r.products, b.n_classes, {role('r.okved_main')} AS main, m FROM registry r LEFT JOIN br b USING (inn) LEFT JOIN ext USING (inn))",
            f"roles(role, k) AS (VALUES {', '.join(f"('{r}', {k})" for k, r in enumerate(names))})",
            """s AS (SELECT g.inn, role, k, CASE WHEN main = role THEN 3.0::DOUBLE ELSE 0 END + coalesce(1.5::DOUBLE * coalesce(n, 0) / m, 0) + CASE WHEN role = 'manufacturer' AND products IS NOT NULL THEN 2.0 ELSE 0 END
  + CASE WHEN role = 'supplier' AND n_classes >= 8 THEN 1.0 + least((n_classes - 8) / 10.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END AS score,
  CASE WHEN main = role THEN 1 ELSE 0 END + CASE WHEN role = 'manufacturer' AND products IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN role = 'supplier' AND n_classes >= 8 THEN 1 ELSE 0 END AS sig
  FROM g CROSS JOIN roles LEFT JOIN exn ON exn.inn = g.inn AND exn.r = role)""",
            "q AS (SELECT *, sum(score) OVER (PARTITION BY inn) AS total, row_number() OVER (PARTITION BY inn ORDER BY score DESC, k) AS rn FROM s)",
            "b1 AS (SELECT inn, role, score, sig, total FROM q WHERE rn = 1)",
            "b2 AS (SELECT inn, role AS role2, score AS score2, sig AS sig2 FROM q WHERE rn = 2)",
        )
        + " SELECT s.inn, "
        + ", ".join(f"round(max(s.score) FILTER (WHERE s.role = '{r}'), 6) AS role_{r}" for r in names)
        + """, any_value(CASE WHEN b1.total > 0 THEN b1.role END) AS role, any_value(round(CASE WHEN b1.total > 0 THEN b1.score / b1.total ELSE 0 END, 2)) AS role_confidence,
  any_value(CASE WHEN b1.total = 0 THEN '' WHEN b1.score / b1.total >= 0.8 AND b1.sig >= 2 THEN 'высокая' WHEN b1.score / b1.total >= 0.55 THEN 'средняя' ELSE 'низкая' END) AS role_level,
  any_value(CASE WHEN b1.total > 0 AND score2 >= 0.3 * b1.score AND sig2 > 0 THEN role2 END) AS role_alt
 FROM s JOIN b1 USING (inn) JOIN b2 USING (inn) GROUP BY s.inn"""
    )


def baseline_top_okpd(spark: SparkSession, d: str) -> DataFrame:
    return E.baseline_codes(E.lot_code_lists(D.items(spark, d).join(D.lots(spark, d).filter(F.col("publish_date") >= F.lit(CUTOFF).cast("date")), "lot_id", "left_semi")), E.top_by_code(supplier_okpd_code8_distinct(spark, d).withColumnRenamed("okpd2_code", "code8")))


_BASE = f"""ca AS ({_codes_sql(f"WHERE l.publish_date < DATE '{CUTOFF}'", "substr(okpd2_code, 1, 8)", "code8")}),
best AS (SELECT code8, inn, pos FROM (SELECT code8, inn, row_number() OVER (PARTITION BY code8 ORDER BY n_wins DESC, inn) AS pos FROM ca) WHERE pos <= 50),
lc0 AS (SELECT lot_id AS query_id, substr(okpd2_code, 1, 8) AS code8, min(product_name) AS name FROM items JOIN lots USING (lot_id) WHERE okpd2_code IS NOT NULL AND publish_date >= DATE '{CUTOFF}' GROUP BY ALL),
lc AS (SELECT query_id, code8, row_number() OVER (PARTITION BY query_id ORDER BY name, code8) AS code_at FROM lc0),
bc0 AS (SELECT query_id, inn, min(row(code_at, pos)) AS key FROM lc JOIN best USING (code8) GROUP BY ALL),
bc AS (SELECT query_id, inn, row_number() OVER (PARTITION BY query_id ORDER BY key, inn) AS place FROM bc0),
cc AS (SELECT customer_inn, cls, inn, count(DISTINCT lot_id) AS wins FROM bids JOIN lots USING (lot_id) JOIN (SELECT DISTINCT lot_id, substr(okpd2_code, 1, 5) AS cls FROM items WHERE okpd2_code IS NOT NULL) USING (lot_id)
  WHERE is_winner AND publish_date < DATE '{CUTOFF}' GROUP BY ALL),
lcls AS (SELECT DISTINCT lot_id AS query_id, substr(okpd2_code, 1, 5) AS cls FROM items JOIN lots USING (lot_id) WHERE okpd2_code IS NOT NULL AND publish_date >= DATE '{CUTOFF}'),
kn AS (SELECT q.lot_id AS query_id, cc.inn, CAST(sum(wins) AS BIGINT) AS wins FROM lots q JOIN lcls ON lcls.query_id = q.lot_id JOIN cc ON cc.customer_inn = q.customer_inn AND cc.cls = lcls.cls GROUP BY ALL),
bcu AS (SELECT query_id, inn, wins, 0 AS late FROM kn UNION ALL SELECT query_id, inn, 0, place FROM bc WHERE place <= 10 AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.query_id = bc.query_id AND kn.inn = bc.inn)),
bcr AS (SELECT query_id, inn, row_number() OVER (PARTITION BY query_id ORDER BY wins DESC, late, inn) AS place FROM bcu),
truth AS (SELECT lot_id AS query_id, list(inn) FILTER (WHERE is_winner) AS winners, list(DISTINCT inn) AS participants FROM bids JOIN lots USING (lot_id) WHERE publish_date >= DATE '{CUTOFF}' GROUP BY lot_id HAVING count(*) FILTER (WHERE is_winner) > 0),
rk AS (SELECT t.query_id, coalesce(min(place) FILTER (WHERE list_contains(winners, inn)), 0) AS rank, count(*) FILTER (WHERE list_contains(participants, inn)) / any_value(len(participants)) AS recall
  FROM truth t LEFT JOIN (SELECT * FROM bcr WHERE place <= 10) b USING (query_id) GROUP BY t.query_id)"""


def baseline_customer_okpd(spark: SparkSession, d: str) -> DataFrame:
    lots, items, _ = _three(spark, d)
    later = lots.filter(F.col("publish_date") >= F.lit(CUTOFF).cast("date"))
    queries = later.select(F.col("lot_id").alias("query_id"), "customer_inn")
    classes = items.filter("okpd2_code is not null").join(later, "lot_id", "left_semi").select(F.col("lot_id").alias("query_id"), S.level(F.col("okpd2_code"), 5).alias("cls"))
    return E.baseline_customer(queries, classes, customer_class_suppliers(spark, d), baseline_top_okpd(spark, d))


def eval_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    lots, _, bids = _three(spark, d)
    truth = M.grouped_bids(lots, bids, CUTOFF).select(F.col("lot_id").alias("query_id"), "winners", "participants")
    return E.metrics(E.ranks(truth, baseline_customer_okpd(spark, d)))


def eval_interval(spark: SparkSession, d: str) -> DataFrame:
    """Within which bounds the hit rate and the reciprocal rank of the baseline lie, by 200 resamples of the lots."""
    lots, _, bids = _three(spark, d)
    truth = M.grouped_bids(lots, bids, CUTOFF).select(F.col("lot_id").alias("query_id"), "winners", "participants")
    ranks = E.ranks(truth, baseline_customer_okpd(spark, d))
    values = ranks.select(F.col("query_id").alias("key"), F.when(F.col("rank") > 0, 1.0).otherwise(0.0).alias("hit"), F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0).alias("mrr"))
    found = E.interval(values, 200, ("hit", "mrr"))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def newcomer_share(spark: SparkSession, d: str) -> DataFrame:
    lots, _, bids = _three(spark, d)
    return E.newcomers(lots, bids, "1995-01-03").groupBy("inn").agg(F.count("*").alias("lots"))


def price_fit(spark: SparkSession, d: str) -> DataFrame:
    """How each supplier's usual price fits each nation's mean order."""
    profile = supplier_profile(spark, d).select("inn", "median_price")
    cards = D.cards(spark, d).select("query_id", "price")
    return profile.join(F.broadcast(cards)).select("inn", "query_id", F.round(S.price_fit(F.col("price"), F.col("median_price")), 6).alias("fit"))


def inn_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.lpad("c_custkey", 8 + 1, "7"), F.when(F.col("c_custkey") % 3 == 0, F.lit("-12")).when(F.col("c_custkey") % 3 == 1, F.lit("x")).otherwise(F.lit("5551")))
    return D.read(spark, d, "customer").select("c_custkey", S.inn(raw).alias("inn"))


def price_normalise(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.format_string("%d", F.floor("c_acctbal")), F.when(F.col("c_custkey") % 2 == 0, F.lit(",50 руб")).otherwise(F.lit(".000,5")))
    return D.read(spark, d, "customer").select("c_custkey", S.price(text).alias("price"))


def price_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Lots per platform and day with their summed price."""
    return D.lots(spark, d).groupBy("platform", "publish_date").agg(F.count("*").alias("n"), F.round(F.sum("start_price"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        lots_projection, items_projection, participations_filtered, lot_docs, supplier_profile, supplier_profile_asof, supplier_okpd, supplier_okpd_code8_sum, supplier_okpd_code8_distinct,
        okpd_sample_names, item_name_code_counts, supplier_class_breadth, supplier_top_class_share, supplier_class_wins, customer_class_suppliers, lot_bidder_counts, lots_with_winner_semi,
        unregistered_suppliers_anti, supplier_card_okpd, supplier_relevant_lots, lot_participants, balanced_lot_pool, stratified_sample, customer_history, okved_mapping, role_scores,
        baseline_top_okpd, baseline_customer_okpd, eval_hit_mrr, eval_interval, newcomer_share, price_fit, inn_normalise, price_normalise, price_by_day,
    )
}

_LIKE = " OR ".join(f"okpd2_code LIKE '{p[:8]}%'" for p in PREFIXES)
SO = f"so AS ({_codes_sql()})"
ORACLES = {
    "lots_projection": with_() + " SELECT * FROM lots",
    "items_projection": with_() + " SELECT lot_id, trim(product_name) AS product_name, okpd2_code FROM items",
    "participations_filtered": with_() + " SELECT lot_id, inn, nullif(kpp, '') AS kpp, is_winner FROM bids WHERE length(inn) IN (10, 12)",
    "lot_docs": with_() + """ SELECT l.lot_id, l.subject, coalesce(i.items, '') AS items, i.codes AS okpd2_codes FROM lots l LEFT JOIN
 (SELECT lot_id, array_to_string(list_sort(list(DISTINCT product_name)), ' | ') AS items, array_to_string(list_sort(list(DISTINCT okpd2_code)), ',') AS codes FROM items GROUP BY lot_id) i USING (lot_id)""",
    "supplier_profile": _profile_sql("", _PROFILE + ", first_date, sum_won"),
    "supplier_profile_asof": _profile_sql(f"WHERE publish_date < DATE '{CUTOFF}'", _PROFILE),
    "supplier_okpd": with_() + " " + _codes_sql(),
    "supplier_okpd_code8_sum": with_(SO) + " SELECT inn, substr(okpd2_code, 1, 8) AS code8, CAST(sum(n_lots) AS BIGINT) AS n_lots, CAST(sum(n_wins) AS BIGINT) AS n_wins, max(last_date) AS last_date FROM so GROUP BY ALL",
    "supplier_okpd_code8_distinct": with_() + " " + _codes_sql(f"WHERE l.publish_date < DATE '{CUTOFF}'", "substr(okpd2_code, 1, 8)"),
    "okpd_sample_names": with_("c AS (SELECT okpd2_code, product_name, count(*) AS n FROM items WHERE okpd2_code IS NOT NULL GROUP BY ALL)") + " SELECT okpd2_code, arg_max(product_name, row(n, product_name)) AS sample_name, CAST(sum(n) AS BIGINT) AS n_items FROM c GROUP BY okpd2_code",
    "item_name_code_counts": with_() + " SELECT product_name, substr(okpd2_code, 1, 8) AS code8, count(*) AS n FROM items WHERE okpd2_code IS NOT NULL AND length(product_name) > 2 GROUP BY ALL",
    "supplier_class_breadth": with_(SO) + " SELECT inn, count(DISTINCT substr(okpd2_code, 1, 2)) AS n_classes FROM so GROUP BY inn",
    "supplier_top_class_share": with_(SO, "w AS (SELECT inn, substr(okpd2_code, 1, 2) AS cls, sum(n_wins) AS w FROM so WHERE n_wins > 0 GROUP BY ALL)") + " SELECT inn, arg_max(cls, row(w, cls)) AS cls, round(max(w) / sum(w), 6) AS share FROM w GROUP BY inn",
    "supplier_class_wins": with_(SO) + " SELECT inn, substr(okpd2_code, 1, 5) AS cls, CAST(sum(n_wins) AS BIGINT) AS w FROM so WHERE n_wins > 0 GROUP BY ALL",
    "customer_class_suppliers": with_(_BASE) + " SELECT customer_inn, cls, inn, wins FROM cc",
    "lot_bidder_counts": with_() + " SELECT lot_id, count(*) AS n_bidders FROM bids GROUP BY lot_id",
    "lots_with_winner_semi": with_() + " SELECT lot_id, platform, publish_date FROM lots l WHERE EXISTS (SELECT 1 FROM bids b WHERE b.lot_id = l.lot_id AND b.is_winner)",
    "unregistered_suppliers_anti": with_(REGISTRY_SQL) + " SELECT inn, count(DISTINCT lot_id) AS n_lots FROM bids JOIN lots USING (lot_id) WHERE inn NOT IN (SELECT inn FROM registry WHERE msp_category <> 'микро') GROUP BY inn",
    "supplier_card_okpd": with_(SO, "c AS (SELECT okpd2_code, product_name, count(*) AS n FROM items GROUP BY ALL)", "nm AS (SELECT okpd2_code, arg_max(product_name, row(n, product_name)) AS sample_name FROM c GROUP BY okpd2_code)",
        f"r AS (SELECT so.*, sample_name, ({_LIKE}) AS relevant FROM so LEFT JOIN nm USING (okpd2_code))", "p AS (SELECT *, row_number() OVER (PARTITION BY inn ORDER BY relevant DESC, n_wins DESC, n_lots DESC, okpd2_code) AS place FROM r)")
        + " SELECT inn, okpd2_code, sample_name, n_lots, n_wins, last_date, relevant, CAST(place AS INTEGER) AS place FROM p WHERE place <= 15",
    "supplier_relevant_lots": with_(f"rel AS (SELECT DISTINCT lot_id FROM items WHERE {_LIKE})", "nb AS (SELECT lot_id, count(*) AS n_bidders FROM bids GROUP BY lot_id)",
        "x AS (SELECT DISTINCT b.inn, b.is_winner, l.* FROM bids b JOIN lots l USING (lot_id) JOIN rel USING (lot_id))", "p AS (SELECT x.*, n_bidders, row_number() OVER (PARTITION BY inn ORDER BY publish_date DESC, lot_id, is_winner) AS place FROM x LEFT JOIN nb USING (lot_id))")
        + " SELECT inn, CAST(place AS INTEGER) AS place, lot_id, subject, publish_date, start_price, platform, is_winner, customer_inn, n_bidders FROM p WHERE place <= 10",
    "lot_participants": with_() + f" SELECT lot_id, array_to_string(list_sort(list(inn) FILTER (WHERE is_winner)), ',') AS winners, array_to_string(list_sort(list(inn)), ',') AS participants FROM bids JOIN lots USING (lot_id) WHERE publish_date >= DATE '{CUTOFF}' GROUP BY lot_id HAVING count(*) FILTER (WHERE is_winner) > 0",
    "balanced_lot_pool": with_("w AS (SELECT lot_id FROM bids WHERE is_winner GROUP BY lot_id HAVING count(DISTINCT inn) = 1)",
        "i AS (SELECT lot_id, count(*) AS n, sum(CASE WHEN TRY_CAST(substr(okpd2_code, 1, 2) AS INTEGER) BETWEEN 1 AND 33 THEN 1 ELSE 0 END) AS goods, sum(CASE WHEN TRY_CAST(substr(okpd2_code, 1, 2) AS INTEGER) BETWEEN 35 AND 99 THEN 1 ELSE 0 END) AS services, min(substr(okpd2_code, 1, 2)) AS class_code FROM items GROUP BY lot_id)")
        + f" SELECT l.lot_id, l.platform, CASE WHEN goods = n THEN 'goods' ELSE 'services' END AS kind, CASE WHEN n = 1 THEN 'one' ELSE 'multi' END AS size_band, class_code FROM lots l JOIN w USING (lot_id) JOIN i USING (lot_id) WHERE publish_date >= DATE '{CUTOFF}' AND (n = 1 OR n BETWEEN 5 AND 30) AND (goods = n OR services = n)",
    "customer_history": with_() + f" SELECT customer_inn, inn, count(*) AS lots, count(*) FILTER (WHERE is_winner) AS wins, CAST(sum(CASE WHEN is_winner THEN 1.0 ELSE 0.5 END) AS DOUBLE) AS any_w FROM bids JOIN lots USING (lot_id) WHERE publish_date < DATE '{CUTOFF}' GROUP BY ALL",
    "okved_mapping": with_(SO, REGISTRY_SQL, "w AS (SELECT inn, substr(okpd2_code, 1, 5) AS cls, sum(n_wins) AS w FROM so WHERE n_wins > 0 GROUP BY ALL)") + " SELECT cls, substr(okved_main, 1, 5) AS okved5, CAST(sum(w) AS BIGINT) AS w FROM w JOIN registry USING (inn) GROUP BY ALL",
    "role_scores": _role_sql(),
    "baseline_top_okpd": with_(_BASE) + " SELECT query_id, inn, CAST(place AS INTEGER) AS place FROM bc WHERE place <= 10",
    "baseline_customer_okpd": with_(_BASE) + " SELECT query_id, inn, CAST(place AS INTEGER) AS place FROM bcr WHERE place <= 10",
    "eval_hit_mrr": with_(_BASE) + " SELECT count(*) AS n, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 4) AS mrr, round(avg(recall), 4) AS recall FROM rk",
    "eval_interval": with_(_BASE, f"""rp AS (SELECT CASE WHEN rank > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END AS mrr, r, CAST('0x' || substr(md5(query_id || ':' || r), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS part FROM rk, range(1, 201) AS t(r)),
rw AS (SELECT *, {" + ".join(f"CASE WHEN part >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in E.POISSON)} AS w FROM rp), rm AS (SELECT r, sum(w * hit) / sum(w) AS hit, sum(w * mrr) / sum(w) AS mrr FROM rw GROUP BY r)""")
        + " SELECT round(quantile_cont(hit, 0.025), 9) AS hit_low, round(quantile_cont(hit, 0.975), 9) AS hit_high, round(quantile_cont(mrr, 0.025), 9) AS mrr_low, round(quantile_cont(mrr, 0.975), 9) AS mrr_high FROM rm",
    "newcomer_share": with_("o AS (SELECT DISTINCT inn FROM bids JOIN lots USING (lot_id) WHERE publish_date < DATE '1995-01-03')") + " SELECT inn, count(DISTINCT lot_id) AS lots FROM bids JOIN lots USING (lot_id) WHERE is_winner AND publish_date >= DATE '1995-01-03' AND inn NOT IN (SELECT inn FROM o) GROUP BY inn",
    "price_fit": with_("buyers AS (SELECT c_nationkey AS query_id, round(avg(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)", "m AS (SELECT inn, median(start_price) AS m FROM bids JOIN lots USING (lot_id) GROUP BY inn)")
        + " SELECT inn, query_id, round(exp(-pow(ln(price / m), 2) / 4.5), 6) AS fit FROM m, buyers",
    "inn_normalise": "SELECT c_custkey, CASE WHEN length(e) IN (10, 12) THEN e END AS inn FROM (SELECT c_custkey, CASE WHEN length(d) IN (9, 11) THEN '0' || d ELSE d END AS e FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '7') || CASE c_custkey % 3 WHEN 0 THEN '12' WHEN 1 THEN '' ELSE '5551' END AS d FROM customer))",
    "price_normalise": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '.50' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '000.5' END::DOUBLE AS price FROM customer",
    "price_by_day": with_() + " SELECT platform, publish_date, count(*) AS n, round(sum(start_price), 2) AS total FROM lots GROUP BY ALL",
}
