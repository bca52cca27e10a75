"""Queries over filtered searches, cards, exports and texts, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions import fixed_values as V
from bidloom.functions import scalars as S
from bidloom.operators import batch as B
from bidloom.operators import companies as C
from bidloom.operators import evaluation as E
from bidloom.operators import marts as M
from bidloom.operators import ranking as R
from bidloom.operators import retrieval as T
from bidloom.plans import mart_queries, search_queries
from bidloom.plans.batch_queries import _UPLOAD, _upload
from bidloom.plans.mart_queries import with_
from bidloom.plans.search_queries import _CONFIDENCE, _FEATURES, _NEW, _RANKED, _REASONS, _SEARCH, Scene
from bidloom.sources import standin as D
from bidloom.sources.standin import CUTOFF, MARKET, REGISTRY_SQL

#: How many procurements the capped upload keeps, and how many lots the sample takes.
CAP, SAMPLE = 10, 200


def platform_similar_lots(spark: SparkSession, d: str) -> DataFrame:
    """Similar lots on the platform that the procurement names."""
    s = Scene(spark, d)
    eligible, asked = s.history.select(F.col("lot_id").alias("id"), F.col("platform").alias("held")), s.cards.select("query_id", "platform")
    return T.similar(s.vectors, s.index, V.VOTE_LOTS, eligible, F.col("platform").isNull() | (F.col("held") == F.col("platform")), asked)


def similar_lots_of_others(spark: SparkSession, d: str) -> DataFrame:
    """Similar lots without those of the card's own customer."""
    s = Scene(spark, d)
    own = s.cards.select("query_id", "customer_inn").join(s.lots.select("customer_inn", F.col("lot_id").alias("id")), "customer_inn")
    return T.similar(s.vectors, s.index, V.VOTE_LOTS, s.history.select(F.col("lot_id").alias("id")), barred=own)


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "inn", F.round("f_text", 6).alias("f_text"), F.round("f_okpd", 6).alias("f_okpd"))


def region_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the home and neighbouring regions; factors are scaled among them."""
    return _kept(Scene(spark, d).features(region_only=True))


def smp_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the register lists as small (not micro) business."""
    s = Scene(spark, d)
    return _kept(s.features(smp=s.registry.filter(F.col("msp_category") == "малое").select("inn")))


def similar_lot_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each candidate did in similar lots: highest similarity, wins (also scaled), bids."""
    rows = Scene(spark, d).features().filter("max_sim is not null")
    return rows.select("query_id", "inn", F.round("max_sim", 6).alias("max_sim"), "wins", "parts", "em_parts", "em_wins", "comp_wins", "ais_wins", F.round("rel_wins_scaled", 6).alias("rel_wins"))


def status_reasons(spark: SparkSession, d: str) -> DataFrame:
    return R.status_reason(Scene(spark, d).ranked(), MARKET).select("query_id", "inn", "status", "status_reason")


def confidence_messages(spark: SparkSession, d: str) -> DataFrame:
    return T.confidence_message(Scene(spark, d).confidence()).select("query_id", "level", "message")


def code_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of the codes looked for. A third of the sections names its classes, a third itself only, the others nothing."""
    s = Scene(spark, d)
    items = M.item_counts(s.items)
    section = F.substring("code8", 1, 2)
    named = items.select(section.alias("section"), F.substring("code8", 1, 5).alias("cls")).distinct().withColumn("kind", F.col("section").cast("int") % 3)
    official = named.filter("kind = 0").select(F.col("cls").alias("code"), F.concat(F.lit("класс "), "cls").alias("name")).union(named.filter("kind = 1").select("section", F.concat(F.lit("раздел "), "section")).distinct())
    return T.labelled(s.shares, official, items.select("code8", F.col("product_name").alias("name"), "n")).select("query_id", "code8", "share", "name")


def new_company_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of every company of the pool that fits a procurement."""
    s = Scene(spark, d)
    return C.new_company_points(s.new_scores(), s.registry, s.registry.select("inn", F.col("inn").endswith("7").alias("in_rnp")), MARKET).select("query_id", "inn", "score")


def newcomer_recall_at(spark: SparkSession, d: str) -> DataFrame:
    return E.newcomer_recall(search_queries.newcomer_recall(spark, d))


def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Register rows of companies with an even number, and cached rows of every third."""
    r, key = D.registry(spark, d), F.col("inn").cast("long")
    cached = r.filter(key % 3 == 0).select("inn", F.concat(F.lit("cached "), "inn").alias("name"), F.when(key % 2 == 0, F.concat(F.lit("+8"), "inn")).alias("phone"), F.concat("inn", F.lit("@example.org")).alias("email"))
    return C.merged_registry(r.filter(key % 2 == 0).select("inn", "name", "okved_main", "phone"), cached)


def short_names(spark: SparkSession, d: str) -> DataFrame:
    """Companies with a legal form before or after the name, and people."""
    key, name = F.col("inn").cast("long"), F.col("name")
    given = (
        F.when(key % 4 == 0, F.concat(F.lit("Общество с  ограниченной ответственностью "), name)).when(key % 4 == 1, F.concat(F.lit("АКЦИОНЕРНОЕ ОБЩЕСТВО "), name))
        .when(key % 4 == 2, F.concat(name, F.lit(" ПУБЛИЧНОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО"))).otherwise("ИВАНОВ ИВАН")
    )
    number = F.when(key % 4 == 3, F.concat("inn", F.lit("00"))).otherwise(F.col("inn"))
    return D.registry(spark, d).select("inn", S.short_name(given, number).alias("short_name"))


def cleaned_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects with law references, numbers and dates put in, cut out again."""
    noisy = F.concat("subject", F.lit(" (п. 4 ч. 1 ст. 93 закона) № А-"), F.col("lot_id").cast("string"), F.lit(" 44-ФЗ "), F.date_format("publish_date", "dd.MM.yyyy"), F.lit(" 2021 г."))
    return D.lots(spark, d).select("lot_id", F.trim(F.regexp_replace(S.clean(noisy), r"\s+", " ")).alias("subject"))


def text_intents(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text asks for goods or services, by the word that comes first."""
    row = F.col("l_partkey") % 5
    words = F.when(row == 0, "Поставка ").when(row == 1, "ремонт ").when(row == 2, "услуги по поставке ").when(row == 3, "покупка с монтажом ").otherwise("")
    return D.parts(spark, d).select(F.col("l_partkey").alias("part"), S.intent(F.concat(words, "product_name")).alias("intent"))


def plural_forms(spark: SparkSession, d: str) -> DataFrame:
    return D.lots(spark, d).select("lot_id", S.plural(F.col("lot_id"), "лот", "лота", "лотов").alias("said"))


def pasted_items(spark: SparkSession, d: str) -> DataFrame:
    """Lists of the parts of a size, some with codes, split into positions again."""
    line = F.concat_ws("", F.lit("  "), "product_name", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("\t"), "okpd2_code")).when(F.col("l_partkey") % 3 == 1, "; 5 шт"), F.lit("\r\n \n"))
    pasted = D.parts(spark, d).groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", line.alias("line")))), lambda x: x["line"]), "").alias("text"))
    return pasted.select("p_size", F.posexplode(B.listed_items(F.col("text"))).alias("at", "item")).select("p_size", "at", "item.product_name", "item.okpd2_code")


def stacked_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Two files without a common key: names of small parts, and names with codes of large ones."""
    parts = D.parts(spark, d).withColumn("row", F.col("l_partkey").cast("int"))
    small, large = parts.filter("p_size <= 10").select("row", "product_name"), parts.filter("p_size > 40").select("row", "product_name", "okpd2_code")
    return B.merged([small, large]).select("file", "row", "product_name", "okpd2_code")


def batch_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first procurements of the upload, as many as a batch takes."""
    return B.procurements(_upload(spark, d), CAP)[0].select("query_id", "procedure_id")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Later lots with a winner, a fixed number in the order of a hash."""
    lots, bids = D.lots(spark, d), D.bids(spark, d)
    later = lots.filter(F.col("publish_date") >= F.lit(CUTOFF).cast("date")).join(bids.filter("is_winner").select("lot_id"), "lot_id", "left_semi")
    return M.hash_sample(later.select("lot_id", "platform"), "lot_id", SAMPLE)


class _Export:
    """The tables that the exports rest on: procurements, ranked suppliers with company data, new companies, confidence, kinds."""

    def __init__(self, spark: SparkSession, d: str):
        s = self.scene = Scene(spark, d)
        self.procs = s.cards.select("query_id", F.concat(F.lit("P"), F.col("query_id").cast("string")).alias("procedure_id"), F.lit(None).cast("string").alias("lot_id"), "text", F.col("spec.product_name").alias("items"))
        names = s.registry.select("inn", "name", "phone", "okved_main")
        self.ranked = R.reasons(s.ranked(), MARKET).join(names, "inn", "left").withColumn("company_name", F.coalesce(S.short_name(F.col("name"), F.col("inn")), F.concat(F.lit("ИНН "), "inn")))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pool_score"), "inn"))
        head = s.new_scores().withColumn("place", best).filter("place <= 5").select("query_id", "inn", "match", "place")
        unfair = s.registry.select("inn", F.lit(False).alias("in_rnp"))
        self.external = C.new_company_points(head, s.registry, unfair, MARKET).drop("region_code").join(names.withColumnRenamed("name", "company_name"), "inn")
        self.intents = s.cards.select("query_id", F.when(F.col("query_id") % 3 == 0, "goods").when(F.col("query_id") % 3 == 1, "services").alias("intent"))


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    x = _Export(spark, d)
    return B.summary(x.procs, x.ranked, x.external, T.confidence_message(x.scene.confidence()), x.scene.given, x.intents)


def batch_recommendations(spark: SparkSession, d: str) -> DataFrame:
    x = _Export(spark, d)
    return B.recommendations(x.procs, x.ranked, x.external)


QUERIES = {
    f.__name__: f
    for f in (
        platform_similar_lots, similar_lots_of_others, region_candidates, smp_candidates, similar_lot_counts, status_reasons, confidence_messages, code_labels, new_company_points, newcomer_recall_at, registry_merge, short_names,
        cleaned_subjects, text_intents, plural_forms, pasted_items, stacked_uploads, batch_capped, hash_sample, batch_summary, batch_recommendations,
    )
}

_SIM = f"""SELECT query_id, id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS place FROM (SELECT v.query_id, p.id, round(sum(w * dw), 9) AS sim FROM qv v JOIN lpost p USING (term) JOIN lots l ON l.lot_id = p.id JOIN cards c ON c.query_id = v.query_id
  WHERE publish_date < DATE '{CUTOFF}' AND {{}} GROUP BY v.query_id, p.id) WHERE sim > 0 QUALIFY place <= {V.VOTE_LOTS}"""
_FILTERED = " SELECT query_id, inn, round(CAST(f_text AS DOUBLE), 6) AS f_text, round(CAST(f_okpd AS DOUBLE), 6) AS f_okpd FROM feat"


def _among(condition: str) -> str:
    return _FEATURES.replace("FROM j WINDOW w", f"FROM (SELECT * FROM j WHERE {condition}) WINDOW w").replace("coalesce(ln(1 + 10 * text) / ln(1 + 10 * max(text) OVER w), 0)", "coalesce(ln(1 + 10 * text) / nullif(ln(1 + 10 * max(text) OVER w), 0), 0)").replace("ln(1 + max(okpd_exp) OVER w) AS", "coalesce(nullif(ln(1 + max(okpd_exp) OVER w), 0), 1) AS")


_STATUS = """st AS (SELECT *, concat_ws('; ', CASE WHEN em_parts > 0 THEN 'побед в похожих закупках (ESHOP): ' || em_wins || ' из ' || em_parts END, CASE WHEN ais_wins > 0 THEN 'победитель похожих процедур (GZ): ' || ais_wins END) AS won,
  coalesce(em_wins / nullif(em_parts, 0), 0) AS rate, CASE WHEN coalesce(wins, 0) >= 3 AND (coalesce(em_parts, 0) < 3 OR em_wins / em_parts >= 0.25) THEN 'verified' WHEN coalesce(wins, 0) >= 1 OR coalesce(code_wins, 0) >= 3 THEN 'experienced'
  WHEN coalesce(em_parts, 0) > 0 THEN 'participant' ELSE 'category' END AS status FROM ranked WHERE place <= 20)"""
_MESSAGE = """ms AS (SELECT query_id, level, CASE WHEN len(unmatched) > 0 THEN 'В похожих закупках не встречается: ' || array_to_string(list_transform(list_slice(unmatched, 1, 4), lambda x: '«' || x || '»'), ', ') || '. Показаны поставщики, подходящие по остальным словам — проверьте, что это то, что вам нужно.'
  WHEN level = 'medium' THEN 'Похожих закупок в истории немного (' || n || ') — рейтинг менее надёжен, чем обычно.' ELSE '' END AS message FROM conf)"""
_POINTS = """pt AS (SELECT query_id, inn, n.match, pool_score, round(round(least(25 * n.match, 50.0::DOUBLE), 1) + round(15 * least(ln(1 + employees) / ln(101.0::DOUBLE), 1.0::DOUBLE), 1) + CASE WHEN CAST(right(msp_since, 4) AS INTEGER) <= 2023 THEN 5 WHEN msp_since IS NOT NULL THEN 2 ELSE 0 END
  + CASE region_code WHEN '01' THEN 5 WHEN '02' THEN 3 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END, 1) AS total FROM news n JOIN registry USING (inn))"""
_EXTERNAL = "ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pool_score DESC, inn) AS place FROM pt QUALIFY place <= 5)"
_ALL = (REGISTRY_SQL, _SEARCH, _FEATURES, _CONFIDENCE, _RANKED)

ORACLES = {
    "platform_similar_lots": with_(_SEARCH) + " " + _SIM.format("l.platform = c.platform"),
    "similar_lots_of_others": with_(_SEARCH) + " " + _SIM.format("l.customer_inn <> c.customer_inn"),
    "region_candidates": with_(_SEARCH, _among("region IN ('01', '02')")) + _FILTERED,
    "smp_candidates": with_(REGISTRY_SQL, _SEARCH, _among("inn IN (SELECT inn FROM registry WHERE msp_category = 'малое')")) + _FILTERED,
    "similar_lot_counts": with_(_SEARCH, _FEATURES, "ms AS (SELECT query_id, inn, max(sim * match) AS max_sim FROM rows0 GROUP BY ALL)") + """ SELECT query_id, inn, round(max_sim, 6) AS max_sim, wins, parts, em_parts, em_wins, comp_wins, ais_wins,
 round(coalesce(ln(1 + wins) / nullif(ln(1 + max(wins) OVER (PARTITION BY query_id)), 0), 0), 6) AS rel_wins FROM a JOIN ms USING (query_id, inn)""",
    "status_reasons": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED, _STATUS) + """ SELECT query_id, inn, status, CASE status WHEN 'verified' THEN won WHEN 'experienced' THEN CASE WHEN coalesce(wins, 0) >= 3 AND rate < 0.25 THEN won || '; доля побед ниже 25%' WHEN coalesce(wins, 0) >= 1 THEN won
 ELSE code_wins || ' побед по тем же кодам ОКПД2, но не в похожих по названию закупках' END WHEN 'participant' THEN 'без побед участвовал в похожих закупках: ' || em_parts ELSE 'работал по тем же кодам ОКПД2 или в закупках с общими словами; близких по предмету нет' END AS status_reason FROM st""",
    "confidence_messages": with_(_SEARCH, _CONFIDENCE, _MESSAGE) + " SELECT query_id, level, message FROM ms",
    "code_labels": with_(_SEARCH, "cn AS (SELECT code8, arg_max(product_name, row(n, product_name)) AS sample FROM (SELECT product_name, substr(okpd2_code, 1, 8) AS code8, count(*) AS n FROM items GROUP BY ALL) GROUP BY code8)")
      + " SELECT query_id, code8, share, CASE CAST(substr(code8, 1, 2) AS INTEGER) % 3 WHEN 0 THEN 'класс ' || substr(code8, 1, 5) WHEN 1 THEN 'раздел ' || substr(code8, 1, 2) ELSE sample END AS name FROM shares JOIN cn USING (code8)",
    "new_company_points": with_(REGISTRY_SQL, _SEARCH, _NEW, _POINTS) + " SELECT query_id, inn, CASE WHEN inn LIKE '%7' THEN round(total * 0.5, 1) ELSE total END AS score FROM pt",
    "newcomer_recall_at": "SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN rank > 0 AND rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 4) AS {c}" for c, k in (("matched", 1 << 40), ("top10", 10), ("top50", 50), ("top200", 200))) + f" FROM ({search_queries.ORACLES['newcomer_recall']})",
    "registry_merge": with_(REGISTRY_SQL, "a AS (SELECT * FROM registry WHERE CAST(inn AS BIGINT) % 2 = 0)", "b AS (SELECT inn, 'cached ' || inn AS name, CASE WHEN CAST(inn AS BIGINT) % 2 = 0 THEN '+8' || inn END AS phone, inn || '@example.org' AS email FROM registry WHERE CAST(inn AS BIGINT) % 3 = 0)")
      + " SELECT coalesce(a.inn, b.inn) AS inn, coalesce(a.name, b.name) AS name, okved_main, coalesce(b.phone, a.phone) AS phone, email FROM a FULL JOIN b ON a.inn = b.inn",
    "short_names": with_(REGISTRY_SQL) + " SELECT inn, CASE CAST(inn AS BIGINT) % 4 WHEN 0 THEN 'ООО ' || name WHEN 1 THEN 'АО ' || name WHEN 2 THEN 'ПАО ' || name ELSE 'ИП Иванов Иван' END AS short_name FROM registry",
    "cleaned_subjects": with_() + " SELECT lot_id, subject FROM lots",
    "text_intents": with_() + " SELECT p_partkey AS part, CASE p_partkey % 5 WHEN 0 THEN 'goods' WHEN 1 THEN 'services' WHEN 2 THEN 'services' WHEN 3 THEN 'goods' END AS intent FROM parts",
    "plural_forms": with_() + " SELECT lot_id, lot_id || CASE WHEN lot_id % 100 BETWEEN 11 AND 14 THEN ' лотов' WHEN lot_id % 10 = 1 THEN ' лот' WHEN lot_id % 10 BETWEEN 2 AND 4 THEN ' лота' ELSE ' лотов' END AS said FROM lots",
    "pasted_items": with_() + " SELECT p_size, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS at, product_name || CASE WHEN p_partkey % 3 = 1 THEN '; 5 шт' ELSE '' END AS product_name, CASE WHEN p_partkey % 3 = 0 THEN okpd2_code ELSE '' END AS okpd2_code FROM parts",
    "stacked_uploads": with_() + " SELECT 0 AS file, CAST(p_partkey AS INTEGER) AS row, product_name, '' AS okpd2_code FROM parts WHERE p_size <= 10 UNION ALL SELECT 1, CAST(p_partkey AS INTEGER), product_name, okpd2_code FROM parts WHERE p_size > 40",
    "batch_capped": with_(_UPLOAD) + f" SELECT CAST(row_number() OVER (ORDER BY min(row)) AS INTEGER) AS query_id, procedure_id FROM up GROUP BY procedure_id QUALIFY query_id <= {CAP}",
    "hash_sample": with_() + f" SELECT lot_id, platform FROM lots WHERE publish_date >= DATE '{CUTOFF}' AND lot_id IN (SELECT lot_id FROM bids WHERE is_winner) ORDER BY md5('0/' || lot_id), lot_id LIMIT {SAMPLE}",
    "stratified_sample": f"""WITH pool AS ({mart_queries.ORACLES['balanced_lot_pool']}), a AS (SELECT *, md5('0/' || lot_id) AS h, row_number() OVER (PARTITION BY platform, kind, size_band, class_code ORDER BY md5('0/' || lot_id), lot_id) AS again, dense_rank() OVER (ORDER BY platform) AS pn FROM pool),
 b AS (SELECT *, row_number() OVER (PARTITION BY platform, kind, size_band ORDER BY again, h, lot_id) AS place FROM a)
 SELECT lot_id, platform, kind, size_band, class_code, CAST(place AS INTEGER) AS place FROM b WHERE place <= CASE WHEN (pn + CASE WHEN kind = 'services' THEN 1 ELSE 0 END + CASE WHEN size_band = 'multi' THEN 1 ELSE 0 END) % 2 = 1 THEN 3 ELSE 2 END""",
    "company_cards": with_(*_ALL, f"rs AS ({_REASONS})") + """ SELECT query_id, inn, CASE WHEN r.inn IS NOT NULL THEN r.name ELSE 'ООО ' || rs.inn END AS company_name, CASE msp_category WHEN 'микро' THEN 'micro' WHEN 'малое' THEN 'small' WHEN 'среднее' THEN 'medium' ELSE 'unknown' END AS size_class,
 CASE WHEN r.inn IS NOT NULL THEN 'Реестр МСП,' ELSE '' END || 'ЕГРЮЛ' AS sources, CASE WHEN rs.inn LIKE '%7' THEN 'Внимание: состоит в реестре недобросовестных поставщиков с 01.02.2020' ELSE coalesce(nullif(split_part(reasons, ' | ', 1), ''), 'Ранее состоял в реестре недобросовестных поставщиков (исключён)') END AS first_reason,
 r.inn IS NOT NULL AS in_msp_registry FROM rs LEFT JOIN registry r USING (inn)""",
    "batch_summary": with_(*_ALL, _NEW, _POINTS, _EXTERNAL, _MESSAGE, "rn AS (SELECT query_id, place, coalesce(name, 'ИНН ' || inn) AS name FROM ranked LEFT JOIN registry USING (inn) WHERE place <= 10)", "f AS (SELECT query_id, count(*) AS found, list(name ORDER BY place) AS names FROM rn GROUP BY query_id)",
      "x AS (SELECT query_id, count(*) AS new FROM ex GROUP BY query_id)", "g AS (SELECT query_id, string_agg(code8, ', ' ORDER BY place) AS codes FROM given WHERE place <= 3 GROUP BY query_id)", "sz AS (SELECT query_id, count(*) AS positions FROM spec GROUP BY query_id)")
      + """ SELECT 'P' || query_id AS procedure_id, '' AS lot_id, text AS name, CAST(positions AS INTEGER) AS positions, coalesce(codes, '') AS codes, CASE query_id % 3 WHEN 0 THEN 'товар' WHEN 1 THEN 'работа/услуга' ELSE '' END AS type, CASE level WHEN 'high' THEN 'высокая' WHEN 'medium' THEN 'средняя' ELSE '' END AS confidence, message AS note,
 coalesce(found, 0) AS found, coalesce(new, 0) AS new, coalesce(names[1], '') AS first, coalesce(names[2], '') AS second, coalesce(names[3], '') AS third FROM cards LEFT JOIN f USING (query_id) LEFT JOIN x USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN ms USING (query_id) LEFT JOIN sz USING (query_id)""",
    "batch_recommendations": with_(*_ALL, _NEW, _POINTS, _EXTERNAL, _STATUS, f"rs AS ({_REASONS})", """u AS (SELECT query_id, 0 AS kind, st.place, inn, status, score, array_to_string(list_slice(string_split(reasons, ' | '), 1, 3), ' | ') AS reasons FROM st JOIN rs USING (query_id, inn) WHERE st.place <= 10
 UNION ALL SELECT query_id, 1, place, inn, NULL, total, '' FROM ex)""") + """ SELECT 'P' || query_id AS procedure_id, '' AS lot_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, place, inn) AS INTEGER) AS place, inn, coalesce(name, 'ИНН ' || inn) AS name, CASE kind WHEN 0 THEN 'история закупок' ELSE 'новая компания (реестр МСП)' END AS source,
 CAST(NULL AS VARCHAR) AS role, status, score, reasons, coalesce(phone, '') AS phone, '' AS email, coalesce(okved_main, '') AS okved FROM u LEFT JOIN registry USING (inn)""",
}
