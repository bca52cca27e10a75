"""Retrieval, ranking and new-company queries, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import fixed_values as V
from bidloom.functions.lineage import fresh_folder, kept
from bidloom.functions.scalars import intent, level, terms
from bidloom.operators import companies as C
from bidloom.operators import evaluation as E
from bidloom.operators import language as L
from bidloom.operators import marts as M
from bidloom.operators import ranking as R
from bidloom.operators import retrieval as T
from bidloom.operators import search_index as S
from bidloom.operators.search import Search, lot_index
from bidloom.plans.mart_queries import SO, _codes_sql, with_
from bidloom.sources import standin as D
from bidloom.sources.standin import CARDS_SQL, CUTOFF, MARKET, REGISTRY_SQL

MAX_DF = 0.5


def _text_index(spark: SparkSession, d: str) -> T.Index:
    docs = D.read(spark, d, "documents").select(F.col("doc_id").alias("id"), terms(F.col("text"), stopwords=(), cleaned=False).alias("terms"))
    return T.fit(docs, 2, 0.3)


def tfidf_idf(spark: SparkSession, d: str) -> DataFrame:
    return _text_index(spark, d).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents most similar to each benchmark text."""
    index = _text_index(spark, d)
    asked = D.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(terms(F.col("text"), stopwords=(), cleaned=False)).alias("term"))
    return T.similar(T.query_vectors(asked, index.idf), index, 10).select("query_id", "id", F.round("sim", 6).alias("sim"), "place")


def vocab_token_counts(spark: SparkSession, d: str) -> DataFrame:
    texts = D.read(spark, d, "documents").select("text").distinct()
    return texts.select(F.explode(terms(F.col("text"), stopwords=(), cleaned=False)).alias("token")).filter(F.length("token") >= 2).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3")


def lemma_class_prob(spark: SparkSession, d: str) -> DataFrame:
    """token, cls, p, place: the classes in which a word of item names stands. The stand-in's words spread over hundreds of classes, so the least share is a tenth of the usual one."""
    pairs = D.items(spark, d).select("product_name", level(F.col("okpd2_code"), 5).alias("cls")).distinct()
    found = L.class_probabilities(pairs.select("cls", F.explode(F.array_distinct(terms(F.col("product_name"), stopwords=(), cleaned=False))).alias("lemma")), share=0.005)
    return found.select(F.col("lemma").alias("token"), "cls", F.round("p", 6).alias("p"), "place")


class Scene(Search):
    """The search over the stand-in tables, with what the queries of this module need besides. Its few words stand in many lots, so that more of them are kept."""

    def __init__(self, spark: SparkSession, d: str, index: S.Kept | None = None):
        lots, items = D.lots(spark, d), D.items(spark, d)
        super().__init__(kept(D.cards(spark, d)), lots, items, D.bids(spark, d), CUTOFF, MARKET, index, max_df=MAX_DF)
        self.registry = D.registry(spark, d)

    def item_index(self) -> tuple[T.Index, DataFrame]:
        rows = kept(M.item_counts(self.items).withColumn("id", F.struct("product_name", "code8")))
        return T.fit(rows.select("id", terms(F.col("product_name")).alias("terms")), 2, MAX_DF), rows

    def votes(self) -> tuple[DataFrame, DataFrame]:
        index, rows = self.item_index()
        # Names and codes identify items, so that ties between equally similar ones go by these.
        top = T.similar(T.query_vectors(self.query_terms, index.idf, weighted=True), index, V.VOTE_ITEMS)
        return T.item_votes(top, rows), T.lot_votes(self.similar, self.lot_codes)

    def new_plans(self) -> DataFrame:
        return C.activity_plans(self.given, C.okved_mapping(M.class_wins(M.supplier_codes(self.bids, self.items, self.lots)), self.registry))

    def new_scores(self) -> DataFrame:
        pool = M.not_in(self.registry.filter(F.length("inn") == 10), self.bids, "inn")
        return C.pool_scores(self.new_plans(), pool, self.given, MARKET)


def similar_lots(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).similar


def okpd_vote_items(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).votes()[0].select("query_id", "code8", F.round("votes", 6).alias("votes"), "matched_item")


def okpd_vote_lots(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).votes()[1].select("query_id", "code8", F.round("votes", 6).alias("votes"))


def okpd_fused(spark: SparkSession, d: str) -> DataFrame:
    return T.fused_votes(*Scene(spark, d).votes()).select("query_id", "code8", F.round("votes", 9).alias("votes"))


def _intents(scene: Scene) -> DataFrame:
    """Even queries look for goods, odd ones for services: the stand-in texts hold no word of either kind."""
    return scene.cards.select("query_id", F.coalesce(intent(F.col("text")), F.when(F.col("query_id") % 2 == 0, "goods").otherwise("services")).alias("intent"))


def okpd_intent_filtered(spark: SparkSession, d: str) -> DataFrame:
    scene = Scene(spark, d)
    fused = T.fused_votes(*scene.votes())
    return T.intent_votes(fused, _intents(scene)).select("query_id", "code8", F.round("votes", 9).alias("votes"))


def okpd_predicted(spark: SparkSession, d: str) -> DataFrame:
    """The codes predicted from words alone, short codes absorbed."""
    scene = Scene(spark, d)
    return T.code_shares(T.absorbed(T.intent_votes(T.fused_votes(*scene.votes()), _intents(scene))))


def code_prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).shares


def lot_code_match(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).matched.groupBy("query_id", "match").agg(F.count("*").alias("lots"))


def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).features().select("query_id", "inn", *[F.round(f"f_{k}", 6).alias(f"f_{k}") for k in V.WEIGHTS])


def ranked_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty suppliers of each procurement."""
    return Scene(spark, d).ranked().select("query_id", "place", "inn", "score")


def supplier_status(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).ranked(None).select("query_id", "inn", "status")


def rnp_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose number ends in 7 stand on the register of unfair suppliers."""
    scene = Scene(spark, d)
    flagged = scene.bids.select("inn").distinct().select("inn", F.col("inn").endswith("7").alias("in_rnp"))
    return R.penalised(scene.ranked(), flagged).select("query_id", "place", "inn", "score")


def confidence_level(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).confidence().select("query_id", "level", "similar_lots", "top_similarity", F.array_join("unmatched", ",").alias("unmatched"))


def factor_contributions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, inn, factor, points: what each factor adds to a ranked supplier's score."""
    return R.contributions(Scene(spark, d).ranked()).select("query_id", "inn", F.inline("factors"))


def reasons_text(spark: SparkSession, d: str) -> DataFrame:
    return R.reasons(Scene(spark, d).ranked(), MARKET).select("query_id", "inn", "place", F.array_join("reasons", " | ").alias("reasons"))


def supplier_evidence_own(spark: SparkSession, d: str) -> DataFrame:
    """The lots that speak for a supplier, with the customer's own one first."""
    return Scene(spark, d).evidence().select("query_id", "inn", F.array_join(F.transform("evidence", lambda e: e["lot_id"].cast("string")), ",").alias("lots"))


def kept_ranked_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty suppliers of each procurement, read off a kept index to which the lots of the last year were added."""
    lots, items = D.lots(spark, d), D.items(spark, d)
    late = F.col("publish_date") >= F.lit("1999-01-01").cast("date")
    index = lot_index(lots.filter(~late), items, fresh_folder(spark), 2, MAX_DF)
    index = S.added(index, T.lot_terms(M.lot_docs(lots.filter(late), items)))
    return Scene(spark, d, index).ranked().select("query_id", "place", "inn", "score")


def search_responses(spark: SparkSession, d: str) -> DataFrame:
    """What a caller gets of each search, in parts that SQL can state: level, candidates, codes and suppliers with their first lots."""
    rows = Scene(spark, d).responses()
    supplier = lambda s: F.concat(s["inn"], F.lit(":"), s["status"], F.lit(":"), F.coalesce(F.get(s["evidence"], F.lit(0))["lot_id"].cast("string"), F.lit("")))
    return rows.select("query_id", "level", "total_candidates", F.array_join("okpd2.code", ",").alias("codes"), F.array_join(F.transform("suppliers", supplier), ",").alias("suppliers"))


def supplier_evidence(spark: SparkSession, d: str) -> DataFrame:
    scene = Scene(spark, d)
    return R.evidence(scene.matched, scene.lots, scene.near_bids, scene.cards).select("query_id", "inn", F.array_join(F.transform("evidence", lambda e: e["lot_id"].cast("string")), ",").alias("lots"))


def new_company_scores(spark: SparkSession, d: str) -> DataFrame:
    return Scene(spark, d).new_scores().select("query_id", "inn", "okved5", "local", F.round("match", 6).alias("match"), F.round("pool_score", 6).alias("pool_score"))


def new_company_capped(spark: SparkSession, d: str) -> DataFrame:
    """Ten new companies for each procurement, spread over activities and regions, with their points."""
    scene = Scene(spark, d)
    unfair = scene.registry.select("inn", F.col("inn").endswith("7").alias("in_rnp"))
    return C.new_company_points(C.diverse(scene.new_scores()), scene.registry, unfair, MARKET).select("query_id", "place", "inn", "okved5", "score")


def newcomer_recall(spark: SparkSession, d: str) -> DataFrame:
    """Where the pool's ranking for a nation's procurement puts each company of that nation."""
    scene = Scene(spark, d)
    truth = scene.registry.select(F.col("region_code").cast("int").alias("query_id"), "inn")
    return E.newcomer_ranks(scene.new_scores(), truth)


def company_cards(spark: SparkSession, d: str) -> DataFrame:
    """Ranked suppliers with what the registry says of them."""
    scene = Scene(spark, d)
    roster = scene.bids.select("inn").distinct().select("inn", F.concat(F.lit("ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ "), "inn").alias("name"), F.lit(None).cast("string").alias("head"), F.lit(True).alias("is_active"))
    unfair = scene.bids.select("inn").distinct().select("inn", F.col("inn").endswith("7").alias("in_rnp"), F.lit(True).alias("was_in_rnp"), F.lit("01.02.2020").alias("since"))
    out = C.enriched(R.reasons(scene.ranked(), MARKET), scene.registry, roster, unfair)
    return out.select("query_id", "inn", "company_name", "size_class", F.array_join("sources", ",").alias("sources"), F.element_at("reasons", 1).alias("first_reason"), "in_msp_registry")


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_idf, tfidf_topk, vocab_token_counts, lemma_class_prob, similar_lots, okpd_vote_items, okpd_vote_lots, okpd_fused, okpd_intent_filtered, okpd_predicted, code_prefix_expand, lot_code_match,
        candidate_features, ranked_suppliers, supplier_status, rnp_penalty, confidence_level, factor_contributions, reasons_text, supplier_evidence, supplier_evidence_own, kept_ranked_suppliers, search_responses, new_company_scores, new_company_capped, newcomer_recall, company_cards,
    )
}


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower(coalesce({x}, '')), 'ё', 'е'), '{V.TOKEN}'), lambda t: len(t) >= 2 OR regexp_full_match(t, '[0-9]+'))"


def _index(tf: str, n: str, prefix: str, max_df: float) -> str:
    p = prefix
    return f"""{p}tf AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM ({tf}) GROUP BY id, term), {p}n AS ({n}),
{p}idf AS (SELECT term, count(*) AS df, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM {p}tf, {p}n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= {max_df} * n),
{p}post AS (SELECT term, id, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS dw FROM (SELECT term, id, tf * idf AS w FROM {p}tf JOIN {p}idf USING (term)))"""


_DOCS = _index(f"SELECT doc_id AS id, unnest({tokens('text')}) AS term FROM documents", "SELECT count(*) AS n FROM documents", "t", 0.3)
_BENCH = f"""bq AS (SELECT query_id, term, tf * idf AS w FROM (SELECT item_id AS query_id, term, 1 + ln(count(*)) AS tf FROM (SELECT item_id, unnest({tokens("text")}) AS term FROM benchmark) GROUP BY ALL) JOIN tidf USING (term)),
bv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM bq),
bs AS (SELECT query_id, id, round(sum(w * dw), 9) AS sim FROM bv JOIN tpost USING (term) GROUP BY ALL),
bp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS place FROM bs WHERE sim > 0)"""

_SEARCH = (
    CARDS_SQL
    + ", nm AS (SELECT lot_id, array_to_string(list_sort(list(DISTINCT product_name)), ' | ') AS it FROM items GROUP BY lot_id), "
    + _index(f"SELECT lot_id AS id, unnest(list_concat({tokens('subject')}, {tokens('it')}, {tokens('it')})) AS term FROM lots LEFT JOIN nm USING (lot_id)", "SELECT count(*) AS n FROM lots", "l", MAX_DF)
    + f""",
qt AS (SELECT query_id, term, max(weight) AS weight FROM (SELECT query_id, unnest({tokens("text")}) AS term, 1.0::DOUBLE AS weight FROM cards
  UNION ALL SELECT query_id, unnest({tokens("product_name")}), 0.7::DOUBLE FROM spec WHERE query_id IN (SELECT query_id FROM cards)) GROUP BY ALL),
qv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, term, weight * idf AS w FROM qt JOIN lidf USING (term))),
sim0 AS (SELECT query_id, id, round(sum(w * dw), 9) AS sim FROM qv JOIN lpost USING (term) JOIN lots ON lot_id = id WHERE publish_date < DATE '{CUTOFF}' GROUP BY query_id, id),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS place FROM sim0 WHERE sim > 0) WHERE place <= {V.TOP_LOTS}),
lcodes AS (SELECT DISTINCT lot_id, substr(okpd2_code, 1, 8) AS code8 FROM items WHERE okpd2_code IS NOT NULL),
sp AS (SELECT query_id, substr(trim(okpd2_code), 1, 8) AS code8, row_number() OVER (PARTITION BY query_id ORDER BY product_name, okpd2_code) AS pos FROM spec WHERE query_id IN (SELECT query_id FROM cards)),
gv AS (SELECT query_id, code8, count(*) AS n, min(pos) AS first FROM sp GROUP BY ALL),
given AS (SELECT * FROM (SELECT query_id, code8, round(n / sum(n) OVER (PARTITION BY query_id), 3) AS share, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS place FROM gv) WHERE place <= 5),
known AS (SELECT DISTINCT substr(okpd2_code, 1, 8) AS code8 FROM items WHERE length(okpd2_code) >= 5),
shares AS (SELECT query_id, k.code8, max(share) AS share FROM given g JOIN known k ON starts_with(k.code8, g.code8) OR starts_with(g.code8, k.code8) GROUP BY ALL),
hits AS (SELECT DISTINCT s.query_id, s.id FROM sim s JOIN lcodes c ON c.lot_id = s.id JOIN shares h ON h.query_id = s.query_id AND h.code8 = c.code8),
matched AS (SELECT s.*, CASE WHEN s.query_id IN (SELECT query_id FROM shares) AND s.id IN (SELECT lot_id FROM lcodes) AND h.id IS NULL THEN {V.CODE_MISMATCH}::DOUBLE ELSE 1.0::DOUBLE END AS match FROM sim s LEFT JOIN hits h USING (query_id, id))"""
)

_FEATURES = f"""nb AS (SELECT lot_id, count(*) AS n_bidders FROM bids GROUP BY lot_id),
rows0 AS (SELECT query_id, inn, sim, match, platform, l.customer_inn, publish_date, is_winner, n_bidders, sim >= {V.SIMILAR_ENOUGH} AND match = 1.0 AS strict FROM matched JOIN lots l ON l.lot_id = id JOIN bids b ON b.lot_id = id JOIN nb ON nb.lot_id = id),
a AS (SELECT query_id, inn, sum(sim * sim * match * CASE WHEN is_winner THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * pow(0.5::DOUBLE, greatest(date_diff('day', publish_date, DATE '{CUTOFF}'), 0) / 365.0::DOUBLE)) AS text,
  count(*) FILTER (WHERE strict AND is_winner) AS wins, count(*) FILTER (WHERE strict) AS parts, count(*) FILTER (WHERE strict AND platform = 'ESHOP') AS em_parts, count(*) FILTER (WHERE strict AND platform = 'ESHOP' AND is_winner) AS em_wins,
  count(*) FILTER (WHERE strict AND platform <> 'ESHOP' AND is_winner) AS ais_wins, count(DISTINCT customer_inn) FILTER (WHERE strict) AS customers, max(publish_date) FILTER (WHERE strict) AS last, count(*) FILTER (WHERE strict AND platform = 'ESHOP' AND is_winner AND n_bidders > 1) AS comp_wins FROM rows0 GROUP BY ALL),
c8 AS ({_codes_sql(f"WHERE l.publish_date < DATE '{CUTOFF}'", "substr(okpd2_code, 1, 8)", "code8")}),
o AS (SELECT query_id, inn, sum(share * (n_wins + (n_lots - n_wins) * 0.5::DOUBLE)) AS okpd_exp, sum(n_lots) AS code_lots, sum(n_wins) AS code_wins FROM shares JOIN c8 USING (code8) GROUP BY ALL),
own AS (SELECT c.query_id, l.lot_id FROM cards c JOIN lots l USING (customer_inn) WHERE l.publish_date < DATE '{CUTOFF}'),
rel AS (SELECT DISTINCT query_id, lot_id FROM own JOIN lcodes USING (lot_id) WHERE (query_id, substr(code8, 1, 5)) IN (SELECT (query_id, substr(code8, 1, 5)) FROM given)),
h AS (SELECT o2.query_id, inn, sum(CASE WHEN r.lot_id IS NULL THEN 0.0::DOUBLE WHEN is_winner THEN 1.0 ELSE 0.5 END) AS rel_w, sum(CASE WHEN is_winner THEN 1.0::DOUBLE ELSE 0.5 END) AS any_w, count(*) FILTER (WHERE r.lot_id IS NOT NULL AND is_winner) AS rel_wins, count(*) FILTER (WHERE is_winner) AS cust_wins FROM own o2 LEFT JOIN rel r USING (query_id, lot_id) JOIN bids USING (lot_id) GROUP BY o2.query_id, inn),
pb AS (SELECT bids.*, publish_date, start_price, platform FROM bids JOIN lots USING (lot_id) WHERE publish_date < DATE '{CUTOFF}'),
pk AS (SELECT inn, kpp, row_number() OVER (PARTITION BY inn ORDER BY count(*) DESC, kpp) AS rn FROM pb WHERE kpp IS NOT NULL GROUP BY inn, kpp),
pf AS (SELECT inn, count(DISTINCT lot_id) AS n_lots, count(DISTINCT lot_id) FILTER (WHERE platform = 'ESHOP') AS n_eshop, count(DISTINCT lot_id) FILTER (WHERE platform = 'GZ') AS n_aisgz, count(DISTINCT lot_id) FILTER (WHERE platform = 'ESHOP' AND is_winner) AS n_eshop_wins, median(start_price) AS med FROM pb GROUP BY inn),
profile AS (SELECT pf.*, CASE WHEN kpp IS NOT NULL AND substr(kpp, 1, 2) <> '00' THEN substr(kpp, 1, 2) ELSE substr(inn, 1, 2) END AS region FROM pf LEFT JOIN (SELECT inn, kpp FROM pk WHERE rn = 1) USING (inn)),
cand AS (SELECT query_id, inn FROM a UNION SELECT query_id, inn FROM (SELECT query_id, inn, row_number() OVER (PARTITION BY query_id ORDER BY okpd_exp DESC, inn) AS rn FROM o) WHERE rn <= {V.EXPERIENCED} UNION SELECT query_id, inn FROM h WHERE rel_w > 0),
j AS (SELECT cand.query_id, cand.inn, a.* EXCLUDE (query_id, inn), o.* EXCLUDE (query_id, inn), h.* EXCLUDE (query_id, inn), p.* EXCLUDE (inn), c.price, c.platform
  FROM cand LEFT JOIN a USING (query_id, inn) LEFT JOIN o USING (query_id, inn) LEFT JOIN h USING (query_id, inn) LEFT JOIN profile p USING (inn) JOIN cards c USING (query_id)),
feat AS (SELECT *, coalesce(ln(1 + 10 * text) / ln(1 + 10 * max(text) OVER w), 0) AS f_text, ln(1 + coalesce(okpd_exp, 0)) / ln(1 + max(okpd_exp) OVER w) AS f_okpd,
  CASE WHEN em_parts > 0 THEN (em_wins + 1) / (em_parts + 3) WHEN ais_wins > 0 THEN {V.WIN_PRIOR}::DOUBLE ELSE 0.5::DOUBLE * coalesce(n_eshop_wins / nullif(n_eshop, 0), {V.WIN_PRIOR}::DOUBLE) END AS f_wins,
  coalesce(pow(0.5::DOUBLE, greatest(date_diff('day', last, DATE '{CUTOFF}'), 0) / 365.0::DOUBLE), 0) AS f_recency, CASE WHEN n_lots > 0 THEN least(coalesce(code_lots, 0) / n_lots, 1.0::DOUBLE) ELSE 0 END AS f_focus,
  CASE region WHEN '01' THEN 1.0::DOUBLE WHEN '02' THEN 0.5 ELSE 0 END AS f_region, least(coalesce(customers, 0) / 10, 1.0::DOUBLE) AS f_breadth,
  coalesce(least(ln(1 + rel_w) / ln(11.0::DOUBLE), 1.0::DOUBLE), 0) AS f_customer_rel, coalesce(least(ln(1 + any_w) / ln(41.0::DOUBLE), 1.0::DOUBLE), 0) AS f_customer_any,
  CASE WHEN price > 0 AND med > 0 THEN exp(-pow(ln(price / med), 2) / 4.5::DOUBLE) ELSE 0 END AS f_price, CASE WHEN n_lots > 0 THEN CASE WHEN platform = 'ESHOP' THEN n_eshop ELSE n_aisgz END / n_lots ELSE 0 END AS f_platform,
  max(any_w IS NOT NULL) OVER w AS has_history FROM j WINDOW w AS (PARTITION BY query_id))"""

_CONFIDENCE = f"""top30 AS (SELECT query_id, id FROM sim WHERE place <= 30), tops AS (SELECT query_id, count(*) AS tops FROM top30 GROUP BY ALL),
th AS (SELECT query_id, term, count(*) AS hits FROM (SELECT DISTINCT query_id, term FROM qt) JOIN lpost USING (term) JOIN top30 USING (query_id, id) GROUP BY ALL),
um AS (SELECT query_id, list_sort(list(DISTINCT term)) AS unmatched FROM qt LEFT JOIN th USING (query_id, term) LEFT JOIN tops USING (query_id) LEFT JOIN lidf USING (term) WHERE df IS NULL OR coalesce(hits, 0) / tops < 0.05 GROUP BY query_id),
conf0 AS (SELECT query_id, count(*) FILTER (WHERE sim >= {V.SIMILAR_ENOUGH}) AS n, max(sim) AS top FROM sim GROUP BY query_id),
conf AS (SELECT q.query_id, coalesce(n, 0) AS n, coalesce(top, 0) AS top, unmatched, CASE WHEN coalesce(n, 0) < 10 OR coalesce(top, 0) < 0.3 OR unmatched IS NOT NULL OR coalesce(n, 0) < 30 THEN 'medium' ELSE 'high' END AS level
  FROM (SELECT DISTINCT query_id FROM qt) q LEFT JOIN conf0 USING (query_id) LEFT JOIN um USING (query_id))"""

_HISTORY = " * CASE WHEN has_history THEN 1 ELSE 0 END"
_SUM = " + ".join(f"{w}::DOUBLE * f_{k}" + (" * CASE WHEN has_history THEN 1 ELSE 0 END" if V.NEEDS.get(k) == "customer_inn" else "") for k, w in V.WEIGHTS.items())
_NORM = " + ".join(f"{w}::DOUBLE" + (" * CASE WHEN has_history THEN 1 ELSE 0 END" if V.NEEDS.get(k) == "customer_inn" else "") for k, w in V.WEIGHTS.items())
_RANKED = f"""rk0 AS (SELECT f.*, level, round(({_SUM}) / (({_NORM}) / CASE level WHEN 'high' THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END), 9) AS raw FROM feat f JOIN conf USING (query_id)),
ranked AS (SELECT *, round(raw * 100, 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, inn) AS place FROM rk0)"""

_SHARE = "least(coalesce(code_lots, 0) / n_lots::DOUBLE, 1.0::DOUBLE)"
_REASONS = f""" SELECT query_id, inn, CAST(place AS INTEGER) AS place, concat_ws(' | ',
  CASE WHEN rel_wins > 0 THEN 'Уже выигрывал у этого заказчика закупки этой категории: ' || rel_wins WHEN rel_w > 0 THEN 'Участвовал в закупках этого заказчика по этой категории' WHEN cust_wins > 0 THEN 'Уже работал с этим заказчиком (побед: ' || cust_wins || ')' END,
  CASE WHEN em_parts > 0 THEN 'Похожие закупки (ESHOP): участвовал в ' || em_parts || ', победил в ' || em_wins || CASE WHEN comp_wins > 0 THEN ', из них при 2+ участниках — ' || comp_wins WHEN em_wins > 0 THEN '; во всех был единственным участником' ELSE '' END END,
  CASE WHEN ais_wins > 0 THEN 'Победитель похожих процедур: ' || ais_wins || ' (GZ)' END,
  CASE WHEN parts > 0 THEN 'Последняя похожая закупка — ' || last WHEN text IS NOT NULL THEN 'Участвовал в закупках с общими словами в названии, но близких по предмету среди них нет' END,
  CASE WHEN customers > 1 THEN 'В похожих закупках работал с ' || customers || ' разными заказчиками' END,
  CASE WHEN code_lots IS NOT NULL AND n_lots >= 10 AND {_SHARE} >= 0.4 THEN 'Профильный поставщик: ' || CAST(round({_SHARE} * 100) AS INTEGER) || '% его закупок — в этой категории'
       WHEN code_lots IS NOT NULL AND n_lots >= 10 AND {_SHARE} < 0.1 THEN 'Универсальный поставщик: на эту категорию приходится ' || CAST(round({_SHARE} * 100) AS INTEGER) || '% его закупок' END,
  CASE WHEN region = '01' THEN 'Стоит на учёте в домашнем регионе' WHEN region = '02' THEN 'Стоит на учёте в соседнем регионе' END,
  CASE WHEN n_lots >= 20 THEN 'Всего закупок: ' || n_lots END) AS reasons FROM ranked WHERE place <= 20"""

_VOTES = (
    f"ic AS (SELECT row_number() OVER () AS id, * FROM (SELECT product_name, substr(okpd2_code, 1, 8) AS code8, count(*) AS cnt FROM items WHERE okpd2_code IS NOT NULL AND length(product_name) > 2 GROUP BY ALL)), "
    + _index(f"SELECT id, unnest({tokens('product_name')}) AS term FROM ic", "SELECT count(*) AS n FROM ic", "x", MAX_DF)
    + f""",
iv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, term, weight * idf AS w FROM qt JOIN xidf USING (term))),
isim AS (SELECT query_id, id, round(sum(w * dw), 9) AS sim FROM iv JOIN xpost USING (term) GROUP BY ALL),
itop AS (SELECT * FROM (SELECT query_id, sim, ic.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, product_name, code8) AS place FROM isim JOIN ic USING (id)) WHERE place <= {V.VOTE_ITEMS}),
vi AS (SELECT query_id, code8, sum(pow(sim, 3) * ln(1 + cnt)) AS vi, arg_max(product_name, row(sim, product_name)) AS matched_item FROM itop GROUP BY ALL),
ncodes AS (SELECT lot_id, count(*) AS codes FROM lcodes GROUP BY lot_id),
vl AS (SELECT query_id, code8, sum(pow(sim, 2) / codes) AS vl FROM sim JOIN lcodes c ON c.lot_id = id JOIN ncodes n ON n.lot_id = id WHERE place <= {V.VOTE_LOTS} GROUP BY ALL),
fu AS (SELECT query_id, code8, 0.5::DOUBLE * coalesce(vi, 0) / sum(vi) OVER (PARTITION BY query_id) + 0.5::DOUBLE * coalesce(vl, 0) / sum(vl) OVER (PARTITION BY query_id) AS votes FROM vi FULL JOIN vl USING (query_id, code8)),
fi AS (SELECT query_id, code8, fits, CASE WHEN fits THEN votes * 4 ELSE votes END AS votes FROM (SELECT *, (CAST(substr(code8, 1, 2) AS INTEGER) <= 32) = (query_id % 2 = 0) AS fits FROM fu)),
fl AS (SELECT *, first_value(fits) OVER (PARTITION BY query_id ORDER BY votes DESC, code8 DESC) AS led FROM fi)"""
)

_NEW = f"""{SO}, cw AS (SELECT inn, substr(okpd2_code, 1, 5) AS cls, sum(n_wins) AS w FROM so WHERE n_wins > 0 GROUP BY ALL),
mp AS (SELECT cls, substr(okved_main, 1, 5) AS okved5, sum(w) AS w FROM cw JOIN registry USING (inn) GROUP BY ALL),
mt AS (SELECT *, sum(w) OVER (PARTITION BY cls) AS total, row_number() OVER (PARTITION BY cls ORDER BY w DESC, okved5) AS rn FROM mp),
wanted AS (SELECT query_id, substr(code8, 1, 5) AS cls, share FROM given WHERE place <= 2),
plan AS (SELECT query_id, cls AS okved5, 2.0::DOUBLE * share AS weight FROM wanted UNION ALL SELECT query_id, okved5, (1.5::DOUBLE * w / total + 0.5) * share FROM wanted JOIN mt USING (cls) WHERE rn <= 4 AND okved5 <> cls AND w / total >= 0.08),
pool AS (SELECT *, substr(okved_main, 1, 5) AS main5 FROM registry WHERE length(inn) = 10 AND inn NOT IN (SELECT inn FROM bids)),
keys AS (SELECT inn, main5 AS okved5, 1.0::DOUBLE AS part FROM pool UNION ALL SELECT DISTINCT inn, substr(x, 1, 5), 0.4::DOUBLE FROM (SELECT inn, unnest(string_split(okved_extra, ';')) AS x FROM pool)),
pm AS (SELECT query_id, inn, sum(weight * part) AS s, max(weight * part) AS match FROM plan JOIN keys USING (okved5) GROUP BY ALL),
news AS (SELECT query_id, inn, main5 AS okved5, region_code IN ('01', '02') AS local, match, round(s + 0.25::DOUBLE * ln(1 + employees) + CASE WHEN region_code = '01' THEN 0.2::DOUBLE ELSE 0 END, 9) AS pool_score
  FROM pm JOIN pool USING (inn) JOIN given g USING (query_id) WHERE g.place = 1 AND (CAST(substr(g.code8, 1, 2) AS INTEGER) <= 32 OR region_code IN ('01', '02')))"""

#: Short codes give their votes away one after another: the state is a query's list of codes.
_ABSORBED = """fz AS (SELECT query_id, code8, votes FROM fl WHERE NOT led OR fits),
sh AS (SELECT query_id, list(code8 ORDER BY length(code8), code8) AS codes FROM fz s WHERE length(code8) >= 5 AND EXISTS (SELECT 1 FROM fz o WHERE o.query_id = s.query_id AND o.code8 <> s.code8 AND starts_with(o.code8, s.code8)) GROUP BY query_id),
ab AS (SELECT query_id, 1 AS i, coalesce(codes, []) AS codes, list({'c': code8, 'v': votes}) AS st FROM fz LEFT JOIN sh USING (query_id) GROUP BY ALL
  UNION ALL SELECT query_id, i + 1, codes, list_transform(list_filter(st, lambda x: x.c <> codes[i]), lambda x: CASE WHEN x.c = heir THEN {'c': x.c, 'v': x.v + own} ELSE x END)
  FROM (SELECT *, list_filter(st, lambda x: x.c = codes[i])[1].v AS own, list_sort(list_transform(list_filter(st, lambda x: x.c <> codes[i] AND starts_with(x.c, codes[i])), lambda x: {'v': x.v, 'c': x.c}), 'DESC')[1].c AS heir FROM ab WHERE i <= len(codes))),
ax AS (SELECT query_id, x.c AS code8, x.v AS votes FROM (SELECT query_id, unnest(arg_max(st, i)) AS x FROM ab GROUP BY query_id)),
ay AS (SELECT *, votes / sum(votes) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, code8) AS place FROM ax)"""

#: The walk that spreads new companies over activities and regions: the state is the list of those taken.
_CAPPED = """wk AS (SELECT query_id, 1 AS i, list({'inn': inn, 'okved5': okved5, 'near': local, 'match': match} ORDER BY pool_score DESC, inn)[:400] AS r, list({'inn': inn, 'okved5': okved5, 'near': local, 'match': match})[:0] AS taken FROM news GROUP BY query_id
  UNION ALL SELECT query_id, i + 1, r, CASE WHEN len(list_filter(taken, lambda t: t.okved5 IS NOT DISTINCT FROM r[i].okved5)) < 6 AND (r[i].near OR len(list_filter(taken, lambda t: NOT t.near)) < 4) THEN list_append(taken, r[i]) ELSE taken END FROM wk WHERE i <= len(r) AND len(taken) < 10),
cap AS (SELECT query_id, unnest(arg_max(taken, i)) AS x, generate_subscripts(arg_max(taken, i), 1) AS place FROM wk GROUP BY query_id),
pts AS (SELECT query_id, place, inn, x.okved5 AS okved5, round(round(least(25::DOUBLE * x.match, 50.0), 1) + round(15::DOUBLE * least(ln(1 + coalesce(employees, 0)) / ln(101.0), 1.0), 1)
  + CASE WHEN TRY_CAST(right(coalesce(msp_since, ''), 4) AS INTEGER) <= 2023 THEN 5.0 WHEN TRY_CAST(right(coalesce(msp_since, ''), 4) AS INTEGER) IS NOT NULL THEN 2.0 ELSE 0.0 END
  + CASE region_code WHEN '01' THEN 5.0 WHEN '02' THEN 3.0 ELSE 0.0 END + CASE WHEN phone IS NOT NULL THEN 5.0 ELSE 0.0 END, 1)::DOUBLE AS points FROM cap JOIN registry ON registry.inn = x.inn)"""

_STATUS = """CASE WHEN coalesce(wins, 0) >= 3 AND (coalesce(em_parts, 0) < 3 OR em_wins / em_parts >= 0.25) THEN 'verified'
 WHEN coalesce(wins, 0) >= 1 OR coalesce(code_wins, 0) >= 3 THEN 'experienced' WHEN coalesce(em_parts, 0) > 0 THEN 'participant' ELSE 'category' END"""

#: A supplier's best lots of forty, and the customer's own lot first where none of them is the customer's.
_OWN = f"""e0 AS (SELECT query_id, b.inn, id, sim, is_winner, coalesce(l.customer_inn = c.customer_inn, false) AS same, row_number() OVER (PARTITION BY query_id, b.inn ORDER BY sim DESC, id, is_winner DESC) AS n
  FROM matched JOIN lots l ON l.lot_id = id JOIN bids b ON b.lot_id = id JOIN cards c USING (query_id) WHERE sim >= {V.SIMILAR_ENOUGH} AND match = 1.0),
e1 AS (SELECT query_id, inn, id, same, row_number() OVER (PARTITION BY query_id, inn ORDER BY same DESC, is_winner DESC, sim DESC, id) AS rn FROM e0 WHERE n <= 40),
e2 AS (SELECT query_id, inn, r.lot_id AS id, row_number() OVER (PARTITION BY query_id, inn ORDER BY is_winner DESC, publish_date DESC, r.lot_id) AS n FROM rel r JOIN bids USING (lot_id) JOIN lots USING (lot_id)),
e3 AS (SELECT query_id, inn, id, rn FROM e1 WHERE rn <= 3 UNION ALL SELECT query_id, inn, id, 0 FROM e2 WHERE n = 1 AND (query_id, inn) NOT IN (SELECT (query_id, inn) FROM e1 WHERE rn <= 3 AND same)),
e4 AS (SELECT query_id, inn, list(id ORDER BY rn)[:3] AS ids FROM e3 GROUP BY ALL)"""

ORACLES = {
    "tfidf_idf": f"WITH {_DOCS} SELECT term, df, round(idf, 6) AS idf FROM tidf",
    "tfidf_topk": f"WITH {_DOCS}, {_BENCH} SELECT query_id, id, round(sim, 6) AS sim, CAST(place AS INTEGER) AS place FROM bp WHERE place <= 10",
    "vocab_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM (SELECT DISTINCT text FROM documents)) WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 3",
    "lemma_class_prob": with_("p AS (SELECT DISTINCT product_name, substr(okpd2_code, 1, 5) AS cls FROM items)", f"c AS (SELECT token, cls, count(*) AS n FROM (SELECT cls, unnest(list_distinct({tokens('product_name')})) AS token FROM p) GROUP BY ALL)",
        "s AS (SELECT *, sum(n) OVER (PARTITION BY token) AS total, row_number() OVER (PARTITION BY token ORDER BY n DESC, cls) AS place FROM c)") + " SELECT token, cls, round(n / total, 6) AS p, CAST(place AS INTEGER) AS place FROM s WHERE total >= 5 AND n / total >= 0.005 AND place <= 5",
    "similar_lots": with_(_SEARCH) + " SELECT query_id, id, sim, CAST(place AS INTEGER) AS place FROM sim",
    "okpd_vote_items": with_(_SEARCH, _VOTES) + " SELECT query_id, code8, round(vi, 6) AS votes, matched_item FROM vi",
    "okpd_vote_lots": with_(_SEARCH, _VOTES) + " SELECT query_id, code8, round(vl, 6) AS votes FROM vl",
    "okpd_fused": with_(_SEARCH, _VOTES) + " SELECT query_id, code8, round(votes, 9) AS votes FROM fu",
    "okpd_intent_filtered": with_(_SEARCH, _VOTES) + " SELECT query_id, code8, round(votes, 9) AS votes FROM fl WHERE NOT led OR fits",
    "code_prefix_expand": with_(_SEARCH) + " SELECT query_id, code8, share FROM shares",
    "lot_code_match": with_(_SEARCH) + " SELECT query_id, match, count(*) AS lots FROM matched GROUP BY ALL",
    "candidate_features": with_(_SEARCH, _FEATURES) + " SELECT query_id, inn, " + ", ".join(f"round(CAST(f_{k} AS DOUBLE), 6) AS f_{k}" for k in V.WEIGHTS) + " FROM feat",
    "ranked_suppliers": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + " SELECT query_id, CAST(place AS INTEGER) AS place, inn, score FROM ranked WHERE place <= 20",
    "supplier_status": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + """ SELECT query_id, inn, CASE WHEN coalesce(wins, 0) >= 3 AND (coalesce(em_parts, 0) < 3 OR em_wins / em_parts >= 0.25) THEN 'verified'
 WHEN coalesce(wins, 0) >= 1 OR coalesce(code_wins, 0) >= 3 THEN 'experienced' WHEN coalesce(em_parts, 0) > 0 THEN 'participant' ELSE 'category' END AS status FROM ranked""",
    "rnp_penalty": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED, "pn AS (SELECT query_id, inn, place AS p0, CASE WHEN inn LIKE '%7' THEN round(score * 0.5, 1) ELSE score END AS score FROM ranked WHERE place <= 20)")
        + " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p0) AS INTEGER) AS place, inn, score FROM pn",
    "confidence_level": with_(_SEARCH, _CONFIDENCE) + " SELECT query_id, level, n AS similar_lots, round(top, 2) AS top_similarity, coalesce(array_to_string(unmatched, ','), '') AS unmatched FROM conf",
    "factor_contributions": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT query_id, inn, '{k}' AS factor, round(CAST(f_{k} AS DOUBLE) * {w}::DOUBLE{_HISTORY if V.NEEDS.get(k) == 'customer_inn' else ''} / (({_NORM}) / CASE level WHEN 'high' THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END) * 100, 6) AS points FROM ranked WHERE place <= 20" for k, w in V.WEIGHTS.items()) + ") WHERE points > 0",
    "reasons_text": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + _REASONS,
    "supplier_evidence": with_(_SEARCH, f"""ev AS (SELECT query_id, b.inn, id, row_number() OVER (PARTITION BY query_id, b.inn ORDER BY coalesce(l.customer_inn = c.customer_inn, false) DESC, is_winner DESC, sim DESC, id) AS rn
  FROM matched JOIN lots l ON l.lot_id = id JOIN bids b ON b.lot_id = id JOIN cards c USING (query_id) WHERE sim >= {V.SIMILAR_ENOUGH} AND match = 1.0)""") + " SELECT query_id, inn, array_to_string(list(id ORDER BY rn), ',') AS lots FROM ev WHERE rn <= 3 GROUP BY ALL",
    "supplier_evidence_own": with_(_SEARCH, _FEATURES, _OWN) + " SELECT query_id, inn, array_to_string(ids, ',') AS lots FROM e4",
    "kept_ranked_suppliers": with_(_SEARCH, _FEATURES, _CONFIDENCE, _RANKED) + " SELECT query_id, CAST(place AS INTEGER) AS place, inn, score FROM ranked WHERE place <= 20",
    "search_responses": with_(_SEARCH, _FEATURES, _OWN, _CONFIDENCE, _RANKED, """tot AS (SELECT query_id, count(*) AS total_candidates FROM ranked GROUP BY query_id),
gc AS (SELECT query_id, string_agg(code8, ',' ORDER BY place) AS codes FROM given GROUP BY query_id),
sup AS (SELECT query_id, string_agg(inn || ':' || st || ':' || coalesce(CAST(ids[1] AS VARCHAR), ''), ',' ORDER BY place) AS suppliers FROM (SELECT query_id, inn, place, STATUS AS st FROM ranked WHERE place <= 20) LEFT JOIN e4 USING (query_id, inn) GROUP BY query_id)""".replace("STATUS", _STATUS))
        + " SELECT query_id, level, total_candidates, codes, suppliers FROM cards JOIN conf USING (query_id) LEFT JOIN gc USING (query_id) LEFT JOIN tot USING (query_id) LEFT JOIN sup USING (query_id)",
    "okpd_predicted": with_(_SEARCH, _VOTES, _ABSORBED).replace("WITH ", "WITH RECURSIVE ", 1)
        + " SELECT query_id, code8, round(share, 3) AS share, CAST(place AS INTEGER) AS place, matched_item FROM ay LEFT JOIN vi USING (query_id, code8) WHERE place <= 5 AND share >= 0.15 * (SELECT max(share) FROM ay t WHERE t.query_id = ay.query_id)",
    "new_company_capped": with_(REGISTRY_SQL, _SEARCH, _NEW, _CAPPED).replace("WITH ", "WITH RECURSIVE ", 1)
        + " SELECT query_id, CAST(place AS INTEGER) AS place, inn, okved5, CASE WHEN inn LIKE '%7' THEN round(points * 0.5, 1) ELSE points END AS score FROM pts",
    "new_company_scores": with_(REGISTRY_SQL, _SEARCH, _NEW) + " SELECT query_id, inn, okved5, local, round(match, 6) AS match, round(pool_score, 6) AS pool_score FROM news",
    "newcomer_recall": with_(REGISTRY_SQL, _SEARCH, _NEW, "tr AS (SELECT CAST(region_code AS INTEGER) AS query_id, inn FROM registry)") + """ SELECT t.query_id, t.inn, CASE WHEN m.pool_score IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM news n WHERE n.query_id = t.query_id AND n.pool_score > m.pool_score) END AS rank
 FROM tr t LEFT JOIN news m ON m.query_id = t.query_id AND m.inn = t.inn""",
}
