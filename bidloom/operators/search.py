"""Searches over a user's tables: a batch of procurements in, ranked suppliers with reasons and evidence out.

Search takes tables and an index, which may be a kept one (search_index.created writes it, search_index.added extends it);
what its methods share is planned once. Nothing is collected; a batch of one procurement is a table of one row.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import fixed_values as V
from bidloom.functions.lineage import kept
from bidloom.functions.scalars import level, terms
from bidloom.operators import marts as M
from bidloom.operators import ranking as R
from bidloom.operators import retrieval as T
from bidloom.operators import search_index as S
from bidloom.operators.marts import Market


def lot_index(lots: DataFrame, items: DataFrame, folder: str, min_df: int = 2, max_df: float = 0.3) -> S.Kept:
    """A kept index of the lots' documents; later days come by search_index.added(index, retrieval.lot_terms(marts.lot_docs(lots, items)))."""
    return S.created(T.lot_terms(M.lot_docs(lots, items)), folder, min_df, max_df)


def best_lots(matched: DataFrame, lots: DataFrame, bids: DataFrame, cards: DataFrame, most: int = 3, seen: int = 40) -> DataFrame:
    """query_id, inn, at, lot_id, is_winner, same_customer, similarity: of a supplier's `seen` most similar lots those of the same customer first, then those won, then by similarity.

    Both limits are row numbers, which Spark also applies before the shuffle."""
    rows = matched.filter((F.col("sim") >= V.SIMILAR_ENOUGH) & (F.col("match") == 1.0)).withColumnRenamed("id", "lot_id").join(bids.select("lot_id", "inn", "is_winner"), "lot_id")
    near = Window.partitionBy("query_id", "inn").orderBy(F.desc("sim"), "lot_id", F.desc("is_winner"))
    rows = rows.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= seen)
    rows = rows.join(lots.select("lot_id", "customer_inn"), "lot_id").join(cards.select("query_id", F.col("customer_inn").alias("card_customer")), "query_id")
    rows = rows.withColumn("same_customer", F.coalesce(F.col("customer_inn") == F.col("card_customer"), F.lit(False)))
    order = Window.partitionBy("query_id", "inn").orderBy(F.desc("same_customer"), F.desc("is_winner"), F.desc("sim"), "lot_id")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most).select("query_id", "inn", "at", "lot_id", "is_winner", "same_customer", F.round("sim", 3).alias("similarity"))


def evidence(matched: DataFrame, relevant: DataFrame, lots: DataFrame, bids: DataFrame, cards: DataFrame, most: int = 3) -> DataFrame:
    """query_id, inn, evidence: the best lots; where none is of the card's customer, the supplier's latest relevant bid for that customer stands first, won ones before others. relevant: query_id, lot_id of the customer's relevant lots."""
    found = best_lots(matched, lots, bids, cards, most)
    own = relevant.join(bids.select("lot_id", "inn", "is_winner"), "lot_id").join(lots.select("lot_id", "publish_date"), "lot_id")
    order = Window.partitionBy("query_id", "inn").orderBy(F.desc("is_winner"), F.desc("publish_date"), "lot_id")
    own = own.withColumn("n", F.row_number().over(order)).filter("n = 1").join(found.filter("same_customer").select("query_id", "inn"), ["query_id", "inn"], "left_anti")
    first = own.select("query_id", "inn", F.lit(0).alias("at"), "lot_id", "is_winner", F.lit(True).alias("same_customer"), F.lit(0.0).alias("similarity"))
    rows = found.unionByName(first).join(lots.select("lot_id", "subject", "publish_date", "start_price", "platform"), "lot_id")
    held = F.array_sort(F.collect_list(F.struct("at", "lot_id", "subject", "publish_date", "start_price", "platform", "is_winner", "same_customer", "similarity")))
    return rows.groupBy("query_id", "inn").agg(F.slice(held, 1, most).alias("evidence"))


class Search:
    """cards: query_id, text, spec (array of product_name, okpd2_code), customer_inn, price, platform. lots, items, bids: as sources.extracts gives them.

    day: only what was published before counts. index: of the lots' documents, kept or as retrieval.fit makes it. query_terms:
    query_id, term, weight, such as retrieval.weighted_terms makes of parsed texts; by default all words of text and items."""

    def __init__(self, cards: DataFrame, lots: DataFrame, items: DataFrame, bids: DataFrame, day: str, market: Market = Market(), index: T.Index | S.Kept | None = None, query_terms: DataFrame | None = None, max_df: float = 0.3):
        self.cutoff, self.day, self.market = day, F.lit(day).cast("date"), market
        self.cards, self.lots, self.items, self.bids = cards, lots, items, bids
        self.history = M.before(lots, day)
        self.max_df, self.given_index, self.given_terms = max_df, index, query_terms
        self.lot_codes = items.filter("okpd2_code is not null").select("lot_id", level(F.col("okpd2_code"), 8).alias("code8")).distinct()

    @cached_property
    def index(self) -> T.Index | S.Kept:
        if self.given_index is not None:
            return self.given_index
        rows, texts = T.lot_texts(M.lot_docs(self.lots, self.items))
        return T.fit(rows, 2, self.max_df, texts)

    @cached_property
    def query_terms(self) -> DataFrame:
        """query_id, term, weight: the largest of a term's weights."""
        rows = self.given_terms
        if rows is None:
            of_text, of_items = terms(F.col("text")), F.flatten(F.transform(F.array_distinct("spec.product_name"), lambda x: terms(x)))
            rows = self.cards.select("query_id", F.explode(of_text).alias("term"), F.lit(1.0).alias("weight")).union(self.cards.select("query_id", F.explode(of_items).alias("term"), F.lit(V.ITEM_WEIGHT).alias("weight")))
        return kept(rows.groupBy("query_id", "term").agg(F.max("weight").alias("weight")))

    @cached_property
    def given(self) -> DataFrame:
        return kept(T.given_shares(self.cards))

    @cached_property
    def vectors(self) -> DataFrame:
        return T.query_vectors(self.query_terms, self.index.idf, weighted=True)

    @cached_property
    def similar(self) -> DataFrame:
        find = S.similar if isinstance(self.index, S.Kept) else T.similar
        return kept(find(self.vectors, self.index, V.TOP_LOTS, self.history.select(F.col("lot_id").alias("id"))))

    @cached_property
    def shares(self) -> DataFrame:
        return kept(T.expanded(self.given, self.items.filter("okpd2_code is not null").select(level(F.col("okpd2_code"), 8).alias("code8")).distinct()))

    @cached_property
    def matched(self) -> DataFrame:
        return kept(R.code_matches(self.similar, self.lot_codes, self.shares))

    @cached_property
    def asked(self) -> DataFrame:
        """lot_id, okpd2_code: which of the codes that the cards ask for a lot holds."""
        rows = self.items.filter("okpd2_code is not null").select("lot_id", level(F.col("okpd2_code"), 8).alias("okpd2_code"))
        return kept(rows.join(self.shares.select(F.col("code8").alias("okpd2_code")).distinct(), "okpd2_code", "left_semi").distinct())

    @cached_property
    def near_bids(self) -> DataFrame:
        """The bids for lots that are similar, of a card's customer, or hold a code that the cards ask for: all that a search counts but for the profiles. Read once."""
        own = self.history.join(self.cards.select(F.trim("customer_inn").alias("customer_inn")).distinct(), "customer_inn", "left_semi")
        lots = self.matched.select(F.col("id").alias("lot_id")).union(own.select("lot_id")).union(self.asked.select("lot_id")).distinct()
        return kept(self.bids.select("lot_id", "inn", "is_winner").join(lots, "lot_id", "left_semi"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.given.select("query_id", F.substring("code8", 1, 5).alias("cls")).distinct()

    @cached_property
    def relevant(self) -> DataFrame:
        """query_id, lot_id: earlier lots of the card's customer in one of its classes."""
        own = self.cards.select("query_id", F.trim("customer_inn").alias("customer_inn")).join(self.history.select("lot_id", "customer_inn"), "customer_inn")
        own = kept(own)  # few lots, by which codes are filtered before they are dealt out
        codes = self.lot_codes.join(own.select("lot_id"), "lot_id", "left_semi").select("lot_id", F.substring("code8", 1, 5).alias("cls"))
        return own.join(codes, "lot_id").join(self.classes, ["query_id", "cls"], "left_semi").select("query_id", "lot_id").distinct()

    def codes8(self) -> DataFrame:
        """Of the codes that the cards ask for."""
        bids = self.near_bids.join(self.asked.select("lot_id"), "lot_id", "left_semi")
        return M.supplier_codes(bids, self.asked, self.lots, self.cutoff).withColumnRenamed("okpd2_code", "code8")

    def features(self, **filters) -> DataFrame:
        """Each part is read twice, for the candidates and for their factors, so it is written once."""
        parts = (
            R.from_similar_lots(self.matched, self.lots, self.near_bids, self.day, self.market), R.from_codes(self.shares, self.codes8()),
            R.customer_history(self.cards, self.classes, self.lots, self.near_bids, self.lot_codes, self.day),
        )
        return R.features(self.cards, *map(kept, parts), M.supplier_profile(self.bids, self.lots, self.cutoff, self.market), self.day, self.market, **filters)

    @cached_property
    def judged(self) -> DataFrame:
        return kept(T.confidence(self.similar, self.query_terms.select("query_id", "term"), self.index, F.lit(True)))

    def confidence(self) -> DataFrame:
        return self.judged

    @cached_property
    def scored(self) -> DataFrame:
        """All candidates with their scores, and of the profile what statuses and reasons need."""
        return kept(R.scored(self.features(), self.judged, None).drop("kpp", "entity_type", "n_wins", "win_rate", "n_customers", "first_date", "last_date", "sum_won"))

    def ranked(self, limit: int | None = 20) -> DataFrame:
        return R.status(self.scored if limit is None else self.scored.filter(F.col("place") <= limit))

    def evidence(self) -> DataFrame:
        return evidence(self.matched, self.relevant, self.lots, self.near_bids, self.cards)

    def responses(self, limit: int = 20) -> DataFrame:
        """A row for each card: query_id, level, message, okpd2 (its codes), total_candidates, weights, and suppliers in order, each with score, status, factors, reasons and evidence."""
        every = self.scored
        totals = every.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
        rows = R.status_reason(R.status(every.filter(F.col("place") <= limit)), self.market)
        rows = R.reasons(rows, self.market).join(self.evidence(), ["query_id", "inn"], "left")
        factors = F.struct(*[F.round(f"f_{k}", 3).alias(k) for k in V.WEIGHTS])
        supplier = F.struct("place", "inn", "score", "status", "status_reason", factors.alias("factors"), "reasons", F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)).alias("evidence"))
        listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(supplier)).alias("suppliers"))
        codes = self.given.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("code8").alias("code"), "share", "matched_item"))).alias("okpd2"))
        told = T.confidence_message(self.confidence()).select("query_id", "level", "message")
        out = self.cards.select("query_id").join(told, "query_id", "left").join(codes, "query_id", "left").join(totals, "query_id", "left").join(listed, "query_id", "left")
        return out.withColumn("total_candidates", F.coalesce("total_candidates", F.lit(0).cast("long"))).withColumn("weights", F.create_map(*[F.lit(x) for pair in V.WEIGHTS.items() for x in pair]))

    def response_json(self, limit: int = 20) -> DataFrame:
        """query_id, response: the same as JSON without the fields that are null."""
        rows = self.responses(limit)
        return rows.select("query_id", F.to_json(F.struct(*[c for c in rows.columns if c != "query_id"]), {"ignoreNullFields": "true"}).alias("response"))
