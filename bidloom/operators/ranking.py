"""Candidate suppliers of a batch of procurements, their factors, scores and explanations.

cards: query_id, customer_inn, price, platform (each may be null). All stages are keyed by query_id and supplier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import fixed_values as V
from bidloom.functions.lineage import kept
from bidloom.functions.scalars import decay, price_fit, rounded
from bidloom.operators.marts import Market


def bid_weight(won: Column) -> Column:
    return F.when(won, V.WIN_WEIGHT).otherwise(V.PART_WEIGHT)


def code_matches(similar_lots: DataFrame, lot_codes: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds match: 1 if the query has no codes, the lot has none, or they share one; else a fixed discount."""
    own = similar_lots.select(F.col("id").alias("lot_id")).distinct()
    held = lot_codes.join(own, "lot_id", "left_semi").groupBy(F.col("lot_id").alias("id")).agg(F.collect_set("code8").alias("held"))
    wanted = shares.groupBy("query_id").agg(F.collect_set("code8").alias("wanted"))
    joined = similar_lots.join(held, "id", "left").join(wanted, "query_id", "left")
    apart = ~F.arrays_overlap("held", "wanted")  # null, and so no discount, where either side has no codes
    return joined.withColumn("match", F.when(apart, V.CODE_MISMATCH).otherwise(1.0)).drop("held", "wanted")


def from_similar_lots(matched: DataFrame, lots: DataFrame, bids: DataFrame, day: Column, market: Market = Market()) -> DataFrame:
    """query_id, inn and what a supplier did in similar lots. day: the reference date; matched: query_id, id, sim, match."""
    bids = kept(bids.select("lot_id", "inn", "is_winner").join(matched.select(F.col("id").alias("lot_id")).distinct(), "lot_id", "left_semi"))
    counts = bids.groupBy("lot_id").agg(F.count("*").alias("n_bidders"))
    rows = matched.withColumnRenamed("id", "lot_id").join(lots.select("lot_id", "publish_date", "platform", "customer_inn"), "lot_id").join(bids.select("lot_id", "inn", "is_winner"), "lot_id").join(counts, "lot_id")
    won, shop = F.coalesce("is_winner", F.lit(False)), F.col("platform") == market.shop
    strict = (F.col("sim") >= V.SIMILAR_ENOUGH) & (F.col("match") == 1.0)
    return rows.groupBy("query_id", "inn").agg(
        F.sum(F.pow("sim", F.lit(2)) * F.col("match") * bid_weight(won) * decay(F.datediff(day, "publish_date"))).alias("text"),
        F.max(F.col("sim") * F.col("match")).alias("max_sim"),
        F.count_if(strict & won).alias("wins"), F.count_if(strict).alias("parts"), F.count_if(strict & shop).alias("em_parts"), F.count_if(strict & shop & won).alias("em_wins"),
        F.count_if(strict & shop & won & (F.col("n_bidders") > 1)).alias("comp_wins"), F.count_if(strict & ~shop & won).alias("ais_wins"),
        F.size(F.collect_set(F.when(strict, F.col("customer_inn")))).alias("customers"), F.max(F.when(strict, F.col("publish_date"))).alias("last"),
    )


def from_codes(shares: DataFrame, supplier_codes: DataFrame) -> DataFrame:
    """query_id, inn, okpd_exp, code_lots, code_wins. supplier_codes: code8, inn, n_lots, n_wins."""
    rows = shares.join(supplier_codes, "code8")
    return rows.groupBy("query_id", "inn").agg(F.sum(F.col("share") * (F.col("n_wins") * V.WIN_WEIGHT + (F.col("n_lots") - F.col("n_wins")) * V.PART_WEIGHT)).alias("okpd_exp"), F.sum("n_lots").alias("code_lots"), F.sum("n_wins").alias("code_wins"))


def customer_history(cards: DataFrame, classes: DataFrame, lots: DataFrame, bids: DataFrame, lot_codes: DataFrame, day: Column) -> DataFrame:
    """query_id, inn, rel_w, any_w, rel_wins, cust_wins, cust_lots: what a supplier did for the card's customer before the day. classes: query_id, cls."""
    own = cards.filter("customer_inn is not null").select("query_id", F.trim("customer_inn").alias("customer_inn")).join(lots.filter(F.col("publish_date") < day).select("lot_id", "customer_inn"), "customer_inn")
    own = kept(own)  # few lots, by which codes and bids are filtered before they are dealt out
    codes = lot_codes.join(own.select("lot_id"), "lot_id", "left_semi").select("lot_id", F.substring("code8", 1, 5).alias("cls")).distinct()
    relevant = own.join(codes, "lot_id").join(classes.select("query_id", "cls"), ["query_id", "cls"], "left_semi").select("query_id", "lot_id").distinct().withColumn("rel", F.lit(True))
    rows = own.join(relevant, ["query_id", "lot_id"], "left").join(bids.select("lot_id", "inn", "is_winner"), "lot_id")
    won, rel = F.coalesce("is_winner", F.lit(False)), F.coalesce("rel", F.lit(False))
    return rows.groupBy("query_id", "inn").agg(
        F.sum(F.when(rel, bid_weight(won)).otherwise(0.0)).alias("rel_w"), F.sum(bid_weight(won)).alias("any_w"), F.count_if(rel & won).alias("rel_wins"), F.count_if(won).alias("cust_wins"), F.count("*").alias("cust_lots")
    )


def features(cards: DataFrame, lots_part: DataFrame, codes_part: DataFrame, customer_part: DataFrame, profile: DataFrame, day: Column, market: Market = Market(), region_only: bool = False, smp: DataFrame | None = None) -> DataFrame:
    """query_id, inn, every factor, and the counts that statuses and reasons need.

    Candidates: suppliers of similar lots, the most experienced by code, and those with relevant bids for the customer;
    filters on region or small business come before the factors are scaled."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("okpd_exp"), "inn"))
    chosen = (
        lots_part.select("query_id", "inn")
        .union(codes_part.withColumn("place", place).filter(F.col("place") <= V.EXPERIENCED).select("query_id", "inn"))
        .union(customer_part.filter("rel_w > 0").select("query_id", "inn")).distinct()
    )
    if smp is not None:
        chosen = chosen.join(smp.select("inn"), "inn", "left_semi")
    keys = ["query_id", "inn"]
    rows = chosen.join(lots_part, keys, "left").join(codes_part, keys, "left").join(customer_part, keys, "left").join(profile, "inn", "left").join(cards.select("query_id", "customer_inn", "price", "platform"), "query_id")
    if region_only:
        rows = rows.filter(F.col("region_code").isin(market.home, market.near))
    whole = Window.partitionBy("query_id")
    most = lambda c, scale=1: F.log1p(scale * F.max(c).over(whole))
    safe = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_lots = F.col("n_lots")
    shop_share = F.when(F.col("platform") == market.shop, F.col("n_eshop")).otherwise(F.col("n_aisgz"))
    history = F.max(F.col("any_w").isNotNull()).over(whole)
    out = rows.withColumns(
        {
            "f_text": F.coalesce(F.log1p(10 * F.col("text")) / safe(most("text", 10)), F.lit(0.0)),
            "f_okpd": F.log1p(F.coalesce("okpd_exp", F.lit(0.0))) / safe(most("okpd_exp")),
            "f_wins": F.when(F.col("em_parts") > 0, (F.col("em_wins") + 1) / (F.col("em_parts") + 3)).when(F.col("ais_wins") > 0, V.WIN_PRIOR).otherwise(0.5 * F.coalesce(F.try_divide("n_eshop_wins", "n_eshop"), F.lit(V.WIN_PRIOR))),
            "f_recency": F.coalesce(decay(F.datediff(day, "last")), F.lit(0.0)),
            "f_focus": F.when(n_lots > 0, F.least(zero("code_lots") / n_lots, F.lit(1.0))).otherwise(0.0),
            "f_region": F.when(F.col("region_code") == market.home, 1.0).when(F.col("region_code") == market.near, 0.5).otherwise(0.0),
            "f_breadth": F.least(zero("customers") / 10, F.lit(1.0)),
            "f_customer_rel": F.coalesce(F.least(F.log1p("rel_w") / F.log1p(F.lit(10.0)), F.lit(1.0)), F.lit(0.0)),
            "f_customer_any": F.coalesce(F.least(F.log1p("any_w") / F.log1p(F.lit(40.0)), F.lit(1.0)), F.lit(0.0)),
            "f_price": price_fit(F.col("price"), F.col("median_price")),
            "f_platform": F.when(F.col("platform").isNotNull() & (n_lots > 0), shop_share / n_lots).otherwise(0.0),
            "rel_wins_scaled": F.coalesce(F.log1p("wins") / safe(most("wins")), F.lit(0.0)),
            "has_history": history,
        }
    )
    return out


def active_weights() -> dict[str, Column]:
    """Weight of each factor for a row's query: none where the query lacks what the factor needs. Rows: customer_inn, has_history, price, platform, level."""
    needed = {"customer_inn": F.col("customer_inn").isNotNull() & F.col("has_history"), "price": F.coalesce(F.col("price"), F.lit(0.0)) > 0, "platform": F.col("platform").isNotNull()}
    return {k: F.when(needed[V.NEEDS[k]], w).otherwise(0.0) if k in V.NEEDS else F.lit(w) for k, w in V.WEIGHTS.items()}


def normalised_weights() -> dict[str, Column]:
    """Active weights divided by their sum, less where confidence is lower: the score is the factors' sum by these."""
    weight = active_weights()
    scale = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in V.CONFIDENCE_SCALE.items()], F.lit(1.0))
    total = reduce(lambda a, b: a + b, weight.values())
    return {k: w / (total / scale) for k, w in weight.items()}


def scored(rows: DataFrame, confidence: DataFrame, limit: int | None = 20) -> DataFrame:
    """Adds score (0 to 100, one decimal), raw score and place. Factors whose field the query lacks don't count; low confidence scales the score down."""
    rows = rows.join(confidence.select("query_id", "level"), "query_id", "left")
    raw = reduce(lambda a, b: a + b, [w * F.col(f"f_{k}") for k, w in normalised_weights().items()])
    out = rows.withColumn("raw_score", rounded(raw, 9)).withColumn("score", rounded(F.col("raw_score") * 100, 1))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "inn")))
    return out if limit is None else out.filter(F.col("place") <= limit)


def status(rows: DataFrame) -> DataFrame:
    """Adds status: verified, experienced, participant or category; approx where the query itself is poorly covered."""
    wins, em, rate = F.coalesce("wins", F.lit(0)), F.coalesce("em_parts", F.lit(0)), F.coalesce(F.try_divide("em_wins", "em_parts"), F.lit(0.0))
    by_rule = F.when((wins >= 3) & ((em < 3) | (rate >= 0.25)), "verified").when((wins >= 1) | (F.coalesce("code_wins", F.lit(0)) >= 3), "experienced").when(em > 0, "participant").otherwise("category")
    return rows.withColumn("status", F.when(F.col("level") == "low", "approx").otherwise(by_rule))


def status_reason(rows: DataFrame, market: Market = Market()) -> DataFrame:
    """Adds status_reason: why a supplier has its status. Rows: status and the counts that it rests on."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = F.coalesce(F.try_divide("em_wins", "em_parts"), F.lit(0.0))
    won = F.concat_ws("; ", F.when(zero("em_parts") > 0, F.concat(F.lit(V.WON_OF.format(market.shop)), num("em_wins"), F.lit(" из "), num("em_parts"))), F.when(zero("ais_wins") > 0, F.concat(F.lit(V.WON_TENDERS.format(market.tender)), num("ais_wins"))))
    few = F.when((zero("wins") >= 3) & (rate < 0.25), F.concat(won, F.lit(V.FEW_WINS))).otherwise(won)
    text = (
        F.when(F.col("status") == "approx", V.APPROXIMATE).when(F.col("status") == "verified", won).when((F.col("status") == "experienced") & (zero("wins") >= 1), few)
        .when(F.col("status") == "experienced", F.concat(num("code_wins"), F.lit(V.BY_CODES))).when(F.col("status") == "participant", F.concat(F.lit(V.TOOK_PART), num("em_parts"))).otherwise(V.BY_CATEGORY)
    )
    return rows.withColumn("status_reason", text)


def penalised(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """Halves the score of suppliers on the register of unfair suppliers and ranks the already truncated list again. flagged: inn, in_rnp."""
    out = rows.join(flagged.select("inn", "in_rnp"), "inn", "left").withColumn("score", F.when(F.col("in_rnp"), rounded(F.col("score") * 0.5, 1)).otherwise(F.col("score")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place")))


def contributions(rows: DataFrame) -> DataFrame:
    """query_id, inn, factors: (factor, points) of the factors above zero, largest first. The points sum to the score before any penalty."""
    parts = F.filter(F.array(*[F.struct(F.round(-F.col(f"f_{k}") * w * 100, 6).alias("minus"), F.lit(k).alias("factor")) for k, w in normalised_weights().items()]), lambda x: x["minus"] < 0)
    return rows.select("query_id", "inn", F.transform(F.array_sort(parts), lambda x: F.struct(x["factor"].alias("factor"), (-x["minus"]).alias("points"))).alias("factors"))


def reasons(rows: DataFrame, market: Market = Market()) -> DataFrame:
    """Adds reasons: what speaks for the supplier, in words, most telling first."""
    num = lambda c: F.col(c).cast("string")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    share = F.least(F.coalesce("code_lots", F.lit(0)) / F.col("n_lots"), F.lit(1.0))
    percent = F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))
    lines = [
        F.when(F.col("rel_wins") > 0, say("Уже выигрывал у этого заказчика закупки этой категории: ", num("rel_wins")))
        .when(F.col("rel_w") > 0, say("Участвовал в закупках этого заказчика по этой категории"))
        .when(F.col("cust_wins") > 0, say("Уже работал с этим заказчиком (побед: ", num("cust_wins"), ")")),
        F.when(F.col("em_parts") > 0, say(f"Похожие закупки ({market.shop}): участвовал в ", num("em_parts"), ", победил в ", num("em_wins"), F.when(F.col("comp_wins") > 0, say(", из них при 2+ участниках — ", num("comp_wins"))).when(F.col("em_wins") > 0, "; во всех был единственным участником").otherwise(""))),
        F.when(F.col("ais_wins") > 0, say("Победитель похожих процедур: ", num("ais_wins"), f" ({market.tender})")),
        F.when(F.col("parts") > 0, say("Последняя похожая закупка — ", num("last"))).when(F.col("text").isNotNull(), "Участвовал в закупках с общими словами в названии, но близких по предмету среди них нет"),
        F.when(F.col("customers") > 1, say("В похожих закупках работал с ", num("customers"), " разными заказчиками")),
        F.when(F.col("code_lots").isNotNull() & (F.col("n_lots") >= 10) & (share >= 0.4), say("Профильный поставщик: ", percent, " его закупок — в этой категории"))
        .when(F.col("code_lots").isNotNull() & (F.col("n_lots") >= 10) & (share < 0.1), say("Универсальный поставщик: на эту категорию приходится ", percent, " его закупок")),
        F.when(F.col("region_code") == market.home, "Стоит на учёте в домашнем регионе").when(F.col("region_code") == market.near, "Стоит на учёте в соседнем регионе"),
        F.when(F.col("n_lots") >= 20, say("Всего закупок: ", num("n_lots"))),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*lines)))


def evidence(matched: DataFrame, lots: DataFrame, bids: DataFrame, cards: DataFrame, most: int = 3) -> DataFrame:
    """query_id, inn, evidence: the supplier's best similar lots: same customer first, then won, then similarity."""
    rows = matched.filter((F.col("sim") >= V.SIMILAR_ENOUGH) & (F.col("match") == 1.0)).withColumnRenamed("id", "lot_id").join(lots, "lot_id").join(bids.select("lot_id", "inn", "is_winner"), "lot_id")
    rows = rows.join(cards.select("query_id", F.col("customer_inn").alias("card_customer")), "query_id").withColumn("same_customer", F.coalesce(F.col("customer_inn") == F.col("card_customer"), F.lit(False)))
    order = Window.partitionBy("query_id", "inn").orderBy(F.desc("same_customer"), F.desc("is_winner"), F.desc("sim"), "lot_id")
    top = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    return top.groupBy("query_id", "inn").agg(F.array_sort(F.collect_list(F.struct("at", "lot_id", "subject", "publish_date", "start_price", F.col("platform"), "is_winner", "same_customer", F.round("sim", 3).alias("similarity")))).alias("evidence"))
