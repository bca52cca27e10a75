"""Marts over lots, their items and the bids for them.

Every mart takes a cutoff date, so that history can be rebuilt as of any day. Bids are not unique by lot and supplier:
counts are of distinct lots, sums and medians are over raw rows. Both come from one aggregation to supplier and lot (which
Spark pre-aggregates before the shuffle) instead of several distinct aggregates, which would multiply the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.scalars import level


@dataclass(frozen=True)
class Market:
    """Names of the two platforms and of the regions near by."""

    shop: str = "ЭМ"
    tender: str = "АИС ГЗ"
    home: str = "78"
    near: str = "47"


def before(df: DataFrame, cutoff: str | None, column: str = "publish_date") -> DataFrame:
    return df if cutoff is None else df.filter(F.col(column) < F.lit(cutoff).cast("date"))


def lot_docs(lots: DataFrame, items: DataFrame) -> DataFrame:
    """lot_id, subject, items (distinct names in order, joined), okpd2_codes (distinct, in order; null if none)."""
    # Dealt out first: sets of single rows save nothing before the shuffle, and are slow to build.
    by_lot = items.repartition("lot_id").groupBy("lot_id").agg(F.array_join(F.array_sort(F.collect_set("product_name")), " | ").alias("items"), F.array_sort(F.collect_set("okpd2_code")).alias("okpd2_codes"))
    return lots.select("lot_id", "subject").join(by_lot, "lot_id", "left").select("lot_id", "subject", F.coalesce("items", F.lit("")).alias("items"), F.when(F.size("okpd2_codes") > 0, F.col("okpd2_codes")).alias("okpd2_codes"))


def supplier_profile(bids: DataFrame, lots: DataFrame, cutoff: str | None = None, market: Market = Market()) -> DataFrame:
    """One row per supplier: region, counts of lots, wins and customers, dates, sums and the median price."""
    lots = before(lots, cutoff).select("lot_id", "publish_date", "start_price", "platform", "customer_inn")
    joined = bids.join(lots, "lot_id")
    # A lot's customer is a key and its platform two flags, since strings among the aggregates would be sorted instead of hashed.
    pairs = joined.groupBy("inn", "lot_id", "customer_inn").agg(
        F.count("*").alias("rows"), F.max("is_winner").alias("won"), F.max(F.col("platform") == market.shop).alias("shop"), F.max(F.col("platform") == market.tender).alias("tender"),
        F.first("publish_date").alias("day"), F.first("start_price").alias("price"), F.sum(F.when(F.col("is_winner"), F.col("start_price"))).alias("won_sum"),
    )
    shop, tender, won = F.col("shop"), F.col("tender"), F.coalesce("won", F.lit(False))
    totals = pairs.groupBy("inn").agg(
        F.count("*").alias("n_lots"), F.count_if(won).alias("n_wins"), F.count_distinct("customer_inn").alias("n_customers"),
        F.count_if(shop).alias("n_eshop"), F.count_if(tender).alias("n_aisgz"), F.count_if(shop & won).alias("n_eshop_wins"),
        F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.sum("won_sum").alias("sum_won"), F.percentile("price", F.lit(0.5), F.col("rows")).alias("median_price"),
    )
    kpps = joined.filter("kpp is not null").groupBy("inn", "kpp").count().groupBy("inn").agg(F.min(F.struct((-F.col("count")).alias("n"), "kpp")).alias("top")).select("inn", F.col("top.kpp").alias("kpp"))
    head = F.substring("inn", 1, 2)
    region = F.when(F.length("inn") == 12, head).when(F.col("kpp").isNotNull() & (F.substring("kpp", 1, 2) != "00"), F.substring("kpp", 1, 2)).otherwise(head)
    return totals.join(kpps, "inn", "left").select(
        "inn", "kpp", F.when(F.length("inn") == 12, "ИП").otherwise("ЮЛ").alias("entity_type"), region.alias("region_code"),
        "n_lots", "n_wins", F.round(F.col("n_wins") / F.col("n_lots"), 3).alias("win_rate"), "n_customers", "n_eshop", "n_aisgz", "n_eshop_wins", "first_date", "last_date", "sum_won", "median_price",
    )


def supplier_codes(bids: DataFrame, items: DataFrame, lots: DataFrame, cutoff: str | None = None, digits: int | None = None) -> DataFrame:
    """inn, okpd2_code, n_lots, n_wins, last_date: distinct lots by supplier and code (or its first `digits` characters)."""
    code = F.col("okpd2_code") if digits is None else level(F.col("okpd2_code"), digits)
    # Dealt out by lot first, so that neither the distinct rows nor the joins deal them out again.
    held = items.filter("okpd2_code is not null").select("lot_id", code.alias("okpd2_code")).repartition("lot_id").distinct()
    won = bids.select("inn", "lot_id", "is_winner").repartition("lot_id").groupBy("inn", "lot_id").agg(F.max("is_winner").alias("won"))
    days = before(lots, cutoff).select("lot_id", "publish_date")
    return won.join(days, "lot_id").join(held, "lot_id").groupBy("inn", "okpd2_code").agg(F.count("*").alias("n_lots"), F.count_if("won").alias("n_wins"), F.max("publish_date").alias("last_date"))


def rolled_up(codes: DataFrame, digits: int = 8) -> DataFrame:
    """Supplier experience by shorter code, as the sum over full codes: a lot with two of them counts twice."""
    return codes.groupBy("inn", level(F.col("okpd2_code"), digits).alias("code8")).agg(F.sum("n_lots").alias("n_lots"), F.sum("n_wins").alias("n_wins"), F.max("last_date").alias("last_date"))


def code_names(items: DataFrame) -> DataFrame:
    """okpd2_code, sample_name (the most frequent; the greatest of equals), n_items."""
    counts = items.filter("okpd2_code is not null").groupBy("okpd2_code", "product_name").agg(F.count("*").alias("n"))
    return counts.groupBy("okpd2_code").agg(F.max_by("product_name", F.struct("n", "product_name")).alias("sample_name"), F.sum("n").alias("n_items"))


def item_counts(items: DataFrame, digits: int = 8) -> DataFrame:
    """product_name, code8, n: documents of the item index."""
    return items.filter("okpd2_code is not null and length(product_name) > 2").groupBy("product_name", level(F.col("okpd2_code"), digits).alias("code8")).agg(F.count("*").alias("n"))


def class_breadth(codes: DataFrame) -> DataFrame:
    return codes.select("inn", level(F.col("okpd2_code"), 2).alias("cls")).distinct().groupBy("inn").agg(F.count("*").alias("n_classes"))


def class_wins(codes: DataFrame, digits: int = 5) -> DataFrame:
    return codes.filter("n_wins > 0").groupBy("inn", level(F.col("okpd2_code"), digits).alias("cls")).agg(F.sum("n_wins").alias("w"))


def top_class(codes: DataFrame) -> DataFrame:
    """inn, cls, share: the class with most wins (the greatest of equals) and its share of the wins."""
    return class_wins(codes, 2).groupBy("inn").agg(F.max_by("cls", F.struct("w", "cls")).alias("cls"), (F.max("w") / F.sum("w")).alias("share"))


def customer_class_suppliers(bids: DataFrame, items: DataFrame, lots: DataFrame, cutoff: str | None = None) -> DataFrame:
    """customer_inn, cls, inn, wins: distinct won lots by full code, summed by class of five characters."""
    held = items.filter("okpd2_code is not null").select("lot_id", level(F.col("okpd2_code"), 5).alias("cls")).repartition("lot_id").distinct()
    won = bids.filter("is_winner").select("inn", "lot_id").repartition("lot_id").distinct()
    known = before(lots, cutoff).select("lot_id", "customer_inn")
    pairs = won.join(known, "lot_id").join(held, "lot_id").repartition("customer_inn", "cls")
    return pairs.groupBy("customer_inn", "cls", "inn").agg(F.count("*").alias("wins"))


def bidder_counts(bids: DataFrame) -> DataFrame:
    return bids.groupBy("lot_id").agg(F.count("*").alias("n_bidders"))


def lots_with_winner(lots: DataFrame, bids: DataFrame) -> DataFrame:
    return lots.join(bids.filter("is_winner"), "lot_id", "left_semi")


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the other's; null keys of `right` don't count."""
    return left.join(right.select(key), key, "left_anti")


def supplier_card_codes(codes: DataFrame, names: DataFrame, prefixes: list[str], limit: int = 15) -> DataFrame:
    """A supplier's codes, those of the procurement first: relevance, wins, lots."""
    relevant = F.exists(F.array(*[F.lit(p[:8]) for p in prefixes[:5]]), lambda p: F.col("okpd2_code").startswith(p)) if prefixes else F.lit(False)
    order = Window.partitionBy("inn").orderBy(F.desc("relevant"), F.desc("n_wins"), F.desc("n_lots"), "okpd2_code")
    return codes.join(names, "okpd2_code", "left").withColumn("relevant", relevant).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("inn", "okpd2_code", "sample_name", "n_lots", "n_wins", "last_date", "relevant", "place")


def supplier_lots(bids: DataFrame, lots: DataFrame, items: DataFrame | None = None, prefixes: list[str] = (), limit: int = 10) -> DataFrame:
    """A supplier's latest lots, optionally only those with a code of the procurement, with the number of bidders."""
    if items is not None:
        relevant = F.exists(F.array(*[F.lit(p[:8]) for p in prefixes[:5]]), lambda p: F.col("okpd2_code").startswith(p))
        lots = lots.join(items.filter(relevant), "lot_id", "left_semi")
    rows = bids.select("inn", "lot_id", "is_winner").distinct().join(lots, "lot_id").join(bidder_counts(bids), "lot_id", "left")
    order = Window.partitionBy("inn").orderBy(F.desc("publish_date"), "lot_id", "is_winner")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("inn", "place", "lot_id", "subject", "publish_date", "start_price", "platform", "is_winner", "customer_inn", F.coalesce("n_bidders", F.lit(0)).alias("n_bidders"))


def grouped_bids(lots: DataFrame, bids: DataFrame, since: str) -> DataFrame:
    """lot_id, winners, participants (sorted lists) of the later lots that have a winner."""
    later = lots.filter(F.col("publish_date") >= F.lit(since).cast("date")).select("lot_id", "subject", "platform")
    lists = bids.groupBy("lot_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_winner"), F.col("inn")))).alias("winners"), F.array_sort(F.collect_list("inn")).alias("participants"))
    return later.join(lists.filter(F.size("winners") > 0), "lot_id")


def balanced_pool(lots: DataFrame, bids: DataFrame, items: DataFrame, since: str) -> DataFrame:
    """Lots with exactly one winner and items of one kind: lot_id, platform, kind, size_band, class_code."""
    cls = F.substring("okpd2_code", 1, 2).try_cast("int")
    single = bids.filter("is_winner and inn is not null").groupBy("lot_id").agg(F.count_distinct("inn").alias("n")).filter("n = 1").select("lot_id")
    kinds = items.groupBy("lot_id").agg(
        F.count("*").alias("n_items"), F.count_if(cls.between(1, 33)).alias("goods"), F.count_if(cls.between(35, 99)).alias("services"), F.min(F.substring("okpd2_code", 1, 2)).alias("class_code"),
        F.count_if((F.coalesce(F.trim("product_name"), F.lit("")) == "") | (F.coalesce(F.trim("okpd2_code"), F.lit("")) == "")).alias("missing"),
    )
    fit = kinds.filter("(n_items = 1 or n_items between 5 and 30) and (goods = n_items or services = n_items) and missing = 0")
    later = lots.filter((F.col("publish_date") >= F.lit(since).cast("date")) & (F.trim("subject") != "") & F.col("start_price").isNotNull() & (F.trim("customer_inn") != "") & F.col("is_smp").isNotNull())
    return later.join(single, "lot_id", "left_semi").join(fit, "lot_id").select(
        "lot_id", "platform", F.when(F.col("goods") == F.col("n_items"), "goods").otherwise("services").alias("kind"), F.when(F.col("n_items") == 1, "one").otherwise("multi").alias("size_band"), "class_code"
    )


def seeded_order(key: Column, seed: int = 0) -> Column:
    """A hash of the key and the seed to order by: the same on every run, however the rows are dealt out."""
    return F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string")))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows that come first in the seeded order of their keys. Each task keeps its own first n, so no whole sort is needed."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def balanced_pick(pool: DataFrame, seed: int = 0) -> DataFrame:
    """Two or three lots of each stratum, new classes first; lots of a stratum in the order of a seeded hash.

    Ranks replace the sequential choice: in each stratum the first lot of every class goes before the second ones."""
    strata = Window.partitionBy("platform", "kind", "size_band")
    shuffled = seeded_order(F.col("lot_id"), seed)
    first = F.row_number().over(Window.partitionBy("platform", "kind", "size_band", "class_code").orderBy(shuffled, "lot_id"))
    place = F.row_number().over(strata.orderBy("again", shuffled, "lot_id"))
    odd = (F.dense_rank().over(Window.orderBy("platform")) + (F.col("kind") == "services").cast("int") + (F.col("size_band") == "multi").cast("int")) % 2
    ranked = pool.withColumn("again", first).withColumn("place", place).filter("place <= 3")
    return ranked.withColumn("quota", F.when(odd == 1, 3).otherwise(2)).filter("place <= quota").select("lot_id", "platform", "kind", "size_band", "class_code", "place")
