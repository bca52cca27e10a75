"""Back-in-time evaluation of ranked lists."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.lineage import kept
from bidloom.functions.scalars import level


def top_by_code(codes8: DataFrame, most: int = 50) -> DataFrame:
    """code8, inn, at: the suppliers with most wins by code."""
    return codes8.withColumn("at", F.row_number().over(Window.partitionBy("code8").orderBy(F.desc("n_wins"), "inn"))).filter(F.col("at") <= most).select("code8", "inn", "at", "n_wins")


def baseline_codes(lot_codes: DataFrame, best: DataFrame, k: int = 10) -> DataFrame:
    """query_id, inn, place: lists of the lot's codes one after another, each supplier once. lot_codes: query_id, code8, at (order of the code).

    A code lists a supplier once, so that only its first k can count, and nothing of the codes after one that lists k."""
    lists = kept(best.filter(F.col("at") <= k).groupBy("code8").agg(F.array_sort(F.collect_list(F.struct("at", "inn"))).alias("list")))
    before = Window.partitionBy("query_id").orderBy("code_at").rangeBetween(Window.unboundedPreceding, -1)
    rows = lot_codes.select("query_id", "code8", F.col("at").alias("code_at")).join(lists, "code8").withColumn("longest", F.max(F.size("list")).over(before))
    rows = rows.filter(F.coalesce("longest", F.lit(0)) < k).select("query_id", "code_at", F.inline("list")).groupBy("query_id", "inn").agg(F.min(F.struct("code_at", "at")).alias("key"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("key", "inn"))).filter(F.col("place") <= k).select("query_id", "inn", "place")


def baseline_customer(queries: DataFrame, lot_classes: DataFrame, customer_classes: DataFrame, by_codes: DataFrame, k: int = 10) -> DataFrame:
    """Suppliers by wins for the customer in the lot's classes, then those of the code baseline. queries: query_id, customer_inn; lot_classes: query_id, cls."""
    known = queries.join(lot_classes.repartition("query_id").distinct(), "query_id").join(customer_classes, ["customer_inn", "cls"]).select("query_id", "inn", "wins", F.lit(0).alias("late"))
    both = known.union(by_codes.select("query_id", "inn", F.lit(0).cast("long").alias("wins"), F.col("place").alias("late"))).repartition("query_id")
    both = both.groupBy("query_id", "inn").agg(F.sum("wins").alias("wins"), F.min("late").alias("late"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("wins"), "late", "inn"))).filter(F.col("place") <= k).select("query_id", "inn", "place")


def ranks(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, rank (of the first winner; 0 if none), recall (share of participants found). queries: query_id, winners, participants."""
    found = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "inn"))).alias("list"))
    first = F.array_min(F.transform(F.filter("list", lambda x: F.array_contains("winners", x["inn"])), lambda x: x["place"]))
    hits = F.size(F.array_intersect(F.array_distinct("participants"), F.col("list.inn")))
    return queries.join(found, "query_id", "left").select("query_id", F.coalesce(first, F.lit(0)).alias("rank"), (F.coalesce(hits, F.lit(0)) / F.size(F.array_distinct("participants"))).alias("recall"))


def metrics(ranked: DataFrame) -> DataFrame:
    """n, hit, mrr, recall."""
    return ranked.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank") > 0, 1.0).otherwise(0.0)), 4).alias("hit"), F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 4).alias("mrr"), F.round(F.avg(F.greatest("recall", F.lit(0.0))), 4).alias("recall"))


#: Cumulative probabilities of Poisson counts 0, 1, ... with mean one.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10))


def replicates(values: DataFrame, n: int = 1000, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """replicate and the mean of each column in each of n resamples. values: key (distinct) and the columns.

    A row's weight in a resample is a Poisson count drawn by hash of key and number, which stands in for drawing as many rows
    with replacement: one aggregation over n groups, summed up before the shuffle."""
    part = F.conv(F.substring(F.md5(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("replicate").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # Comparisons are added up, which Spark compiles, where a filter over an array is interpreted; rows of weight zero add nothing.
    weight = reduce(lambda a, b: a + b, [(F.col("part") >= p).cast("int") for p in POISSON])
    rows = values.select("key", *columns, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate")).withColumn("part", part).withColumn("weight", weight)
    sums = rows.groupBy("replicate").agg(F.sum("weight").alias("total"), *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns]).filter("total > 0")
    return sums.select("replicate", *[(F.col(c) / F.col("total")).alias(c) for c in columns])


def interval(values: DataFrame, n: int = 1000, columns: tuple[str, ...] = ("value",), share: float = 0.95) -> DataFrame:
    """One row: of each column the ends of the interval that holds so many of the resampled means, as c_low and c_high."""
    ends = (1 - share) / 2, (1 + share) / 2
    return replicates(values, n, columns).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in columns for name, q in zip(("low", "high"), ends, strict=True)])


def newcomers(lots: DataFrame, bids: DataFrame, since: str) -> DataFrame:
    """lot_id, inn: winners of later lots who made no bid before."""
    day = F.lit(since).cast("date")
    old = bids.join(lots.filter(F.col("publish_date") < day).select("lot_id"), "lot_id", "left_semi").select("inn").distinct()
    return bids.filter("is_winner").join(lots.filter(F.col("publish_date") >= day).select("lot_id"), "lot_id", "left_semi").select("lot_id", "inn").distinct().join(old, "inn", "left_anti")


def newcomer_ranks(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, inn, rank of the true winner among the pool (1 + companies with a higher score; 0 if it doesn't fit). truth: query_id, inn."""
    ranked = scores.select("query_id", "inn", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("pool_score"))).alias("rank"))
    return truth.join(ranked, ["query_id", "inn"], "left").select("query_id", "inn", F.coalesce(F.col("rank").cast("long"), F.lit(0)).alias("rank"))


def newcomer_recall(ranks: DataFrame, tops: tuple[int, ...] = (10, 50, 200)) -> DataFrame:
    """n, matched (share of newcomers that fit at all) and top10, top50, top200: shares of newcomers that the pool's ranking puts so high."""
    share = lambda hit: F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4)
    return ranks.agg(F.count("*").alias("n"), share(F.col("rank") > 0).alias("matched"), *[share(F.col("rank").between(1, k)).alias(f"top{k}") for k in tops])


def learned_weights(rows: DataFrame, label: str, columns: list[str]) -> dict[str, float]:
    """Weights of factors by logistic regression with balanced classes; negative ones are cut, the rest sum to one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weighted = rows.withColumn("__w", F.coalesce(*[F.when(F.col(label) == y, total / (len(counts) * c)) for y, c in counts.items()]))
    data = VectorAssembler(inputCols=columns, outputCol="__x").transform(weighted)
    fitted = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=200, regParam=1.0 / max(total, 1), standardization=False).fit(data)
    kept = np.clip(np.array(fitted.coefficients), 0, None)
    return dict(zip(columns, (kept / (kept.sum() or 1.0)).round(4).tolist(), strict=True))


def lot_code_lists(items: DataFrame) -> DataFrame:
    """query_id, code8, at: a lot's codes in the order of its item names."""
    rows = items.filter("okpd2_code is not null").select(F.col("lot_id").alias("query_id"), level(F.col("okpd2_code"), 8).alias("code8"), "product_name")
    first = rows.groupBy("query_id", "code8").agg(F.min("product_name").alias("name"))
    return first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("name", "code8"))).select("query_id", "code8", "at")
