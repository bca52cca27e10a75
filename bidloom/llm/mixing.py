"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each document has a fixed 60-bit hash of its id and text. A source that must give T of its S words gives every document floor(T / S) times
and once more those documents whose hash lies below a threshold. The threshold comes from histograms: words summed by
source and hash bucket, the bucket in which the running sum crosses the remaining budget found, and only that bucket
refined with the next bits. Nothing is sorted by hash and the filter is one comparison; a larger target of the same
source takes a superset (nested budgets).

Rows equal in id and text share their hash. Where the threshold falls among them, it is refined further by the bits of
their row numbers, so that as many of them go in as the budget holds; which of them makes no difference to the result.

Defined cases: null text has size 0; a null source is a source of its own, last in order; null ids hash as the empty
string, and as such together with the text; rows that repeat are taken one by one; an empty table gives an empty result; a
source without words gets target 0 and gives nothing; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, attach, settle, table

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
MOST_REPEATS = 3
#: Bits of the hash that one histogram resolves, and of the whole hash.
STEP_BITS, HASH_BITS = 12, 60
#: Bits of row numbers.
SALT_BITS = 60


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.struct(source.isNull(), F.coalesce(source, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    Weights share the total; a source's target stops at `repeats` times its size and the excess goes to the others by
    weight until none is above. In order of size / weight the capped sources are a prefix, so running sums give the
    water level directly instead of a loop. The windows hold one row per source, never documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(repeats)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", cap)
    )
    whole = Window.partitionBy()
    return (
        sources.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("open", F.col("weight") * F.col("level") <= F.col("cap"))
        .withColumn("pos", F.row_number().over(by_ratio))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("pos", "level"))).over(whole))
        .withColumn("target", F.when(F.col("pos") >= F.col("first.pos"), F.col("weight") * F.col("first.level")).otherwise(F.col("cap").cast("double")))
        .select("source", "rank", "source_size", "target")
    )


def refined(state: DataFrame, rows: DataFrame, code: str, bits: int) -> DataFrame:
    """Finds the value of `code` at which a source's budget `left` runs out, histogram by histogram.

    state: rank, left, low. Returns rank, left (of the budget within that value), low (the value; the old one where the
    budget isn't reached), edge_words and edge_rows (words and rows that have the value; null where it isn't reached)."""
    for shift in range(bits - STEP_BITS, -1, -STEP_BITS):
        width = 1 << shift
        # low: start of the boundary bucket found so far; only documents inside it are counted again.
        inside = attach(rows.select("rank", "size", code), state.select("rank", "low", "left"), "rank", "inner")
        if shift < bits - STEP_BITS:
            inside = inside.filter((F.col(code) >= F.col("low")) & (F.col(code) < F.col("low") + F.lit(width << STEP_BITS)))
        bins = inside.groupBy("rank", F.shiftright(code, shift).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.max("left").alias("left"))
        running = Window.partitionBy("rank").orderBy("bin")
        crossed = (
            bins.withColumn("upto", F.sum("words").over(running))
            .filter(F.col("upto") > F.col("left"))
            .groupBy("rank").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "words", "rows"), "bin").alias("at"))
        )
        state = settle(
            state.join(crossed, "rank", "left").select(
                "rank", (F.col("left") - F.coalesce(F.col("at.before"), F.lit(0))).alias("left"),
                F.when(F.col("at").isNull(), F.col("low")).otherwise(F.col("at.bin") * F.lit(width)).alias("low"),
                F.col("at.words").alias("edge_words"), F.col("at.rows").alias("edge_rows"),
            )
        )
    return state


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """rank, whole (times every document goes in), edge, edge_salt: documents below them (by hash, then row number) go in once more."""
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.when(some, F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).otherwise(0.0)
    goals = goals.select("rank", whole.alias("whole"), left.alias("left"), F.lit(0).cast("long").alias("low"))
    state = refined(goals.drop("whole"), sizes, "hash", HASH_BITS)
    # The document on the edge goes in if that brings the source nearer to its target.
    nearer = F.coalesce(F.col("edge_words"), F.lit(0)) < 2 * F.col("left")
    found = state.withColumn("edge_salt", F.when(nearer, F.lit((1 << 63) - 1)).otherwise(F.lit(0)).cast("long"))
    several = state.filter("edge_rows > 1")
    if several.limit(1).count():
        equal = attach(sizes, several.select("rank", F.col("low").alias("hash")), ["rank", "hash"], "inner")
        fine = refined(several.select("rank", "left", F.lit(0).cast("long").alias("low")), equal, "salt", SALT_BITS)
        fine = fine.select("rank", (F.col("low") + nearer.cast("long")).alias("fine"))
        found = found.join(fine, "rank", "left").withColumn("edge_salt", F.coalesce("fine", "edge_salt"))
    return goals.select("rank", "whole").join(found.select("rank", F.col("low").alias("edge"), "edge_salt"), "rank")


def times(hash_: Column, salt: Column, whole: Column, edge: Column, edge_salt: Column) -> Column:
    return whole + ((hash_ < edge) | ((hash_ == edge) & (salt < edge_salt))).cast("long")


def hashed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, hash and salt (the row number) of each document, and `more`."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"), F.monotonically_increasing_id().alias("salt"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (how often the mix takes the document), one row per input row."""
    sizes = settle(hashed(docs))
    goals = settle(targets(sizes, weights, repeats))
    keyed = goals.select(source_key(F.col("source")).alias("key"), "rank", "source_size", "target")
    ranked = attach(sizes.withColumn("key", source_key(F.col("source"))), keyed, "key", "inner").drop("key")
    edges = settle(thresholds(ranked, goals))
    copies = times(F.col("hash"), F.col("salt"), F.col("whole"), F.col("edge"), F.col("edge_salt"))
    return attach(ranked, edges, "rank", "inner").select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), "hash", "edge", "whole")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with their columns.

    The decision is joined as the thresholds of the source (one row per source), so texts are not shuffled; row numbers are
    those of the scan, which must deal out the table alike both times it is read."""
    sizes = settle(hashed(docs).drop("doc_id"))
    goals = settle(targets(sizes, weights, repeats))
    keyed = goals.select(source_key(F.col("source")).alias("key"), "rank")
    ranked = attach(sizes.withColumn("key", source_key(F.col("source"))), keyed, "key", "inner")
    edges = settle(keyed.join(thresholds(ranked, goals), "rank").drop("rank"))
    marked = hashed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", source_key(F.col("source")))
    taken = attach(marked, edges, "key", "inner").withColumn("times", times(F.col("hash"), F.col("salt"), F.col("whole"), F.col("edge"), F.col("edge_salt"))).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s0),
s2 AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * {MOST_REPEATS} AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM s2),
s4 AS (SELECT *, CAST(total - cap_before AS DOUBLE) / (all_weight - weight_before) AS level FROM s3),
s5 AS (SELECT *, weight * level <= cap AS is_open FROM s4),
s6 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rnk) AS pos FROM s5),
s7 AS (SELECT *, min(CASE WHEN is_open THEN pos END) OVER () AS first_pos FROM s6),
s8 AS (SELECT *, min(CASE WHEN pos = first_pos THEN level END) OVER () AS water FROM s7),
goals AS (SELECT source, source_size, CASE WHEN pos >= first_pos THEN weight * water ELSE CAST(cap AS DOUBLE) END AS target FROM s8),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
byhash AS (SELECT source, h, sum(size) AS words FROM sizes GROUP BY source, h),
run AS (SELECT b.source, b.h, b.words, sum(b.words) OVER (PARTITION BY b.source ORDER BY b.h) AS upto FROM byhash b),
edge AS (
  SELECT g.source, arg_min(r.h, r.h) AS h, arg_min(r.words, r.h) AS words, arg_min(r.upto - r.words, r.h) AS before
  FROM g JOIN run r ON r.source IS NOT DISTINCT FROM g.source
  WHERE r.upto > CASE WHEN g.source_size > 0 THEN g.target - g.whole * g.source_size ELSE 0 END GROUP BY g.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
  d.size * (g.whole + CASE WHEN d.h < e.h OR (d.h = e.h AND e.words < 2 * ((g.target - g.whole * g.source_size) - e.before)) THEN 1 ELSE 0 END) AS taken
FROM sizes d JOIN g ON g.source IS NOT DISTINCT FROM d.source LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM d.source
"""
