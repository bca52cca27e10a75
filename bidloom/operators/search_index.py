"""A kept index and an exact top-k search that doesn't read what can't matter.

The index is a folder of Parquet tables. A segment holds the documents that were added at one time: `forward` (a document's
terms) and `blocks`, the postings of a term in parts of about BLOCK documents of like weight, each with the greatest weight
in it. A version holds what depends on all documents: `terms` (document frequencies) and `norms`. Adding documents writes
their segment and a new version: frequencies are summed and norms recomputed from the terms that are kept, texts aren't
read again and old blocks stay. Inverse frequencies are applied when a query is asked, so a search after an addition finds
what an index fitted to all documents at once would. A block's greatest weight was taken with the norms of its time; a
segment's least quotient of new and old norms keeps it an upper bound.

Search. Weights aren't negative, so a document's score is at most the sum of its terms' greatest ones. The blocks that may
weigh most are read until they hold twice the documents asked for; the k-th best score among these is a threshold. Then
lists whose greatest weights together stay below it are left out, and of the others the blocks that can't reach it with all
else. Documents found there whose score, with the most that unread blocks could add, reaches the threshold are scored from
their own terms. Blocks of a term lie in many partitions: a term that many documents hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions.lineage import settled

#: Documents in a block, about; weights of a block lie within a factor of 2 ** (1 / CLASSES).
BLOCK, CLASSES = 256, 4
#: Scores are rounded to nine places before they are ranked; bounds allow for that.
SLACK = 1e-8


class Kept(NamedTuple):
    folder: str
    version: int
    documents: int
    min_df: int
    max_df: float
    #: For each segment, the least quotient of a document's norm now and when the segment was written.
    shrinks: list[float]
    #: id, held (array of term, tf), segment; segment, term, class, part, size, top, postings (array of id, tf); term, df; id, segment, norm, first
    forward: DataFrame
    blocks: DataFrame
    terms: DataFrame
    norms: DataFrame

    @property
    def idf(self) -> DataFrame:
        """term, df, idf of the terms that are in neither too few nor too many documents."""
        df = F.col("df")
        return self.terms.filter((df >= self.min_df) & (df <= F.lit(self.max_df * self.documents))).withColumn("idf", F.ln(F.lit(1 + self.documents) / (1 + df)) + 1)

    def held(self, rows: DataFrame) -> DataFrame:
        """The rows (with id) once for each term of the index in their document."""
        own = rows.join(self.forward.select("id", F.col("held.term").alias("of")), "id")
        return own.select(*rows.columns, F.explode("of").alias("term"))


def opened(spark: SparkSession, folder: str) -> Kept:
    """The latest version in a folder; a version whose writing didn't end doesn't count."""
    state = spark.read.parquet(f"{folder}/state").orderBy(F.desc("version")).first()
    version = state["version"]
    within = lambda df: df.filter(F.col("segment") <= version)
    return Kept(
        folder, version, state["documents"], state["min_df"], state["max_df"], list(state["shrinks"]), within(spark.read.parquet(f"{folder}/forward")), within(spark.read.parquet(f"{folder}/blocks")),
        spark.read.parquet(f"{folder}/terms/version={version}"), spark.read.parquet(f"{folder}/norms/version={version}"),
    )


def created(docs: DataFrame, folder: str, min_df: int = 2, max_df: float = 0.3) -> Kept:
    """docs: id, terms (array, repeats count). Writes an index to an empty folder."""
    return _extended(docs, folder, None, min_df, max_df)


def added(index: Kept, docs: DataFrame) -> Kept:
    """The index with further documents, whose ids must be new."""
    if not docs.join(index.forward.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("some of these documents are in the index")
    return _extended(docs, index.folder, index, index.min_df, index.max_df)


def _extended(docs: DataFrame, folder: str, before: Kept | None, min_df: int, max_df: float) -> Kept:
    spark, version = docs.sparkSession, 0 if before is None else before.version + 1
    documents = docs.count() + (before.documents if before else 0)
    counts = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg((1 + F.ln(F.count("*"))).alias("tf"))
    path = f"{folder}/forward/segment={version}"
    counts.groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("held")).write.mode("overwrite").parquet(path)
    forward = spark.read.parquet(path).withColumn("segment", F.lit(version))
    own = forward.select("id", F.explode("held").alias("x")).select("id", "x.*")
    dfs = own.groupBy("term").agg(F.count("*").alias("df"))
    if before is not None:
        dfs = dfs.unionByName(before.terms).groupBy("term").agg(F.sum("df").alias("df"))
    dfs.write.mode("overwrite").parquet(f"{folder}/terms/version={version}")
    empty = Kept(folder, version, documents, min_df, max_df, [], forward, None, spark.read.parquet(f"{folder}/terms/version={version}"), None)
    idf = empty.idf.select("term", "idf")

    # Norms of all documents with the frequencies of now; where no term counts, that of a document as if all did.
    every = forward if before is None else before.forward.unionByName(forward)
    rows = every.select("id", "segment", F.explode("held").alias("x")).select("id", "segment", "x.*").join(idf, "term", "left")
    square = lambda c: F.sqrt(F.sum(c * c))
    norms = rows.groupBy("id", "segment").agg(square(F.col("tf") * F.col("idf")).alias("norm"), square(F.col("tf")).alias("plain"))
    first = F.coalesce("norm", "plain") if before is None else F.coalesce("was", "norm", "plain")
    if before is not None:
        norms = norms.join(before.norms.select("id", F.col("first").alias("was")), "id", "left")
    norms.select("id", "segment", "norm", first.alias("first")).write.mode("overwrite").parquet(f"{folder}/norms/version={version}")
    norms = spark.read.parquet(f"{folder}/norms/version={version}")

    weights = own.join(norms.filter(F.col("segment") == version).select("id", "first"), "id").withColumn("value", F.col("tf") / F.col("first"))
    weights = weights.withColumn("class", F.floor(-CLASSES * F.log2("value")).cast("int"))
    large = weights.groupBy("term", "class").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)), F.lit(0)).cast("int")
    parts = weights.join(large, ["term", "class"], "left").withColumn("part", part).groupBy("term", "class", "part")
    parts.agg(F.count("*").alias("size"), F.max("value").alias("top"), F.collect_list(F.struct("id", "tf")).alias("postings")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/blocks/segment={version}")
    least = {r["segment"]: r["least"] for r in norms.groupBy("segment").agg(F.min(F.col("norm") / F.col("first")).alias("least")).collect()}
    shrinks = [float(least.get(k) or 1.0) for k in range(version + 1)]
    state = spark.createDataFrame([(version, documents, min_df, float(max_df), shrinks)], "version int, documents long, min_df int, max_df double, shrinks array<double>")
    state.coalesce(1).write.mode("append").parquet(f"{folder}/state")
    return opened(spark, folder)


def listed(vectors: DataFrame, index: Kept) -> DataFrame:
    """The blocks of each query's terms: query_id, term, x (the query's share of a score), segment, class, part, size and gain, the most that a document in it gets there. vectors: query_id, term, w."""
    shrink = F.element_at(F.array(*map(F.lit, index.shrinks)), F.col("segment").cast("int") + 1)
    asked = vectors.join(index.idf.select("term", "idf"), "term").select("query_id", "term", (F.col("w") * F.col("idf")).alias("x"))
    return asked.join(index.blocks.select("term", "segment", "class", "part", "size", "top"), "term").withColumn("gain", F.col("x") * F.col("top") / shrink).drop("top")


def sums(chosen: DataFrame, index: Kept) -> DataFrame:
    """query_id, id, score: what the chosen blocks add to the documents in them."""
    rows = chosen.select("query_id", "x", "term", "segment", "class", "part").join(index.blocks.select("term", "segment", "class", "part", "postings"), ["term", "segment", "class", "part"])
    rows = rows.select("query_id", "x", F.explode("postings").alias("p")).groupBy("query_id", F.col("p.id").alias("id")).agg(F.sum(F.col("x") * F.col("p.tf")).alias("raw"))
    return rows.join(index.norms.select("id", "norm"), "id").select("query_id", "id", (F.col("raw") / F.col("norm")).alias("score"))


class Bounds(NamedTuple):
    #: query_id, threshold: a score that k documents reach, 0 where fewer were seen.
    thresholds: DataFrame
    #: The listed blocks with `read`: whether a document that matters may stand there.
    blocks: DataFrame


def bounds(vectors: DataFrame, index: Kept, k: int, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> Bounds:
    lists = settled(listed(vectors, index))
    strongest = Window.partitionBy("query_id").orderBy(F.desc("gain"), "term", "segment", "class", "part").rowsBetween(Window.unboundedPreceding, -1)
    probe = lists.withColumn("before", F.coalesce(F.sum("size").over(strongest), F.lit(0))).filter(F.col("before") < 2 * k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    kth = kept(sums(probe, index)).withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("threshold"))
    thresholds = settled(vectors.select("query_id").distinct().join(kth, "query_id", "left").select("query_id", F.coalesce("threshold", F.lit(0.0)).alias("threshold")))
    whole, rising = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("most", "term")
    of_terms = lists.groupBy("query_id", "term").agg(F.max("gain").alias("most")).withColumn("total", F.sum("most").over(whole)).withColumn("weak", F.sum("most").over(rising)).join(thresholds, "query_id")
    least = F.col("threshold") - SLACK
    read = (F.col("weak") >= least) & (F.col("gain") + F.col("total") - F.col("most") >= least)
    return Bounds(thresholds, lists.join(of_terms, ["query_id", "term"]).withColumn("read", read).drop("total", "weak", "most", "threshold"))


def similar(vectors: DataFrame, index: Kept, k: int, eligible: DataFrame | None = None, pair_filter: Column | None = None, asked: DataFrame | None = None, barred: DataFrame | None = None) -> DataFrame:
    """query_id, id, sim, place: what retrieval.similar finds, with the same arguments; vectors as retrieval.query_vectors makes them with the index's idf."""

    def allowed(found: DataFrame) -> DataFrame:
        columns = found.columns
        found = found if eligible is None else found.join(eligible, "id")
        found = found if asked is None else found.join(asked, "query_id")
        found = (found if pair_filter is None else found.filter(pair_filter)).select(*columns)
        return found if barred is None else found.join(barred.select("query_id", "id"), ["query_id", "id"], "left_anti")

    vectors = settled(vectors)
    bound = bounds(vectors, index, k, allowed)
    blocks = settled(bound.blocks)
    unread = blocks.filter(~F.col("read")).groupBy("query_id", "term").agg(F.max("gain").alias("most")).groupBy("query_id").agg(F.sum("most").alias("rest"))
    limits = bound.thresholds.join(unread, "query_id", "left")
    seen = allowed(sums(blocks.filter("read"), index)).join(limits, "query_id").filter(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("threshold") - SLACK)
    seen = settled(seen.select("query_id", "id", "score", "rest"))
    terms = seen.filter("rest is not null").select("query_id", "id").join(index.forward.select("id", "held"), "id").select("query_id", "id", F.explode("held").alias("h")).select("query_id", "id", "h.*")
    x = vectors.join(index.idf.select("term", "idf"), "term").select("query_id", "term", (F.col("w") * F.col("idf")).alias("x"))
    scored = terms.join(x, ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("x") * F.col("tf")).alias("raw")).join(index.norms.select("id", "norm"), "id").select("query_id", "id", (F.col("raw") / F.col("norm")).alias("score"))
    found = seen.filter("rest is null").select("query_id", "id", "score").unionByName(scored).select("query_id", "id", F.round("score", 9).alias("sim")).filter("sim > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
