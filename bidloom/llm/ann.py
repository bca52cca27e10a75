"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is cut into balanced parts with few edges between them, and a softmax classifier
learns to tell a vector's part (its targets are the parts of its neighbours). Every row of the table goes to its most
probable part, every query to its `probes` most probable ones, where all vectors are reranked by exact double distances.
The number of probes is the least with which RECALL of the sample's own neighbours are found; a warning says so where
that takes all parts. The number of parts follows the table (ROWS_PER_PART), from PARTS up to MOST_PARTS, and the sample
follows the parts.

Parts are cut into chunks and queries into blocks of bounded size, so that no task holds a whole part, however many
equal vectors it has. A query that finds fewer than it should is searched again in all parts. Only the classifier is
broadcast.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of another length
than most have a part for each length, where all are compared; a query is compared with every row but its own, rows that
repeat its id included; of rows with one id that are queries, the least vector asks; equal distances go by the smaller
vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table
from .vectors import matrix, usable

NEIGHBOURS = 10
#: Sample rows at least and at most, and parts.
SAMPLE, MOST_SAMPLED, PARTS, MOST_PARTS, ROWS_PER_PART = 4096, 16_384, 16, 256, 20_000
RECALL = 0.97
#: Vectors and queries of one part that meet in one task.
CHUNK, QUERY_BLOCK = 20_000, 10_000


def nearest(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k rows of x nearest to each row of q."""
    d = (x * x).sum(1)[None, :] - 2 * q @ x.T
    k = min(k, len(x))
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row: halves along principal axes, then moves that cut fewer edges while no part outgrows the mean by 5 %."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        split = []
        for g in groups:
            centred = x[g] - x[g].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = g[np.argsort(centred @ axis, kind="stable")]
            split += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = split
    for k, g in enumerate(groups):
        label[g] = k
    edges = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    counts = np.bincount(label, minlength=len(groups))
    most = int(np.ceil(len(x) / len(groups) * 1.05))
    votes = np.zeros((len(x), len(groups)), np.int64)
    np.add.at(votes, (edges[:, 0], label[edges[:, 1]]), 1)
    around = [[] for _ in range(len(x))]
    for a, b in edges.tolist():
        around[a].append(b)
    for _ in range(5):
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            old = label[i]
            for new in np.argsort(-votes[i], kind="stable").tolist():
                if votes[i, new] <= votes[i, old]:
                    break
                if counts[new] < most:
                    label[i] = new
                    counts[old] -= 1
                    counts[new] += 1
                    for j in around[i]:
                        votes[j, old] -= 1
                        votes[j, new] += 1
                    moved += 1
                    break
        if not moved:
            break
    return label


class Router:
    """A softmax classifier from vectors to parts, and how many parts to probe."""

    def __init__(self, sample: np.ndarray, parts: int = PARTS, recall: float = RECALL, k: int = NEIGHBOURS):
        parts = max(1, min(parts, 1 << max(0, (len(sample) // 32).bit_length() - 1))) if len(sample) else 1
        self.parts, self.centre = parts, sample.mean(0) if len(sample) else 0.0
        self.scale = float(np.sqrt(((sample - self.centre) ** 2).sum(1).mean())) or 1.0 if len(sample) else 1.0
        self.weights, self.probes = np.zeros((sample.shape[1] + 1, parts)), parts
        if parts == 1:
            return
        graph = nearest(sample, sample, k + 1)
        graph = np.array([[j for j in row if j != i][:k] for i, row in enumerate(graph.tolist())])
        label = balanced_parts(sample, graph, parts)
        target = np.zeros((len(sample), parts))
        np.add.at(target, (np.repeat(np.arange(len(sample)), k), label[graph].ravel()), 1 / (2 * k))
        target[np.arange(len(sample)), label] += 0.5
        f = self.features(sample)
        mean, square = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, 301):
            slope = f.T @ (self.softmax(f) - target) / len(f) + 1e-5 * self.weights
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            self.weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        order = self.order(sample)
        home = order[:, 0]
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(order), 0), 1)
        needed = np.take_along_axis(rank, home[graph], 1)
        self.probes = next(p for p in range(1, parts + 1) if (needed < p).mean() >= recall)
        if self.probes == parts:
            warnings.warn(f"a recall of {recall} takes all {parts} parts: these vectors hold no partition, every row is compared", stacklevel=2)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.centre) / self.scale * 4, np.ones((len(x), 1))])

    def softmax(self, f: np.ndarray) -> np.ndarray:
        z = f @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from most to least probable."""
        return np.argsort(-(self.features(x) @ self.weights), axis=1, kind="stable")


def search_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k nearest vectors of this chunk for each query of this block, by exact distances and then ids."""
    if not queries.num_rows or not vectors.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    qid, vid = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
    own, row_of = queries.column("row").to_numpy(), vectors.column("row").to_numpy()
    q, x = matrix(queries.column("query")), matrix(vectors.column("vector"))
    squares = (x * x).sum(1)
    slack = 1e-9 * (squares.max() + (q * q).sum(1))
    out = []
    for start in range(0, len(q), 256):
        rough = squares[None, :] - 2 * q[start : start + 256] @ x.T
        for i, row in enumerate(rough, start):
            kth = np.partition(row, min(k, len(row) - 1))[min(k, len(row) - 1)]  # one more than k: the query itself may be there
            near = np.flatnonzero((row <= kth + slack[i]) & (row_of != own[i]))
            exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
            best = np.lexsort((vid[near], exact))[:k]
            out.append((np.full(len(best), qid[i]), vid[near[best]], exact[best]))
    return pa.table({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("query_id", "vec_id", "score"))})


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, sample: int | None = None, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = lengths["size"]
    parts = parts or min(MOST_PARTS, max(PARTS, 1 << (lengths["count"] // ROWS_PER_PART).bit_length()))
    sample = sample or min(MOST_SAMPLED, max(SAMPLE, 64 * parts))
    taken = np.array([r["vector"] for r in rows.filter(F.size("vector") == size).select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(sample).collect()], float)
    shared = spark.sparkContext.broadcast(Router(taken.reshape(len(taken), -1), parts, recall, k))

    def routed(batches):
        for b in batches:
            lists, held = b.column("vector").value_lengths().to_numpy(), [None] * b.num_rows
            usual = np.flatnonzero(lists == size)
            for i, order in zip(usual, shared.value.order(matrix(b.column("vector").take(pa.array(usual)))).tolist() if len(usual) else [], strict=True):
                held[i] = order
            for i in np.flatnonzero(lists != size):
                held[i] = [-int(lists[i])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held, pa.list_(pa.int32()))], ["vec_id", "vector", "row", "parts"])

    kind = rows.schema["vector"].dataType.simpleString()
    index = settle(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(routed, f"vec_id long, vector {kind}, row long, parts array<int>"))
    homes = index.select("vec_id", "vector", "row", F.element_at("parts", 1).alias("part"))
    asked = index.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct(F.col("vector").alias("query"), "row", "parts")).alias("q")).select("query_id", "q.*")
    counts = {r["part"]: r["count"] for r in homes.groupBy("part").count().collect()}  # as many rows as there are parts
    queries = asked.count()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chunks = F.element_at(F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, -(-n // CHUNK))]), F.col("part"))
    blocks = -(-queries // QUERY_BLOCK)

    def look(asked: DataFrame, probes: int) -> DataFrame:
        sent = asked.select("query_id", "query", "row", F.explode(F.slice("parts", 1, probes)).alias("part")).withColumn("chunks", chunks).filter("chunks is not null")
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        held = homes.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["part", "chunk", "block"]
        found = sent.select(*keys, "query_id", "query", "row").groupBy(*keys).cogroup(held.select(*keys, "vec_id", "vector", "row").groupBy(*keys)).applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return settle(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))

    first = look(asked, shared.value.probes)
    total = sum(n for p, n in counts.items() if p >= 0)
    if shared.value.probes < shared.value.parts:
        full = first.groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1)).select("query_id")
        short = settle(asked.filter(F.element_at("parts", 1) >= 0).join(full, "query_id", "left_anti"))
        if short.limit(1).count():
            first = first.join(short.select("query_id"), "query_id", "left_anti").unionByName(look(short, shared.value.parts))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
