"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A hash function turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the nearest
of the 2 D corners of the cross-polytope. FUNCTIONS of them name a bucket of one of TABLES tables; a vector also goes to
the buckets in which one function takes its second-nearest corner. Equal vectors of one label are one class,
told apart by 128 bits.

Candidates are never listed pair by pair: in each bucket every class is verified against the bucket's hub (random per
bucket), the links form components, and buckets that still hold several components are compared in blocks of bounded
size across components. All links of a vector lie in its component, so links are then counted by blocked exact cosines
inside components; a link that the hashing missed but whose ends are connected otherwise counts too.

Defined cases: vectors that are null, zero or hold null or non-finite components and rows with a null label link with
nothing; vectors of different lengths never link; rows that repeat are other vectors to each other; null ids are the
last to be chosen; an empty table gives an empty result; only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, attach, mix64, rekeyed, settle, table
from .graph import components
from .vectors import matrix, unit, usable

COSINE = 0.98
TABLES, FUNCTIONS = 16, 3
#: Classes of a bucket or component that are compared in one block.
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def corners(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second-nearest corner of the cross-polytope for each row, by the k-th rotation."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    rng = np.random.default_rng(7919 * (k + 1) + size)
    y = np.zeros((n, size))
    y[:, :d] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
    a = np.abs(y)
    first = a.argmax(1)
    rows = np.arange(n)
    low = first * 2 + (y[rows, first] < 0)
    a[rows, first] = -1
    second = a.argmax(1)
    return low, second * 2 + (y[rows, second] < 0)


def buckets(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Bucket keys of unit vectors, TABLES * (1 + FUNCTIONS) each; salt keeps labels apart."""
    out = []
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            near = [corners(x, t * FUNCTIONS + f) for f in range(FUNCTIONS)]
            for probe in range(-1, FUNCTIONS):
                key = np.full(len(x), t, np.uint64)
                for f in range(FUNCTIONS):
                    key = key * np.uint64(4 * x.shape[1] + 8) + near[f][int(f == probe)].astype(np.uint64)
                out.append(mix64(key + salt))
    return np.stack(out, axis=1).view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list[int] | None] = [None] * b.num_rows
        sizes = np.array(b.column("size").to_pylist())
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = unit(matrix(b.column("vector").take(pa.array(at))))
            salt = mix64(b.column("label_key").to_numpy()[at].view(np.uint64) + np.uint64(d))
            for i, keys in zip(at, buckets(x, salt).tolist(), strict=True):
                rows[i] = keys
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(rows, pa.list_(pa.int64()))], ["node", "buckets"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one length whose cosine reaches the threshold."""
    for b in batches:
        a, c = b.column("vector_a"), b.column("vector_b")
        sizes = np.array([a.value_lengths().to_numpy(), c.value_lengths().to_numpy()]).reshape(2, -1)
        keep = np.zeros(b.num_rows, bool)
        for d in np.unique(sizes[0][sizes[0] == sizes[1]]):
            at = np.flatnonzero((sizes[0] == d) & (sizes[1] == d))
            pick = pa.array(at)
            keep[at] = (unit(matrix(a.take(pick))) * unit(matrix(c.take(pick)))).sum(1) >= COSINE
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["u", "v"])


def _links(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of a block pair: its place, the places of the rows it links with, for rows of one label and length."""
    block, label, size = (t.column(c).to_numpy() for c in ("block", "label_key", "size"))
    apart = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    for kind in {(a, b) for a, b in zip(label.tolist(), size.tolist(), strict=True)}:
        at = np.flatnonzero((label == kind[0]) & (size == kind[1]))
        x = unit(matrix(t.column("vector").take(pa.array(at))))
        near = x @ x.T >= COSINE
        if apart:
            near &= block[at][:, None] != block[at][None, :]
        np.fill_diagonal(near, False)
        yield at, near


def _across(t: pa.Table) -> pa.Table:
    """Links between components, one for each two components of the block pair."""
    t = t.combine_chunks()
    node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for at, near in _links(t):
        near &= comp[at][:, None] != comp[at][None, :]
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            p, q = at[i], at[j]
            found.setdefault((min(comp[p], comp[q]), max(comp[p], comp[q])), (node[p], node[q]))
    return pa.table({"u": pa.array([int(u) for u, _ in found.values()], pa.int64()), "v": pa.array([int(v) for _, v in found.values()], pa.int64())})


def _counted(t: pa.Table) -> pa.Table:
    """Rows of other classes that each class of a block pair links with."""
    t = t.combine_chunks()
    members, total = t.column("members").to_numpy(), np.zeros(t.num_rows, np.int64)
    for at, near in _links(t):
        total[at] += near @ members[at]
    return pa.table({"node": t.column("node"), "n": pa.array(total)})


def dealt(members: DataFrame, key: str, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deals the members of each key into block pairs (i, j) of at most 2 * block rows or so. sizes: key, m."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    return (
        attach(members, sizes, key, "inner", 500_000)
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("with", "m")
    )


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    rows = vectors.select("vec_id", "embedding", F.col("label").alias("label")).withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull())
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "embedding"))).withColumn("high", F.xxhash64(F.lit(7), "embedding", "label"))
    rows = rekeyed(rows, apart(rows.select("node", "high")))
    classes = settle(
        rows.filter("ok").groupBy("node").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("members"), F.first("embedding").alias("vector"), F.first(F.xxhash64("label")).alias("label_key"), F.first(F.size("embedding")).alias("size")
        )
    )
    keyed = settle(classes.select("node", "vector", "label_key", "size").mapInArrow(_hashed, "node long, buckets array<long>"))
    entries = keyed.select("node", F.explode(F.array_distinct("buckets")).alias("key"))
    ranked = F.col("node").bitwiseXOR(F.col("key"))
    shared = entries.groupBy("key").agg(F.min(ranked).alias("low"), F.max(ranked).alias("high")).filter("low != high")
    shared = settle(shared.select("key", F.col("low").bitwiseXOR(F.col("key")).alias("hub")))
    members = settle(attach(entries, shared, "key", "inner", 500_000))
    stars = members.filter("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    for end in ("a", "b"):
        stars = stars.join(classes.select(F.col("node").alias(end), F.col("vector").alias(f"vector_{end}"), F.col("label_key").alias(f"label_{end}")), end)
    first = settle(stars.filter("label_a = label_b").mapInArrow(_pairs, "u long, v long"))
    comps = components(first)

    member = attach(members.select("key", "node"), comps, "node", "left", 500_000).withColumn("comp", F.coalesce("component", "node")).drop("component")
    open_keys = settle(member.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high and m > 2").select("key", "m"))
    blocks = dealt(member, "key", open_keys).join(classes.select("node", "vector", "label_key", "size"), "node")
    across = settle(blocks.groupBy("key", "i", "j").applyInArrow(_across, "u long, v long"))
    comps = components(first.union(across))

    sizes = settle(comps.groupBy("component").agg(F.count("*").alias("m")))
    inside = dealt(comps, "component", sizes).join(classes.select("node", "vector", "label_key", "size", "members"), "node")
    counted = inside.groupBy("component", "i", "j").applyInArrow(_counted, "node long, n long").groupBy("node").agg(F.sum("n").alias("others"))
    least = settle(comps.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id")))
    linked = attach(comps, least, "component", "inner", 500_000).join(counted, "node").select("node", "component_id", "others")
    found = settle(
        classes.join(linked, "node", "left").filter("members > 1 or others is not null")
        .select("node", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    )
    out = attach(rows.select("vec_id", "node"), found, "node", "left", 500_000)
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.v FROM r JOIN e ON r.other = e.u),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.u = c.vec_id
"""
