"""Connected components of an undirected graph given as an edge table, without ever collecting it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: So many edges are one task's work; more are contracted by star operations first.
EDGES_PER_TASK = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links every node of this task's edges to the smallest node it reaches by them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star operation; a node with many edges is only ever aggregated."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = settle(large.filter(F.col("u") != F.col("v")).distinct())
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return settle(small.filter(F.col("u") != F.col("v")).distinct())


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """edges: u, v (long). Returns node, component (the smallest node it is connected with) for every node that has an edge.

    Edges between a node and itself make it a component of its own; null ends are ignored; no edges give no rows."""
    edges = edges.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    state = settle(edges.mapInArrow(_forest, "u long, v long").distinct())
    nodes = state.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if state.count() <= edges_per_task:
        return settle(state.repartition(1).mapInArrow(_forest, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("component")))
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state, before = state.filter(F.col("u") != F.col("v")), None
    while (now := mark(state)) != before:
        before, state = now, _stars(state)
    return settle(nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node")))
