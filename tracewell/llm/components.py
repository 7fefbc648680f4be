"""Connected components over an edge table by alternating large-star and
small-star rounds. Each round is two aggregations and two joins of the edges;
before it, chunks of at most CHUNK edges are each drawn together to stars where they
lie, without a shuffle, which leaves fewer rounds. The smallest node that a node is
tied to only falls from step to step, so the rounds end; they grow with the logarithm
of the longest path at most. Sums are written before they are joined with: Spark
splits a join at a hub only between plain exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import staged

MAX_ROUNDS = 60
CHUNK = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b -> node, root: each node of more than itself with the smallest node of its group."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root[root], root):
            root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _drawn_together(chunk: int):
    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(x.column("a").to_numpy(), x.column("b").to_numpy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if held and sum(h.num_rows for h in held) + part.num_rows > chunk:
                    yield one(held)
                    held = []
                held.append(part)
        if held:
            yield one(held)

    return run


def _settled(edges: DataFrame) -> bool:
    """Every node hangs once on a node that hangs on none, or is such a node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
    by_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by_node.where(F.col("hangs") + F.col("holds") > 1).isEmpty()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """edges(a, b) long -> (node, component): smallest node reachable. Self-loops
    and null ends are ignored; nodes without an edge don't appear."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = staged(e.mapInArrow(_drawn_together(chunk), "a long, b long"), "links")
    for _ in range(MAX_ROUNDS):
        # Written above in small pieces, these are read in larger ones.
        e = staged(e.mapInArrow(_drawn_together(chunk), "a long, b long"), "links")
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "links")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), "links")
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
