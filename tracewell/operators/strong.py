"""Strongly connected components, by trimming and forward/backward colouring.

Joins of tables that grow with the nodes are hinted: Spark would broadcast them for
their small files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import staged

MAX_ROUNDS = 1000


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both ways, until none goes."""
    left = edges.count()
    for _ in range(MAX_ROUNDS):
        ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))))
        inner = staged(ends.groupBy("node").agg(F.bool_or("out").alias("o"), F.bool_and("out").alias("i")).where("o and not i").select("node"), "inner")
        kept = edges.join(inner.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi")
        edges = staged(kept.join(inner.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi").select("src", "dst"), "trimmed")
        now = edges.count()
        if now in (0, left):
            return edges
        left = now
    raise RuntimeError(f"trimming did not end in {MAX_ROUNDS} rounds")


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it."""
    colour = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node"))
    for _ in range(MAX_ROUNDS):
        met = edges.join(colour.hint("merge"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("met"))
        step = colour.join(met.hint("merge"), "node", "left").select("node", F.least("colour", "met").alias("colour"), (F.col("met") < F.col("colour")).alias("moved"))
        step = staged(step, "colour")
        colour = step.drop("moved")
        if step.where("moved").isEmpty():
            return colour
    raise RuntimeError(f"colours did not settle in {MAX_ROUNDS} rounds")


def _back(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """node, component: what reaches its colour's node by nodes of that colour."""
    a, b = (colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst"))
    inside = staged(edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("component")), "inside")
    own = colour.select("node", F.col("colour").alias("component"), (F.col("node") == F.col("colour")).alias("reached"))
    for _ in range(MAX_ROUNDS):
        met = inside.join(own.where("reached").select(F.col("node").alias("dst")).hint("merge"), "dst").select(F.col("src").alias("node")).distinct().withColumn("met", F.lit(True))
        step = own.join(met.hint("merge"), "node", "left").select("node", "component", F.coalesce(F.col("reached") | F.col("met"), F.col("reached")).alias("reached"), (~F.col("reached") & F.col("met").isNotNull()).alias("moved"))
        step = staged(step, "reached")
        own = step.drop("moved")
        if step.where("moved").isEmpty():
            return own.where("reached").select("node", "component")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> node, component: the nodes that lie on a cycle, a loop at one
    node included, with the least node of all that they reach and are reached by.

    Nodes without edges both ways go first, again and again. Then the least node that
    reaches a node is its colour, and what reaches a colour's own node within the colour
    is that node's component; the rest goes round again. Each step is a join of edges and
    an aggregation, its result a written table; pairs of nodes are never listed. Rounds
    grow with the longest shortest path inside a component and the longest chain before
    one. Null ends are ignored."""
    known = staged(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    loops = known.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found: list[DataFrame] = []
    left = _trimmed(known.where("src <> dst"))
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        own = _back(left, _coloured(left))
        found.append(own)
        gone = own.select("node")
        left = left.join(gone.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti").select("src", "dst")
        left = _trimmed(staged(left, "left"))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    every = reduce(DataFrame.unionByName, [*found, loops])
    # A component of one node counts where the node has a loop.
    size = every.groupBy("component").agg(F.count_distinct("node").alias("n")).where("n > 1").select("component")
    several = staged(every.join(size.hint("merge"), "component", "left_semi").select("node", "component"), "several")
    kept = several.unionByName(loops.join(several.select("node").hint("merge"), "node", "left_anti"))
    return kept.distinct()
