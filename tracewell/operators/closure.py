"""Iterative graph operators: frontier joins whose rounds are written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import staged

MAX_ROUNDS = 200


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges(src, dst), seeds(node) -> seed, node, depth: nodes reachable from each
    seed, itself at depth 0, with the least number of steps. Cycles end where they
    meet what was visited. Each round is one join, one distinct and one anti join."""
    edges = staged(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    front = staged(seeds.select(F.col("node").alias("seed"), "node").where("node is not null").distinct(), "front")
    seen = [front.withColumn("depth", F.lit(0))]
    for depth in range(1, MAX_ROUNDS + 1 if max_depth is None else max_depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        visited = reduce(DataFrame.unionByName, seen).select("seed", "node")
        front = staged(step.join(visited, ["seed", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen.append(front.withColumn("depth", F.lit(depth)))
    else:
        if max_depth is None:
            raise RuntimeError(f"closure did not end in {MAX_ROUNDS} rounds")
    return reduce(DataFrame.unionByName, seen)


def nearest(edges: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """edges(src parent, dst child), nodes(node), wanted(node) -> node, found, depth: the
    nearest ancestor that is wanted, the least of equally near ones; nodes without one are
    left out. A walk stops where it finds one and never enters a node twice."""
    up = staged(edges.select(F.col("dst").alias("at"), F.col("src").alias("next")).where("at is not null and next is not null").distinct(), "up")
    goal = wanted.select(F.col("node").alias("next"), F.lit(True).alias("hit")).distinct()
    front = staged(nodes.select("node", F.col("node").alias("at")).where("node is not null").distinct(), "front")
    seen, found = [front], []
    for depth in range(1, MAX_ROUNDS + 1):
        step = staged(front.join(up, "at").join(goal, "next", "left").select("node", F.col("next").alias("at"), F.coalesce("hit", F.lit(False)).alias("hit")).distinct(), "step")
        if step.isEmpty():
            break
        hits = staged(step.where("hit").groupBy("node").agg(F.min("at").alias("found")).withColumn("depth", F.lit(depth)), "found")
        found.append(hits)
        visited = reduce(DataFrame.unionByName, seen)
        front = staged(step.where("not hit").select("node", "at").join(hits.select("node"), "node", "left_anti").join(visited, ["node", "at"], "left_anti"), "front")
        seen.append(front)
    else:
        raise RuntimeError(f"walks did not end in {MAX_ROUNDS} steps")
    return reduce(DataFrame.unionByName, found) if found else nodes.select("node", F.col("node").alias("found"), F.lit(0).alias("depth")).limit(0)


def paths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Traversal that yields a node once per path: node, depth, path (node ids from
    the root). Only back edges are cut. Without a max_depth, paths of more than
    MAX_ROUNDS steps are an error."""
    front = staged(roots.select("node", F.array("node").alias("path")), "walk")
    seen = [front.withColumn("depth", F.lit(0))]
    for depth in range(1, (max_depth or MAX_ROUNDS) + 1):
        step = front.join(edges.select("src", "dst"), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = staged(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "walk")
        if front.isEmpty():
            break
        seen.append(front.withColumn("depth", F.lit(depth)))
    else:
        if max_depth is None:
            raise RuntimeError(f"paths did not end in {MAX_ROUNDS} steps")
    return reduce(DataFrame.unionByName, seen)


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """nodes(node), edges(src parent, dst child) -> node, score. Rank flows from
    child to parent; nodes without a parent spread theirs evenly. Ends early when
    the L1 change falls under the tolerance (0 runs all rounds)."""
    edges = edges.select("src", "dst").distinct()
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(1.0))
    out = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("out"))
    base = staged(nodes.join(out, "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out")), "rank")
    links = staged(edges.join(out.withColumnRenamed("node", "dst"), "dst").select("dst", "src", "out"), "links")
    score = base.select("node", "out", F.lit(1.0 / n).alias("score"))
    for _ in range(rounds):
        loose = score.where("out = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        given = links.join(score.select(F.col("node").alias("dst"), "score"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        # One row, broadcast.
        step = score.join(given, "node", "left").crossJoin(F.broadcast(loose)).select("node", "out", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))
        step = staged(step, "rank")
        score = step.drop("moved")
        if tolerance and (step.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
    return score.select("node", "score")


def minimized(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(node) -> node, superseded_by (sorted; empty for those that stay): a
    node goes when another of the set descends from it."""
    down = closure(edges, chosen).where("depth > 0")
    inside = down.join(chosen.select("node"), "node", "left_semi").groupBy(F.col("seed").alias("node")).agg(F.sort_array(F.collect_set("node")).alias("superseded_by"))
    return chosen.select("node").distinct().join(inside, "node", "left").select("node", F.coalesce("superseded_by", F.array().cast("array<string>")).alias("superseded_by"))
