"""Coverage conducted up refining chains, in any number of measures at once.

Joins of tables that grow with the nodes are hinted: values that repeat make files so
small that Spark would broadcast all their rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import staged
from tracewell.operators.strong import strongly_connected

MAX_ROUNDS = 200


def _summed(met: DataFrame, values: Sequence[str], *key: str) -> DataFrame:
    """What children are worth, summed and counted by parent and by the label they name (or none)."""
    return met.groupBy(*key, "named").agg(*[F.sum(c).alias(c) for c in values], F.sum("n").alias("n"))


def _to_labels(given: DataFrame, labels: DataFrame, values: Sequence[str], *key: str) -> DataFrame:
    """Sums by parent and named label -> means by label, of the children that name it and those that name none."""
    met = given.hint("merge").join(labels.select("node", "label").hint("merge"), "node").where("named is null or named = label")
    return met.groupBy(*key, "label").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in values])


def _worth(keys: DataFrame, given: DataFrame, labels: DataFrame, values: Sequence[str], *key: str) -> DataFrame:
    """A node's value: the mean over its labels of the greater of attached and conducted; 0 without labels."""
    rows = keys.join(labels.hint("merge"), "node", "left")
    rolled = _to_labels(given, labels, values, *key)
    rows = rows.join(rolled.select(*key, "label", *[F.col(c).alias(f"rolled {c}") for c in values]).hint("merge"), [*key, "label"], "left")
    best = {c: F.greatest(F.col(c), F.col(f"rolled {c}")) for c in values}
    return rows.groupBy(*key).agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(c) for c, v in best.items()])


def _unrolled(knot: DataFrame, inner: DataFrame, outer: DataFrame, labels: DataFrame, values: Sequence[str]) -> DataFrame:
    """Values of nodes on cycles: from each node all paths through the knot that repeat no
    node are walked; a step back onto the path counts as a child worth nothing.

    inner(src, dst, named) lies within knots; outer has what nodes get from outside,
    summed. Paths of a knot may be many: their number grows with the orders in which its
    nodes can be walked."""
    walks = [staged(knot.select("node", F.array("node").alias("path")), "walks")]
    for _ in range(MAX_ROUNDS):
        step = walks[-1].join(inner.select("src", "dst").distinct(), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = staged(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "walks")
        if step.isEmpty():
            break
        walks.append(step)
    else:
        raise RuntimeError(f"walks did not end in {MAX_ROUNDS} steps")
    below: DataFrame | None = None
    for walk in reversed(walks):
        steps = walk.join(inner.withColumnRenamed("src", "node"), "node")
        if below is None:
            met = steps.select("path", "node", "named", *[F.lit(0.0).alias(c) for c in values], F.lit(1).alias("n"))
        else:
            # Each longer path ends at the child that it was made for; a child that has none was on the path.
            ends = below.select(F.slice("path", 1, F.size("path") - 1).alias("path"), F.col("node").alias("dst"), *values)
            met = steps.join(ends, ["path", "dst"], "left").select("path", "node", "named", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values], F.lit(1).alias("n"))
        met = met.unionByName(walk.join(outer, "node").select("path", "node", "named", *values, "n"))
        below = staged(_worth(walk, _summed(met, values, "path", "node"), labels, values, "path", "node"), "walked")
    return below.select("node", *values)


def refining(edges: DataFrame) -> DataFrame:
    """edges(src parent, dst child, label or null) -> src, dst, named: distinct, written."""
    return staged(edges.where("src is not null and dst is not null").select("src", "dst", F.col("label").alias("named")).distinct(), "refining")


def conducted(labels: DataFrame, edges: DataFrame, values: Sequence[str]) -> DataFrame:
    """labels(node, label, <values>), edges(src parent, dst child, label or null) -> node,
    label, <values>: what refining nodes conduct to each label that gets anything from one."""
    edges = refining(edges)
    parents = edges.select(F.col("src").alias("node")).distinct()
    labels = labels.select("node", "label", *values)
    return conducted_along(edges, labels, staged(labels.join(parents.hint("merge"), "node", "left_semi"), "labels"), values)


def conducted_along(edges: DataFrame, labels: DataFrame, held_by: DataFrame, values: Sequence[str]) -> DataFrame:
    """The same along refining() edges; held_by are the labels of parents, labels hold at
    least those of nodes that are none.

    In each of the values, a node is worth the mean over its labels of the greater of
    what is attached and what is conducted, and nothing without labels. A label gets the
    mean over the nodes that refine it by name or refine its node as a whole, whatever
    their worth. Works up from the leaves, one round per height; a parent's children are
    summed before they meet its labels. Where no node is ready the rest holds cycles:
    the nodes of each are taken together, and one is worth what a walk from it finds that
    never enters a node twice on one path. One row per (node, label) is expected."""
    parents = edges.select(F.col("src").alias("node")).distinct()
    # Most nodes are leaves: their labels are summed up once, before they meet an edge.
    placed = staged(edges.join(parents.select(F.col("node").alias("dst"), F.lit(True).alias("refined")).hint("merge"), "dst", "left").select(*edges.columns, "refined"), "placed")
    leaves = labels.groupBy(F.col("node").alias("dst")).agg(*[F.avg(c).alias(c) for c in values]).hint("merge")
    met = placed.where("refined is null").join(leaves, "dst", "left").select(F.col("src").alias("node"), "named", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values], F.lit(1).alias("n"))
    given: list[DataFrame] = [staged(_summed(met, values, "node"), "given")]
    waiting = placed.where("refined").select(*edges.columns)
    left, knots, knotted = waiting.count(), None, None
    ready = staged(parents.join(waiting.select(F.col("src").alias("node")).hint("merge"), "node", "left_anti"), "ready")
    done: list[DataFrame] = []

    def given_to(nodes: DataFrame | None = None) -> DataFrame:
        every = reduce(DataFrame.unionByName, given)
        own = every if nodes is None else every.join(nodes.hint("merge"), "node", "left_semi")
        return _summed(own, values, "node")

    for _ in range(MAX_ROUNDS):
        if not left and knots is None:
            break
        plain = ready if knots is None else ready.join(knots.select("node"), "node", "left_anti")
        new = [staged(_worth(plain, given_to(plain), held_by, values, "node"), "worth")]
        tied = None if knots is None else staged(ready.join(knots, "node"), "tied")
        if tied is not None and not tied.isEmpty():
            inside = tied.select(F.col("node").alias("dst"), F.col("component").alias("of"))
            inner = staged(knotted.join(tied.withColumnRenamed("node", "src"), "src").join(inside, "dst").where("component = of").select("src", "dst", "named"), "inner")
            outer = staged(given_to(tied.select("node")), "outer")
            new.append(_unrolled(tied, inner, outer, held_by, values))
        worth = reduce(DataFrame.unionByName, new)
        done.append(worth.select("node"))
        open_edges = waiting if knotted is None else waiting.unionByName(knotted)
        met = open_edges.join(worth.withColumnRenamed("node", "dst").hint("merge"), "dst").select(F.col("src").alias("node"), "named", *values, F.lit(1).alias("n"))
        given.append(staged(_summed(met, values, "node"), "given"))
        if not left:
            break
        rest = staged(waiting.join(worth.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").select(*edges.columns), "waiting")
        now = rest.count()
        if now == left:
            # Nothing was ready: cycles hold the rest up. Their own edges wait no longer.
            if knots is not None:
                raise RuntimeError("cycles remain between components")
            knots = staged(strongly_connected(rest), "knots")
            ends = [knots.select(F.col("node").alias(end), F.col("component").alias(f"{end} in")) for end in ("src", "dst")]
            placed = staged(rest.join(ends[0].hint("merge"), "src", "left").join(ends[1].hint("merge"), "dst", "left"), "placed")
            within = F.coalesce(F.col("src in") == F.col("dst in"), F.lit(False))
            knotted = placed.where(within).select(*edges.columns)
            rest = placed.where(~within).select(*edges.columns)
            now = rest.count()
        before, held = waiting.select(F.col("src").alias("node")).distinct(), rest.select(F.col("src").alias("node")).distinct()
        if knots is not None:
            # A cycle's nodes are ready together.
            unit = lambda df: df.join(knots, "node", "left").select("node", F.coalesce("component", "node").alias("unit"))
            before = before.unionByName(knots.select("node")).distinct().join(reduce(DataFrame.unionByName, done), "node", "left_anti")
            held = unit(before).join(unit(held).select("unit"), "unit", "left_semi").select("node")
        ready = staged(before.join(held.hint("merge"), "node", "left_anti"), "ready")
        waiting, left = rest, now
    else:
        raise RuntimeError(f"values did not settle in {MAX_ROUNDS} rounds")
    return _to_labels(given_to(), held_by, values, "node")
