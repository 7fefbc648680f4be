"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of one group (label and length) lie within a distance eps exactly
when their cosine reaches the bound. Vectors are sorted by their grid cells of
side eps on the leading principal axes, the sequence is cut into blocks, and
intervals of the sequence are joined from coarse to fine: a pair of intervals
whose boxes on those axes lie further apart than eps holds no link and is left.
Surviving pairs of blocks are compared by matrix products in double precision.

A pair of blocks gives back a link count for each vector and one edge per vector
to a root of its component there; links themselves are never listed. Equal
vectors of a group are one class from the start.

The axes are fitted on AXES_SAMPLE vectors; they affect speed only, never results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import staged
from tracewell.llm.components import components

AXES = 6
AXES_SAMPLE = 4096
BLOCK = 1024
FAN_OUT = 16
#: Pairs of blocks per Arrow batch: bounds what a task holds at once.
PAIRS_AT_ONCE = 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes by vector length, from a bounded sample."""
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(AXES_SAMPLE).select("embedding").collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    out = {}
    for d, found in by_length.items():
        u = _unit(np.asarray(found, dtype=np.float64))
        out[d] = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)[2][: min(AXES, d)].T
    return out


def _projected(axes: dict[int, np.ndarray], d: int, u: np.ndarray) -> np.ndarray:
    p = u @ axes[d] if d in axes else u[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _cells(sent, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            lengths = np.asarray([len(v) for v in vectors])
            cells = np.zeros((len(vectors), AXES), dtype=np.int32)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                p = _projected(sent.value, int(d), _unit(np.asarray([vectors[i] for i in at], dtype=np.float64)))
                cells[at] = np.floor(p / eps)
            cols = [b.column("cid"), b.column("label"), b.column("copies"), b.column("embedding"), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(cells[:, i], pa.int32()) for i in range(AXES)]], names=["cid", "label", "copies", "embedding", "dim", *[f"c{i}" for i in range(AXES)]])

    return run


def _blocks(sent, block: int):
    """Sorted rows -> one row per run of at most `block` vectors of one group."""

    def made(group: tuple, rows: list, part: int, k: int) -> dict:
        x = np.asarray([r[2] for r in rows], dtype=np.float64)
        u = _unit(x)
        p = _projected(sent.value, group[1], u)
        return {"label": group[0], "dim": group[1], "part": part, "slot": k, "block": (part << 32) + k, "cids": np.asarray([r[0] for r in rows], dtype="<i8").tobytes(), "copies": np.asarray([r[1] for r in rows], dtype="<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, group, rows = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            out = []
            for cid, label, dim, copies, v in zip(*(b.column(c).to_pylist() for c in ("cid", "label", "dim", "copies", "embedding"))):
                if group != (label, dim) or len(rows) == block:
                    if rows:
                        out.append(made(group, rows, part, k))
                        k += 1
                    group, rows = (label, dim), []
                rows.append((cid, copies, v))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK_ARROW)
        if rows:
            yield pa.RecordBatch.from_pylist([made(group, rows, part, k)], schema=_BLOCK_ARROW)

    return run


_BLOCK_ARROW = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("part", pa.int32()), ("slot", pa.int32()), ("block", pa.int64()), ("cids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
_BLOCK = "label long, dim int, part int, slot int, block long, cids binary, copies binary, vectors binary, lo array<double>, hi array<double>"


def _roots(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable, for the graph of edges r-c over n nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, r, root[c])
        np.minimum.at(low, c, low[r])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def compared(a: tuple, b: tuple | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two blocks (ids, copies, vectors), or one with itself: node ids, links of
    each to copies of the others here, root id of each."""
    ids, copies, x = a
    u = _unit(x)
    if b is None:
        hit = u @ u.T >= least
        np.fill_diagonal(hit, False)
        r, c = np.nonzero(hit)
        links = hit @ copies
    else:
        hit = u @ _unit(b[2]).T >= least
        r, c = np.nonzero(hit)
        c = c + len(ids)
        links = np.concatenate((hit @ b[1], copies @ hit))
        ids = np.concatenate((ids, b[0]))
    at = np.unique(np.concatenate((r, c)))
    if not len(at):
        return ids[:0], links[:0], ids[:0]
    root = _roots(r, c, len(ids))
    return ids[at], links[at], ids[root[at]]


def _join(least: float):
    def part(row: dict, side: str) -> tuple:
        ids = np.frombuffer(row[f"cids_{side}"], dtype="<i8")
        return ids, np.frombuffer(row[f"copies_{side}"], dtype="<i8"), np.frombuffer(row[f"vectors_{side}"], dtype="<f8").reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                node, links, root = compared(part(row, "a"), None if row["a"] == row["b"] else part(row, "b"), least)
                if len(node):
                    yield pa.RecordBatch.from_pydict({"node": node, "links": links.astype(np.int64), "root": root})

    return run


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks of one group whose boxes come within eps,
    found level by level: partitions of the sequence, runs of FAN_OUT blocks, blocks."""
    box = blocks.select("label", "dim", F.col("part").cast("long").alias("top"), (F.col("block") - F.col("slot") % FAN_OUT).alias("mid"), F.col("block").alias("low"), "lo", "hi")

    def near(la, ha, lb, hb):
        gap = F.zip_with(F.zip_with(lb, ha, lambda x, y: x - y), F.zip_with(la, hb, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        # One part in a million more, for the rounding of the projection.
        return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * 1.000001

    def boxes(level: str, *above: str) -> DataFrame:
        edges = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(AXES)] + [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(AXES)]
        g = box.groupBy("label", "dim", *above, level).agg(*edges)
        return g.select("label", "dim", *above, F.col(level).alias("n"), F.array(*[f"l{i}" for i in range(AXES)]).alias("lo"), F.array(*[f"h{i}" for i in range(AXES)]).alias("hi"))

    pairs = None
    for level, above in (("top", ()), ("mid", ("top",)), ("low", ("mid",))):
        g = boxes(level, *above)
        x = g.select("label", "dim", *[F.col(c).alias("up_a") for c in above], F.col("n").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        y = g.select("label", "dim", *[F.col(c).alias("up_b") for c in above], F.col("n").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        fits = (F.col("a") <= F.col("b")) & near(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"))
        if pairs is None:
            pairs = x.join(y, ["label", "dim"]).where(fits).select("label", "dim", "a", "b")
        else:
            up = pairs.select("label", "dim", F.col("a").alias("up_a"), F.col("b").alias("up_b"))
            pairs = up.join(x, ["label", "dim", "up_a"]).join(y, ["label", "dim", "up_b"]).where(fits).select("label", "dim", "a", "b")
    return pairs.select("a", "b")


def linked(vectors: DataFrame, least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept.

    Rows are compared when labels are equal and not null and vectors have one
    length. A vector that is null, empty, zero, or holds null or non-finite
    components, and a row without vec_id, links with nothing; the latter has a
    null component_id and is kept. Rows that repeat a vec_id count as vectors of
    their own."""
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * least))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # Equal vectors are told by 128 bits: two hashes of different seeds.
    key = ["k1", "k2"]
    keyed = v.withColumns({"k1": F.when(usable, F.xxhash64("label", "embedding")), "k2": F.when(usable, F.xxhash64(F.lit(1), F.col("embedding"), F.col("label")))})
    good = keyed.where("k1 is not null")
    # Equal rows meet as ids first; the vector comes from the row of the least id.
    heads = good.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    firsts = good.join(heads, [*key, "vec_id"]).dropDuplicates(key)
    # Numbered once: what follows reads the written numbers.
    classes = staged(firsts.select(F.monotonically_increasing_id().alias("cid"), *key, "vec_id", "label", "copies", "embedding"), "vectors")
    sent = spark.sparkContext.broadcast(fitted_axes(classes))
    cells = [f"c{i}" for i in range(AXES)]
    placed = classes.select("cid", "label", "copies", "embedding").mapInArrow(_cells(sent, eps), "cid long, label long, copies long, embedding array<double>, dim int, " + ", ".join(f"{c} int" for c in cells))
    order = ["label", "dim", *cells, "cid"]
    sequence = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("cid", "label", "dim", "copies", "embedding")
    blocks = staged(sequence.mapInArrow(_blocks(sent, block), _BLOCK), "blocks")
    pairs = block_pairs(blocks, eps)
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cids", "copies", "vectors")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    found = staged(both.mapInArrow(_join(least), "node long, links long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = classes.select(F.col("cid").alias("node"), *key, "vec_id", "copies").join(roots, "node", "left").join(counts, "node", "left")
    of = of.select(*key, "vec_id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least_id = of.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    # Written, so that Spark can split the join at a frequent vector.
    by_class = staged(of.join(least_id, "component").select(*key, "n_links", "component_id"), "classes")
    out = keyed.select("vec_id", *key).join(by_class, key, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
