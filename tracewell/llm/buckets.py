"""Links between nodes that share a bucket and turn out to be alike.

Rows are (bucket, node); traits of a node are its size and sketch. Two nodes are
close when their sizes allow the similarity and their sketches nearly do; this is
a filter, and what passes is confirmed on the full texts or sets.

First round: in each bucket a centre takes all rows close to it that no other
centre has; they become centres in turn. A bucket of m rows thus gives at most m - 1
star edges, which span the graph of its close pairs. They are confirmed by joins.
Second round: star edges that failed tie the components of the confirmed ones into
families. The full texts or sets of their members are sent to the family, or to
each bucket that holds several of its components, and pairs of different components
are confirmed there, in the task; what leaves it is one edge for each two components
that join. So every close pair of a bucket is confirmed, refused, or inside one
component, while no group's pairs are ever written out.

A bucket or family of more than PART rows is cut into parts that are compared two
by two in tasks of their own. Heavy buckets are found by counting hashed cells, of which
there are always CELLS: a bucket counts as heavy from PART rows and four times the mean
cell on, so that a task may hold a bucket of that size whole, which grows with the
table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import staged
from tracewell.llm.components import components

CELLS = 1 << 14
PART = 4096
#: Buckets up to this size are compared together with others.
SMALL = 512
#: A bit that keys of parts have.
OWN = 1 << 62
Arrays = dict[str, np.ndarray]
#: (columns, places i, places j) -> whether those rows are close.
Close = Callable[[Arrays, np.ndarray, np.ndarray], np.ndarray]
#: payloads of a group -> (place i, places j) -> whether they are alike.
Exact = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


def sizes_allow(x: Arrays, i, j, percent: int) -> np.ndarray:
    return 100 * np.minimum(x["size"][i], x["size"][j]) >= percent * np.maximum(x["size"][i], x["size"][j])


def differing(x: Arrays, columns: tuple[str, ...], i, j) -> np.ndarray:
    """Bits in which the columns differ."""
    return sum(np.bitwise_count(x[c][i] ^ x[c][j]).astype(np.int64) for c in columns)


def parted(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, node, ...) with the keys of more than PART rows cut up: such a row
    goes to one key for each pair of parts that holds its own. Other rows stay as they are."""
    parts = staged(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PART).select(key, F.ceil(F.col("n") / PART).alias("parts")), "parts")
    if parts.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = rows.join(parts, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Above all keys of their own: a bucket below OWN is the whole of it.
    several = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(OWN))
    return rows.join(parts, key, "left_anti").unionByName(dealt.withColumn(key, several).select(*rows.columns))


def light_and_parted(rows: DataFrame) -> DataFrame:
    """rows with heavy buckets parted; others are spared the counting of each bucket."""
    # Hashed: bits of SimHashes are uneven, and a cell of many light buckets isn't heavy.
    cell = F.pmod(F.xxhash64("bucket"), F.lit(CELLS))
    # At most CELLS rows; at most a quarter of them can be heavy.
    counts = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toPandas()
    heavy = counts["cell"][counts["n"] > PART + 4 * counts["n"].sum() / CELLS].tolist()
    return rows.where(~cell.isin(heavy)).unionByName(parted(rows.where(cell.isin(heavy)), "bucket")) if heavy else rows


def _sorted(rows: DataFrame, key: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, "node")


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches sorted by key -> tables of whole groups, with the groups' starts and
    sizes. Holds one group's rows beyond the batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = pa.Table.from_batches([batch])
        x = x if held is None else pa.concat_tables((held, x))
        of = x.column(key).to_numpy()
        cut = int(np.searchsorted(of, of[-1]))
        held = x.slice(cut)
        if cut:
            yield x.slice(0, cut), *_groups(of[:cut])
    if held is not None:
        yield held, *_groups(held.column(key).to_numpy())


def _groups(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(of)])))


def _arrays(x: pa.Table, skip: tuple[str, ...] = ()) -> Arrays:
    """Columns as arrays, those of sketches unsigned: counting bits takes no signs."""
    own = {c: x.column(c).to_numpy() for c in x.column_names if c not in skip}
    return {c: v if c in ("bucket", "node", "size", "family", "component") else v.view(np.uint64) for c, v in own.items()}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose bucket has another node."""
    for x, starts, counts in _by_key(batches, "bucket"):
        node = x.column("node").to_numpy()
        several = np.repeat(node[starts] != node[starts + counts - 1], counts)
        yield from x.filter(pa.array(several)).to_batches()


def small_pairs(x: Arrays, starts: np.ndarray, counts: np.ndarray, close: Close) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs (i < j) of all groups of at most SMALL rows, compared together:
    each row with the row d places on."""
    room = np.repeat(np.where(counts > SMALL, 0, starts + counts), counts) - np.arange(counts.sum())
    at, d, found = np.flatnonzero(room > 1), 1, [np.empty((2, 0), dtype=np.int64)]
    while len(at):
        hit = at[close(x, at, at + d)]
        found.append(np.stack((hit, hit + d)))
        d += 1
        at = at[room[at] > d]
    i, j = np.concatenate(found, axis=1)
    return i, j


def star_edges(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of close pairs, the edges from each centre to what it takes."""
    beside: dict[int, list[int]] = {}
    for p, q in zip(i.tolist(), j.tolist()):
        beside.setdefault(p, []).append(q)
        beside.setdefault(q, []).append(p)
    edges, seen = [], set()
    for first in sorted(beside):
        todo = [] if first in seen else [first]
        seen.add(first)
        for centre in todo:
            taken = [q for q in beside[centre] if q not in seen]
            seen.update(taken)
            edges += [(centre, q) for q in taken]
            todo += taken
    return edges


def large_star_edges(x: Arrays, lo: int, n: int, close: Close) -> list[tuple[int, int]]:
    """The same for rows lo to lo + n, without a list of the close pairs."""
    edges, left = [], np.arange(lo, lo + n)
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        for centre in todo:
            hit = close(x, centre, left)
            taken = left[hit].tolist()
            edges += [(centre, q) for q in taken]
            todo += taken
            left = left[~hit]
    return edges


def _stars(close: Close):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, counts in _by_key(batches, "bucket"):
            x = _arrays(table)
            edges = star_edges(*small_pairs(x, starts, counts, close))
            for lo, n in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist()):
                edges += large_star_edges(x, lo, n, close)
            at = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
            yield _edges(x["node"][at[:, 0]], x["node"][at[:, 1]])

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def joining_edges(x: Arrays, payloads: list[bytes], close: Close, exact: Exact) -> list[tuple[int, int]]:
    """Edges between rows of different components, each of which joins two of them."""
    component = x["component"].copy()
    names, sizes = np.unique(component, return_counts=True)
    # Of two components one isn't the largest: its rows meet all others, but those that met it before.
    outside = np.flatnonzero(component != names[np.argmax(sizes)])
    alike, every, edges = exact(payloads), np.arange(len(component)), []
    met = np.zeros(len(component), dtype=bool)
    for i in outside.tolist():
        others = every[(component != component[i]) & ~met]
        met[i] = True
        others = others[close(x, i, others)]
        for j in others[alike(i, others)].tolist() if len(others) else ():
            if component[i] != component[j]:
                component[component == component[j]] = component[i]
                edges.append((i, j))
    return edges


def _joined(key: str, close: Close, exact: Exact):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, counts in _by_key(batches, key):
            for lo, n in zip(starts.tolist(), counts.tolist()):
                group = table.slice(lo, n)
                x = _arrays(group, ("payload",))
                if (x["component"] == x["component"][0]).all():
                    continue
                at = np.asarray(joining_edges(x, group.column("payload").to_pylist(), close, exact), dtype=np.int64).reshape(-1, 2)
                yield _edges(x["node"][at[:, 0]], x["node"][at[:, 1]])

    return run


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with each end replaced by its label(node, component), where it has one."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))
        edges = edges.join(own, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("c", end)).drop("n", "c")
    return edges


def linked(rows: DataFrame, traits: DataFrame, close: Close, confirmed: Callable[[DataFrame], DataFrame], payloads: Callable[[DataFrame], DataFrame], exact: Exact, by_family: bool, once: Close | None = None) -> DataFrame:
    """rows(bucket, node), traits(node, size, sketch columns), all long and not null ->
    (node, component) of the nodes that are linked: the smallest node of each group.

    confirmed keeps the true ones of a table of distinct pairs (a, b); payloads gives
    (node, payload) for a table of nodes, and exact compares payloads of one group.
    by_family sends each payload to its family once: right for large payloads whose
    sketches leave only families of real likeness. Otherwise it goes to the buckets, where
    `once` may stand for `close` and leave out pairs that are compared in another bucket; it
    may read traits that `close` doesn't."""
    shared = staged(_sorted(light_and_parted(rows), "bucket").mapInArrow(_shared, "bucket long, node long"), "shared")
    met = _sorted(shared.join(traits, "node"), "bucket")
    tried = staged(met.mapInArrow(_stars(close), "a long, b long").where("a <> b").distinct(), "pairs")
    near = staged(confirmed(tried), "near")
    found = staged(components(near), "groups")
    failed = _labelled(tried.join(near, ["a", "b"], "left_anti"), found).where("a <> b").distinct()
    families = staged(components(failed).withColumnRenamed("component", "family"), "families")
    if families.isEmpty():
        return found
    # The nodes of the components in a family; a node without a link is its own.
    inside = found.join(families.withColumnRenamed("node", "component"), "component").select("node", "component", "family")
    lone = families.join(found, "node", "left_anti").select("node", F.col("node").alias("component"), "family")
    inside = staged(inside.unionByName(lone), "members")
    if by_family:
        key, met = "family", parted(inside, "family")
    else:
        key, met = "bucket", staged(shared.join(inside, "node"), "members")
        several = met.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        met = staged(met.join(staged(several.select("bucket"), "buckets"), "bucket", "left_semi"), "members")
    met = met.select(key, "node", "component").join(traits, "node").join(payloads(met.select("node").distinct()), "node")
    more = staged(_sorted(met, key).mapInArrow(_joined(key, once or close, exact), "a long, b long").distinct(), "near")
    wider = staged(components(_labelled(more, found)), "groups")
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = found.unionByName(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    return found.join(wider.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
