"""Vector code compression: product codes with codebooks fitted in exact integers.

A vector of integers floor(4096 x) is cut into PARTS consecutive parts. The parts of
one position are sorted along a Hilbert curve and cut into flat blocks, each with the
box of its parts (least and greatest of each component) and their sum. A round takes
the least and greatest squared distance of a block's box to each codebook entry: an
entry that lies further from the box than another one reaches at most can't be the
nearest of any part inside and is left off the block's shortlist. A block whose
shortlist holds one entry gives its sum and count as they stand; the others compare
their parts with the shortlist in 64-bit integers. Parts are written once, as blocks;
a round reads them where they lie and sends on sums and counts of the entries only.

The curve's scale is taken from mean and deviation of all components; it orders
parts and never changes a result."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 512
LARGEST = 2**63 - 1

#: Codebooks of one vector length: for each part position an array of entries x components.
Codebooks = dict[int, list[np.ndarray]]


def cuts(length: int, parts: int) -> list[int]:
    """Where parts begin and end; the first ones take what doesn't divide."""
    return [i * (length // parts) + min(i, length % parts) for i in range(parts + 1)]


def limit(length: int, parts: int) -> int:
    """Components saturate here, so that squared distances of a whole vector fit 62 bits."""
    return math.isqrt(2**60 // max(1, length)) // 2


def as_integers(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    most = limit(vectors.shape[1], parts)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(scale)), -most, most).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of non-negative cells (under 2**bits) on a Hilbert curve, as a
    long of bits x dimensions binary digits."""
    x = cells.T.astype(np.int64)
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            # Where the digit is set the lower digits of the first axis turn over, else
            # those of this axis and the first change places.
            on = (x[i] >> level) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def box_distances(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of each entry to points of the box."""
    below, above = lo - entries, entries - hi
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(np.abs(below), np.abs(above))
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def shortlist(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes of the entries that may be nearest (ties included) to a point of the box."""
    least, most = box_distances(lo, hi, entries)
    return np.flatnonzero(least <= most.min())


def nearest(points: np.ndarray, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, ties to the lower one, and the squared distance."""
    apart = points[:, None, :] - entries[among][None, :, :]
    d = (apart * apart).sum(axis=2)
    at = d.argmin(axis=1)
    return among[at], d[np.arange(len(points)), at]


_PART = "rid long, vec_id long, label long, dim int, part int, key long, x binary"


def _parted(centre: float, spread: float, parts: int, scale: int):
    """Vectors -> one row per part, with its place on the curve; the first part carries id and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            lengths = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                take = (ends[rows] - d)[:, None] + np.arange(d)
                whole = as_integers(flat[take], parts, scale)
                at = cuts(int(d), parts)
                for p in range(parts):
                    x = np.ascontiguousarray(whole[:, at[p] : at[p + 1]])
                    n = x.shape[1]
                    led = min(n, 21)
                    bits = min(10, 63 // led) if led else 0
                    key = np.zeros(len(x), dtype=np.int64)
                    if led:
                        cells = (x[:, :led] / scale - centre) / (6 * spread) + 0.5
                        key = hilbert_keys(np.clip(np.floor(cells * 2**bits), 0, 2**bits - 1).astype(np.int64), bits)
                    own = pa.array(rows)
                    ids, labels = (b.column(c).take(own) if p == 0 else pa.nulls(len(rows), pa.int64()) for c in ("vec_id", "label"))
                    data = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 8 * n).astype(np.int32)), pa.py_buffer(x)])
                    yield pa.RecordBatch.from_arrays([b.column("rid").take(own), ids, labels, pa.array(np.full(len(x), d, np.int32)), pa.array(np.full(len(x), p, np.int32)), pa.array(key), data], names=["rid", "vec_id", "label", "dim", "part", "key", "x"])

    return run


_FLAT_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("rids", pa.binary()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("x", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary()), ("total", pa.binary())])
_FLAT = "dim int, part int, n int, rids binary, ids array<long>, labels array<long>, x binary, lo binary, hi binary, total binary"


def _blocks(size: int, parts: int):
    """Sorted parts -> flat blocks of at most `size` parts of one position and length."""

    def made(rows: pa.Table) -> dict:
        dim, part, n = rows["dim"][0].as_py(), rows["part"][0].as_py(), rows.num_rows
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.int64).reshape(n, -1)
        box = {"lo": x.min(axis=0).tobytes(), "hi": x.max(axis=0).tobytes(), "total": x.sum(axis=0).tobytes()}
        own = {"ids": rows["vec_id"].to_pylist(), "labels": rows["label"].to_pylist()} if part == 0 else {}
        return {"dim": dim, "part": part, "n": n, "rids": rows["rid"].to_numpy().astype(np.int64).tobytes(), "x": x.tobytes(), **own, **box}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, count = None, 0
        for b in batches:
            kinds = b.column("dim").to_numpy().astype(np.int64) * parts + b.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for start, end in zip(edges, edges[1:]):
                while start < end:
                    if held and (group != kinds[start] or count == size):
                        yield pa.RecordBatch.from_pylist([made(pa.Table.from_batches(held))], schema=_FLAT_ARROW)
                        held, count = [], 0
                    group, step = kinds[start], min(end - start, size - count)
                    held.append(b.slice(start, step))
                    start, count = start + step, count + step
        if held:
            yield pa.RecordBatch.from_pylist([made(pa.Table.from_batches(held))], schema=_FLAT_ARROW)

    return run


def _flat(row: dict) -> tuple[np.ndarray, ...]:
    n = row["n"]
    return tuple(np.frombuffer(row[c], dtype=np.int64) for c in ("lo", "hi", "total")) + (np.frombuffer(row["x"], dtype=np.int64).reshape(n, -1),)


def _sums(sent):
    """Blocks -> count and sums of the parts nearest to each entry, summed in the task.
    Sums are kept as 32 low bits and the rest, so that any number of them adds up in longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = sent.value
        found: dict[tuple[int, int, int], list] = {}
        for b in batches:
            for row in b.to_pylist():
                lo, hi, total, x = _flat(row)
                entries = books[row["dim"]][row["part"]]
                short = shortlist(lo, hi, entries)
                if len(short) == 1:
                    each = [(short[0], row["n"], total)]
                else:
                    near, _ = nearest(x, entries, short)
                    each = [(e, len(at := np.flatnonzero(near == e)), x[at].sum(axis=0)) for e in np.unique(near)]
                for e, n, s in each:
                    own = found.setdefault((row["dim"], row["part"], int(e)), [0, 0])
                    own[0] += n
                    own[1] = own[1] + s.astype(object)
        out = [{"dim": d, "part": p, "entry": e, "n": n, "at": i, "low": v & 0xFFFFFFFF, "high": v >> 32} for (d, p, e), (n, s) in found.items() for i, v in enumerate([0] if np.size(s) == 0 else map(int, s))]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))

    return run


def _assigned(sent):
    """Blocks -> each part's nearest entry and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = sent.value
        for b in batches:
            for row in b.to_pylist():
                lo, hi, _, x = _flat(row)
                entries = books[row["dim"]][row["part"]]
                entry, error = nearest(x, entries, shortlist(lo, hi, entries))
                n = row["n"]
                ids, labels = (pa.array(row[c], pa.int64()) if row[c] else pa.nulls(n, pa.int64()) for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["rids"], dtype=np.int64)), ids, labels, pa.array(np.full(n, row["dim"], np.int32)), pa.array(np.full(n, row["part"], np.int32)), pa.array(entry.astype(np.int32)), pa.array(error)], names=["rid", "vec_id", "label", "dim", "part", "entry", "error"])

    return run


def _first_codebooks(good: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Parts of the rows of the smallest ids, for each vector length."""
    from pyspark.sql import Window

    first = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "embedding", "rid")
    rows = good.withColumn("place", F.row_number().over(first)).where(F.col("place") <= entries).select("dim", "place", "embedding").collect()
    out: Codebooks = {}
    for d in {r["dim"] for r in rows}:
        own = [r["embedding"] for r in sorted((r for r in rows if r["dim"] == d), key=lambda r: r["place"])]
        x, at = as_integers(np.asarray(own, dtype=np.float64).reshape(len(own), d), parts, scale), cuts(d, parts)
        out[d] = [x[:, at[p] : at[p + 1]].copy() for p in range(parts)]
    return out


def _moved(books: Codebooks, blocks: DataFrame) -> Codebooks:
    """Codebooks after one round; what comes to the driver is one row per component of an entry."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    sums = blocks.mapInArrow(_sums(sent), "dim int, part int, entry int, n long, at int, low long, high long")
    rows = sums.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).collect()
    sent.destroy()
    out = {d: [e.copy() for e in own] for d, own in books.items()}
    for r in rows:
        entries = out[r["dim"]][r["part"]]
        if entries.shape[1]:
            entries[r["entry"], r["at"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return out


def digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in own for entry in part for v in entry.tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> vec_id, code, error, label_error, codebooks_sha256.

    Rows are dropped whose vector is null or holds a null or non-finite component; rows
    that repeat an id or a vector stay, each with its code. Vectors of different lengths
    have codebooks of their own, and parts of a length that `parts` doesn't divide differ
    by one component (an empty vector has code zero and error zero). The first codebook
    takes as many rows as there are, up to `entries`, in order of vec_id (null last),
    then of the vector. Components that lie so far out that a squared distance would
    leave 62 bits (some 2**26 / scale at 64 components) count as the bound. label_error
    sums over rows of equal label, nulls together, and stops at the largest long.
    At most 7 parts of 256 entries, or 15 of 16, fit the code."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = v.where(F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))).withColumns({"dim": F.size("embedding"), "rid": F.monotonically_increasing_id()})
    books = _first_codebooks(good, parts, entries, scale)
    total = lambda f: F.sum(F.aggregate("embedding", F.lit(0.0), f))
    scope = good.agg(F.sum("dim").alias("n"), total(lambda s, x: s + x).alias("s"), total(lambda s, x: s + x * x).alias("q")).first()
    centre = scope["s"] / scope["n"] if scope["n"] else 0.0
    spread = math.sqrt(max(0.0, scope["q"] / scope["n"] - centre * centre)) if scope["n"] else 0.0
    if not (math.isfinite(centre) and math.isfinite(spread) and spread > 0):
        centre, spread = 0.0, 1.0
    order = ["dim", "part", "key", "rid"]
    placed = good.select("rid", "vec_id", "label", "embedding").mapInArrow(_parted(centre, spread, parts, scale), _PART)
    blocks = staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block, parts), _FLAT), "blocks")
    for _ in range(rounds):
        books = _moved(books, blocks)
    sent = spark.sparkContext.broadcast(books)
    given = blocks.mapInArrow(_assigned(sent), "rid long, vec_id long, label long, dim int, part int, entry int, error long")
    # Each entry is one byte of the code, the first part highest.
    placed_byte = F.col("entry").cast("long") * F.element_at(F.array(*[F.lit(256 ** (parts - 1 - p)) for p in range(parts)]), F.col("part") + 1)
    coded = given.groupBy("rid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.max("dim").alias("dim"), F.sum(placed_byte).alias("bytes"), F.sum("error").alias("error"))
    # Written, so that Spark can split the join at a frequent label.
    coded = staged(coded, "codes")
    by_label = staged(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "errors")
    hashed = F.create_map(*[c for d in sorted(books) for c in (F.lit(d), F.lit(digest(books[d])))]) if books else None
    out = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return out.select("vec_id", F.lower(F.lpad(F.hex("bytes"), 2 * parts, "0")).alias("code"), "error", "label_error", (hashed[F.col("dim")] if hashed is not None else F.lit(None).cast("string")).alias("codebooks_sha256"))
