"""MinHash near-dedup by one-permutation hashing with optimal densification.

A document's set is its distinct k-word shingles. Each shingle is hashed once;
the top bits choose a bin and the least value of a bin is its entry. Bins left
empty borrow from a bin found by a hash of (bin, attempt), the same for every
document. Bands of bins make buckets; candidate edges in a bucket are stars (see
`buckets`), and every edge is confirmed on the full sets. Which of the first 128
bins are full, and one bit of each, make a sketch that estimates the similarity
with a deviation of 0.05 to 0.08; pairs of an estimate under ESTIMATE are spared the
comparison of their sets. What shares a bucket and reaches it is linked exactly as
if all pairs were compared.

Documents with equal sets are one class from the start: classes are compared,
copies are never expanded into pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.buckets import Arrays, linked, sizes_allow
from tracewell.llm.common import as_int64, maybe_in, mixed, staged, windows, word_hashes
from tracewell.llm.components import components

BIN_BITS = 8
ROWS = 6
BANDS = (1 << BIN_BITS) // ROWS
#: Percent of the wanted similarity that a sketch must show where both sets have so
#: many shingles: about five deviations of the estimate below 0.8. Smaller sets, whose
#: comparison costs little, aren't held to it.
ESTIMATE = ((128, 70), (32, 45))
SKETCH = ("full1", "full2", "bit1", "bit2")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than k words make one shingle."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if 0 < len(h) < k:
        return windows(h, len(h))
    return np.unique(windows(h, k))


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin minima of a sorted non-empty set, empty bins densified; which were full."""
    bins = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    full = np.zeros(1 << BIN_BITS, dtype=bool)
    value = np.zeros(1 << BIN_BITS, dtype=np.uint64)
    full[bins[first]], value[bins[first]] = True, s[first]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        with np.errstate(over="ignore"):
            at = mixed(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> np.uint64(64 - BIN_BITS)
        hit = full[at.astype(np.int64)]
        value[empty[hit]] = value[at[hit].astype(np.int64)]
        empty = empty[~hit]
    return value, full


_BAND_SALT = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        acc = _BAND_SALT.copy()
        for i in range(ROWS):
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return acc


def sketch(value: np.ndarray, full: np.ndarray) -> np.ndarray:
    """SKETCH of a signature: full bins, and the lowest bit of each, of the first 128."""
    bit = (value[:128] & np.uint64(1)).astype(bool) & full[:128]
    return np.packbits(np.concatenate((full[:128], bit))).view(np.int64)


def close(percent: int):
    def run(x: Arrays, i, j) -> np.ndarray:
        """Sizes and sketches allow the similarity. Two full bins with different
        values have different bits every other time."""
        either, both, unlike = 0, 0, 0
        for full, bit in zip(SKETCH[:2], SKETCH[2:]):
            f, g = x[full][i], x[full][j]
            either = either + np.bitwise_count(f | g).astype(np.int64)
            both = both + np.bitwise_count(f & g).astype(np.int64)
            unlike = unlike + np.bitwise_count((x[bit][i] ^ x[bit][j]) & f & g).astype(np.int64)
        fewer = np.minimum(x["size"][i], x["size"][j])
        need = np.select([fewer >= n for n, _ in ESTIMATE], [e for _, e in ESTIMATE], -10_000)
        return sizes_allow(x, i, j, percent) & (10_000 * (both - 2 * unlike) >= need * percent * either)

    return run


def _sketches(k: int, percent: int):
    #: Sets below this size reach the similarity with equal sets only, which need no bands.
    least = -(-percent // max(1, 100 - percent)) if percent < 100 else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, bands, bits = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                raw = s.tobytes()
                h1.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                h2.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                sig = signature(s) if len(s) >= least else None
                bands.append(np.empty(0, dtype=np.int64) if sig is None else as_int64(band_keys(sig[0])))
                bits.append((0,) * len(SKETCH) if sig is None else sketch(*sig))
            bits = np.asarray(bits, dtype=np.int64).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(bits.T))],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", *SKETCH],
            )

    return run


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""

    def size(x: bytes, y: bytes) -> int:
        p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        p, q = (p, q) if len(p) <= len(q) else (q, p)
        return int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))

    return pd.Series([size(x, y) for x, y in zip(a, b)], dtype="int64")


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, s: the full sets of the documents of distinct ids(doc_id)."""

    @F.pandas_udf("binary")
    def as_set(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shingle_set(t, k).tobytes())

    # An inner join: Spark moves a semi join below the bit map, which then spares nothing.
    return staged(maybe_in(docs, ids).join(ids, "doc_id").select("doc_id", as_set("text").alias("s")), "sets")


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k)
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    # Sets are too large to send around: the same plan at every size.
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    shared = both.select("a", "b", (F.octet_length("sa") / 8).cast("long").alias("na"), (F.octet_length("sb") / 8).cast("long").alias("nb"), _shared("sa", "sb").alias("i"))
    return shared.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b").distinct()


def alike(percent: int):
    def index(payloads: list[bytes]):
        """Sets of one group -> whether set i and each of sets j reach the similarity,
        by an index from shingles to the sets that hold them."""
        sets = [np.frombuffer(p, dtype=np.uint64) for p in payloads]
        sizes = np.asarray([len(s) for s in sets])
        shingles, held = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(held, kind="stable")
        holders = np.repeat(np.arange(len(sets)), sizes)[order]
        ends = np.cumsum(np.bincount(held, minlength=len(shingles)))
        starts = np.concatenate(([0], ends[:-1]))
        first = np.cumsum(sizes) - sizes

        def run(i: int, js: np.ndarray) -> np.ndarray:
            own = held[first[i] : first[i] + sizes[i]]
            n = ends[own] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(sets))[js]
            return 100 * common >= percent * (sizes[i] + sizes[js] - common)

        return run

    return index


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Null, empty or wordless
    texts have an empty set and link with nothing. Rows with a null doc_id are
    returned with a null component_id and kept. Rows that repeat a doc_id share
    its component. An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = staged(docs.mapInArrow(_sketches(k, percent), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)), "sketches")
    usable = made.where("n_shingles > 0 and doc_id is not null")
    same = ["h1", "h2", "n_shingles"]
    # Equal sets have equal bands. Written, so that the join with it is one of plain exchanges, which Spark can split at a large class of copies.
    firsts = [F.first(c).alias(c) for c in ("bands", *SKETCH)]
    reps = staged(usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *firsts), "classes")
    named = docs.where("doc_id is not null")
    rows = reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("node"))
    traits = reps.where(F.size("bands") > 0).select(F.col("rep").alias("node"), F.col("n_shingles").alias("size"), *SKETCH)
    near = linked(rows, traits, close(percent), lambda pairs: confirmed(named, pairs, k, percent), lambda ids: sets_of(named, ids.select(F.col("node").alias("doc_id")), k).select(F.col("doc_id").alias("node"), F.col("s").alias("payload")), alike(percent), by_family=True)
    reps = reps.select(*same, "rep", "copies")
    usable = usable.select("doc_id", *same)
    copies = usable.join(reps.where("copies > 1").drop("copies"), same).where("doc_id <> rep").select(F.col("doc_id").alias("node"), "rep").distinct()
    # A doc_id that repeats with other texts belongs to several classes: those links go through the component search.
    several = copies.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    loose = copies.join(several, "node", "left_semi").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    found = components(near.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(loose)) if not loose.isEmpty() else near
    placed = copies.join(several, "node", "left_anti")
    both = placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component")).unionByName(found)
    label = both.groupBy("node").agg(F.min("component").alias("component_id"))
    out = made.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that a smaller doc_id of their group stands for. Of
    rows that repeat a doc_id one stays, that with the smallest hash of its text."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    twice = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return left
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("*"), F.xxhash64("text")).alias("row")).select("row.*")
    return left.join(twice, "doc_id", "left_anti").unionByName(one)
