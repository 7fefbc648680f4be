"""Tables and word hashing for the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.storage import shared_dir, staged

__all__ = ["MEMO_WORDS", "as_int64", "maybe_in", "maybe_marked", "mixed", "shared_dir", "staged", "table", "windows", "word_hashes"]
MEMO_WORDS = 200_000
#: Size in bits of the map that spares documents without candidates a shuffle: a
#: table of at most MAP_BITS / 64 rows of two longs, some 100 MB where it is joined;
#: an exact join follows it. A full map spares nothing and loses nothing.
MAP_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 text, in order."""
    words = data.split()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer; spreads linear combinations over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k consecutive word hashes (order counts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for i in range(1, k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(acc)


def as_int64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def maybe_marked(docs: DataFrame, ids: DataFrame, mark: str) -> DataFrame:
    """docs with a boolean column that tells whether doc_id may be among ids: by a bit map
    of hashed ids of fixed size."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(__at % 64 as int))")
    words = ids.select(at.alias("__at")).select(F.floor(F.col("__at") / 64).alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    marked = docs.withColumn("__at", at).withColumn("__word", F.floor(F.col("__at") / 64)).join(F.broadcast(words), "__word", "left")
    return marked.withColumn(mark, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__at", "__word", "__bits")


def maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id may be among ids."""
    return maybe_marked(docs, ids, "__may").where("__may").drop("__may")
