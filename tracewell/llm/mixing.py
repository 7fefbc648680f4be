"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hash order, are cut into blocks. Target weights
become whole shares of a period of slots; block k of a source of share s may
start at slot floor(k * period / s) and must end by ceil((k + 1) * period / s).
In each slot the startable block of the earliest deadline runs, so while all
sources last, none is a whole block ahead of or behind its share. A share differs
from its weight by less than one slot of a period's 1024, so against the weight a
source may gain or lose up to one more block in each 1024 slots. The period's
schedule repeats; a source that has run out leaves its slots to the next ones.
Every document gets one place; none is dropped or repeated.

All of it is DataFrame work. The schedule is one small table, bounded by
MAX_SOURCES and the period. Ranks within a source come from counts of hash
ranges of about BUCKET documents, so no task holds a whole source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewell.llm.common import staged

PERIOD = 1024
MAX_SOURCES = 256
BLOCK = 16
BUCKET = 2048
#: Default target weight of a source: its documents to this power.
TEMPERED = 0.5


def _source(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def _order(docs: DataFrame) -> Column:
    """Hash that orders a source; rows without an id are spread by their columns, of any type."""
    return F.md5(F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("none "), F.to_json(docs["row"]))))


def shares(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """counts(source, n) -> source, n, share: whole shares of the period, at least
    1 each; what flooring leaves goes to the largest fractions, then by name."""
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(TEMPERED))
    else:
        if any(x <= 0 for x in weights.values()):
            raise ValueError("target weights must be positive")
        w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(float(min(weights.values()))))
    everything = Window.partitionBy()
    df = counts.withColumn("w", w).withColumn("sources", F.count("*").over(everything)).withColumn("total", F.sum("w").over(everything))
    guard = F.when(F.col("sources") <= MAX_SOURCES, F.col("w") / F.col("total") * (PERIOD - F.col("sources"))).otherwise(F.raise_error(F.lit(f"more than {MAX_SOURCES} sources: group them first")).cast("double"))
    df = df.withColumn("exact", guard).withColumn("whole", F.floor("exact"))
    df = df.withColumn("left", F.lit(PERIOD) - F.col("sources") - F.sum("whole").over(everything))
    nth = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), "source"))
    return df.select("source", "n", (F.col("whole") + 1 + F.when(nth <= F.col("left"), 1).otherwise(0)).alias("share"))


def schedule(shared: DataFrame) -> DataFrame:
    """shares -> one row per slot of the period: t, source, nth (of its source in
    the period), share, before (slots of each source before t), and the arrays n_of
    and share_of, all in the order of the source names."""
    one = shared.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "n", "share"))).alias("s")).where(F.size("s") > 0)

    def step(state: Column, t: Column) -> Column:
        k = lambda i: F.element_at(state["done"], i + 1)
        ready = F.transform("s", lambda x, i: F.when((k(i) < x["share"]) & (F.floor(k(i) * PERIOD / x["share"]) <= t), F.struct(F.ceil((k(i) + 1) * PERIOD / x["share"]).alias("deadline"), i.alias("i"))))
        best = F.array_min(F.filter(ready, lambda r: r.isNotNull()))["i"]
        done = F.transform(state["done"], lambda d, i: F.when(i == best, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.concat(state["run"], F.array(F.struct(t.cast("int").alias("t"), best.alias("i"), state["done"].alias("before")))).alias("run"))

    none = F.from_json(F.lit("[]"), T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("before", T.ArrayType(T.LongType()))])))
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), none.alias("run"))
    run = one.select("s", F.inline(F.aggregate(F.sequence(F.lit(0), F.lit(PERIOD - 1)), start, step)["run"]))
    own = F.element_at("s", F.col("i") + 1)
    return run.select("t", own["source"].alias("source"), F.element_at("before", F.col("i") + 1).alias("nth"), own["share"].alias("share"), "before", F.col("s.n").alias("n_of"), F.col("s.share").alias("share_of"))


def ranked(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs(row, doc_id, source) with __source and __rank, the place in its source's hash order (0 first)."""
    order = _order(docs)
    df = docs.withColumn("__source", _source(docs)).withColumn("__order", order)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET))
    sizes = counts.select(F.col("source").alias("__source"), buckets.alias("__buckets"))
    part = (F.conv(F.substring("__order", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) * F.col("__buckets")).cast("int")
    # At most MAX_SOURCES rows.
    df = df.join(F.broadcast(sizes), "__source").withColumn("__bucket", part).drop("__buckets")
    held = df.groupBy("__source", "__bucket").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("__source", "__bucket", before.alias("__offset"))
    nth = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__order"))
    return df.withColumn("__nth", nth).join(offsets, ["__source", "__bucket"]).withColumn("__rank", F.col("__offset") + F.col("__nth") - 1).drop("__order", "__bucket", "__offset", "__nth")


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """row (a struct of docs' columns, so that no name can clash), __source, __block (of
    its source), __slot and __position (0 first, gapless): its place in the mixture.

    A null source counts as the empty name. Sources missing from `weights` get the
    least weight given. Rows of equal doc_id take neighbouring places, in no order."""
    docs = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    counts = staged(docs.groupBy(_source(docs).alias("source")).agg(F.count("*").alias("n")), "sources")
    plan = staged(schedule(shares(counts, weights)), "schedule")
    df = ranked(docs, counts).withColumn("__block", F.floor(F.col("__rank") / block))
    slots = plan.select(F.col("source").alias("__source"), "t", "nth", "share", "before", "n_of", "share_of")
    firsts = slots.select("__source", F.col("share").alias("__share")).distinct()
    df = df.join(F.broadcast(firsts), "__source").withColumn("nth", F.col("__block") % F.col("__share")).withColumn("__round", F.floor(F.col("__block") / F.col("__share")))
    # One row per slot of the period, each with an array over the sources.
    df = df.join(F.broadcast(slots), ["__source", "nth"])
    ahead = F.zip_with(F.zip_with("before", "share_of", lambda b, s: (F.col("__round") * s + b) * block), "n_of", lambda x, n: F.least(x, n))
    df = df.withColumn("__position", F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x) + F.col("__rank") % block).withColumn("__slot", F.col("__round") * PERIOD + F.col("t"))
    return df.select("row", "__source", F.col("__block").cast("long").alias("__block"), F.col("__slot").cast("long").alias("__slot"), "__position")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, block, slot, position of every document."""
    out = placed(docs.select("doc_id", "source"), weights, block)
    return out.select("row.doc_id", F.col("__source").alias("source"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, per_file: int = 16_384) -> DataFrame:
    """docs' own columns, dealt out by place: partition p holds the places from
    p * per_file on, in order, so files written from it follow the mixture."""
    out = placed(docs, weights, block)
    n = docs.count()
    parts = max(1, -(-n // per_file))
    return out.repartitionById(parts, F.floor(F.col("__position") / per_file).cast("int")).sortWithinPartitions("__position").select("row.*")
