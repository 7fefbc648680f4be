"""Event logs and change logs: state is the latest value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def threads(events: DataFrame) -> DataFrame:
    """events(key, seq, event) -> key, opened, comments, replies, anchor_seq, open.

    A thread opens with its first comment; a resolve after the last comment closes
    it; the last promote moves its anchor. Aggregates only: no group is gathered."""
    of = lambda *kinds: F.col("event").isin(*kinds)
    last = lambda *kinds: F.max(F.when(of(*kinds), F.col("seq")))
    g = events.groupBy("key").agg(F.min(F.when(of("comment"), F.col("seq"))).alias("opened"), F.count_if(of("comment")).alias("comments"), F.count_if(of("reply")).alias("replies"), last("promote").alias("anchor_seq"), last("comment").alias("said"), last("resolve").alias("resolved"))
    return g.where("opened is not null").select("key", "opened", "comments", "replies", "anchor_seq", (F.col("resolved").isNull() | (F.col("resolved") < F.col("said"))).alias("open"))


def latest_values(log: DataFrame, key: str, value: Column, *order: str) -> DataFrame:
    """The last value written per key, as key, value."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"))


def undone(log: DataFrame, to: int) -> DataFrame:
    """The log without its tail from an entry on, that entry included."""
    return log.where(F.col("seq") < to)


def renamed(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """df with ids replaced by names(old, new) wherever they stand."""
    for c in columns:
        m = names.select(F.col("old").alias(f"__{c}"), F.col("new").alias(f"__new_{c}"))
        df = df.join(m, df[c] == m[f"__{c}"], "left").withColumn(c, F.coalesce(f"__new_{c}", c)).drop(f"__{c}", f"__new_{c}")
    return df


def conflicts(writes: DataFrame, current: DataFrame) -> DataFrame:
    """writes(id, token), current(id, version) -> id, token, state for writes that can't go in."""
    both = writes.join(current, "id", "left")
    state = F.when(F.col("version").isNull(), "node_not_found").when(F.col("token") != F.col("version"), "conflict")
    return both.withColumn("state", state).where("state is not null").select("id", "token", "state")


def between(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new(id, path, hash) of two snapshots -> id, new_id, old_path, new_path,
    change. Rows of one id are compared first: moved, edited, or both. What is left is
    matched by equal content, ties in order of id: renamed, or renamed and moved. The rest
    was added or removed. Rows that stay as they are aren't listed; null hashes equal no
    other. Ids are taken to be unique in a snapshot."""
    a = old.select("id", F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    b = new.select("id", F.col("path").alias("new_path"), F.col("hash").alias("new_hash"))
    moved, edited = ~F.col("old_path").eqNullSafe(F.col("new_path")), ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    same = a.join(b, "id").select("id", F.col("id").alias("new_id"), "old_path", "new_path", F.when(moved & edited, "moved and edited").when(moved, "moved").when(edited, "edited").alias("change")).where("change is not null")
    order = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("id"))
    gone = a.join(b.select("id"), "id", "left_anti").withColumnRenamed("old_hash", "hash").withColumn("nth", order("hash"))
    come = b.join(a.select("id"), "id", "left_anti").withColumnRenamed("new_hash", "hash").withColumn("nth", order("hash")).withColumnRenamed("id", "new_id")
    rest = gone.join(come, ["hash", "nth"], "full")
    kind = F.when(F.col("new_id").isNull(), "removed").when(F.col("id").isNull(), "added").when(moved, "renamed and moved").otherwise("renamed")
    return same.unionByName(rest.select("id", "new_id", "old_path", "new_path", kind.alias("change")))
