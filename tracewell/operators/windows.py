"""Order-dependent operators as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """df with __island: runs of consecutive numbers within keys. Repeated numbers
    must be removed before."""
    w = Window.partitionBy(*keys).orderBy(number)
    return df.withColumn("__island", F.col(number) - F.row_number().over(w))


def compacted(df: DataFrame, key: str, label: str) -> DataFrame:
    """key, labels: A,B,C,F -> 'A-C,F'; runs of two stay listed."""
    rows = islands(df.select(key, F.ascii(label).alias("n"), F.col(label).alias("l")).distinct(), [key], "n")
    run = rows.groupBy(key, "__island").agg(F.min("n").alias("at"), F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("c"))
    text = F.when(F.col("c") > 2, F.concat("lo", F.lit("-"), "hi")).when(F.col("c") == 2, F.concat("lo", F.lit(","), "hi")).otherwise(F.col("lo"))
    pairs = run.select(key, F.struct("at", text.alias("t")).alias("x")).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return pairs.select(key, F.array_join(F.transform("xs", lambda x: x["t"]), ",").alias("labels"))


def first_gap(df: DataFrame, key: str, label: str) -> DataFrame:
    """key, expected, found: the first single-letter label out of sequence."""
    w = Window.partitionBy(key).orderBy(label)
    rows = df.select(key, label).distinct().withColumn("rn", F.row_number().over(w))
    bad = rows.where(F.ascii(label) - 64 != F.col("rn"))
    return bad.groupBy(key).agg(F.min(F.struct("rn", F.char(F.col("rn") + 64).alias("expected"), F.col(label).alias("found"))).alias("x")).select(key, "x.expected", "x.found")


#: Lines of one range of a long sequence; a range is one window partition.
SPAN = 10_000


def _ranged(df: DataFrame, line: str) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(line) / SPAN))


def known(df: DataFrame, keys: list[str], line: str, order: list[Column], value: Column, name: str, *, own: bool = True, ahead: bool = False) -> DataFrame:
    """df with `name`: the last value that isn't null up to each row (own: the row itself
    included), or with `ahead` the first from there on, within keys.

    In two levels, so that one long sequence is no task of its own: windows over ranges of
    SPAN lines, then one row per range, whose values are carried over the ranges. order
    begins with the line and tells rows apart."""
    turned = [F.desc(c) if ahead else F.asc(c) for c in order]
    df = _ranged(df, line).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__range").orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    where = F.when(F.col("__value").isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    ends = df.groupBy(*keys, "__range").agg((F.min_by if ahead else F.max_by)("__value", where).alias("__end"))
    over = Window.partitionBy(*keys).orderBy(F.desc("__range") if ahead else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__range", F.last("__end", ignorenulls=True).over(over).alias("__carried"))
    out = df.withColumn(name, F.last("__value", ignorenulls=True).over(inside)).join(carried, [*keys, "__range"])
    return out.withColumn(name, F.coalesce(name, "__carried")).drop("__range", "__value", "__carried")


def summed(df: DataFrame, keys: list[str], line: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value up to each row within keys, in two levels as `known`."""
    df = _ranged(df, line).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__range").agg(F.sum("__value").alias("__sum"))
    before = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    out = df.withColumn(name, F.sum("__value").over(inside)).join(before, [*keys, "__range"])
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__value", "__before")


def block_owner(markers: DataFrame, lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Lines with the block that owns them: markers with no executable line between
    them form one block, which owns the lines after it up to the next block. Keys and
    lines are not null; a line is listed once."""
    both = markers.select(*keys, line, F.lit(1).alias("m")).unionByName(lines.select(*keys, line, F.lit(0).alias("m")))
    order = [F.col(line), -F.col("m")]
    told = known(both, keys, line, order, F.col("m"), "__prior", own=False)
    start = ((F.col("m") == 1) & (F.coalesce("__prior", F.lit(0)) == 0)).cast("int")
    return summed(told, keys, line, order, start, "block").where("m = 0").drop("m", "__prior")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
