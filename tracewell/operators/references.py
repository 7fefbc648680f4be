"""Reference lists: items, resolution and faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fault classes by stage.
CLASSES = ("malformed", "unknown_namespace", "unknown_requirement", "unknown_assertion", "forbidden")
ITEM = r"^[A-Z][0-9]+(-[A-Z](\+[A-Z])*)?$"


def items(df: DataFrame, text: str, namespaces: list[str], *keys: str) -> DataFrame:
    """One row per comma-separated item: keys, item_index, raw, class, code. class is
    null for an item that reads as a reference. An item whose target is written
    more than once in its list is forbidden, at every place."""
    parts = df.select(*keys, F.posexplode(F.split(text, ",", -1)).alias("item_index", "part"), F.size(F.split(text, ",", -1)).alias("n"))
    raw = F.trim("part")
    parts = parts.withColumn("raw", raw)
    empty, last = F.col("raw") == "", F.col("item_index") == F.col("n") - 1
    known = F.substring("raw", 1, 1).isin(*namespaces)
    fault = F.when(empty, "malformed").when(F.col("raw").rlike(r"\s"), "malformed").when(~F.col("raw").rlike(ITEM) & known, "malformed").when(~known | ~F.col("raw").rlike(ITEM), "unknown_namespace")
    code = F.when(empty & last & (F.col("n") > 1), "trailing_separator").when(empty, "empty_item").when(F.col("raw").rlike(r"\s"), "not_an_identifier").when(fault == "malformed", "label_form")
    parts = parts.withColumn("class", fault).withColumn("code", code)
    times = F.count(F.when(F.col("class").isNull(), 1)).over(Window.partitionBy(*keys, "raw"))
    twice = F.col("class").isNull() & (times > 1)
    parts = parts.withColumn("twice", twice)
    return parts.select(*keys, "item_index", "raw", F.when(F.col("twice"), "forbidden").otherwise(F.col("class")).alias("class"), F.when(F.col("twice"), "duplicate").otherwise(F.col("code")).alias("code"))


def base_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^([A-Z][0-9]+)", 1)


def labels_of(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"-([A-Z+]+)$", 1), F.lit(""))


def expanded(df: DataFrame) -> DataFrame:
    """Items that read as references -> one row per label: adds target, base, label."""
    labels = F.split(labels_of(F.col("raw")), r"\+")
    df = df.withColumn("base", base_of(F.col("raw")))
    out = df.withColumn("label", F.explode_outer(labels))
    return out.withColumn("target", F.concat_ws("-", "base", "label"))


def resolved(refs: DataFrame, requirements: DataFrame, assertions: DataFrame) -> DataFrame:
    """refs(…, class, base, label) with the class set where the target is missing.
    A reader's verdict stands whatever the tables hold."""
    req = requirements.select(F.col("id").alias("base"), F.lit(True).alias("has_req"))
    lab = assertions.select(F.col("req_id").alias("base"), "label", F.lit(True).alias("has_label")).distinct()
    df = refs.join(req, "base", "left").join(lab, ["base", "label"], "left")
    missing = F.when(F.col("has_req").isNull(), "unknown_requirement").when(F.col("label").isNotNull() & F.col("has_label").isNull(), "unknown_assertion")
    return df.withColumn("class", F.coalesce("class", missing)).drop("has_req", "has_label")


def split_ref(ref: Column) -> Column:
    """struct(base, label); label is null for a bare id, all is null for no id."""
    fits = ref.rlike(ITEM)
    return F.struct(F.when(fits, base_of(ref)).alias("base"), F.when(fits, labels_of(ref)).alias("label"))


def anchor_parts(anchor: Column) -> Column:
    """struct(node, type, value) of `node`, `node#label`, `node#section:…`, `node#edge:…`."""
    value = F.when(F.contains(anchor, F.lit("#")), F.substring_index(anchor, "#", -1))
    kind = F.when(value.isNull(), "bare").when(value.startswith("section:"), "section").when(value.startswith("edge:"), "edge").otherwise("assertion")
    return F.struct(F.substring_index(anchor, "#", 1).alias("node"), kind.alias("type"), F.regexp_replace(value, "^(section|edge):", "").alias("value"))
