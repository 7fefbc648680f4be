"""Structured Streaming jobs over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.storage import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str, time: str = "ts") -> DataFrame:
    """A table's files as a stream; its time, if without zone, is taken as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    # A file stream reads folders; a single file is picked out of its folder by its name.
    df = files.load(f"{sf_dir}/{name}.parquet*", format="parquet")
    return df.withColumn(time, F.col(time).cast("timestamp"))


def start_done(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Clicks joined with the purchases of the same user that follow in time: a
    stream-stream join, whose state the two watermarks bound."""
    start = events.where("event_type = 'click'").select("event_id", F.col("user_id"), F.col("ts").alias("began")).withWatermark("began", "2 hours")
    done = events.where("event_type = 'purchase'").select(F.col("event_id").alias("done_id"), F.col("user_id").alias("done_user"), F.col("ts").alias("ended")).withWatermark("ended", "2 hours")
    return start.join(done, F.expr(f"user_id = done_user and ended >= began and ended <= began + interval {within}")).select("event_id", "done_id")


def run_to_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, into a Parquet table in the shared folder.
    Started again with the same checkpoint it goes on where it stopped."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def append_and_read(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Append a stream to a JSON log and read the log."""
    base = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    q = df.writeStream.format("json").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).json(f"{base}/out")


def latest_by_key(spark: SparkSession, df: DataFrame, key: str, order: list[str]) -> str:
    """Keep the latest row per key by foreachBatch: each batch is merged with the
    table of the batch before and written under its own number, so a batch that
    runs twice writes the same table. Returns the folder; the highest number holds."""
    base = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{base}/{number - 1}"))
        whole = F.struct(*rows.columns)
        rows.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{base}/{number}")

    df.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return base
