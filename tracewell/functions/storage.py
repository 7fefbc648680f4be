"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. On a cluster it must be configured; on a
    local master an unset value gets a temporary folder."""
    path = spark.conf.get(_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set(_KEY, path)
    return path


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage at a
    table that outlives its executors. options are those of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
