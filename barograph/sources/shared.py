"""The folder that the driver and all executors see, for what a job writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; the warehouse stands in where none is set (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/_jobs"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)
