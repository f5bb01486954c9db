"""Structured Streaming jobs: scoring what is new, decision days and late comments as they come, writes safe to repeat.

Every job runs to the end of what is there (`availableNow`) and then stops, so a daily trigger is a scheduler that
starts it. State and progress lie in the checkpoint folder, which must be shared by driver and executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import asof


def files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """One pass over everything new, in micro-batches; returns when it is done."""
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def own_session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful jobs: their number of partitions is fixed with the first checkpoint, so it is set by the cluster's cores."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", max(2, spark.sparkContext.defaultParallelism))
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


def overwrite_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A folder a batch, overwritten as a whole when the batch is repeated; for streams that give each row once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of `overwrite_batch`, with their number."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


def decided(articles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Streamed articles(stock_id, post_time, ...) with the trading day they count for.

    calendar(stock_id, trade_date) is static: each day covers the span since the one before, so a stream meets it
    by equality on (stock_id, day) without a window; days beyond the calendar go.
    """
    w = Window.partitionBy("stock_id").orderBy("trade_date")
    before = F.coalesce(F.date_add(F.lag("trade_date").over(w), 1), F.date_sub("trade_date", 31))
    span = calendar.select("stock_id", "trade_date").distinct().withColumn("_from", before)
    span = span.select("stock_id", "trade_date", F.explode(F.sequence("_from", "trade_date")).alias("eff"))
    return articles.withColumn("eff", asof.effective_date(F.col("post_time"))).join(span, ["stock_id", "eff"]).drop("eff")


def daily_counts(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """Articles and mean score by day, closed once the watermark has passed; what comes later than `delay` is left out."""
    t = articles.withColumn("at", F.col("post_time").cast("timestamp")).withWatermark("at", delay)
    return t.groupBy(F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("score")).select(F.to_date("w.start").alias("day"), "n", "score")


def append_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch can't double: a folder a batch, overwritten as a whole; keys that an earlier batch has written are left out.

    Of rows of one key the least by their other columns stays, so a repeated batch writes the same row.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        fresh = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least")).select(*keys, "_least.*").select(*batch.columns) if rest else batch.dropDuplicates(keys)
        if number:
            old = spark.read.option("basePath", path).schema(batch.schema.add("batch", "long")).parquet(path).where(F.col("batch") < number)
            fresh = fresh.join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(spark: SparkSession, folder: str, schema: str, score: Column, out: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Score every row that has no score yet, batch by batch until none is left; returns what was written."""
    todo = files(spark, folder, schema).where(F.col("sentiment_score").isNull()).withColumn("sentiment_score", score)
    run(todo, append_once(out, keys), checkpoint)
    return spark.read.schema(todo.schema.add("batch", "long")).option("basePath", out).parquet(out).drop("batch")
