"""Guards of the research stages, deterministic bars for demonstrations, digests and stored models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = {"target_up_down": [0, 1], "target_triple_barrier": [-1, 0, 1]}
SEGMENTS = ["meta_train", "meta_eval", "purged"]


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The same frame; raises for columns that are not there."""
    if absent := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns missing: {absent}")
    return df


def timeout_column(target: str, prefix: str = "p") -> str:
    """The column of class 0's probability, by its place among the target's classes; raises for another target."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}")
    return f"{prefix}{TARGETS[target].index(0)}"


def segment_violations(df: DataFrame, expected: dict[str, int], starts: dict[int, str]) -> DataFrame:
    """Rule, found: segments outside the domain, segments whose rows are not as many as expected, folds that start on another day."""
    count = df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    unknown = count.where(~F.col("segment").isin(SEGMENTS)).select(F.concat(F.lit("unknown segment "), "segment").alias("rule"), F.col("n").cast("string").alias("found"))
    want = df.sparkSession.createDataFrame(sorted(expected.items()), "segment string, want long")
    other = want.join(count, "segment", "left").where(F.coalesce("n", F.lit(0)) != F.col("want")).select(F.concat(F.lit("rows of "), "segment").alias("rule"), F.coalesce("n", F.lit(0)).cast("string").alias("found"))
    days = df.sparkSession.createDataFrame(sorted(starts.items()), "fold int, day string")
    first = df.groupBy("fold").agg(F.min("d").cast("string").alias("first"))
    late = days.join(first, "fold", "left").where(~F.col("day").eqNullSafe(F.col("first"))).select(F.concat(F.lit("start of fold "), F.col("fold").cast("string")).alias("rule"), F.col("first").alias("found"))
    return unknown.unionByName(other).unionByName(late)


def may_write(conditions: dict[str, bool]) -> None:
    """Raises with the names of the conditions that do not hold."""
    if failed := sorted(k for k, ok in conditions.items() if not ok):
        raise PermissionError(f"not written: {failed}")


def retained_shift(df: DataFrame, by: list[str], keep: Column, y: str, classes: tuple = (-1, 0, 1)) -> DataFrame:
    """The rate of each class among what a gate keeps, and how far that is from its rate among all."""
    rows = df.withColumn("_k", keep).withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    hit = F.col(y) == F.col("class")
    c = rows.groupBy(*by, "class").agg(F.avg(hit.cast("double")).alias("rate"), F.avg(F.when(F.col("_k"), hit.cast("double"))).alias("retained_rate"))
    return c.withColumn("shift", F.col("retained_rate") - F.col("rate"))


def mock_bars(calendar: DataFrame, s: Column | None = None) -> DataFrame:
    """Deterministic bars for calendar(stock_id, trade_date): closes walk by arithmetic on the stock's number (`s`, by default from its checksum) and the day's; no random state."""
    s, i = F.crc32(F.col("stock_id").cast("binary")) % 97 if s is None else s, F.unix_date("trade_date")
    close = 100 + (s * 7 + i * 13) % 41 - 20 + s
    return calendar.select("stock_id", "trade_date", close.cast("double").alias("close_price"), (1000 + (s * 31 + i * 17) % 997).alias("volume"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path and SHA-256 of each file, hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def save_model(model, path: str) -> str:
    """Through Spark's own writer, no pickle; replaces what was there."""
    model.write().overwrite().save(path)
    return path


def label_report(labels: DataFrame, least: float = 0.05) -> DataFrame:
    """By stock: share of timeouts and whether it is below `least`, the rarest class's share and whether that reaches it."""
    n = F.count("triple_barrier")
    share = lambda k: F.try_divide(F.count_if(F.col("triple_barrier") == k), n)
    r = labels.groupBy("stock_id").agg(share(0).alias("timeout_ratio"), F.least(share(-1), share(0), share(1)).alias("rarest_share"))
    return r.select("stock_id", "timeout_ratio", (F.col("timeout_ratio") < least).alias("below"), "rarest_share", (F.col("rarest_share") >= least).alias("balanced"))
