"""The run log: entries that may be written, day outcomes of items, and what a missing price row means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTCOMES = ["OK", "NO_DATA", "FETCH_FAILED", "REFUSED"]
WITH_DETAIL = ["FETCH_FAILED", "REFUSED"]


def invalid(entries: DataFrame) -> DataFrame:
    """Entries with an unknown outcome, a failure without detail, or a detail on anything else."""
    o, detail = F.col("outcome"), F.coalesce(F.col("detail"), F.lit("")) != ""
    why = F.when(~F.coalesce(o.isin(OUTCOMES), F.lit(False)), "unknown outcome").when(o.isin(WITH_DETAIL) & ~detail, "detail missing").when(~o.isin(WITH_DETAIL) & detail, "detail without failure")
    return entries.withColumn("why", why).where(F.col("why").isNotNull())


def appended(log: DataFrame, entries: DataFrame, started_at) -> DataFrame:
    """The log with the entries of one run; the job fails at an entry that may not be written."""
    odd = invalid(entries).select("source", "batch_key", "item_key", "why")
    checked = entries.join(odd, ["source", "batch_key", "item_key"], "left")
    ok = checked.withColumn("outcome", F.when(F.col("why").isNotNull(), F.raise_error(F.col("why"))).otherwise(F.col("outcome"))).drop("why")
    return log.unionByName(ok.withColumn("started_at", F.lit(started_at).cast(log.schema["started_at"].dataType)).select(log.columns))


def keyword_outcomes(keywords: DataFrame, hits: DataFrame, batches: DataFrame) -> DataFrame:
    """keywords(batch, keyword), hits(batch, keyword), batches(batch, outcome): OK for a hit; a miss is NO_DATA, but FETCH_FAILED in a degraded batch, which has not seen every page."""
    h = hits.select("batch", "keyword").distinct().withColumn("_hit", F.lit(True))
    df = keywords.join(h, ["batch", "keyword"], "left").join(batches.select("batch", F.col("outcome").alias("_b")), "batch")
    out = F.when(F.col("_hit"), "OK").when(F.col("_b") == "SOURCE_DEGRADED", "FETCH_FAILED").otherwise("NO_DATA")
    return df.select("batch", "keyword", out.alias("outcome"))


def attempts(days: DataFrame) -> DataFrame:
    """days(market, trade_date, outcome) with `attempted`: a market is left alone after a day on which it refused; the others go on."""
    w = Window.partitionBy("market").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    refused = F.coalesce(F.max(F.col("outcome") == "REFUSED").over(w), F.lit(False))
    return days.withColumn("attempted", ~refused).withColumn("outcome", F.when(~refused, F.col("outcome")))


def copied_prices(wanted: DataFrame, candidates: DataFrame, batches: DataFrame) -> DataFrame:
    """wanted(stock_id, trade_date, market) with what became of each: OK with its price, NO_DATA where the market's batch was OK, else the batch's failure."""
    c = candidates.select("stock_id", "trade_date", "close_price", F.lit(True).alias("_there"))
    b = batches.select("market", "trade_date", F.col("outcome").alias("_b"))
    df = wanted.join(c, ["stock_id", "trade_date"], "left").join(b, ["market", "trade_date"], "left")
    out = F.when(F.col("_there"), "OK").when(F.col("_b") == "OK", "NO_DATA").when(F.col("_b") == "REFUSED", "REFUSED").otherwise("FETCH_FAILED")
    return df.select("stock_id", "trade_date", "market", "close_price", out.alias("outcome"))
