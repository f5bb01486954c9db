"""Checks of features, prices and labels: each gives the rows that break a rule, or the figures to hold against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.functions.scalar import close_enough
from barograph.operators import indicators, sentiment

STATUSES = [sentiment.SUCCESS, sentiment.EMPTY, sentiment.FAILED]


def _apart(a: Column, b: Column) -> Column:
    return ~close_enough(a, b)


def price_violations(features: DataFrame, prices: DataFrame) -> DataFrame:
    """Features whose close or volume is not the price table's."""
    p = prices.select("stock_id", "trade_date", F.col("close_price").alias("_c"), F.col("volume").alias("_v"))
    return features.join(p, ["stock_id", "trade_date"]).where(_apart(F.col("close_price"), F.col("_c")) | _apart(F.col("volume"), F.col("_v"))).select("stock_id", "trade_date")


def derivation_violations(features: DataFrame) -> DataFrame:
    """Rows whose return, target or volatility is not what the closes give; (stock_id, trade_date, check)."""
    given = features.withColumn("_given", F.col("target_return")).withColumn("_r", indicators.log_return(F.col("close_price")))
    again = indicators.targets(given).withColumn("_v", indicators.volatility(F.col("_r"), 5))
    broken = {"return_1d": _apart(F.col("return_1d"), F.col("_r")), "target_return": _apart(F.col("_given"), F.col("target_return")), "volatility_5d": _apart(F.col("volatility_5d"), F.col("_v"))}
    each = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]))
    return again.select("stock_id", "trade_date", F.explode(each).alias("check"))


def status_violations(features: DataFrame) -> DataFrame:
    """An unknown status; where the source did not fail, sentiment that is NULL with articles or known without; where it did, a count or sentiment that is known."""
    status = ~F.coalesce(F.col("source_status").isin(STATUSES), F.lit(False))
    failed = F.col("source_status") == sentiment.FAILED
    known = failed & (F.col("article_count").isNotNull() | F.col("sentiment").isNotNull())
    odd = ~failed & (F.col("sentiment").isNull() != (F.coalesce("article_count", F.lit(0)) == 0))
    name = F.when(status, "source_status_enum").when(known, "source_failed_not_null").when(odd, "sentiment_null_iff_article_zero")
    return features.select("stock_id", "trade_date", name.alias("check")).where(F.col("check").isNotNull())


def invariants(features: DataFrame, prices: DataFrame) -> DataFrame:
    """All violations with the name of the rule."""
    return price_violations(features, prices).withColumn("check", F.lit("price_consistency")).unionByName(derivation_violations(features)).unionByName(status_violations(features))


def label_reconciliation(prices: DataFrame, labels: DataFrame, horizon: int = 5) -> DataFrame:
    """One row: rows without entry and with too few days, and what tails and missing opens account for."""
    w = indicators.by_stock()
    ahead = prices.select("stock_id", F.lead("open_price").over(w).alias("o"), F.lead("trade_date").over(w).alias("d"))
    a = ahead.agg(F.count_distinct("stock_id").alias("n_stocks"), F.count_if(F.col("o").isNull() & F.col("d").isNotNull()).alias("gaps"))
    reason = lambda r: F.count_if(F.col("label_reason").eqNullSafe(r)).alias(r)
    c = labels.agg(reason("no_entry"), reason("insufficient_data"), reason(indicators.AMBIGUOUS), F.count("triple_barrier").alias("labelled"), F.count(F.lit(1)).alias("rows"))
    out = a.join(F.broadcast(c))  # one row beside one row
    tails = F.col("n_stocks") * (horizon - 1)
    return out.select("n_stocks", "rows", "labelled", "no_entry", (F.col("n_stocks") + F.col("gaps")).alias("expected_no_entry"), "insufficient_data", tails.alias("expected_insufficient_tail"), (F.col("insufficient_data") - tails).alias("insufficient_within_window"), F.col(indicators.AMBIGUOUS))


def label_xor_violations(labels: DataFrame) -> DataFrame:
    """Rows with both a label and a reason, or neither."""
    return labels.where(F.col("triple_barrier").isNull() == F.col("label_reason").isNull()).select("stock_id", "trade_date")


def null_ratios(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The stocks with the largest share of NULL."""
    share = F.round(F.avg(F.col(column).isNull().cast("double")), 8).alias("null_ratio")
    return df.groupBy("stock_id").agg(share).orderBy(F.desc("null_ratio"), "stock_id").limit(top)


def total_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and known values of each column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])


def write_checks(before: DataFrame, added: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Groups whose rows before and added do not make the rows after."""
    n = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    c = n(before, "before").join(n(added, "added"), by, "full_outer").join(n(after, "after"), by, "full_outer").fillna(0, ["before", "added", "after"])
    return c.where(F.col("before") + F.col("added") != F.col("after"))


def insert_preview(rows: DataFrame) -> DataFrame:
    """By stock: rows, rows without prices, least and greatest close and their days (the first day of equal ones)."""
    d = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    return rows.groupBy("stock_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("close_price").isNull()).alias("null_prices"), F.min("close_price").alias("least"), F.min_by("trade_date", F.struct("close_price", d)).alias("least_day"), F.max("close_price").alias("greatest"), F.max_by("trade_date", F.struct("close_price", -d)).alias("greatest_day"))


def foreign_rows(rows: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of another batch."""
    return rows.join(batch.select(key).distinct(), key, "left_anti")


def expected_new(stocks: DataFrame, days: DataFrame, existing: DataFrame) -> DataFrame:
    """The product of new stocks and calendar days, both short lists, less what is there."""
    return stocks.select("stock_id").distinct().crossJoin(F.broadcast(days.select("trade_date").distinct())).join(existing, ["stock_id", "trade_date"], "left_anti")


def impact(old: DataFrame, new: DataFrame, expected: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that changed though not expected to, or did not though expected."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), columns, F.lit(True))
    changed = old.join(renamed, keys).where(~same).select(*keys)
    want = expected.select(*keys)
    return changed.exceptAll(want).withColumn("side", F.lit("unexpected")).unionByName(want.exceptAll(changed).withColumn("side", F.lit("unchanged")))


def allowed_split(diff: DataFrame, stocks: DataFrame, day) -> DataFrame:
    """Each difference with whether it was allowed: of a listed stock, from the day on."""
    listed = stocks.select("stock_id").distinct().withColumn("_in", F.lit(True))
    return diff.join(listed, "stock_id", "left").withColumn("allowed", F.coalesce("_in", F.lit(False)) & (F.col("trade_date") >= F.lit(day).cast("date"))).drop("_in")


def context(df: DataFrame, marked: Column, reach: int = 5) -> DataFrame:
    """The marked rows with up to `reach` rows of their stock before and after."""
    near = Window.partitionBy("stock_id").orderBy("trade_date").rowsBetween(-reach, reach)
    m = F.coalesce(marked, F.lit(False))
    return df.withColumn("marked", m).withColumn("_near", F.max("marked").over(near)).where("_near").drop("_near")


def sample_with_nulls(df: DataFrame, keys: list[str], column: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash of their keys and all rows where the column is NULL."""
    drawn = df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
    return drawn.unionByName(df.where(F.col(column).isNull()))


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Column, rows met, greatest difference, and rows of which one side alone is NULL."""
    j = a.select(*keys, *columns).join(b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), keys)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(c) - F.col(f"_{c}")).alias("d"), (F.col(c).isNull() != F.col(f"_{c}").isNull()).alias("odd")) for c in columns])
    return j.select(F.inline(each)).groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_difference"), F.count_if("odd").alias("one_null"))


def collisions(keywords: DataFrame) -> DataFrame:
    """keywords(keyword, stock_id) that point to several stocks: their pairs in order of stock."""
    a, b = keywords.select("keyword", "stock_id").distinct(), keywords.select("keyword", F.col("stock_id").alias("other")).distinct()
    return a.join(b, "keyword").where(F.col("stock_id") < F.col("other"))


def routing_rows(names: DataFrame) -> DataFrame:
    """names(stock_id, name, trade_date): each stock's latest name and how many it has had."""
    last = F.max_by("name", F.struct("trade_date", "name"))
    return names.groupBy("stock_id").agg(last.alias("name"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("all_names"))


def coverage(panel: DataFrame, hits: DataFrame, reach: int = 5) -> DataFrame:
    """By stock: panel days, days with a hit, and days with one in the last `reach` rows."""
    h = hits.select("stock_id", "trade_date").distinct().withColumn("_h", F.lit(1))
    df = panel.select("stock_id", "trade_date").join(h, ["stock_id", "trade_date"], "left")
    df = df.withColumn("_near", F.max("_h").over(indicators.frame(-(reach - 1), 0)))
    return df.groupBy("stock_id").agg(F.count(F.lit(1)).alias("days"), F.count("_h").alias("hit_days"), F.count("_near").alias("near_days"))


def dropped_causes(hits: DataFrame, calendar: DataFrame) -> DataFrame:
    """Why a hit (stock_id, eff) has no trading day: not_in_panel, after_panel, after_own_calendar, before_own_calendar; others are mapped or carried forward."""
    span = calendar.groupBy("stock_id").agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_b"))
    whole = calendar.agg(F.max("trade_date").alias("_g"))  # one row
    e = F.col("eff")
    why = F.when(F.col("_b").isNull(), "not_in_panel").when(e > F.col("_g"), "after_panel").when(e > F.col("_b"), "after_own_calendar").when(e < F.col("_a"), "before_own_calendar").otherwise("mapped")
    return hits.join(span, "stock_id", "left").join(F.broadcast(whole)).groupBy(why.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def gaps(days: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Expected days that are not there."""
    return days.select(*keys).distinct().join(there.select(*keys).distinct(), keys, "left_anti")


def page_rate(entries: DataFrame, days: int = 7) -> DataFrame:
    """entries(page_index, at) by page, without those more than `days` older than their page's newest."""
    w = Window.partitionBy("page_index")
    fresh = entries.withColumn("_max", F.max("at").over(w)).where(F.col("at") >= F.col("_max") - F.lit(days * 86400))
    return fresh.groupBy("page_index").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
