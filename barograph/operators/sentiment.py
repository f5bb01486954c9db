"""Daily sentiment of a stock from articles, by name and by theme, and the feature table built on it.

Articles meet the two maps first and then each stock's own calendar, as one article may fall on different
days for different stocks. The maps are small dimensions; Spark broadcasts them when their size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.functions import scalar
from barograph.operators import asof, indicators

POSITIVE, NEGATIVE, DIRECT_SHARE, THEME_SHARE = 0.55, 0.45, 0.7, 0.3
SUCCESS, EMPTY, FAILED = "SUCCESS", "SUCCESS_EMPTY", "SOURCE_FAILED"
#: What a failed row has NULL, whatever was fetched or filled.
OWNED = ["article_count", "sentiment", "bullishness", "agreement", "sentiment_3d", "sentiment_5d", "sentiment_lag1", "sentiment_lag2"]


def scored(articles: DataFrame, allowed: list[str]) -> DataFrame:
    """Scored articles of allowed sources with polarity flags and their effective day."""
    s = F.col("sentiment_score")
    return (
        articles.where(F.col("source").isin(allowed) & s.isNotNull())
        .withColumn("pos", (s >= POSITIVE).cast("double")).withColumn("neg", (s <= NEGATIVE).cast("double"))
        .withColumn("eff", asof.effective_date(F.col("post_time")))
    )


def _hits(articles: DataFrame, entity_map: DataFrame, theme_map: DataFrame) -> DataFrame:
    """What is said of a stock on a day, by name and by theme: sums by (stock_id, eff), made before any as-of join."""
    own = articles.join(entity_map, articles["fetch_keyword"] == entity_map["keyword"]).select("stock_id", "eff", F.lit(True).alias("own"), F.lit(1.0).alias("w"), "sentiment_score", "pos", "neg")
    theme = articles.join(theme_map, articles["fetch_keyword"] == theme_map["theme_keyword"]).select("stock_id", "eff", F.lit(False).alias("own"), F.col("relevance_weight").alias("w"), "sentiment_score", "pos", "neg")
    side = {"direct": F.col("own"), "theme": ~F.col("own")}
    total = lambda on, x: F.sum(F.when(on, F.col("w") * F.col(x)))
    sums = [e for k, on in side.items() for e in (F.count_if(on).alias(f"{k}_n"), F.sum(F.when(on, F.col("w"))).alias(f"{k}_w"), total(on, "sentiment_score").alias(f"{k}_s"), total(on, "pos").alias(f"{k}_pos"), total(on, "neg").alias(f"{k}_neg"))]
    return own.unionByName(theme).groupBy("stock_id", "eff").agg(*sums)


def both_daily(articles: DataFrame, entity_map: DataFrame, theme_map: DataFrame, calendar: DataFrame) -> DataFrame:
    """The sums of both sides by (stock_id, trade_date), through one as-of window over days."""
    day = asof.forward(_hits(articles, entity_map, theme_map), "eff", calendar, ["stock_id"])
    sums = [c for c in day.columns if c not in ("stock_id", "eff", "trade_date")]
    return day.groupBy("stock_id", "trade_date").agg(*[F.sum(c).alias(c) for c in sums])


def direct_daily(articles: DataFrame, entity_map: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stock days that have articles of their own."""
    none = entity_map.select(F.col("keyword").alias("theme_keyword"), "stock_id", F.lit(0.0).alias("relevance_weight")).where("false")
    both = both_daily(articles, entity_map, none, calendar)
    return both.select("stock_id", "trade_date", F.col("direct_n").alias("article_count"), (F.col("direct_s") / F.col("direct_w")).alias("direct_score"), F.col("direct_pos").alias("pos"), F.col("direct_neg").alias("neg"))


def theme_daily(articles: DataFrame, theme_map: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stock days that have articles of a theme."""
    none = theme_map.select(F.col("theme_keyword").alias("keyword"), "stock_id").where("false")
    both = both_daily(articles, none, theme_map, calendar)
    return both.select("stock_id", "trade_date", F.col("theme_n").alias("theme_count"), F.try_divide("theme_s", "theme_w").alias("theme_score"), "theme_pos", "theme_neg")


def fused(both: DataFrame) -> DataFrame:
    """70 to 30 where both sides speak, one side alone otherwise; both_daily has a row where either does."""
    return with_fusion(both).select("stock_id", "trade_date", "article_count", "sentiment", "pos", "neg", "bullishness", "agreement")


def with_fusion(both: DataFrame) -> DataFrame:
    """The sums of both sides, NULL on a day without articles, to article_count, sentiment, pos, neg, bullishness and agreement."""
    d, t = F.try_divide("direct_s", "direct_w"), F.try_divide("theme_s", "theme_w")
    score = F.when(d.isNotNull() & t.isNotNull(), DIRECT_SHARE * d + THEME_SHARE * t).otherwise(F.coalesce(d, t, F.lit(0.5)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pos, neg = (zero(f"direct_{c}") + THEME_SHARE * zero(f"theme_{c}") for c in ("pos", "neg"))
    n = F.col("direct_n") + F.col("theme_n")
    out = both.withColumns({"article_count": n, "sentiment": F.when(n.isNotNull(), score), "pos": pos, "neg": neg})
    return out.withColumns({"bullishness": scalar.bullishness(F.col("pos"), F.col("neg")), "agreement": scalar.agreement(F.col("pos"), F.col("neg"))})


def failed_keys(run_log: DataFrame, entity_map: DataFrame, calendar: DataFrame, reach: int = 2) -> DataFrame:
    """(stock_id, trade_date) that no usable batch covers.

    A batch that ended OK or NO_DATA covers its day and the `reach` days before; only stocks with a keyword
    that was ever asked for count, from the first batch day on.
    """
    mapped = run_log.join(entity_map, run_log["item_key"] == entity_map["keyword"]).select("stock_id", "batch_date", "outcome")
    covered = mapped.where(F.col("outcome").isin("OK", "NO_DATA")).select("stock_id", F.explode(F.sequence(F.date_sub("batch_date", reach), F.col("batch_date"))).alias("trade_date")).distinct()
    span = mapped.groupBy("stock_id").agg(F.min("batch_date").alias("_from"), F.max("batch_date").alias("_to"))
    days = calendar.select("stock_id", "trade_date").distinct().join(span, "stock_id").where(F.col("trade_date").between(F.col("_from"), F.col("_to")))
    return days.select("stock_id", "trade_date").join(covered, ["stock_id", "trade_date"], "left_anti")


def _told_days(bars: DataFrame, hits: DataFrame, batches: DataFrame, reach: int) -> DataFrame:
    """bars with the sums of the hits that fall to each day and `_failed`, as `failed_keys` has it: bars, hits(stock_id, eff, ...) and
    batches(stock_id, batch_date, _usable) meet in one exchange and one order by stock.

    Latest first, and on one day batches, then the day, then what is said: a hit goes to the last day seen, and a day is
    covered if the last usable batch seen is at most `reach` days ahead of it.
    """
    days = bars.select("*", F.col("trade_date").alias("_at"), F.lit(1).alias("_side"))
    said = hits.withColumnRenamed("eff", "_at").withColumn("_side", F.lit(0))
    asked = batches.withColumnRenamed("batch_date", "_at").withColumn("_side", F.lit(2))
    rows = days.unionByName(said, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    whole = Window.partitionBy("stock_id")
    seen = whole.orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda on: F.last(F.when(on, F.col("_at")), ignorenulls=True).over(seen)
    batch = F.when(F.col("_side") == 2, F.col("_at"))
    rows = rows.withColumns({"_day": last(F.col("_side") == 1), "_next": last(F.col("_usable")), "_from": F.min(batch).over(whole), "_to": F.max(batch).over(whole)})
    covered = F.coalesce(F.date_sub("_next", reach) <= F.col("_at"), F.lit(False))
    failed = F.coalesce(F.col("_at").between(F.col("_from"), F.col("_to")), F.lit(False)) & ~covered
    kept = rows.where((F.col("_side") != 2) & F.col("_day").isNotNull())
    sums = [c for c in hits.columns if c not in ("stock_id", "eff")]
    own = [c for c in bars.columns if c not in ("stock_id", "trade_date")]
    # one row of a day is its bar: the greatest known value of its columns is the bar's
    out = kept.groupBy("stock_id", F.col("_day").alias("trade_date")).agg(*[F.max(c).alias(c) for c in own], *[F.sum(c).alias(c) for c in sums], F.max(F.when(F.col("_side") == 1, failed)).alias("_bad"))
    return out


def daily_features(bars: DataFrame, articles: DataFrame, entity_map: DataFrame, theme_map: DataFrame, run_log: DataFrame, allowed: list[str], reach: int = 2) -> DataFrame:
    """Technical and sentiment features on the price calendar; a stock has one bar a day.

    The status comes before any fill: a failed key is SOURCE_FAILED, articles or not, the others are SUCCESS or, without
    an article, SUCCESS_EMPTY. Days without articles that did not fail have 0 articles and indices of 0.0, but
    no sentiment; failed rows end with NULL in all eight sentiment columns, whatever was fetched or filled.
    """
    hits = _hits(scored(articles, allowed), entity_map, theme_map)
    batches = run_log.join(entity_map, run_log["item_key"] == entity_map["keyword"]).groupBy("stock_id", "batch_date").agg(F.max(F.col("outcome").isin("OK", "NO_DATA")).alias("_usable"))
    df = indicators.technical(with_fusion(_told_days(bars, hits, batches, reach)))
    df = df.withColumn("source_status", F.when(F.col("_bad"), FAILED).when(F.col("article_count") > 0, SUCCESS).otherwise(EMPTY))
    df = df.withColumns({c: F.when(~F.col("_bad"), F.coalesce(c, F.lit(zero))) for c, zero in (("article_count", 0), ("bullishness", 0.0), ("agreement", 0.0))})
    df = (
        df.withColumn("sentiment_3d", indicators.rolling_mean("sentiment", 3)).withColumn("sentiment_5d", indicators.rolling_mean("sentiment", 5))
        .withColumn("sentiment_lag1", indicators.lag_with_warm_up("sentiment", 1, F.col("_bad"))).withColumn("sentiment_lag2", indicators.lag_with_warm_up("sentiment", 2, F.col("_bad")))
    )
    return df.withColumns({c: F.when(~F.col("_bad"), F.col(c)) for c in OWNED}).drop("_bad", "pos", "neg", *[c for c in hits.columns if c not in ("stock_id", "eff")])


ORDERS = {"newest": ["post_time DESC", "article_id"], "oldest": ["post_time", "article_id"], "highest": ["sentiment_score DESC NULLS LAST", "article_id"], "lowest": ["sentiment_score NULLS LAST", "article_id"]}


def article_rows(articles: DataFrame, label: str | None = None, contains: str | None = None, order: str = "newest", column: str = "title") -> DataFrame:
    """Articles of one band and with a piece of text, whatever its case, in one of four orders; the day as text."""
    df = articles.withColumn("label", scalar.sentiment_band(F.col("sentiment_score"))).withColumn("day", F.date_format("post_time", "yyyy-MM-dd HH:mm"))
    if label:
        df = df.where(F.col("label") == label)
    if contains:
        df = df.where(F.contains(F.lower(column), F.lit(contains.lower())))
    return df.orderBy(*[F.expr(c.split(" ")[0]).desc_nulls_last() if " DESC" in c else F.expr(c.split(" ")[0]).asc_nulls_last() for c in ORDERS[order]])


def radar(counts: DataFrame, themes: DataFrame) -> DataFrame:
    """counts(theme_keyword, n, pos, neg) to bullishness, label and three stocks of each theme; a theme without articles shows placeholders."""
    stocks = F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("relevance_weight")).alias("w"), "stock_id"))), lambda x: x["stock_id"]), 1, 3)
    each = themes.groupBy("theme_keyword").agg(stocks.alias("stocks"), F.count(F.lit(1)).alias("_k")).join(counts, "theme_keyword", "left")
    some = F.coalesce(F.col("n") > 0, F.lit(False))
    b = F.when(some, scalar.bullishness(F.col("pos"), F.col("neg"))).otherwise(0.85)
    out = each.withColumn("bullishness", b)
    label = F.when(F.col("bullishness") >= 1.0, "very_bullish").when(F.col("bullishness") >= 0.3, "bullish").when(F.col("bullishness") <= -0.5, "bearish").otherwise("steady")
    return out.select("theme_keyword", F.when(some, F.col("n")).otherwise(F.col("_k") * 8).alias("article_count"), "bullishness", label.alias("label"), F.array_join("stocks", ",").alias("stocks"))
