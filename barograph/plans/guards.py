"""Queries of guards, write counts and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import folds, guards, indicators, merges, metrics, sentiment, universe
from barograph.plans.models import SQL_CURVE
from barograph.plans.prices import SQL_TB, SQL_UNIVERSE, W
from barograph.plans.registry import query
from barograph.sources.fixtures import Views


@query("D38_M41_retained_shift", ", k AS (SELECT model, c.class, round(avg(CAST(y3 = c.class AS INTEGER)), 8) AS rate, round(avg(CAST(y3 = c.class AS INTEGER)) FILTER (p <= 0.4), 8) AS retained_rate FROM preds, (VALUES (-1), (0), (1)) c(class) GROUP BY 1, 2) SELECT *, round(retained_rate - rate, 7) AS shift FROM k")
def retained_shift(v: Views) -> DataFrame:
    df = guards.retained_shift(v.preds, ["model"], F.col("p") <= 0.4, "y3")
    return df.withColumns({"rate": F.round("rate", 8), "retained_rate": F.round("retained_rate", 8), "shift": F.round(F.round("retained_rate", 8) - F.round("rate", 8), 7)})


@query("M36_segment_guard", ", s AS (SELECT fold, d, CASE fold WHEN 0 THEN 'meta_train' WHEN 1 THEN 'meta_eval' ELSE 'other' END AS segment FROM preds) SELECT 'unknown segment other' AS rule, CAST(count(*) FILTER (segment = 'other') AS VARCHAR) AS found FROM s UNION ALL SELECT 'rows of meta_eval', CAST(count(*) FILTER (segment = 'meta_eval') AS VARCHAR) FROM s UNION ALL SELECT 'start of fold 2', CAST(min(d) AS VARCHAR) FROM s WHERE fold = 2")
def segment_guard(v: Views) -> DataFrame:
    df = v.preds.select("fold", "d", F.when(F.col("fold") == 0, "meta_train").when(F.col("fold") == 1, "meta_eval").otherwise("other").alias("segment"))
    return guards.segment_violations(df, {"meta_eval": -1}, {2: "1900-01-01"})


@query("M39_model_choices", SQL_CURVE + "SELECT model, theta, round(recall, 8) AS recall FROM curve WHERE coverage >= 0.3 AND lift >= 0.9 AND recall >= 0.2 QUALIFY row_number() OVER (PARTITION BY model ORDER BY recall DESC, precision DESC, theta) = 1")
def model_choices(v: Views) -> DataFrame:
    """Each model's own curve and its own threshold."""
    return metrics.choose_threshold(metrics.threshold_curve(v.preds, ["model"]), 0.3, 0.9, 0.2, ["model"]).select("model", "theta", F.round("recall", 8).alias("recall"))


@query("A32_mock_bars", ", k AS (SELECT stock_id, trade_date, CAST(substr(stock_id, 7) AS INTEGER) * 7 % 97 AS s, date_diff('day', DATE '1970-01-01', trade_date) AS i FROM bars) SELECT 'mock' || s AS stock_id, trade_date, CAST(100 + (s * 7 + i * 13) % 41 - 20 + s AS DOUBLE) AS close_price, 1000 + (s * 31 + i * 17) % 997 AS volume FROM k")
def mock_bars(v: Views) -> DataFrame:
    """On the real calendar, stocks renamed by number."""
    s = F.substring("stock_id", 7, 9).cast("int") * 7 % 97
    return guards.mock_bars(v.bars.select(F.concat(F.lit("mock"), s.cast("string")).alias("stock_id"), "trade_date"), s=F.substring("stock_id", 5, 9).cast("int"))


@query("A16_A17_inserted_count", "SELECT count(*) AS inserted FROM (SELECT DISTINCT 'u' || (article_id // 2) AS url FROM articles) WHERE url NOT IN (SELECT 'u' || (article_id // 2) FROM articles WHERE article_id % 6 = 0)")
def inserted_count(v: Views) -> DataFrame:
    a = v.articles.select(F.concat(F.lit("u"), F.floor(F.col("article_id") / 2).cast("string")).alias("url"), "article_id")
    return merges.insert_ignore(a.where("article_id % 6 = 0").drop("article_id"), a, ["url"], [F.col("article_id")]).agg(F.count(F.lit(1)).alias("inserted"))


@query("F04_M11_M12_universe_reasons", SQL_UNIVERSE + "SELECT coalesce(exclusion_reason, 'included') AS reason, count(*) AS n FROM universe GROUP BY 1")
def universe_reasons(v: Views) -> DataFrame:
    u = universe.build(v.bars, top=15, code_pattern=r"^Brand#[1-9][0-9]*$")
    return u.groupBy(F.coalesce("exclusion_reason", F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("F01_A02_sorted_features", "SELECT stock_id, trade_date, close_price FROM bars ORDER BY stock_id, trade_date")
def sorted_features(v: Views) -> DataFrame:
    return v.bars.select("stock_id", "trade_date", "close_price").orderBy("stock_id", "trade_date")


@query("B07_B09_article_rows", "SELECT article_id, CASE WHEN sentiment_score >= 0.6 THEN 'positive' WHEN sentiment_score <= 0.4 THEN 'negative' ELSE 'neutral' END AS label, strftime(post_time, '%Y-%m-%d %H:%M') AS day FROM articles WHERE sentiment_score >= 0.6 AND fetch_keyword LIKE '%w3%'")
def article_rows(v: Views) -> DataFrame:
    return sentiment.article_rows(v.articles, "positive", "W3", "highest", "fetch_keyword").select("article_id", "label", "day")


@query("D10_D48_radar_labels", """, c AS (SELECT fetch_keyword AS theme_keyword, count(*) AS n, count(*) FILTER (sentiment_score >= 0.55) AS pos, count(*) FILTER (sentiment_score <= 0.45) AS neg FROM (SELECT * REPLACE (CASE fetch_keyword WHEN 'kw4' THEN 'kw5' ELSE fetch_keyword END AS fetch_keyword) FROM articles) GROUP BY 1),
t AS (SELECT theme_keyword, list(stock_id ORDER BY relevance_weight DESC, stock_id) AS s FROM theme_map GROUP BY 1), b AS (SELECT theme_keyword, s, n, CASE WHEN n > 0 THEN ln((1 + pos) / (1 + neg)) ELSE 0.85 END AS b FROM t LEFT JOIN c USING (theme_keyword))
SELECT theme_keyword, coalesce(n, 8 * len(s)) AS article_count, round(b, 8) + 0.0 AS bullishness, CASE WHEN b >= 1.0 THEN 'very_bullish' WHEN b >= 0.3 THEN 'bullish' WHEN b <= -0.5 THEN 'bearish' ELSE 'steady' END AS label, array_to_string(s[1:3], ',') AS stocks FROM b""")
def radar_labels(v: Views) -> DataFrame:
    s = F.col("sentiment_score")
    moved = F.when(F.col("fetch_keyword") == "kw4", "kw5").otherwise(F.col("fetch_keyword"))  # so one theme has no article
    c = v.articles.groupBy(moved.alias("theme_keyword")).agg(F.count(F.lit(1)).alias("n"), F.count_if(s >= 0.55).alias("pos"), F.count_if(s <= 0.45).alias("neg"))
    return sentiment.radar(c, v.theme_map).withColumn("bullishness", F.round("bullishness", 8) + 0.0)


@query("D11_market_max_date", "SELECT m.market, max(trade_date) AS last_day FROM (VALUES ('TWSE'), ('TPEX'), ('US')) m(market) LEFT JOIN bars ON m.market = CASE WHEN CAST(substr(stock_id, 7) AS INTEGER) % 2 = 1 THEN 'TWSE' ELSE 'TPEX' END GROUP BY 1")
def market_max_date(v: Views) -> DataFrame:
    """A market without rows is there with NULL."""
    markets = v.spark.createDataFrame([("TWSE",), ("TPEX",), ("US",)], "market string")
    own = F.when(F.substring("stock_id", 7, 9).cast("int") % 2 == 1, "TWSE").otherwise("TPEX")
    return markets.join(v.bars.groupBy(own.alias("market")).agg(F.max("trade_date").alias("last_day")), "market", "left")


@query("D19_D20_label_report", SQL_TB + "SELECT stock_id, round(count(*) FILTER (triple_barrier = 0) / count(triple_barrier), 8) AS timeout_ratio, count(*) FILTER (triple_barrier = 0) / count(triple_barrier) < 0.05 AS below, round(least(count(*) FILTER (triple_barrier = 1), count(*) FILTER (triple_barrier = 0), count(*) FILTER (triple_barrier = -1)) / count(triple_barrier), 8) AS rarest_share, least(count(*) FILTER (triple_barrier = 1), count(*) FILTER (triple_barrier = 0), count(*) FILTER (triple_barrier = -1)) / count(triple_barrier) >= 0.05 AS balanced FROM labels3 GROUP BY 1")
def label_report(v: Views) -> DataFrame:
    r = guards.label_report(indicators.triple_barrier(v.bars))
    return r.withColumns({c: F.round(c, 8) for c in ("timeout_ratio", "rarest_share")})


SQL_GROWING = f""", pan AS (SELECT stock_id, trade_date, lead(trade_date, 5) OVER {W}) AS label_end_date FROM bars), cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)),
fo AS (SELECT k AS fold, k * 120 + 500 AS b, k * 120 + 501 AS c, k * 120 + 620 AS d FROM range(1000) r(k) WHERE k * 120 + 620 <= (SELECT max(i) FROM cal)),
sp AS (SELECT f.fold, CASE WHEN x.i < f.c THEN 'train' ELSE 'test' END AS role, p.stock_id, p.trade_date, p.label_end_date, s.trade_date AS test_start FROM fo f JOIN cal x ON x.i <= f.d JOIN pan p ON p.trade_date = x.trade_date JOIN cal s ON s.i = f.c)
SELECT fold, count(*) FILTER (role = 'train' AND label_end_date < test_start) AS train_rows, count(*) FILTER (role = 'test') AS test_rows FROM sp GROUP BY 1"""


@query("I03_expanding_folds", SQL_GROWING)
def expanding_folds(v: Views) -> DataFrame:
    panel = indicators.targets(v.bars.select("stock_id", "trade_date", "close_price")).select("stock_id", "trade_date", "label_end_date")
    split = folds.WalkForward(train=500, test=120, embargo=0, expanding=True).split(panel)
    return split.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows"))
