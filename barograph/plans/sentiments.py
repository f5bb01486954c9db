"""Queries of sentiment features, comments and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import asof, comments, runlog, sentiment
from barograph.plans.prices import SQL_TECH, TECH, TECH_SQL_COLS, W
from barograph.plans.registry import query
from barograph.sources.fixtures import ALLOWED, Views

#: Means of scores with few digits often lie halfway between two roundings; sums in another order must not decide.
NUDGE = 1e-12
SQL_ART = """, art AS (SELECT *, CAST(sentiment_score >= 0.55 AS INTEGER)::DOUBLE AS pos, CAST(sentiment_score <= 0.45 AS INTEGER)::DOUBLE AS neg, CAST(CAST(post_time AS DATE) + CASE WHEN CAST(post_time AS TIME) > TIME '15:30:00' THEN 1 ELSE 0 END AS DATE) AS eff FROM articles WHERE source IN ('forum', 'board', 'media') AND sentiment_score IS NOT NULL),
ent AS (SELECT article_id, stock_id, eff, sentiment_score, pos, neg FROM art JOIN entity_map ON fetch_keyword = keyword),
ent_day AS (SELECT e.*, b.trade_date FROM ent e ASOF JOIN bars b ON e.stock_id = b.stock_id AND e.eff <= b.trade_date),
direct AS (SELECT stock_id, trade_date, count(*) AS article_count, avg(sentiment_score) AS direct_score, sum(pos) AS pos, sum(neg) AS neg FROM ent_day GROUP BY 1, 2),
thm AS (SELECT stock_id, eff, relevance_weight AS w, relevance_weight * sentiment_score AS ws, relevance_weight * pos AS wp, relevance_weight * neg AS wn FROM art JOIN theme_map ON fetch_keyword = theme_keyword),
thm_day AS (SELECT t.*, b.trade_date FROM thm t ASOF JOIN bars b ON t.stock_id = b.stock_id AND t.eff <= b.trade_date),
theme AS (SELECT stock_id, trade_date, count(*) AS theme_count, sum(ws) / sum(w) AS theme_score, sum(wp) AS theme_pos, sum(wn) AS theme_neg FROM thm_day GROUP BY 1, 2),
mix AS (SELECT stock_id, trade_date, coalesce(article_count, 0) + coalesce(theme_count, 0) AS article_count, CASE WHEN direct_score IS NOT NULL AND theme_score IS NOT NULL THEN 0.7 * direct_score + 0.3 * theme_score ELSE coalesce(direct_score, theme_score, 0.5) END AS sentiment,
  coalesce(pos, 0) + 0.3 * coalesce(theme_pos, 0) AS pos, coalesce(neg, 0) + 0.3 * coalesce(theme_neg, 0) AS neg FROM direct FULL JOIN theme USING (stock_id, trade_date)),
fused AS (SELECT *, ln((1 + pos) / (1 + neg)) AS bullishness, CASE WHEN pos + neg = 0 THEN 0.0 ELSE 1 - sqrt(1 - least(greatest(((pos - neg) / (pos + neg)) ** 2, 0.0), 1.0)) END AS agreement FROM mix),
rl AS (SELECT stock_id, batch_date, outcome FROM run_log JOIN entity_map ON item_key = keyword),
covered AS (SELECT DISTINCT stock_id, CAST(batch_date - CAST(j AS INTEGER) AS DATE) AS trade_date FROM rl, range(3) x(j) WHERE outcome IN ('OK', 'NO_DATA')),
span AS (SELECT stock_id, min(batch_date) AS f, max(batch_date) AS t FROM rl GROUP BY 1),
failed AS (SELECT stock_id, trade_date FROM bars JOIN span USING (stock_id) WHERE trade_date BETWEEN f AND t AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.stock_id = bars.stock_id AND c.trade_date = bars.trade_date))
"""


def _art(v: Views) -> DataFrame:
    return sentiment.scored(v.articles, ALLOWED)


@query("C01_C05_forward_asof", SQL_ART + "SELECT article_id, stock_id, eff, trade_date FROM ent_day")
def forward(v: Views) -> DataFrame:
    hit = _art(v).join(v.entity_map, F.col("fetch_keyword") == F.col("keyword")).select("article_id", "stock_id", "eff")
    return asof.forward(hit, "eff", v.bars.select("stock_id", "trade_date"), ["stock_id"])


@query("C06_global_asof", SQL_ART + ", cal AS (SELECT DISTINCT trade_date FROM bars) SELECT article_id, (SELECT min(trade_date) FROM cal WHERE trade_date >= eff) AS trade_date FROM art WHERE eff <= (SELECT max(trade_date) FROM cal)")
def global_asof(v: Views) -> DataFrame:
    """Days first: only distinct days enter the window that has no key."""
    art = _art(v).select("article_id", "eff")
    days = asof.forward(art.select("eff").distinct(), "eff", v.bars.select("trade_date"), [])
    return art.join(days, "eff").select("article_id", "trade_date")


@query("D01_direct_daily", SQL_ART + "SELECT stock_id, trade_date, article_count, round(direct_score + 1e-12, 8) AS direct_score, pos, neg FROM direct")
def direct_daily(v: Views) -> DataFrame:
    return sentiment.direct_daily(_art(v), v.entity_map, v.bars.select("stock_id", "trade_date")).withColumn("direct_score", F.round(F.col("direct_score") + NUDGE, 8))


@query("C02_D02_theme_daily", SQL_ART + "SELECT stock_id, trade_date, theme_count, round(theme_score + 1e-12, 8) AS theme_score, round(theme_pos, 8) AS theme_pos, round(theme_neg, 8) AS theme_neg FROM theme")
def theme_daily(v: Views) -> DataFrame:
    df = sentiment.theme_daily(_art(v), v.theme_map, v.bars.select("stock_id", "trade_date"))
    return df.withColumns({c: F.round(F.col(c) + (NUDGE if c == "theme_score" else 0.0), 8) for c in ("theme_score", "theme_pos", "theme_neg")})


@query("C03_D03_D05_fusion", SQL_ART + "SELECT stock_id, trade_date, article_count, round(sentiment + 1e-12, 8) + 0.0 AS sentiment, round(bullishness + 1e-12, 8) + 0.0 AS bullishness, round(agreement + 1e-12, 8) + 0.0 AS agreement FROM fused")
def fusion(v: Views) -> DataFrame:
    cal = v.bars.select("stock_id", "trade_date")
    df = sentiment.fused(sentiment.both_daily(_art(v), v.entity_map, v.theme_map, cal))
    return df.select("stock_id", "trade_date", "article_count", *[(F.round(F.col(c) + NUDGE, 8) + 0.0).alias(c) for c in ("sentiment", "bullishness", "agreement")])


@query("C19_failed_keys", SQL_ART + "SELECT * FROM failed")
def failed_keys(v: Views) -> DataFrame:
    return sentiment.failed_keys(v.run_log, v.entity_map, v.bars.select("stock_id", "trade_date"))


OWNED = ["sentiment", "bullishness", "agreement", "sentiment_3d", "sentiment_5d", "sentiment_lag1", "sentiment_lag2"]


@query("A21_E08_E09_I22_I23_daily_features", SQL_TECH.rstrip() + SQL_ART + f""", j AS (SELECT t.*, f.article_count AS ac, f.sentiment, f.bullishness, f.agreement, x.stock_id IS NOT NULL AS bad
  FROM tech t LEFT JOIN fused f ON f.stock_id = t.stock_id AND f.trade_date = t.trade_date LEFT JOIN failed x ON x.stock_id = t.stock_id AND x.trade_date = t.trade_date),
k AS (SELECT *, avg(sentiment) OVER {W} ROWS 2 PRECEDING) AS sentiment_3d, avg(sentiment) OVER {W} ROWS 4 PRECEDING) AS sentiment_5d,
  coalesce(lag(sentiment, 1) OVER {W}), CASE WHEN row_number() OVER {W}) <= 1 AND NOT bad THEN 0.5 END) AS sentiment_lag1, coalesce(lag(sentiment, 2) OVER {W}), CASE WHEN row_number() OVER {W}) <= 2 AND NOT bad THEN 0.5 END) AS sentiment_lag2 FROM j)
SELECT stock_id, trade_date, {TECH_SQL_COLS}, CASE WHEN NOT bad THEN coalesce(ac, 0) END AS article_count, CASE WHEN bad THEN 'SOURCE_FAILED' WHEN ac > 0 THEN 'SUCCESS' ELSE 'SUCCESS_EMPTY' END AS source_status, {", ".join(f"CASE WHEN NOT bad THEN round({f'coalesce({c}, 0.0)' if c in ('bullishness', 'agreement') else c} + 1e-12, 8) + 0.0 END AS {c}" for c in OWNED)} FROM k""")
def daily_features(v: Views) -> DataFrame:
    df = sentiment.daily_features(v.bars, v.articles, v.entity_map, v.theme_map, v.run_log, ALLOWED)
    return df.select("stock_id", "trade_date", *[(F.round(c, 8) + 0.0).alias(c) for c in TECH], "article_count", "source_status", *[(F.round(F.col(c) + NUDGE, 8) + 0.0).alias(c) for c in OWNED])


@query("D06_J04_counts_as_of", """, cut AS (SELECT article_id, post_time + INTERVAL 90 MINUTE AS cutoff FROM articles WHERE article_id IN (SELECT article_id FROM comments))
SELECT cut.article_id, cutoff, count(*) FILTER (comment_tag = '推' AND comment_time <= cutoff) AS push, count(*) FILTER (comment_tag = '噓' AND comment_time <= cutoff) AS boo, count(*) FILTER (comment_tag = '→' AND comment_time <= cutoff) AS neutral FROM cut JOIN comments USING (article_id) GROUP BY 1, 2""")
def counts_as_of(v: Views) -> DataFrame:
    c = v.comments
    cut = v.articles.join(c, "article_id", "left_semi").select("article_id", (F.col("post_time") + F.expr("INTERVAL '90' MINUTE")).alias("cutoff"))
    return comments.counts_as_of(c, cut)


@query("E17_M32_time_resets", """, p AS (SELECT article_id, comment_time, max(comment_time) OVER (PARTITION BY article_id ORDER BY comment_seq ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev FROM comments)
SELECT article_id, coalesce(bool_or(comment_time < prev), FALSE) AS suspect FROM p GROUP BY 1""")
def time_resets(v: Views) -> DataFrame:
    return comments.time_resets(v.comments)


@query("E18_year_inference", """, m AS (SELECT article_id, comment_seq, (100 * (1 + (article_id * 5 + comment_seq * 5) % 12) + 3) AS md FROM comments),
f AS (SELECT *, CASE WHEN md < coalesce(lag(md) OVER (PARTITION BY article_id ORDER BY comment_seq), 101) THEN 1 ELSE 0 END AS fall FROM m)
SELECT article_id, comment_seq, CAST(2000 + sum(fall) OVER (PARTITION BY article_id ORDER BY comment_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS year_inferred FROM f""")
def year_inference(v: Views) -> DataFrame:
    df = v.comments.withColumn("md", 100 * (1 + (F.col("article_id") * 5 + F.col("comment_seq") * 5) % 12) + 3)
    return comments.infer_years(df, F.lit(2000).cast("long"), F.lit(101)).select("article_id", "comment_seq", "year_inferred")


@query("E18_year_anchors", """, m AS (SELECT article_id, comment_seq, 100 * (1 + (article_id * 5 + comment_seq * 5) % 12) + 3 AS md, CASE WHEN comment_seq = 3 THEN 2010 END AS own FROM comments),
s AS (SELECT *, count(own) OVER (PARTITION BY article_id ORDER BY comment_seq) AS seg, CASE WHEN own IS NULL AND md < coalesce(lag(md) OVER (PARTITION BY article_id ORDER BY comment_seq), 101) THEN 1 ELSE 0 END AS fall FROM m)
SELECT article_id, comment_seq, CAST(CASE WHEN seg > 0 THEN 2010 ELSE 2000 END + sum(fall) OVER (PARTITION BY article_id, seg ORDER BY comment_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS year_inferred FROM s""")
def year_anchors(v: Views) -> DataFrame:
    """The third comment shows its year."""
    df = v.comments.withColumn("md", 100 * (1 + (F.col("article_id") * 5 + F.col("comment_seq") * 5) % 12) + 3).withColumn("own", F.when(F.col("comment_seq") == 3, 2010).cast("long"))
    return comments.infer_years(df, F.lit(2000).cast("long"), F.lit(101), "own").select("article_id", "comment_seq", "year_inferred")


@query("H14_M06_out_of_bounds", """, a AS (SELECT article_id, post_time, post_time + INTERVAL 100 MINUTE AS scraped_at FROM articles)
SELECT article_id, comment_seq, CASE WHEN comment_time > scraped_at THEN 'after_scrape' ELSE 'before_post' END AS cause FROM comments JOIN a USING (article_id) WHERE comment_time > scraped_at OR comment_time < date_trunc('minute', post_time)""")
def out_of_bounds(v: Views) -> DataFrame:
    a = v.articles.select("article_id", "post_time", (F.col("post_time") + F.expr("INTERVAL '100' MINUTE")).alias("scraped_at"))
    return comments.out_of_bounds(v.comments, a)


@query("D07_D08_E11_comment_ratios", "SELECT source, sum(push_count) AS push, sum(boo_count) AS boo, sum(push_count + boo_count + neutral_count) AS total, round((sum(push_count) - sum(boo_count)) / (sum(push_count) + sum(boo_count) + 1), 8) AS push_ratio FROM articles GROUP BY 1")
def comment_ratios(v: Views) -> DataFrame:
    c = v.articles.groupBy("source").agg(F.sum("push_count").alias("push"), F.sum("boo_count").alias("boo"), F.sum(F.col("push_count") + F.col("boo_count") + F.col("neutral_count")).alias("total"))
    return c.withColumn("push_ratio", F.round(comments.push_ratio(F.col("push"), F.col("boo")), 8))


@query("C12_completeness", """SELECT a.article_id, a.push_count + a.boo_count + a.neutral_count AS said, count(c.comment_seq) AS found FROM articles a LEFT JOIN comments c USING (article_id) WHERE a.push_count IS NOT NULL GROUP BY 1, 2 HAVING count(c.comment_seq) < a.push_count + a.boo_count + a.neutral_count""")
def completeness(v: Views) -> DataFrame:
    a = v.articles.where(F.col("push_count").isNotNull()).select("article_id", (F.col("push_count") + F.col("boo_count") + F.col("neutral_count")).alias("said"))
    return a.join(v.comments, "article_id", "left").groupBy("article_id", "said").agg(F.count("comment_seq").alias("found")).where("found < said")


@query("D14_D15_outcomes", "SELECT batch_date, count(*) FILTER (outcome = 'OK') AS ok, count(*) FILTER (outcome = 'NO_DATA') AS no_data, count(*) FILTER (outcome = 'FETCH_FAILED') AS fetch_failed, count(*) FILTER (outcome = 'REFUSED') AS refused, count(*) AS total FROM run_log GROUP BY 1")
def outcomes(v: Views) -> DataFrame:
    o = F.col("outcome")
    return v.run_log.groupBy("batch_date").agg(*[F.count_if(o == k).alias(k.lower()) for k in ("OK", "NO_DATA", "FETCH_FAILED", "REFUSED")], F.count(F.lit(1)).alias("total"))


@query("M05_keyword_outcomes", ", k AS (SELECT keyword, CAST(substr(keyword, 3) AS INTEGER) % 3 AS batch FROM entity_map), h AS (SELECT DISTINCT fetch_keyword AS keyword FROM articles WHERE sentiment_score >= 0.99) SELECT batch, keyword, CASE WHEN keyword IN (SELECT keyword FROM h) THEN 'OK' WHEN batch = 2 THEN 'FETCH_FAILED' ELSE 'NO_DATA' END AS outcome FROM k")
def keyword_outcomes(v: Views) -> DataFrame:
    """Three batches of keywords, the last of them degraded."""
    k = v.entity_map.select((F.substring("keyword", 3, 9).cast("int") % 3).alias("batch"), "keyword")
    hits = v.articles.where("sentiment_score >= 0.99").select(F.col("fetch_keyword").alias("keyword")).join(k, "keyword")
    batches = v.spark.createDataFrame([(0, "OK"), (1, "NO_DATA"), (2, "SOURCE_DEGRADED")], "batch int, outcome string")
    return runlog.keyword_outcomes(k, hits, batches)


@query("J09_market_attempts", ", m AS (SELECT stock_id AS market, trade_date, CASE WHEN volume % 997 = 0 THEN 'REFUSED' WHEN volume % 7 = 0 THEN 'FETCH_FAILED' ELSE 'OK' END AS outcome FROM bars), f AS (SELECT market, min(trade_date) FILTER (outcome = 'REFUSED') AS d FROM m GROUP BY 1) SELECT market, trade_date, d IS NULL OR trade_date <= d AS attempted, CASE WHEN d IS NULL OR trade_date <= d THEN outcome END AS outcome FROM m JOIN f USING (market)")
def market_attempts(v: Views) -> DataFrame:
    o = F.when(F.col("volume") % 997 == 0, "REFUSED").when(F.col("volume") % 7 == 0, "FETCH_FAILED").otherwise("OK")
    return runlog.attempts(v.bars.select(F.col("stock_id").alias("market"), "trade_date", o.alias("outcome")))


@query("A28_copied_prices", """, w AS (SELECT stock_id, trade_date, volume, close_price, CASE volume % 3 WHEN 0 THEN 'TWSE' ELSE 'TPEX' END AS market FROM bars),
b AS (SELECT trade_date, market, CASE (day(trade_date) + length(market) + CASE market WHEN 'TWSE' THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'REFUSED' ELSE 'NO_DATA' END AS outcome FROM (SELECT DISTINCT trade_date FROM bars), (VALUES ('TWSE'), ('TPEX')) m(market))
SELECT stock_id, trade_date, market, CASE WHEN volume % 2 = 0 THEN close_price END AS close_price, CASE WHEN volume % 2 = 0 THEN 'OK' WHEN outcome = 'OK' THEN 'NO_DATA' WHEN outcome = 'REFUSED' THEN 'REFUSED' ELSE 'FETCH_FAILED' END AS outcome FROM w JOIN b USING (trade_date, market)""")
def copied_prices(v: Views) -> DataFrame:
    w = v.bars.select("stock_id", "trade_date", "volume", "close_price", F.when(F.col("volume") % 3 == 0, "TWSE").otherwise("TPEX").alias("market"))
    markets = v.spark.createDataFrame([("TWSE", 1), ("TPEX", 0)], "market string, k int")
    days = v.bars.select("trade_date").distinct().crossJoin(F.broadcast(markets))  # two markets
    code = (F.dayofmonth("trade_date") + 4 + F.col("k")) % 3
    b = days.select("market", "trade_date", F.when(code == 0, "OK").when(code == 1, "REFUSED").otherwise("NO_DATA").alias("outcome"))
    return runlog.copied_prices(w.select("stock_id", "trade_date", "market"), w.where("volume % 2 = 0"), b)


@query("A27_B20_run_log", "SELECT item_key, batch_date, outcome, CASE WHEN outcome IN ('FETCH_FAILED', 'REFUSED') THEN 'HTTP 503' END AS detail FROM run_log")
def run_log(v: Views) -> DataFrame:
    rows = v.run_log.select(F.lit("board").alias("source"), F.col("batch_date").cast("string").alias("batch_key"), "item_key", "outcome", F.when(F.col("outcome") == "FETCH_FAILED", "HTTP 503").alias("detail"))
    log = rows.where("false").withColumn("started_at", F.lit(None).cast("timestamp"))
    return runlog.appended(log, rows, "2024-01-01 15:35:00").select("item_key", F.col("batch_key").cast("date").alias("batch_date"), "outcome", "detail")


@query("B20_invalid_entries", "SELECT item_key, batch_date, CASE WHEN outcome = 'OK' AND day(batch_date) % 4 = 0 THEN 'detail without failure' WHEN outcome = 'FETCH_FAILED' AND day(batch_date) % 4 <> 0 THEN 'detail missing' END AS why FROM run_log WHERE (outcome = 'OK' AND day(batch_date) % 4 = 0) OR (outcome = 'FETCH_FAILED' AND day(batch_date) % 4 <> 0)")
def invalid_entries(v: Views) -> DataFrame:
    rows = v.run_log.withColumn("detail", F.when((F.dayofmonth("batch_date") % 4 == 0) & (F.col("outcome") != "NO_DATA"), "HTTP 503"))
    return runlog.invalid(rows).select("item_key", "batch_date", "why")
