"""Queries of parameterised and feature scans, stamped pipelines, verified inserts, cutoffs and permissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import guards, metrics, partitioned, scans
from barograph.plans.depth import ARTICLES, PRICES
from barograph.plans.registry import query
from barograph.sources.fixtures import ALLOWED, WITH_DIRECTION, Views
from barograph.sources.shared import new_path


@query("A01_parameter_scans", """, s AS (SELECT 'stock' AS scan, stock_id, trade_date FROM bars WHERE stock_id = 'Brand#13' AND volume >= 50 UNION ALL SELECT 'span', stock_id, trade_date FROM bars WHERE trade_date BETWEEN DATE '1995-03-01' AND DATE '1995-05-31')
SELECT scan, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day, 'stock_id,trade_date' AS columns FROM s GROUP BY 1 UNION ALL SELECT 'nothing', 0, NULL, NULL, 'stock_id,trade_date'""")
def parameter_scans(v: Views) -> DataFrame:
    """Three scans of all bars: by stock and volume, by span, and for a name that would end the text if it were pasted."""
    asked = {
        "stock": ("stock_id = :stock AND volume >= :least", {"stock": "Brand#13", "least": 50}),
        "span": ("trade_date BETWEEN :first AND :last", {"first": "1995-03-01", "last": "1995-05-31"}),
        "nothing": ("stock_id = :stock", {"stock": "x' OR '1' = '1"}),
    }
    out = []
    for name, (where, args) in asked.items():
        got = scans.scan(v.spark, f"SELECT stock_id, trade_date FROM {{bars}} WHERE {where}", args, bars=v.bars)
        out.append(got.agg(F.lit(name).alias("scan"), F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.lit(",".join(got.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, out)


@query("A02_feature_scans", """, c AS (SELECT c.* FROM comments c JOIN articles a USING (article_id) WHERE a.source IN ('forum', 'board'))
SELECT 'prices' AS part, count(*) AS n, CAST(min(trade_date) AS VARCHAR) AS least, CAST(max(trade_date) AS VARCHAR) AS most FROM bars
UNION ALL SELECT 'articles', count(*), CAST(min(CAST(post_time AS DATE)) AS VARCHAR), CAST(max(CAST(post_time AS DATE)) AS VARCHAR) FROM articles WHERE source IN ('forum', 'board', 'media') AND sentiment_score IS NOT NULL
UNION ALL SELECT 'entities', count(*), min(keyword), max(keyword) FROM entity_map UNION ALL SELECT 'themes', count(*), min(theme_keyword), max(theme_keyword) FROM theme_map
UNION ALL SELECT 'comments', count(*), CAST(min(CAST(comment_time AS DATE)) AS VARCHAR), CAST(max(CAST(comment_time AS DATE)) AS VARCHAR) FROM c""")
def feature_scans(v: Views) -> DataFrame:
    found = scans.feature_tables(v.bars, v.articles, v.entity_map, v.theme_map, v.comments, ALLOWED, WITH_DIRECTION)
    by = {"prices": "trade_date", "articles": "post_time", "entities": "keyword", "themes": "theme_keyword", "comments": "comment_time"}
    text = lambda k: F.to_date(by[k]).cast("string") if "time" in by[k] else F.col(by[k]).cast("string")
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n"), F.min(text(k)).alias("least"), F.max(text(k)).alias("most")) for k, df in found.items()])


@query("M07_stamped_quotes", "SELECT stock_id, trade_date, CASE WHEN volume % 5 = 0 THEN round(close_price * 1.5, 4) ELSE close_price END AS close_price, CASE WHEN volume % 5 = 0 THEN 'yfinance_auto_adjusted' ELSE 'twse_mi_index' END AS source FROM bars WHERE volume % 5 = 0 OR volume % 2 = 0")
def stamped_quotes(v: Views) -> DataFrame:
    """A provider's adjusted closes over part of a price table; its rows without a close change nothing."""
    t = partitioned.Table(v.spark, new_path(v.spark, "prices"), PRICES, ["stock_id", "trade_date"], "year")
    b = v.bars.select("stock_id", "trade_date", "close_price", "volume", F.year("trade_date").alias("year"))
    t.merge(b.where("volume % 2 = 0").withColumn("source", F.lit("twse_mi_index")), "old")
    scans.quote_pipeline(t, b.withColumn("close_price", F.when(F.col("volume") % 5 == 0, F.round(F.col("close_price") * 1.5, 4))), "yfinance_auto_adjusted", "quotes")
    return t.read().select("stock_id", "trade_date", "close_price", "source")


_SQL_SEARCH = """, f AS (SELECT fetch_keyword AS keyword, CASE WHEN sentiment_score >= 0.3 THEN 'u' || (article_id // 3) END AS url, post_time FROM articles WHERE CAST(substr(fetch_keyword, 3) AS INTEGER) % 7 <> 3),
n AS (SELECT * FROM f WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY post_time, keyword) = 1),
k AS (SELECT DISTINCT 'u' || (article_id // 3) AS url FROM articles WHERE article_id % 6 = 0)
"""


def _search(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keywords whose number leaves 3 when divided by 7 failed; low scores stand for searches that found nothing."""
    n = F.substring("fetch_keyword", 3, 9).cast("int")
    url = F.concat(F.lit("u"), F.floor(F.col("article_id") / 3).cast("string"))
    a = v.articles
    found = a.where(n % 7 != 3).select(F.col("fetch_keyword").alias("keyword"), F.when(F.col("sentiment_score") >= 0.3, url).alias("url"), "post_time")
    return scans.search_pipeline(found, a.where("article_id % 6 = 0").select(url.alias("url")), a.where(n % 7 == 3).select(F.col("fetch_keyword").alias("keyword")))


@query("M07_search_articles", _SQL_SEARCH + "SELECT keyword, url, post_time FROM n WHERE url NOT IN (SELECT url FROM k)")
def search_articles(v: Views) -> DataFrame:
    return _search(v)[0].select("keyword", "url", "post_time")


@query("M07_search_outcomes", _SQL_SEARCH + "SELECT keyword, CASE WHEN bool_or(url IS NOT NULL) THEN 'OK' ELSE 'NO_DATA' END AS outcome FROM f GROUP BY 1 UNION ALL SELECT DISTINCT fetch_keyword, 'FETCH_FAILED' FROM articles WHERE CAST(substr(fetch_keyword, 3) AS INTEGER) % 7 = 3")
def search_outcomes(v: Views) -> DataFrame:
    return _search(v)[2]


@query("M25_verified_insert", """, s AS (SELECT count(*) FILTER (article_id % 3 <> 0) AS old, count(*) FILTER (article_id % 3 = 0) AS new FROM articles)
SELECT 'inserted' AS "check", new AS expected, new AS found, TRUE AS ok FROM s UNION ALL SELECT 'old rows changed', 0, 0, TRUE FROM s UNION ALL SELECT 'new rows missing', 0, 0, TRUE FROM s UNION ALL SELECT 'total', old + new, old + new, TRUE FROM s""")
def verified_insert(v: Views) -> DataFrame:
    t = partitioned.Table(v.spark, new_path(v.spark, "articles"), ARTICLES, ["article_id"], "source")
    a = v.articles.select("article_id", "push_count", "boo_count", "source")
    t.merge(a.where("article_id % 3 <> 0"), "base")
    return scans.verified_insert(t, a.where("article_id % 3 = 0"), "new")


@query("M16_timeout_share", "SELECT event_id, round(p * p / (p * p + 2 * abs(p - 0.5) + (1 - p)), 8) AS share FROM preds")
def timeout_share(v: Views) -> DataFrame:
    p = F.col("p")
    share = scans.timeout_share({-1: 2 * F.abs(p - 0.5), 0: p * p, 1: 1 - p}, "target_triple_barrier", guards.TARGETS)
    return v.preds.select("event_id", F.round(share, 8).alias("share"))


@query("M16_figures_apart", ", c AS (SELECT model, avg((p - y) ** 2) AS brier, count(*) FILTER ((p >= 0.5) = (y = 1)) / count(*) AS accuracy FROM preds GROUP BY 1) SELECT model, 'brier' AS figure, round(brier, 8) AS rebuilt, round(brier + 0.001, 8) AS reference FROM c WHERE model IN ('m1', 'm3') UNION ALL SELECT model, 'accuracy', round(accuracy, 8), round(accuracy - 0.001, 8) FROM c WHERE model = 'm2'")
def figures_apart(v: Views) -> DataFrame:
    """A reference that differs in one figure of two models and in another of a third."""
    now = metrics.classification(v.preds, ["model"]).select("model", "brier", "accuracy")
    m = F.col("model")
    then = now.withColumn("brier", F.when(m.isin("m1", "m3"), F.col("brier") + 0.001).otherwise(F.col("brier") + 1e-12)).withColumn("accuracy", F.when(m == "m2", F.col("accuracy") - 0.001).otherwise(F.col("accuracy")))
    return scans.figures_apart(now, then, "model").withColumns({c: F.round(c, 8) for c in ("rebuilt", "reference")})


@query("M37_panel_violations", "SELECT 'column label_end_date' AS rule, CAST(1 AS BIGINT) AS found UNION ALL SELECT 'purge mode ' || CASE WHEN fold = 4 THEN 'approximate' ELSE 'NULL' END, count(*) FROM preds WHERE fold IN (4, 5) GROUP BY 1 UNION ALL SELECT 'doubled keys', count(*) FROM (SELECT model, d FROM preds GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0")
def panel_violations(v: Views) -> DataFrame:
    p = v.preds.withColumn("purge_mode", F.when(F.col("fold") < 4, "exact").when(F.col("fold") == 4, "approximate"))
    return scans.panel_violations(p, ["model", "d", "label_end_date"], ["model", "d"], "purge_mode")


@query("M40_write_permission", "SELECT event_id, refused = '' AS allowed, refused FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 <> 0 THEN 'write_flag' END, CASE WHEN event_id % 3 = 0 THEN 'whole_input' END, CASE WHEN fold = 5 THEN 'holdout_unused' END) AS refused FROM preds)")
def write_permission(v: Views) -> DataFrame:
    """A request may be written if its flag is set, its input was not capped and its holdout not used before."""
    e = F.col("event_id")
    asked = v.preds.select("event_id", F.when(e % 3 == 0, 100).alias("max_rows"), (e % 2 == 0).alias("flag"), F.when(F.col("fold") != 5, False).alias("used"))
    return scans.write_permission(asked, {"write_flag": F.col("flag"), "whole_input": F.col("max_rows").isNull(), "holdout_unused": ~F.col("used")}).select("event_id", "allowed", "refused")


@query("H07_cutoffs", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 9 * 3600 + 5 * 60 WHEN 1 THEN 15 * 3600 + 30 * 60 + 15 WHEN 2 THEN 86399 ELSE 55800 END AS seconds, CAST(CAST(ts AS DATE) + CASE WHEN extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) + extract(microsecond FROM ts) % 1000000 / 1e6 > CASE event_id % 7 WHEN 0 THEN 32700 WHEN 1 THEN 55815 WHEN 2 THEN 86399 ELSE 55800 END THEN 1 ELSE 0 END AS DATE) AS effective_date FROM events")
def cutoffs(v: Views) -> DataFrame:
    """Cutoffs as people write them, and what nobody can read; each event's day by its own cutoff."""
    k = F.col("event_id") % 7
    text = F.when(k == 0, " 9:05").when(k == 1, "15:30:15").when(k == 2, "23:59:59").when(k == 3, "noon").when(k == 4, "24:00").when(k == 5, "12:60")
    df = v.table("events").select("event_id", "ts", scans.cutoff(text).alias("seconds"))
    now = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")
    return df.select("event_id", "seconds", F.date_add(F.to_date("ts"), (now > F.col("seconds")).cast("int")).alias("effective_date"))
