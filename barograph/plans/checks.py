"""Queries of comment features, feature and label checks, coverage and small joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import asof, checks, comments, indicators, merges
from barograph.plans.prices import SQL_TB, W
from barograph.plans.registry import query
from barograph.plans.sentiments import SQL_ART, _art
from barograph.plans.training import SQL_FEAT, feat
from barograph.sources.fixtures import ALLOWED, WITH_DIRECTION, Views

KEYS = ["stock_id", "trade_date"]

SQL_COMMENTED = """, hit AS (SELECT a.article_id, m.stock_id, CAST(a.post_time AS DATE) + 1 AS trade_date, a.source, CASE WHEN a.article_id % 10 <> 0 THEN (SELECT count(*) FROM comments c WHERE c.article_id = a.article_id) + CASE WHEN a.article_id % 17 = 0 THEN 1 ELSE 0 END END AS total_comments,
    a.post_time, a.post_time + INTERVAL 200 MINUTE AS scraped_at, CAST(a.post_time AS DATE) + 1 + TIME '15:30:00' AS decision_point
  FROM articles a JOIN entity_map m ON a.fetch_keyword = m.keyword WHERE a.article_id <= 600),
prevs AS (SELECT article_id, comment_time, max(comment_time) OVER (PARTITION BY article_id ORDER BY comment_seq ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev FROM comments),
health AS (SELECT article_id, coalesce(bool_or(comment_time < prev), FALSE) AS suspect, count(*) AS n FROM prevs GROUP BY 1),
cnt AS (SELECT h.article_id, h.stock_id, count(*) FILTER (ok AND comment_tag = '推') AS p, count(*) FILTER (ok AND comment_tag = '噓') AS b, count(*) FILTER (ok) AS t
  FROM hit h LEFT JOIN (SELECT c.*, c.comment_time <= h.scraped_at AND c.comment_time >= date_trunc('minute', h.post_time) AND c.comment_time <= h.decision_point AS ok, h.stock_id FROM comments c JOIN hit h ON h.article_id = c.article_id) c ON c.article_id = h.article_id AND c.stock_id = h.stock_id WHERE h.total_comments IS NOT NULL GROUP BY 1, 2),
cd AS (SELECT h.stock_id, h.trade_date, sum(CASE WHEN good AND h.source IN ('forum', 'board') THEN p END) AS push_sum, sum(CASE WHEN good AND h.source IN ('forum', 'board') THEN b END) AS boo_sum, sum(CASE WHEN good THEN t END) AS total_sum
  FROM (SELECT h.*, NOT coalesce(suspect, FALSE) AND coalesce(n, 0) >= total_comments AS good FROM hit h LEFT JOIN health USING (article_id) WHERE total_comments IS NOT NULL) h JOIN cnt USING (article_id, stock_id) GROUP BY 1, 2)
"""


def comment_days(v: Views) -> DataFrame:
    """Articles up to number 600 with their comments: every tenth was not read, every seventeenth lost a comment."""
    a = v.articles.where("article_id <= 600").join(v.entity_map, F.col("fetch_keyword") == F.col("keyword"))
    n = v.comments.groupBy("article_id").agg(F.count(F.lit(1)).alias("_n"))
    a = a.join(n, "article_id", "left")
    day = F.date_add(F.to_date("post_time"), 1)
    total = F.when(F.col("article_id") % 10 != 0, F.coalesce("_n", F.lit(0)) + F.when(F.col("article_id") % 17 == 0, 1).otherwise(0))
    hits = a.select("article_id", "stock_id", day.alias("trade_date"), "source", total.alias("total_comments"), "post_time", (F.col("post_time") + F.expr("INTERVAL '200' MINUTE")).alias("scraped_at"), (day.cast("timestamp_ntz") + F.expr("INTERVAL '930' MINUTE")).alias("decision_point"))
    return comments.comment_daily(hits, v.comments, WITH_DIRECTION)


@query("D07_D08_M13_comment_daily", SQL_COMMENTED + "SELECT stock_id, CAST(trade_date AS DATE) AS trade_date, CAST(push_sum AS BIGINT) AS push_sum, CAST(boo_sum AS BIGINT) AS boo_sum, CAST(total_sum AS BIGINT) AS total_sum FROM cd")
def comment_daily(v: Views) -> DataFrame:
    return comment_days(v)


@query("E10_E11_comment_features", SQL_COMMENTED + f", r AS (SELECT *, total_sum / (avg(total_sum) OVER {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) + 1) AS ratio, (push_sum - boo_sum) / (push_sum + boo_sum + 1) AS r FROM cd) SELECT stock_id, CAST(trade_date AS DATE) AS trade_date, round(ratio, 8) AS comment_volume_ratio, round(1 - r * r, 8) AS comment_polarization, round(r - lag(r) OVER {W}), 8) + 0.0 AS net_push_momentum FROM r")
def comment_features(v: Views) -> DataFrame:
    f = comments.comment_features(comment_days(v))
    return f.select(*KEYS, *[(F.round(c, 8) + (0.0 if c == "net_push_momentum" else 0)).alias(c) for c in ("comment_volume_ratio", "comment_polarization", "net_push_momentum")])


@query("M06_backfill", """, a AS (SELECT article_id, post_time, post_time + INTERVAL 100 MINUTE AS scraped_at FROM articles), bad AS (SELECT DISTINCT article_id FROM comments JOIN a USING (article_id) WHERE comment_time > scraped_at OR comment_time < date_trunc('minute', post_time))
SELECT article_id, comment_seq, comment_tag, comment_time FROM comments WHERE article_id % 3 <> 0 AND article_id NOT IN (SELECT article_id FROM bad)""")
def backfill(v: Views) -> DataFrame:
    c = v.comments
    a = v.articles.select("article_id", "post_time", (F.col("post_time") + F.expr("INTERVAL '100' MINUTE")).alias("scraped_at"))
    return comments.backfill(c.unionByName(c), a, c.where("article_id % 3 = 0"))


@query("M02_uncounted_articles", "SELECT DISTINCT article_id FROM articles JOIN comments USING (article_id) WHERE push_count IS NULL")
def uncounted(v: Views) -> DataFrame:
    return v.articles.where("push_count IS NULL").join(v.comments, "article_id", "left_semi").select("article_id")


def features(v: Views) -> DataFrame:
    t = indicators.targets(indicators.technical(v.bars))
    return t.select(*KEYS, "close_price", "volume", "return_1d", "target_return", "volatility_5d", (F.col("volume") % 4).alias("article_count"), F.when(F.col("volume") % 4 != 0, 0.5).alias("sentiment"), F.when(F.col("volume") % 4 != 0, "SUCCESS").otherwise("SUCCESS_EMPTY").alias("source_status"))


@query("M17_price_consistency", "SELECT stock_id, trade_date FROM bars WHERE volume % 101 = 0 OR volume % 103 = 0")
def price_consistency(v: Views) -> DataFrame:
    f = features(v).withColumns({"close_price": F.when(F.col("volume") % 103 == 0, F.col("close_price") + 1).otherwise(F.col("close_price")), "volume": F.when(F.col("volume") % 101 == 0, F.col("volume") + 1).otherwise(F.col("volume"))})
    return checks.price_violations(f, v.bars)


@query("M18_derivations", f", t AS (SELECT *, lead(close_price) OVER {W}) AS nc FROM bars) SELECT stock_id, trade_date, 'return_1d' AS \"check\" FROM t WHERE volume % 101 = 0 UNION ALL SELECT stock_id, trade_date, 'target_return' FROM t WHERE volume % 107 = 0 AND nc IS NOT NULL UNION ALL SELECT stock_id, trade_date, 'volatility_5d' FROM t WHERE volume % 109 = 0")
def derivations(v: Views) -> DataFrame:
    f = features(v).withColumns({c: F.when(F.col("volume") % m == 0, F.col(c) + 1).otherwise(F.col(c)) for c, m in (("return_1d", 101), ("target_return", 107), ("volatility_5d", 109))})
    return checks.derivation_violations(f)


@query("M19_I24_invariants", "SELECT stock_id, trade_date, 'source_status_enum' AS \"check\" FROM bars WHERE volume % 31 = 0 UNION ALL SELECT stock_id, trade_date, 'source_failed_not_null' FROM bars WHERE volume % 31 <> 0 AND volume % 41 = 0 UNION ALL SELECT stock_id, trade_date, 'sentiment_null_iff_article_zero' FROM bars WHERE volume % 31 <> 0 AND volume % 41 <> 0 AND volume % 4 <> 0 AND volume % 37 = 0")
def invariants(v: Views) -> DataFrame:
    n = F.col("volume")
    status = F.when(n % 31 == 0, "LATE").when(n % 41 == 0, "SOURCE_FAILED").otherwise(F.col("source_status"))
    f = features(v).withColumns({"source_status": status, "sentiment": F.when(n % 37 != 0, F.col("sentiment"))})
    return checks.invariants(f, v.bars)


@query("D18_label_reconciliation", SQL_TB + """SELECT (SELECT count(DISTINCT stock_id) FROM bars) AS n_stocks, count(*) AS rows, count(triple_barrier) AS labelled, count(*) FILTER (label_reason = 'no_entry') AS no_entry, (SELECT count(DISTINCT stock_id) FROM bars) AS expected_no_entry,
  count(*) FILTER (label_reason = 'insufficient_data') AS insufficient_data, 4 * (SELECT count(DISTINCT stock_id) FROM bars) AS expected_insufficient_tail, count(*) FILTER (label_reason = 'insufficient_data') - 4 * (SELECT count(DISTINCT stock_id) FROM bars) AS insufficient_within_window, count(*) FILTER (label_reason = 'ambiguous_dual_barrier') AS ambiguous_dual_barrier FROM labels3""")
def reconciliation(v: Views) -> DataFrame:
    return checks.label_reconciliation(v.bars, indicators.triple_barrier(v.bars))


@query("M27_label_xor", "SELECT stock_id, trade_date FROM bars WHERE volume % 41 = 0")
def label_xor(v: Views) -> DataFrame:
    df = indicators.triple_barrier(v.bars).withColumn("label_reason", F.when(F.col("volume") % 41 != 0, F.col("label_reason")).when(F.col("label_reason").isNull(), "both"))
    return checks.label_xor_violations(df)


@query("D24_null_ratios", SQL_FEAT + "SELECT stock_id, round(avg(CAST(sentiment IS NULL AS INTEGER)), 8) AS null_ratio FROM feat GROUP BY 1 ORDER BY null_ratio DESC, stock_id LIMIT 5")
def null_ratios(v: Views) -> DataFrame:
    return checks.null_ratios(feat(v), "sentiment")


@query("M22_total_counts", SQL_FEAT + "SELECT count(*) AS rows, count(sentiment) AS sentiment, count(target) AS target FROM feat")
def total_counts(v: Views) -> DataFrame:
    return checks.total_counts(feat(v), ["sentiment", "target"])


@query("M20_M24_write_checks", "SELECT stock_id, count(*) FILTER (volume % 2 = 0) AS before, count(*) FILTER (volume % 2 = 1) AS added, count(*) FILTER (volume % 50 <> 0) AS after FROM bars GROUP BY 1 HAVING count(*) <> count(*) FILTER (volume % 50 <> 0)")
def write_checks(v: Views) -> DataFrame:
    b = v.bars
    return checks.write_checks(b.where("volume % 2 = 0"), b.where("volume % 2 = 1"), b.where("volume % 50 <> 0"), "stock_id")


@query("M23_insert_preview", ", x AS (SELECT stock_id, trade_date, CASE WHEN volume % 29 <> 0 THEN close_price END AS c FROM bars) SELECT stock_id, count(*) AS rows, count(*) FILTER (c IS NULL) AS null_prices, min(c) AS least, arg_min(trade_date, row(c, trade_date)) FILTER (c IS NOT NULL) AS least_day, max(c) AS greatest, arg_max(trade_date, row(c, -epoch(trade_date))) FILTER (c IS NOT NULL) AS greatest_day FROM x GROUP BY 1")
def insert_preview(v: Views) -> DataFrame:
    b = v.bars.withColumn("close_price", F.when(F.col("volume") % 29 != 0, F.col("close_price")))
    known = checks.insert_preview(b.where("close_price IS NOT NULL")).drop("rows", "null_prices")
    return checks.insert_preview(b).select("stock_id", "rows", "null_prices").join(known, "stock_id")


@query("M21_foreign_rows", "SELECT stock_id, trade_date FROM bars WHERE stock_id NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def foreign_rows(v: Views) -> DataFrame:
    return checks.foreign_rows(v.bars.select(*KEYS), v.bars.where("stock_id IN ('Brand#1', 'Brand#2', 'Brand#3')"), "stock_id")


@query("G06_expected_new", "SELECT s.stock_id, d.trade_date FROM (SELECT DISTINCT stock_id FROM bars) s CROSS JOIN (SELECT DISTINCT trade_date FROM bars) d LEFT JOIN bars b ON b.stock_id = s.stock_id AND b.trade_date = d.trade_date WHERE b.volume IS NULL")
def expected_new(v: Views) -> DataFrame:
    return checks.expected_new(v.bars, v.bars, v.bars.select(*KEYS))


@query("G07_M26_M31_impact", "SELECT stock_id, trade_date, 'unexpected' AS side FROM bars WHERE volume % 6 = 0 AND volume % 4 <> 0 UNION ALL SELECT stock_id, trade_date, 'unchanged' FROM bars WHERE volume % 4 = 0 AND volume % 6 <> 0")
def impact(v: Views) -> DataFrame:
    b = v.bars.select(*KEYS, "close_price", "volume")
    return checks.impact(b, b.withColumn("close_price", F.when(F.col("volume") % 6 != 0, F.col("close_price"))), b.where("volume % 4 = 0"), KEYS, ["close_price"])


@query("M29_allowed_split", "SELECT stock_id, trade_date, stock_id IN ('Brand#1', 'Brand#2') AND trade_date >= DATE '1995-01-01' AS allowed FROM bars WHERE volume % 5 = 0")
def allowed_split(v: Views) -> DataFrame:
    b = v.bars.select(*KEYS, "volume")
    return checks.allowed_split(b.where("volume % 5 = 0").select(*KEYS), b.where("stock_id IN ('Brand#1', 'Brand#2')"), "1995-01-01")


@query("E26_M28_context", f", m AS (SELECT stock_id, trade_date, volume % 211 = 0 AS marked, max(volume % 211 = 0) OVER {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM bars) SELECT stock_id, trade_date, marked FROM m WHERE near")
def context(v: Views) -> DataFrame:
    return checks.context(v.bars.select(*KEYS, "volume"), F.col("volume") % 211 == 0).drop("volume")


@query("F09_sample_with_nulls", "SELECT count(*) + 20 AS n, count(*) AS nulls FROM bars WHERE volume % 29 = 0")
def sample_with_nulls(v: Views) -> DataFrame:
    """The draw is by Spark's own hash, so the sizes are compared."""
    b = v.bars.withColumn("close_price", F.when(F.col("volume") % 29 != 0, F.col("close_price")))
    return checks.sample_with_nulls(b, KEYS, "close_price", 20).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("close_price").isNull()).alias("nulls"))


@query("C22_max_difference", "SELECT 'close_price' AS \"column\", count(*) AS rows, 0.25::DOUBLE AS max_difference, count(*) FILTER (volume % 29 = 0) AS one_null FROM bars UNION ALL SELECT 'volume', count(*), 0.0, 0 FROM bars")
def max_difference(v: Views) -> DataFrame:
    b = v.bars.select(*KEYS, "close_price", F.col("volume").cast("double").alias("volume"))
    other = b.withColumn("close_price", F.when(F.col("volume") % 29 != 0, F.col("close_price") + 0.25))
    return checks.max_difference(b, other, KEYS, ["close_price", "volume"]).withColumn("max_difference", F.round("max_difference", 6))


@query("C18_collisions", "SELECT a.theme_keyword AS keyword, a.stock_id, b.stock_id AS other FROM theme_map a JOIN theme_map b ON a.theme_keyword = b.theme_keyword AND a.stock_id < b.stock_id")
def collisions(v: Views) -> DataFrame:
    return checks.collisions(v.theme_map.withColumnRenamed("theme_keyword", "keyword"))


@query("D21_routing_rows", ", nm AS (SELECT stock_id, 'n' || (volume % 3) AS name, trade_date FROM bars) SELECT stock_id, arg_max(name, trade_date) AS name, string_agg(DISTINCT name, ',' ORDER BY name) AS all_names FROM nm GROUP BY 1")
def routing_rows(v: Views) -> DataFrame:
    return checks.routing_rows(v.bars.select("stock_id", F.concat(F.lit("n"), (F.col("volume") % 3).cast("string")).alias("name"), "trade_date"))


@query("D22_E25_M34_coverage", f", h AS (SELECT stock_id, trade_date, CASE WHEN volume % 12 = 0 THEN 1 END AS h FROM bars), n AS (SELECT *, max(h) OVER {W} ROWS 4 PRECEDING) AS near FROM h) SELECT stock_id, count(*) AS days, count(h) AS hit_days, count(near) AS near_days FROM n GROUP BY 1")
def coverage(v: Views) -> DataFrame:
    b = v.bars.select(*KEYS, "volume")
    hits = b.where("volume % 12 = 0")
    return checks.coverage(b, hits.unionByName(hits))


@query("D23_dropped_causes", SQL_ART + """, h AS (SELECT CASE WHEN article_id % 50 = 0 THEN 'Brand#99' ELSE stock_id END AS stock_id, CAST(eff + CASE article_id % 7 WHEN 0 THEN 4000 WHEN 1 THEN -4000 ELSE 0 END AS DATE) AS eff FROM ent),
s AS (SELECT stock_id, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1)
SELECT CASE WHEN b IS NULL THEN 'not_in_panel' WHEN eff > (SELECT max(trade_date) FROM bars) THEN 'after_panel' WHEN eff > b THEN 'after_own_calendar' WHEN eff < a THEN 'before_own_calendar' ELSE 'mapped' END AS cause, count(*) AS n FROM h LEFT JOIN s USING (stock_id) GROUP BY 1""")
def dropped_causes(v: Views) -> DataFrame:
    k = F.col("article_id") % 7
    hits = _art(v).join(v.entity_map, F.col("fetch_keyword") == F.col("keyword")).select(F.when(F.col("article_id") % 50 == 0, "Brand#99").otherwise(F.col("stock_id")).alias("stock_id"), F.date_add("eff", F.when(k == 0, 4000).when(k == 1, -4000).otherwise(0)).alias("eff"))
    return checks.dropped_causes(hits, v.bars.select(*KEYS))


@query("G02_J06_M35_gaps", "SELECT DISTINCT d.trade_date, m.market FROM (SELECT DISTINCT trade_date FROM bars) d, (SELECT DISTINCT 'M' || CAST(substr(stock_id, 7) AS INTEGER) % 12 AS market FROM bars) m EXCEPT SELECT trade_date, 'M' || CAST(substr(stock_id, 7) AS INTEGER) % 12 FROM bars")
def gaps(v: Views) -> DataFrame:
    """Twelve markets of two or three stocks each."""
    b = v.bars.select("trade_date", F.concat(F.lit("M"), (F.substring("stock_id", 7, 9).cast("int") % 12).cast("string")).alias("market"))
    expected = b.select("trade_date").distinct().withColumn("market", F.explode(F.array(*[F.lit(f"M{i}") for i in range(12)])))
    return checks.gaps(expected, b, ["trade_date", "market"])


@query("D51_page_rate", ", e AS (SELECT article_id // 25 AS page_index, CAST(floor(epoch(post_time)) AS BIGINT) - CASE WHEN article_id % 25 = 7 THEN 8640000 ELSE 0 END AS t FROM articles), f AS (SELECT *, max(t) OVER (PARTITION BY page_index) AS m FROM e) SELECT page_index, count(*) AS n, min(t) AS oldest, max(t) AS newest FROM f WHERE t >= m - 604800 GROUP BY 1")
def page_rate(v: Views) -> DataFrame:
    at = F.unix_seconds(F.col("post_time").cast("timestamp")) - F.when(F.col("article_id") % 25 == 7, 8640000).otherwise(0)
    return checks.page_rate(v.articles.select(F.floor(F.col("article_id") / 25).alias("page_index"), at.alias("at")))


@query("C10_active_targets", "SELECT DISTINCT stock_id, fetch_keyword FROM articles JOIN entity_map ON fetch_keyword = keyword WHERE source = 'media'")
def active_targets(v: Views) -> DataFrame:
    return v.articles.where("source = 'media'").join(v.entity_map, F.col("fetch_keyword") == F.col("keyword")).select("stock_id", "fetch_keyword").distinct()


@query("C11_A18_article_comments", "SELECT article_id, comment_seq, source FROM comments JOIN articles USING (article_id) WHERE source IN ('forum', 'board', 'media') AND push_count IS NOT NULL")
def comments_of_articles(v: Views) -> DataFrame:
    return v.comments.join(v.articles.where(F.col("source").isin(ALLOWED) & F.col("push_count").isNotNull()), "article_id").select("article_id", "comment_seq", "source")


@query("A29_C13_C14_bulk_backfill", "SELECT stock_id, trade_date, close_price FROM bars WHERE stock_id IN (SELECT stock_id FROM entity_map WHERE keyword < 'kw3') AND volume % 3 = 0")
def bulk_backfill(v: Views) -> DataFrame:
    b = v.bars.select(*KEYS, "close_price", "volume")
    universe = v.entity_map.where("keyword < 'kw3'").select("stock_id").distinct()
    return b.join(universe, "stock_id", "left_semi").join(b.where("volume % 3 <> 0"), KEYS, "left_anti").drop("volume")


@query("C15_C23_not_routed", "SELECT stock_id, trade_date FROM bars WHERE stock_id NOT IN (SELECT stock_id FROM theme_map)")
def not_routed(v: Views) -> DataFrame:
    return v.bars.select(*KEYS).join(v.theme_map.select("stock_id").distinct(), "stock_id", "left_anti")


@query("C20_unscored_keys", ", un AS (SELECT article_id, fetch_keyword, CAST(CAST(post_time AS DATE) + CASE WHEN CAST(post_time AS TIME) > TIME '15:30:00' THEN 1 ELSE 0 END AS DATE) AS eff FROM articles WHERE sentiment_score IS NULL AND source IN ('forum', 'board', 'media')), mp AS (SELECT keyword AS k, stock_id FROM entity_map UNION SELECT theme_keyword, stock_id FROM theme_map), h AS (SELECT stock_id, eff FROM un JOIN mp ON fetch_keyword = k) SELECT DISTINCT h.stock_id, b.trade_date FROM h ASOF JOIN bars b ON h.stock_id = b.stock_id AND h.eff <= b.trade_date")
def unscored_keys(v: Views) -> DataFrame:
    maps = v.entity_map.select("keyword", "stock_id").union(v.theme_map.select("theme_keyword", "stock_id")).distinct()
    bare = v.articles.where(F.col("source").isin(ALLOWED) & F.col("sentiment_score").isNull()).withColumn("eff", asof.effective_date(F.col("post_time")))
    hits = bare.join(maps, F.col("fetch_keyword") == F.col("keyword")).select("stock_id", "eff").distinct()
    return asof.forward(hits, "eff", v.bars.select(*KEYS), ["stock_id"]).select(*KEYS).distinct()


@query("D13_last_batch", "SELECT max(batch_date) AS last_day FROM run_log WHERE outcome = 'OK'")
def last_batch(v: Views) -> DataFrame:
    return v.run_log.where("outcome = 'OK'").agg(F.to_date(F.max(F.date_format("batch_date", "yyyyMMdd")), "yyyyMMdd").alias("last_day"))


@query("M30_diff_by_keyword", "SELECT fetch_keyword, CAST(post_time AS DATE) AS day, count(*) AS n FROM articles WHERE fetch_keyword IN (SELECT keyword FROM entity_map WHERE stock_id IN ('Brand#1', 'Brand#7')) GROUP BY 1, 2")
def diff_by_keyword(v: Views) -> DataFrame:
    changed = v.entity_map.where("stock_id IN ('Brand#1', 'Brand#7')").select(F.col("keyword").alias("fetch_keyword"))
    return v.articles.join(changed, "fetch_keyword", "left_semi").groupBy("fetch_keyword", F.to_date("post_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("A25_keyword_lists", "SELECT keyword, stock_id, CAST(substr(keyword, 3) AS INTEGER) % 4 <> 0 AS is_active FROM entity_map WHERE CAST(substr(keyword, 3) AS INTEGER) % 7 <> 0")
def keyword_lists(v: Views) -> DataFrame:
    """Upsert, disable and delete, one after another."""
    n = F.substring("keyword", 3, 9).cast("int")
    old = v.entity_map.withColumn("is_active", F.lit(True))
    off = old.where(n % 4 == 0).withColumn("is_active", F.lit(False))
    return merges.update(old, off, ["keyword"], ["is_active"]).join(old.where(n % 7 == 0), "keyword", "left_anti")


@query("M01_M03_active_keywords", "SELECT keyword FROM entity_map WHERE CAST(substr(keyword, 3) AS INTEGER) % 4 <> 0 ORDER BY CAST(substr(keyword, 3) AS INTEGER) DESC LIMIT 10")
def active_keywords(v: Views) -> DataFrame:
    n = F.substring("keyword", 3, 9).cast("int")
    return v.entity_map.where(n % 4 != 0).orderBy(n.desc()).limit(10).select("keyword")


@query("M33_keyword_map_drift", "SELECT keyword, stock_id, CAST(substr(keyword, 3) AS INTEGER) > 30 AS drift FROM entity_map UNION SELECT theme_keyword, stock_id, CAST(substr(theme_keyword, 3) AS INTEGER) > 30 FROM theme_map")
def keyword_map_drift(v: Views) -> DataFrame:
    both = v.entity_map.select("keyword", "stock_id").union(v.theme_map.select("theme_keyword", "stock_id")).distinct()
    n = F.substring("keyword", 3, 9).cast("int")
    updated, freeze = F.date_add(F.lit("2024-01-01").cast("date"), n), F.lit("2024-01-31").cast("date")
    return both.select("keyword", "stock_id", (updated > freeze).alias("drift"))
