"""Queries of text scores and their checks, times and calendars, artifacts, generators, scalers and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions import scalar
from barograph.operators import learners, textscores
from barograph.plans.prices import SQL_TB
from barograph.plans.registry import query
from barograph.sources.fixtures import Views
from barograph.streaming import jobs, joins, tails


def scratch(v: Views, name: str) -> str:
    """A new folder of the warehouse, which driver and executors share."""
    return f"{v.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_jobs/{name}-{uuid.uuid4().hex}"


@query("H05_forum_time", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 3 THEN make_timestamp(CASE WHEN month(CAST(ts AS DATE) + 40) <= 3 AND month(ts) >= 10 THEN year(CAST(ts AS DATE) + 40) - 1 ELSE year(CAST(ts AS DATE) + 40) END, month(ts), day(ts), 12, 0, 0) ELSE CAST(CAST(ts AS DATE) + 40 AS TIMESTAMP) END AS t FROM events WHERE NOT (month(ts) = 2 AND day(ts) = 29)""")
def forum_time(v: Views) -> DataFrame:
    """Stamps as pages write them, bare days, and what nobody can read; the reference is forty days later."""
    ts, k = F.col("ts"), F.col("event_id") % 6
    text = F.when(k == 0, F.date_format(ts, "EEE MMM d HH:mm:ss yyyy")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(ts, " yyyy/MM/dd")).when(k == 3, F.date_format(ts, "M/dd")).when(k == 4, "yesterday")
    ref = F.date_add(F.to_date(ts), 40).cast("timestamp_ntz")
    e = v.table("events").where(~((F.month(ts) == 2) & (F.dayofmonth(ts) == 29)))
    return e.select("event_id", scalar.forum_time(text, ref).alias("t"))


@query("H11_market", "SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'TWSE' ELSE 'TPEX' END AS market FROM supplier")
def market(v: Views) -> DataFrame:
    return v.table("supplier").select("s_suppkey", scalar.market_of(F.when(F.col("s_suppkey") % 2 == 0, "twse_mi_index").otherwise("tpex_daily_quotes")).alias("market"))


@query("H12_J06_weekdays_between", "SELECT o_orderkey, CAST(d AS DATE) AS day FROM (SELECT o_orderkey, unnest(range(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + 10, INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) < 6")
def weekdays_between(v: Views) -> DataFrame:
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", F.explode(scalar.weekdays_between(d, F.date_add(d, 9))).alias("day"))


@query("H13_M08_next_run", "SELECT event_id, CAST(CASE WHEN isodow(ts) < 6 AND CAST(ts AS TIME) < TIME '15:35:00' THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END END + TIME '15:35:00' AS TIMESTAMP) AS due FROM events".replace("CASE isodow(ts) WHEN", "CAST(CASE isodow(ts) WHEN").replace("ELSE 1 END END", "ELSE 1 END AS INTEGER) END"))
def next_run(v: Views) -> DataFrame:
    return v.table("events").select("event_id", scalar.next_run(F.col("ts")).alias("due"))


@query("M09_failure_kind", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'daily_quota' WHEN 1 THEN 'quota' WHEN 2 THEN 'retriable' WHEN 3 THEN 'refused' WHEN 4 THEN 'retriable' ELSE 'other' END AS kind FROM events")
def failure_kind(v: Views) -> DataFrame:
    said = F.get(F.array(*[F.lit(x) for x in ("quota GenerateRequestsPerDay", "Quota exceeded", "HTTP 503", "HTTP 429", "TLS handshake failed", "bad value")]), (F.col("event_id") % 6).cast("int"))
    return v.table("events").select("event_id", scalar.failure_kind(said).alias("kind"))


@query("H19_dates", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%m/%d %H:%M') AS minute FROM events")
def dates(v: Views) -> DataFrame:
    return v.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "MM/dd HH:mm").alias("minute")).distinct()


@query("A23_A24_cached_scores", "SELECT DISTINCT p_name AS title, p_size / 50.0::DOUBLE AS sentiment_score FROM part WHERE p_partkey % 3 = 0 AND p_name IN (SELECT p_name FROM part WHERE p_size > 10)")
def cached_scores(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_name").alias("title"), "p_size", "p_partkey")
    return textscores.cached(part.where("p_size > 10"), part.where("p_partkey % 3 = 0").select("title", (F.col("p_size") / 50).alias("sentiment_score"))).distinct()


@query("I25_A24_hybrid_scores", "SELECT p_partkey, CASE WHEN p_size / 50.0::DOUBLE NOT BETWEEN 0.4 AND 0.6 THEN p_size / 50.0::DOUBLE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0.75 END AS sentiment_score FROM part")
def hybrid_scores(v: Views) -> DataFrame:
    rows = v.table("part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), "p_size")
    cache = rows.where("p_partkey % 3 = 0").select("title", F.lit(0.25).alias("sentiment_score"))
    return textscores.hybrid(rows, F.col("p_size") / 50, cache, lambda t: t.withColumn("sentiment_score", F.lit(0.75)))[0].select("p_partkey", "sentiment_score")


@query("H21_answers", "SELECT p_size AS batch, 'p' || p_partkey AS id, round((p_partkey % 100) / 100.0::DOUBLE, 2) AS score FROM part")
def answers(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_size").alias("batch"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.round((F.col("p_partkey") % 100) / 100, 2).alias("score"))
    said = part.groupBy("batch").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "score")))).alias("json"))
    return textscores.answers(said, part)


@query("H22_themes", "SELECT n_nationkey AS batch, 'theme' || k AS theme, 's' || j AS stock_id, CASE WHEN j % 2 = 0 THEN 'name' || j ELSE 's' || j END AS name, CASE WHEN j % 3 = 0 THEN 1.0 ELSE j / 10.0 END::DOUBLE AS weight FROM nation, range(3) a(k), range(4) b(j) WHERE n_nationkey % 2 = 0")
def themes(v: Views) -> DataFrame:
    """Answers with four trends, of which three count; odd nations answer with plain keywords."""
    stocks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(F.concat(F.lit("s"), j.cast("string"), F.lit(" ")).alias("stock_id"), F.when(j % 2 == 0, F.concat(F.lit("name"), j.cast("string"))).alias("name"), F.when(j % 3 != 0, j / 10).alias("weight")))
    trends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.concat(F.lit(" theme"), k.cast("string")).alias("theme"), stocks.alias("stocks")))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(trends.alias("trends")))).otherwise('{"keywords": ["a", " b", "a"]}')
    return textscores.themes(v.table("nation").select(F.col("n_nationkey").alias("batch"), text.alias("json")), 3)[1]


@query("A30_artifact_mode", "SELECT 'n' || n_nationkey AS path, CASE n_nationkey % 5 WHEN 0 THEN 'REAL' WHEN 4 THEN 'EMPTY' ELSE 'ERROR' END AS mode FROM nation")
def artifact_mode(v: Views) -> DataFrame:
    texts = ['{"leaderboard": [{"model": "rf", "macro_f1": 0.5}], "champion": "rf"}', '{"leaderboard": [], "champion": "rf"}', "not json", '{"leaderboard": [{"model": "rf"}], "champion": "rf"}']
    text = F.get(F.array(*[F.lit(x) for x in texts]), (F.col("n_nationkey") % 5).cast("int"))
    return textscores.artifact_mode(v.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), text.alias("json")), ["leaderboard", "champion"], ["model", "macro_f1"])


@query("I13_ridge_probabilities", """, n AS (SELECT count(*) AS n, sum(p) AS sp, sum(p * p) AS pp, sum(2 * y - 1) AS t, sum(p * (2 * y - 1)) AS pt FROM preds), w AS (SELECT (t * (pp + 0.001) - pt * sp) / ((n + 0.001) * (pp + 0.001) - sp * sp) AS a, ((n + 0.001) * pt - sp * t) / ((n + 0.001) * (pp + 0.001) - sp * sp) AS b FROM n)
SELECT event_id, round(1 / (1 + exp(-(a + b * p))), 6) AS probability FROM preds, w""")
def ridge_probabilities(v: Views) -> DataFrame:
    w = learners.ridge_weights(v.preds, ["p"], "y")
    return learners.ridge_predict(v.preds, w).select("event_id", F.round("probability", 6).alias("probability"))


@query("I14_scaled", ", s AS (SELECT model, avg(vol) AS m, stddev_pop(vol) AS dv FROM preds WHERE fold < 3 GROUP BY 1) SELECT event_id, round((vol - m) / CASE WHEN dv = 0 THEN 1 ELSE dv END, 6) + 0.0 AS vol FROM preds JOIN s USING (model)")
def scaled(v: Views) -> DataFrame:
    p = v.preds.select("event_id", "model", "fold", "vol")
    return learners.scaled(p, p.where("fold < 3"), ["model"], ["vol"]).select("event_id", (F.round("vol", 6) + 0.0).alias("vol"))


@query("I14_scaled_robustly", ", s AS (SELECT median(vol) AS m, quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25) AS dv FROM preds WHERE fold < 3) SELECT event_id, round((vol - m) / CASE WHEN dv = 0 THEN 1 ELSE dv END, 6) + 0.0 AS vol FROM preds, s")
def scaled_robustly(v: Views) -> DataFrame:
    p = v.preds.select("event_id", "fold", "vol")
    return learners.scaled(p, p.where("fold < 3"), [], ["vol"], robust=True).select("event_id", (F.round("vol", 6) + 0.0).alias("vol"))


@query("A01_A03_panel_files", "SELECT stock_id, trade_date, close_price FROM bars WHERE close_price > 103")
def panel_files(v: Views) -> DataFrame:
    """Bars written as Parquet and read again with a filter that reaches the files."""
    path = scratch(v, "panel")
    v.bars.select("stock_id", "trade_date", "close_price").write.parquet(path)
    return v.spark.read.parquet(path).where("close_price > 103")


ARTICLES = "article_id long, source string, fetch_keyword string, post_time timestamp_ntz, sentiment_score double, push_count long, boo_count long, neutral_count long"


def _arriving(v: Views) -> str:
    folder = scratch(v, "arriving")
    v.articles.repartition(4).write.parquet(folder)
    return folder


@query("J02_J08_drain", "SELECT article_id, round(article_id % 100 / 100.0, 2)::DOUBLE AS sentiment_score FROM articles WHERE sentiment_score IS NULL")
def drain(v: Views) -> DataFrame:
    """Articles arrive as files; those without a score get one, once each."""
    done = jobs.drain(v.spark, _arriving(v), ARTICLES, F.round((F.col("article_id") % 100) / 100, 2), scratch(v, "scored"), scratch(v, "checkpoint"), ["article_id"])
    return done.select("article_id", "sentiment_score")


@query("J01_J03_decision_days", "SELECT a.article_id, b.stock_id, min(b.trade_date) AS trade_date FROM articles a JOIN entity_map ON fetch_keyword = keyword JOIN bars b ON b.stock_id = entity_map.stock_id AND b.trade_date >= CAST(CAST(post_time AS DATE) + CASE WHEN CAST(post_time AS TIME) > TIME '15:30:00' THEN 1 ELSE 0 END AS DATE) GROUP BY 1, 2")
def decision_days(v: Views) -> DataFrame:
    """The stream of articles meets each stock's calendar as it comes."""
    out = scratch(v, "decided")
    stream = jobs.files(v.spark, _arriving(v), ARTICLES).join(v.entity_map, F.col("fetch_keyword") == F.col("keyword")).select("article_id", "stock_id", "post_time")
    jobs.run(jobs.decided(stream, v.bars.select("stock_id", "trade_date")), jobs.append_once(out, ["article_id", "stock_id"]), scratch(v, "checkpoint"))
    return v.spark.read.schema("article_id long, stock_id string, trade_date date, batch long").option("basePath", out).parquet(out).select("article_id", "stock_id", "trade_date")


@query("J07_tail_state", SQL_TB + "SELECT * FROM labels3")
def tail_state(v: Views) -> DataFrame:
    """Bars come in three files, each met by a run of its own that restarts from the checkpoint; some come a file late."""
    folder, out, checkpoint = (scratch(v, n) for n in ("bars", "told", "checkpoint"))
    session = jobs.own_session(v.spark)
    b = v.bars.select("stock_id", "trade_date", "open_price", "high_price", "low_price", "volume")
    file = F.when(F.col("trade_date") < "1995-01-01", 0).when(F.col("trade_date") < "1997-01-01", 1).otherwise(2)
    held_back = (F.col("trade_date").between("1994-11-01", "1994-12-31") | F.col("trade_date").between("1996-11-01", "1996-12-31")) & (F.col("volume") % 4 == 0)
    b = b.withColumn("file", F.least(file + F.when(held_back, 1).otherwise(0), F.lit(2)))
    for k in range(3):
        b.where(F.col("file") == k).drop("file", "volume").coalesce(1).write.mode("append").parquet(folder)
        jobs.run(tails.told(jobs.files(session, folder, tails.BARS)), jobs.overwrite_batch(out), checkpoint, "update")
    told = jobs.written(v.spark, out, tails.TOLD)
    return tails.latest(told)


SQL_WAVES = """, aw AS (SELECT article_id, post_time, CASE WHEN day(post_time + INTERVAL 8500 DAY) <= 10 THEN 0 WHEN day(post_time + INTERVAL 8500 DAY) <= 20 THEN 1 ELSE 2 END AS w FROM articles),
cw AS (SELECT c.*, least(2, CASE WHEN day(comment_time + INTERVAL 8500 DAY) <= 10 THEN 0 WHEN day(comment_time + INTERVAL 8500 DAY) <= 20 THEN 1 ELSE 2 END + CASE WHEN (article_id * 31 + comment_seq) % 4 = 0 THEN 1 ELSE 0 END) AS w FROM comments c),
wm AS (SELECT k AS w, least((SELECT max(post_time) FROM aw WHERE aw.w < k), (SELECT max(comment_time) FROM cw WHERE cw.w < k)) - INTERVAL 1 DAY AS mark FROM range(3) r(k)),
met AS (SELECT cw.*, (x.mark IS NULL OR comment_time > x.mark) AND (y.mark IS NULL OR post_time > y.mark) AS taken FROM cw JOIN aw USING (article_id) JOIN wm x ON x.w = cw.w JOIN wm y ON y.w = aw.w WHERE comment_time BETWEEN post_time AND post_time + INTERVAL 90 MINUTE)
"""


@query("J04_comments_in_time", SQL_WAVES + "SELECT article_id, count(*) FILTER (taken AND comment_tag = '推') AS push, count(*) FILTER (taken AND comment_tag = '噓') AS boo, count(*) FILTER (taken AND comment_tag = '→') AS neutral, count(*) FILTER (NOT taken) AS late FROM met GROUP BY 1")
def comments_in_time(v: Views) -> DataFrame:
    """Articles and comments come in three waves by their day, a fourth of the comments a wave late; a run a wave."""
    posts, said, out, checkpoint = (scratch(v, n) for n in ("articles", "comments", "taken", "checkpoint"))
    session = jobs.own_session(v.spark)
    day = lambda c: F.dayofmonth(F.col(c) + F.expr("INTERVAL '8500' DAY"))
    wave = lambda c: F.when(day(c) <= 10, 0).when(day(c) <= 20, 1).otherwise(2)
    a = v.articles.select("article_id", "post_time").withColumn("w", wave("post_time"))
    c = v.comments.withColumn("w", F.least(wave("comment_time") + F.when((F.col("article_id") * 31 + F.col("comment_seq")) % 4 == 0, 1).otherwise(0), F.lit(2)))
    kinds = "article_id long, comment_seq long, comment_tag string, comment_time timestamp_ntz"
    for k in range(3):
        a.where(F.col("w") == k).drop("w").write.mode("append").parquet(posts)
        c.where(F.col("w") == k).drop("w").write.mode("append").parquet(said)
        jobs.run(joins.in_time(jobs.files(session, posts, "article_id long, post_time timestamp_ntz"), jobs.files(session, said, kinds)), jobs.overwrite_batch(out), checkpoint)
    taken = jobs.written(v.spark, out, kinds)
    return joins.counts(taken, joins.late(a, c.drop("w"), taken))
