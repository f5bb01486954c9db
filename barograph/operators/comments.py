"""Comment timelines: resets, years of bare dates, bounds, and counts as of any moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUSH, BOO, NEUTRAL = "推", "噓", "→"


def time_resets(comments: DataFrame) -> DataFrame:
    """Per article, whether any time falls before the last known one in sequence."""
    before = Window.partitionBy("article_id").orderBy("comment_seq").rowsBetween(Window.unboundedPreceding, -1)
    back = F.col("comment_time") < F.last("comment_time", ignorenulls=True).over(before)
    return comments.withColumn("_back", F.coalesce(back, F.lit(False))).groupBy("article_id").agg(F.bool_or("_back").alias("suspect"))


def infer_years(comments: DataFrame, post_year: Column, post_md: Column, full_year: str | None = None) -> DataFrame:
    """`md` (month * 100 + day, NULL unread) to a year: one more at each fall; read rows only.

    A stamp with its own year, in the column `full_year`, anchors anew: what follows counts from there.
    """
    by = Window.partitionBy("article_id").orderBy("comment_seq")
    own = F.col(full_year) if full_year else F.lit(None).cast("long")
    df = comments.withColumn("_own", own).withColumn("_seg", F.count("_own").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.coalesce(F.last("_own", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), post_year)
    prev = F.coalesce(F.last("md", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), post_md)
    fall = F.col("_own").isNull() & F.coalesce(F.col("md") < prev, F.lit(False))
    df = df.withColumn("_base", base).withColumn("_fall", fall.cast("int"))
    falls = F.sum("_fall").over(Window.partitionBy("article_id", "_seg").orderBy("comment_seq").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("year_inferred", F.when(F.col("md").isNotNull(), F.col("_base") + falls)).drop("_own", "_seg", "_base", "_fall")


def counts_as_of(comments: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoffs(article_id, cutoff) with push, boo and neutral counts of times up to the cutoff."""
    inside = F.col("comment_time") <= F.col("cutoff")
    count = lambda tag: F.count_if(F.coalesce(F.contains("comment_tag", F.lit(tag)) & inside, F.lit(False)))
    return cutoffs.join(comments, "article_id", "left").groupBy("article_id", "cutoff").agg(count(PUSH).alias("push"), count(BOO).alias("boo"), count(NEUTRAL).alias("neutral"))


def out_of_bounds(comments: DataFrame, articles: DataFrame) -> DataFrame:
    """Comments with a cause: unparsed, after_scrape or before_post (to the minute)."""
    df = comments.join(articles.select("article_id", "post_time", "scraped_at"), "article_id")
    t = F.col("comment_time")
    why = F.when(t.isNull(), "unparsed").when(t > F.col("scraped_at"), "after_scrape").when(t < F.date_trunc("minute", "post_time"), "before_post")
    return df.withColumn("cause", why).where(F.col("cause").isNotNull()).select("article_id", "comment_seq", "cause")


def push_ratio(push: Column, boo: Column) -> Column:
    """E11"""
    return (push - boo) / (push + boo + 1)


def comment_daily(hits: DataFrame, comments: DataFrame, directed: list[str]) -> DataFrame:
    """Comment sums by (stock_id, trade_date) from each row's own decision point.

    hits: (article_id, stock_id, trade_date, source, total_comments, post_time, scraped_at, decision_point), a row
    an article and stock. An article counts only once its comments were read (total_comments is not NULL). Its row
    is NULL where its times run back or fewer comments are there than were counted; comments out of bounds or
    after the decision point are left out; direction is NULL for a source that has none. A day whose rows are
    all NULL is NULL, never 0.
    """
    read = hits.where(F.col("total_comments").isNotNull())
    health = time_resets(comments).join(comments.groupBy("article_id").agg(F.count(F.lit(1)).alias("_rows")), "article_id")
    keys = ["article_id", "stock_id", "trade_date"]
    t = F.col("comment_time")
    usable = (t <= F.col("scraped_at")) & (t >= F.date_trunc("minute", "post_time")) & (t <= F.col("decision_point"))
    count = lambda tag: F.count_if(F.coalesce(usable & F.contains("comment_tag", F.lit(tag)), F.lit(False)))
    c = read.select(*keys, "post_time", "scraped_at", "decision_point").join(comments, "article_id", "left").groupBy(*keys).agg(count(PUSH).alias("_p"), count(BOO).alias("_b"), count(NEUTRAL).alias("_n"))
    rows = read.join(c, keys).join(health, "article_id", "left")
    bad = F.coalesce("suspect", F.lit(False)) | (F.coalesce("_rows", F.lit(0)) < F.col("total_comments"))
    way = F.col("source").isin(directed)
    return rows.groupBy("stock_id", "trade_date").agg(F.sum(F.when(~bad & way, F.col("_p"))).alias("push_sum"), F.sum(F.when(~bad & way, F.col("_b"))).alias("boo_sum"), F.sum(F.when(~bad, F.col("_p") + F.col("_b") + F.col("_n"))).alias("total_sum"))


def comment_features(daily: DataFrame) -> DataFrame:
    """Volume ratio to the five days before, polarization, and the push ratio's change; NULL wherever a part is."""
    w = Window.partitionBy("stock_id").orderBy("trade_date")
    before = F.avg("total_sum").over(w.rowsBetween(-5, -1))
    r = push_ratio(F.col("push_sum"), F.col("boo_sum"))
    return daily.withColumn("comment_volume_ratio", F.col("total_sum") / (before + 1)).withColumn("_r", r).withColumn("comment_polarization", 1 - F.col("_r") * F.col("_r")).withColumn("net_push_momentum", F.col("_r") - F.lag("_r").over(w)).drop("_r")


def backfill(comments: DataFrame, articles: DataFrame, done: DataFrame) -> DataFrame:
    """One row a (article_id, comment_seq) of articles not done yet; an article with any comment out of bounds is rejected whole."""
    w = Window.partitionBy("article_id", "comment_seq").orderBy(F.col("comment_time").asc_nulls_last())
    once = comments.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").join(done.select("article_id"), "article_id", "left_anti")
    return once.join(out_of_bounds(once, articles).select("article_id").distinct(), "article_id", "left_anti")
