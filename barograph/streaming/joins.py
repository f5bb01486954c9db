"""Comments meet their articles as both arrive, within a span after the post; what comes after the watermark is late.

Both sides carry a watermark. A comment waits for its article, and an article for its comments, only until the
watermark has passed every row it could meet, so the state holds the last span and delay, not the history. Rows that
come later than `delay` behind what the slower side has shown are left out of the join; they are not lost in
silence: `late` finds them among what arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, DELAY = "90 minutes", "1 day"


def _at(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time needs a zone; times without one count as the session's."""
    return df.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", delay)


def in_time(articles: DataFrame, comments: DataFrame, span: str = SPAN, delay: str = DELAY) -> DataFrame:
    """Streams articles(article_id, post_time) and comments(article_id, comment_seq, comment_tag, comment_time) ->
    article_id, comment_seq, comment_tag, comment_time of comments from the post to `span` after it, both in time."""
    a = _at(articles.select("article_id", "post_time"), "post_time", delay).withColumnsRenamed({"article_id": "_article", "_at": "_posted"})
    c = _at(comments, "comment_time", delay)
    near = (F.col("article_id") == F.col("_article")) & (F.col("_at") >= F.col("_posted")) & (F.col("_at") <= F.col("_posted") + F.expr(f"INTERVAL {span}"))
    return c.join(a, near).select("article_id", "comment_seq", "comment_tag", "comment_time")


def within(articles: DataFrame, comments: DataFrame, span: str = SPAN) -> DataFrame:
    """The same for stored tables: all comments of the span, however late they came."""
    a = articles.select("article_id", "post_time")
    return comments.join(a, "article_id").where((F.col("comment_time") >= F.col("post_time")) & (F.col("comment_time") <= F.col("post_time") + F.expr(f"INTERVAL {span}"))).select(comments.columns)


def late(articles: DataFrame, comments: DataFrame, taken: DataFrame, span: str = SPAN) -> DataFrame:
    """Of what arrived, comments within the span that the stream did not take."""
    return within(articles, comments, span).join(taken.select("article_id", "comment_seq"), ["article_id", "comment_seq"], "left_anti")


def counts(taken: DataFrame, missed: DataFrame) -> DataFrame:
    """article_id, push, boo, neutral of comments taken, and how many came too late."""
    rows = taken.select("article_id", "comment_tag", F.lit(0).alias("late")).unionByName(missed.select("article_id", "comment_tag", F.lit(1).alias("late")))
    tag = lambda t: F.count_if((F.col("late") == 0) & (F.col("comment_tag") == t))
    return rows.groupBy("article_id").agg(tag("推").alias("push"), tag("噓").alias("boo"), tag("→").alias("neutral"), F.sum("late").alias("late"))
