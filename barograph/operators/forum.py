"""Forum pages: entries of board and search pages, page budgets and stops, comments of an article page.

Pages are rows (page_index from 0, html; null html is a page that could not be fetched). Markup is taken apart by
expressions; each page is on its own until the short list of pages is looked at in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.functions import scalar
from barograph.operators import substrings
from barograph.operators.comments import BOO, NEUTRAL, PUSH

#: The site's markup.
ENTRY, COMMENT = '<div class="r-ent">', '<div class="push">'
_TEXT = r"(?s)<{tag}[^>]*class=\"{name}\"[^>]*>(.*?)</{tag}>"
LOW_PUSH, QUIET_WORDS = 20, ["公告", "盤後"]


def plain(s: Column) -> Column:
    """Text of a piece of markup: tags and entities out, trimmed."""
    t = F.regexp_replace(s, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def _inside(s: Column, tag: str, name: str) -> Column:
    return plain(F.regexp_extract(s, _TEXT.format(tag=tag, name=name), 1))


def entries(pages: DataFrame, base_url: str) -> DataFrame:
    """page_index, pos, url, title, date, author, push_count of the entries that have a link."""
    parts = F.slice(F.split("html", ENTRY), 2, 1_000_000)
    each = pages.where(F.col("html").isNotNull()).select("page_index", F.posexplode(parts).alias("pos", "_e"))
    link = F.regexp_extract("_e", r'(?s)class="title">\s*<a[^>]*href="([^"]*)"', 1)
    pushes = _inside(F.col("_e"), "div", "nrec")
    out = each.withColumn("_l", link).where(F.col("_l") != "")
    return out.select(
        "page_index", "pos", F.concat(F.lit(base_url), "_l").alias("url"), _inside(F.col("_e"), "div", "title").alias("title"), _inside(F.col("_e"), "div", "date").alias("date"),
        _inside(F.col("_e"), "div", "author").alias("author"), F.when(pushes == "", "0").otherwise(pushes).alias("push_count"),
    )


def reachable(pages: DataFrame) -> DataFrame:
    """Pages before the first that failed; a failed first page raises."""
    w = Window.orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0)  # over (page_index, failed) of one scan's few pages
    marks = pages.select("page_index", F.max(F.col("html").isNull()).over(w).alias("_failed"))
    first = F.col("_failed") & (F.col("page_index") == 0)
    ok = marks.withColumn("_failed", F.when(first, F.raise_error(F.lit("source is unreachable"))).otherwise(F.col("_failed"))).where(~F.col("_failed"))
    return pages.join(ok.select("page_index"), "page_index", "left_semi")


def keyword_search(pages: DataFrame, keyword: str, base_url: str, source: str = "search") -> DataFrame:
    """Entries of a keyword's search pages, as many as could be read."""
    return entries(reachable(pages), base_url).select(F.lit(source).alias("source"), F.lit(keyword).alias("fetch_keyword"), "date", "title", "push_count", "author", "url")


def scanned_pages(pages: DataFrame, base_url: str, since: int | None, budget: int) -> DataFrame:
    """The pages that a board scan reads, newest first: up to the first whose newest entry is not after `since`, one that failed, or the budget; with newest and reached."""
    newest = entries(pages, base_url).groupBy("page_index").agg(F.max(scalar.url_epoch(F.col("url"))).alias("newest"))
    marks = pages.select("page_index", F.col("html").isNull().alias("failed")).join(newest, "page_index", "left")
    old = F.coalesce(F.col("newest") <= F.lit(since), F.lit(False)) if since is not None else F.lit(False)
    before = Window.orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("reached", old).withColumn("_stop", F.coalesce(F.max(F.col("reached") | F.col("failed")).over(before), F.lit(False)))
    return marks.where(~F.col("_stop") & (F.col("page_index") < budget)).drop("_stop")


def board_outcome(scanned: DataFrame, hits: DataFrame, since: int | None, budget: int) -> DataFrame:
    """One row: pages, rows and outcome OK, NO_DATA or SOURCE_DEGRADED."""
    s = scanned.agg(F.count_if(~F.col("failed")).alias("pages"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("_failed"), F.coalesce(F.bool_or("reached"), F.lit(False)).alias("_reached"))
    n = hits.agg(F.count(F.lit(1)).alias("rows"))
    spent = F.lit(since is not None) & ~F.col("_reached") & (F.col("pages") >= budget)
    return s.join(F.broadcast(n)).select("pages", "rows", F.when(F.col("_failed") | spent, "SOURCE_DEGRADED").when(F.col("rows") == 0, "NO_DATA").otherwise("OK").alias("outcome"))  # one row beside one


def board_hits(pages: DataFrame, keywords: DataFrame, base_url: str, since: int | None, budget: int, source: str = "board") -> DataFrame:
    """Entries of the scanned pages by each keyword that their title holds, once a (url, keyword).

    keywords(keyword) is the tracked list. Titles and keywords meet by the keyword's rarest gram, an equality, before
    the substring test.
    """
    read = entries(pages.join(scanned_pages(pages, base_url, since, budget).where(~F.col("failed")).select("page_index"), "page_index", "left_semi"), base_url)
    hits = substrings.hits(read, "title", keywords.select("keyword"), "keyword")
    w = Window.partitionBy("url", "keyword").orderBy("page_index", "pos")
    first = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select(F.lit(source).alias("source"), F.col("keyword").alias("fetch_keyword"), "date", "title", "push_count", "author", "url")


def all_titles(pages: DataFrame, base_url: str) -> DataFrame:
    """Every entry once by url, where it is seen first."""
    w = Window.partitionBy("url").orderBy("page_index", "pos")
    return entries(pages, base_url).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def article_comments(articles: DataFrame) -> DataFrame:
    """articles(url, html) -> url, comment_seq, comment_tag, raw_time: comments with a known tag, numbered in order."""
    parts = F.slice(F.split("html", COMMENT), 2, 1_000_000)
    each = articles.select("url", F.transform(parts, lambda p: F.struct(_inside(p, "span", r"[^\"]*push-tag").alias("tag"), _inside(p, "span", r"push-ipdatetime").alias("raw_time"))).alias("c"))
    known = F.filter("c", lambda c: F.contains(c["tag"], F.lit(PUSH)) | F.contains(c["tag"], F.lit(BOO)) | F.contains(c["tag"], F.lit(NEUTRAL)))
    rows = each.select("url", F.posexplode(known).alias("i", "c"))
    return rows.select("url", (F.col("i") + 1).alias("comment_seq"), F.col("c.tag").alias("comment_tag"), "c.raw_time")


def article_page(articles: DataFrame) -> DataFrame:
    """Url, push_count, boo_count, neutral_count, total_comments, engagement_metric, full_datetime (null if not shown)."""
    c = article_comments(articles).groupBy("url").agg(*[F.count_if(F.contains("comment_tag", F.lit(t))).alias(n) for t, n in ((PUSH, "push_count"), (BOO, "boo_count"), (NEUTRAL, "neutral_count"))])
    shown = plain(F.regexp_extract("html", r'(?s)article-meta-tag">\s*時間\s*</span>\s*<span[^>]*article-meta-value[^>]*>(.*?)</span>', 1))
    out = articles.select("url", F.nullif(shown, F.lit("")).alias("full_datetime")).join(c, "url", "left").fillna(0, ["push_count", "boo_count", "neutral_count"])
    total = F.col("push_count") + F.col("boo_count") + F.col("neutral_count")
    return out.select("url", "push_count", "boo_count", "neutral_count", total.alias("total_comments"), (F.col("push_count") - F.col("boo_count")).alias("engagement_metric"), "full_datetime")


def clean_rows(rows: DataFrame) -> DataFrame:
    """Forum rows with engagement, post time and provider id; the score is still unknown."""
    return rows.select("*", scalar.push_count(F.col("push_count")).alias("engagement"), scalar.post_time(F.col("url")).alias("post_time"), scalar.provider_article_id(F.col("url")).alias("provider_article_id"), F.lit(None).cast("double").alias("sentiment_score"))


def hot_titles(rows: DataFrame) -> DataFrame:
    """Titles with many pushes that are no notices."""
    quiet = [~F.contains("title", F.lit(w)) for w in QUIET_WORDS]
    keep = scalar.push_count(F.col("push_count")) >= LOW_PUSH
    for q in quiet:
        keep = keep & q
    return rows.where(keep)
