"""Queries of report payloads and forum pages, which are first written out from bars, articles and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import forum, reports
from barograph.plans.registry import query
from barograph.sources.fixtures import Views

TWSE_NAMES = ["證券代號 ", "證券名稱", "成交股數", "成交筆數", " 成交金額", "開盤價<br>(元)", "最高價", "最低價", "收盤價", "本益比", "最後揭示買價", "最後揭示買量"]
TPEX_NAMES = ["代號", "名稱", "成交股數  ", "成交筆數", " 成交金額(元)", "開盤 ", "最高 ", "最低", "收盤 ", "漲跌", "最後買價", "最後買量<br>(張數)"]
BASE, SINCE, BUDGET = "https://host", 1_700_000_000 - 60 * 700, 40

SQL_REPORT = """, rp AS (SELECT *, CAST(split_part(stock_id, '#', 2) AS INTEGER) AS n FROM bars),
rq AS (SELECT *, CASE WHEN n % 5 = 0 THEN '00' || lpad(CAST(n AS VARCHAR), 2, '0') ELSE CAST(1100 + n AS VARCHAR) END AS code, volume % 7 = 0 AS bare, n % 11 = 3 AND volume % 4 = 0 AS broken, n % 5 <> 0 AS common FROM rp)
"""
SQL_RECORDS = """SELECT trade_date, code AS stock_id, stock_id AS security_name, CASE WHEN NOT bare THEN open_price END AS open_price, CASE WHEN NOT bare THEN high_price END AS high_price, CASE WHEN NOT bare THEN low_price END AS low_price,
  CASE WHEN NOT bare THEN close_price END AS close_price, volume, CAST(floor(turnover) AS BIGINT) AS turnover_amount, CAST(n AS BIGINT) AS transactions, CASE WHEN NOT bare THEN low_price END AS best_bid_price, {bid_volume} AS best_bid_volume,
  CAST(NULL AS DOUBLE) AS best_ask_price, CAST(NULL AS BIGINT) AS best_ask_volume, {pe} AS pe_ratio, '{source}' AS source FROM rq WHERE common AND NOT broken"""


def payloads(v: Views, names: list[str]) -> DataFrame:
    """A report a day, its numbers as the exchanges write them, in one of three shapes beside a table of indices."""
    n = F.split("stock_id", "#")[1].cast("int")
    vol = F.col("volume")
    price = lambda c: F.when(vol % 7 == 0, "--").otherwise(F.col(c).cast("string"))
    code = F.when(n % 5 == 0, F.concat(F.lit("00"), F.lpad(n.cast("string"), 2, "0"))).otherwise((1100 + n).cast("string"))
    broken = (n % 11 == 3) & (vol % 4 == 0)
    row = F.array(
        F.concat(code, F.lit(" ")), F.col("stock_id"), F.when(broken, "n.a").otherwise(F.format_number(vol, 0)), n.cast("string"), F.concat(F.format_number(F.floor("turnover"), 0), F.lit("　")),
        price("open_price"), price("high_price"), price("low_price"), price("close_price"), F.when(vol % 3 == 0, "0.00").otherwise("12.5"), price("low_price"), F.translate((vol % 50).cast("string"), "0123456789", "０１２３４５６７８９"),
    )
    days = v.bars.groupBy("trade_date").agg(F.transform(F.sort_array(F.collect_list(F.struct("stock_id", row.alias("r")))), lambda x: x["r"]).alias("data"))
    fields, k = F.array(*[F.lit(x) for x in names]), F.dayofyear("trade_date") % 3
    other = F.struct(F.lit("大盤").alias("title"), F.array(F.lit("指數"), F.lit("收盤")).alias("fields"), F.array(F.array(F.lit("x"), F.lit("1"))).alias("data"))
    main = F.struct(F.lit("全部").alias("title"), fields.alias("fields"), F.col("data").alias("data"))
    text = F.when(k == 0, F.to_json(F.struct(F.array(other, main).alias("tables"), F.lit("OK").alias("stat")))).when(k == 1, F.to_json(F.struct(fields.alias("fields9"), F.col("data").alias("data9"), fields.alias("fields1")))).otherwise(F.to_json(F.struct(fields.alias("fields"), F.col("data").alias("aaData"))))
    return days.select("trade_date", text.alias("payload"))


@query("A04_A05_report_tables", ", d AS (SELECT trade_date, count(*) AS n FROM bars GROUP BY 1) SELECT trade_date, CASE dayofyear(trade_date) % 3 WHEN 0 THEN 'tables[1]' WHEN 1 THEN 'fields9' ELSE 'fields/aaData' END AS shape, n, CAST(8 AS INTEGER) AS close_at FROM d")
def report_tables(v: Views) -> DataFrame:
    found = reports.market_table(payloads(v, TWSE_NAMES), reports.TWSE_FIELDS)
    return found.select("trade_date", "shape", F.size("data").cast("long").alias("n"), reports.field_index(F.col("fields"), reports.TWSE_FIELDS["close"]).alias("close_at"))


@query("A06_twse_report", SQL_REPORT + SQL_RECORDS.format(pe="CASE WHEN volume % 3 <> 0 THEN 12.5::DOUBLE END", bid_volume="volume % 50", source="twse"))
def twse_report(v: Views) -> DataFrame:
    return reports.records(reports.parse_report(payloads(v, TWSE_NAMES), reports.TWSE_FIELDS, "twse"))


@query("A07_M10_tpex_report", SQL_REPORT + SQL_RECORDS.format(pe="CAST(NULL AS DOUBLE)", bid_volume="CAST(NULL AS BIGINT)", source="tpex"))
def tpex_report(v: Views) -> DataFrame:
    return reports.records(reports.parse_report(payloads(v, TPEX_NAMES), reports.TPEX_FIELDS, "tpex"))


@query("A06_report_stats", SQL_REPORT + "SELECT trade_date, count(*) AS rows_total, count(*) FILTER (common) AS rows_common_stock, count(*) FILTER (NOT common) AS rows_excluded_by_code_shape, count(*) FILTER (common AND broken) AS rows_unparseable, count(*) FILTER (common AND NOT broken AND bare) AS rows_without_prices, count(*) FILTER (common AND NOT broken AND volume = 0) AS rows_zero_volume, count(*) FILTER (common AND NOT broken AND bare AND volume = 0) AS rows_no_trade_at_all FROM rq GROUP BY 1")
def report_stats(v: Views) -> DataFrame:
    return reports.report_stats(reports.parse_report(payloads(v, TWSE_NAMES), reports.TWSE_FIELDS, "twse"))


@query("A08_B01_month_scan", "SELECT stock_id, trade_date, open_price, high_price, CASE WHEN volume % 7 <> 0 THEN low_price END AS low_price, close_price, volume FROM bars")
def month_scan(v: Views) -> DataFrame:
    d = F.col("trade_date")
    text = v.bars.select("stock_id", F.concat_ws("/", (F.year(d) - 1911).cast("string"), F.date_format(d, "MM"), F.date_format(d, "dd")).alias("date"), *[F.col(f"{c}_price").cast("string").alias(c) for c in ("open", "high", "close")], F.when(F.col("volume") % 7 == 0, "--").otherwise(F.col("low_price").cast("string")).alias("low"), F.format_number("volume", 0).alias("capacity"))
    return reports.month_scan(text)


SQL_ENTRIES = f""", en AS (SELECT article_id // 25 AS page_index, article_id % 25 AS pos, '{BASE}/bbs/Stock/M.' || (1700000000 - 60 * article_id) || '.A.' || article_id || '.html' AS url, 1700000000 - 60 * article_id AS epoch, '[標的] ' || fetch_keyword || ' <R&D>' AS title,
  CASE article_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '爆' ELSE CAST(article_id % 60 AS VARCHAR) END AS push_count, 'u' || article_id AS author, strftime(post_time, '%m/%d') AS date, article_id % 9 <> 0 AS live FROM articles),
np AS (SELECT page_index, max(epoch) FILTER (live) AS newest FROM en GROUP BY 1),
sc AS (SELECT page_index FROM np WHERE page_index < {BUDGET} AND page_index <= coalesce((SELECT min(page_index) FROM np WHERE newest <= {SINCE}), 1000000000))
"""


def board(v: Views) -> DataFrame:
    """Pages of 25 entries each; every ninth article has been deleted and has no link."""
    i = F.col("article_id")
    link = F.concat(F.lit('<a href="/bbs/Stock/M.'), (1700000000 - 60 * i).cast("string"), F.lit(".A."), i.cast("string"), F.lit('.html">[標的] '), "fetch_keyword", F.lit(" &lt;R&amp;D&gt;</a>"))
    mark = F.when(i % 6 == 0, "").when(i % 6 == 1, '<span class="hl f1">爆</span>').otherwise((i % 60).cast("string"))
    entry = F.concat(F.lit(forum.ENTRY + '\n<div class="nrec">'), mark, F.lit('</div>\n<div class="title">\n'), F.when(i % 9 == 0, "(已被刪除)").otherwise(link), F.lit('\n</div><div class="meta"><div class="author">'), F.concat(F.lit("u"), i.cast("string")), F.lit('</div><div class="date"> '), F.date_format("post_time", "MM/dd"), F.lit("</div></div></div>"))
    rows = v.articles.groupBy(F.floor(i / 25).alias("page_index")).agg(F.sort_array(F.collect_list(F.struct((i % 25).alias("p"), i.alias("i"), entry.alias("e")))).alias("r"))
    return rows.select("page_index", F.concat(F.lit("<html><body>"), F.array_join(F.transform("r", lambda x: x["e"]), "\n"), F.lit("</body></html>")).alias("html"))


@query("A13_board_titles", SQL_ENTRIES + "SELECT page_index, url, title, date, author, push_count FROM en WHERE live")
def board_titles(v: Views) -> DataFrame:
    return forum.all_titles(board(v), BASE).drop("pos")


@query("A11_keyword_search", SQL_ENTRIES + "SELECT 'search' AS source, 'kw' AS fetch_keyword, date, title, push_count, author, url FROM en WHERE live AND page_index < 12")
def keyword_search(v: Views) -> DataFrame:
    """The thirteenth page fails: what came before it stays."""
    pages = board(v).withColumn("html", F.when(F.col("page_index") != 12, F.col("html")))
    return forum.keyword_search(pages, "kw", BASE)


@query("A12_J05_board_hits", SQL_ENTRIES + "SELECT 'board' AS source, keyword AS fetch_keyword, date, title, push_count, author, url FROM en JOIN sc USING (page_index) JOIN entity_map ON contains(title, keyword) WHERE live")
def board_hits(v: Views) -> DataFrame:
    return forum.board_hits(board(v), v.entity_map, BASE, SINCE, BUDGET)


@query("A12_J09_board_outcome", SQL_ENTRIES + f"SELECT (SELECT count(*) FROM sc) AS pages, (SELECT count(*) FROM en JOIN sc USING (page_index) JOIN entity_map ON contains(title, keyword) WHERE live) AS rows, CASE WHEN (SELECT min(newest) FROM np JOIN sc USING (page_index)) > {SINCE} AND (SELECT count(*) FROM sc) >= {BUDGET} THEN 'SOURCE_DEGRADED' ELSE 'OK' END AS outcome")
def board_outcome(v: Views) -> DataFrame:
    pages = board(v)
    return forum.board_outcome(forum.scanned_pages(pages, BASE, SINCE, BUDGET), forum.board_hits(pages, v.entity_map, BASE, SINCE, BUDGET), SINCE, BUDGET)


@query("H23_hot_titles", SQL_ENTRIES + "SELECT url, title FROM en WHERE live AND (push_count = '爆' OR try_cast(push_count AS INTEGER) >= 20) AND title NOT LIKE '%kw7 %'")
def hot_titles(v: Views) -> DataFrame:
    rows = forum.all_titles(board(v), BASE).withColumn("title", F.when(F.contains("title", F.lit("kw7 ")), F.concat(F.lit("[公告] "), "title")).otherwise(F.col("title")))
    return forum.hot_titles(rows).select("url", "title")


@query("B02_forum_rows", SQL_ENTRIES + "SELECT url, CASE WHEN push_count = '爆' THEN 100 ELSE CAST(push_count AS INTEGER) END AS engagement, CAST(to_timestamp(epoch + 28800) AT TIME ZONE 'UTC' AS TIMESTAMP) AS post_time, 'ptt_Stock_M.' || epoch || '.A.' || regexp_extract(url, '([0-9]+)[.]html', 1) AS provider_article_id, CAST(NULL AS DOUBLE) AS sentiment_score FROM en WHERE live")
def forum_rows(v: Views) -> DataFrame:
    return forum.clean_rows(forum.all_titles(board(v), BASE)).select("url", "engagement", "post_time", "provider_article_id", "sentiment_score")


def article_pages(v: Views) -> DataFrame:
    """The pages of commented articles; every fourth has a comment with an unknown tag, every fifth shows no time."""
    c = v.comments
    div = F.concat(F.lit(forum.COMMENT + '<span class="f1 hl push-tag">'), F.when((F.col("article_id") % 4 == 0) & (F.col("comment_seq") == 1), "？").otherwise(F.col("comment_tag")), F.lit(' </span><span class="push-ipdatetime"> '), F.date_format("comment_time", "MM/dd HH:mm"), F.lit("\n</span></div>"))
    each = c.groupBy("article_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("comment_seq", div.alias("d")))), lambda x: x["d"]), "").alias("d"))
    head = F.when(F.col("article_id") % 5 == 0, "").otherwise(F.concat(F.lit('<span class="article-meta-tag">時間</span><span class="article-meta-value">Mon '), F.col("article_id").cast("string"), F.lit("</span>")))
    return each.select(F.col("article_id").cast("string").alias("url"), F.concat(head, "d").alias("html"))


SQL_SAID = ", sd AS (SELECT article_id, comment_seq, comment_tag, comment_time FROM comments WHERE NOT (article_id % 4 = 0 AND comment_seq = 1)) "


@query("A14_article_page", SQL_SAID + ", al AS (SELECT DISTINCT article_id FROM comments) SELECT CAST(article_id AS VARCHAR) AS url, count(*) FILTER (comment_tag = '推') AS push_count, count(*) FILTER (comment_tag = '噓') AS boo_count, count(*) FILTER (comment_tag = '→') AS neutral_count, count(comment_tag) AS total_comments, count(*) FILTER (comment_tag = '推') - count(*) FILTER (comment_tag = '噓') AS engagement_metric, CASE WHEN article_id % 5 <> 0 THEN 'Mon ' || article_id END AS full_datetime FROM al LEFT JOIN sd USING (article_id) GROUP BY article_id")
def article_page(v: Views) -> DataFrame:
    return forum.article_page(article_pages(v))


@query("A14_article_comments", SQL_SAID + "SELECT CAST(article_id AS VARCHAR) AS url, CAST(row_number() OVER (PARTITION BY article_id ORDER BY comment_seq) AS INTEGER) AS comment_seq, comment_tag, strftime(comment_time, '%m/%d %H:%M') AS raw_time FROM sd")
def article_comments(v: Views) -> DataFrame:
    return forum.article_comments(article_pages(v))
