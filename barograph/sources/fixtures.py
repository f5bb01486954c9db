"""The driver's tables as market bars, articles, comments, run logs and predictions.

Each view is given twice: as a DataFrame, and as SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Articles are dated back by so many days, so that they fall within the calendars of the bars.
SHIFT_DAYS = 8500
SOURCES = {"click": "forum", "view": "board", "signup": "media", "purchase": "wire"}
ALLOWED = ["forum", "board", "media"]
WITH_DIRECTION = ["forum", "board"]

SQL_VIEWS = """WITH RECURSIVE bars AS MATERIALIZED (
  SELECT p_brand AS stock_id, CAST(l_shipdate AS DATE) AS trade_date,
    arg_min(tick, k) AS open_price, max(tick) AS high_price, min(tick) AS low_price, arg_max(tick, k) AS close_price,
    CAST(sum(l_quantity) AS BIGINT) AS volume, round(sum(l_extendedprice), 2) AS turnover
  FROM (SELECT *, round(100 + 40 * (l_discount + l_tax), 2) AS tick, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2),
articles AS (
  SELECT event_id AS article_id, source, 'kw' || (user_id % 40) AS fetch_keyword, ts - INTERVAL 8500 DAY AS post_time,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(least(value / 100, 1.0), 4) END AS sentiment_score,
    CASE WHEN source IN ('forum', 'board') THEN event_id % 7 END AS push_count, CASE WHEN source IN ('forum', 'board') THEN event_id % 3 END AS boo_count,
    CASE WHEN source IN ('forum', 'board') THEN event_id % 5 END AS neutral_count
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'forum' WHEN 'view' THEN 'board' WHEN 'signup' THEN 'media' WHEN 'purchase' THEN 'wire' ELSE 'other' END AS source FROM events)),
entity_map AS (SELECT 'kw' || n AS keyword, 'Brand#' || (n % 25 + 1) AS stock_id FROM (SELECT DISTINCT p_size % 40 AS n FROM part)),
theme_map AS (SELECT 'kw' || n AS theme_keyword, 'Brand#' || ((n * 7 + 3 * j) % 25 + 1) AS stock_id, (8 + n % 3) / 10.0::DOUBLE AS relevance_weight FROM (SELECT DISTINCT p_size % 40 AS n FROM part), range(2) q(j) WHERE n % 2 = 0),
comments AS (
  SELECT article_id, turn AS comment_seq, CASE WHEN turn % 3 = 2 OR role = 'system' THEN '噓' WHEN role = 'user' THEN '推' ELSE '→' END AS comment_tag,
    post_time + to_minutes(CAST(37 * turn - CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN 180 ELSE 0 END AS INTEGER)) AS comment_time
  FROM conversations JOIN articles ON conv_id = article_id),
run_log AS (
  SELECT 'kw' || (user_id % 40) AS item_key, CAST(ts - INTERVAL 8500 DAY AS DATE) AS batch_date, CASE max(event_id) % 10 WHEN 7 THEN 'NO_DATA' WHEN 0 THEN 'OK' ELSE 'FETCH_FAILED' END AS outcome
  FROM events GROUP BY 1, 2 HAVING max(event_id) % 10 <> 9),
preds AS (
  SELECT event_id, CAST(ts AS DATE) AS d, ts, 'm' || (user_id % 4) AS model, CAST(event_id % 6 AS INTEGER) AS fold, CASE WHEN event_id * 7919 % 100 < 30 THEN 1 ELSE 0 END AS y,
    (event_id * 7907 + user_id * 31) % 1000 / 1000.0::DOUBLE AS p, CAST(event_id * 7919 % 3 AS INTEGER) - 1 AS y3, CAST((event_id * 31 + user_id) % 3 AS INTEGER) - 1 AS h3,
    (event_id * 104729 % 2001 - 1000) / 50000.0::DOUBLE AS ret, value AS vol
  FROM events)
"""


#: Bars by (application, folder), with the listing of the files they were made of: the price table that every query on bars reads, kept
#: partitioned and sorted by stock.
_BARS: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


class Views:
    """Lazy frames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def bars(self) -> DataFrame:
        """Daily bars, persisted in memory and on disk: windows by stock over them need neither exchange nor sort."""
        key, listing = (self.spark.sparkContext.applicationId, self.sf_dir), self._listing("lineitem", "part")
        if key in _BARS and _BARS[key][0] != listing:  # the folder was written anew
            _BARS.pop(key)[1].unpersist()
        if key not in _BARS:
            _BARS[key] = listing, self.built_bars().repartition("stock_id").sortWithinPartitions("stock_id", "trade_date").persist()
        return _BARS[key][1]

    def _listing(self, *names: str) -> tuple:
        """Path, size and time of every file of some tables, whatever the store."""
        found, conf = [], self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            files = path.getFileSystem(conf).listFiles(path, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(found))

    def built_bars(self) -> DataFrame:
        """Daily bars of each brand: its ships of a day are ticks; part is a dimension that Catalyst may broadcast by size."""
        tick = F.round(100 + 40 * (F.col("l_discount") + F.col("l_tax")), 2)
        key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        joined = self.table("lineitem").join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return (
            joined.withColumn("tick", tick)
            .groupBy(F.col("p_brand").alias("stock_id"), F.to_date("l_shipdate").alias("trade_date"))
            .agg(
                F.min_by("tick", key).alias("open_price"), F.max("tick").alias("high_price"), F.min("tick").alias("low_price"), F.max_by("tick", key).alias("close_price"),
                F.sum("l_quantity").cast("long").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
            )
        )

    @property
    def articles(self) -> DataFrame:
        kind, source = F.col("event_type"), F.lit("other")
        for k, v in SOURCES.items():
            source = F.when(kind == k, v).otherwise(source)
        e = self.table("events").withColumn("source", source)
        counted = F.col("source").isin(WITH_DIRECTION)
        return e.select(
            F.col("event_id").alias("article_id"), "source", F.concat(F.lit("kw"), (F.col("user_id") % 40).cast("string")).alias("fetch_keyword"),
            (F.col("ts") - F.expr(f"INTERVAL '{SHIFT_DAYS}' DAY")).alias("post_time"),
            F.when(F.col("event_id") % 13 != 0, F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4)).alias("sentiment_score"),
            *[F.when(counted, F.col("event_id") % m).alias(c) for c, m in (("push_count", 7), ("boo_count", 3), ("neutral_count", 5))],
        )

    @property
    def entity_map(self) -> DataFrame:
        n = F.col("n")
        return self._keywords.select(F.concat(F.lit("kw"), n.cast("string")).alias("keyword"), F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")).alias("stock_id"))

    @property
    def _keywords(self) -> DataFrame:
        """n: the keywords' numbers, 40 at most."""
        return self.table("part").select((F.col("p_size") % 40).alias("n")).distinct()

    @property
    def theme_map(self) -> DataFrame:
        n = F.col("n")
        both = self._keywords.where(n % 2 == 0).select("n", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
        stock = F.concat(F.lit("Brand#"), ((n * 7 + 3 * F.col("j")) % 25 + 1).cast("string"))
        return both.select(F.concat(F.lit("kw"), n.cast("string")).alias("theme_keyword"), stock.alias("stock_id"), ((8 + n % 3) / 10).alias("relevance_weight"))

    @property
    def comments(self) -> DataFrame:
        turn = F.col("turn")
        tag = F.when((turn % 3 == 2) | (F.col("role") == "system"), "噓").when(F.col("role") == "user", "推").otherwise("→")
        minutes = 37 * turn - F.when((F.col("conv_id") % 11 == 0) & (turn == 2), 180).otherwise(0)
        joined = self.table("conversations").select("conv_id", "turn", "role").join(self.articles.select("article_id", "post_time"), F.col("conv_id") == F.col("article_id"))
        return joined.select("article_id", turn.alias("comment_seq"), tag.alias("comment_tag"), (F.col("post_time") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("comment_time"))

    @property
    def run_log(self) -> DataFrame:
        """One entry a keyword and day with events; its outcome goes by the last of them."""
        item, day = F.concat(F.lit("kw"), (F.col("user_id") % 40).cast("string")), F.to_date(F.col("ts") - F.expr(f"INTERVAL '{SHIFT_DAYS}' DAY"))
        last = self.table("events").groupBy(item.alias("item_key"), day.alias("batch_date")).agg((F.max("event_id") % 10).alias("code"))
        out = F.when(F.col("code") == 7, "NO_DATA").when(F.col("code") == 0, "OK").otherwise("FETCH_FAILED")
        return last.where("code <> 9").select("item_key", "batch_date", out.alias("outcome"))

    @property
    def preds(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        return self.table("events").select(
            e, F.to_date("ts").alias("d"), "ts", F.concat(F.lit("m"), (u % 4).cast("string")).alias("model"), (e % 6).cast("int").alias("fold"),
            F.when(e * 7919 % 100 < 30, 1).otherwise(0).alias("y"), ((e * 7907 + u * 31) % 1000 / 1000).alias("p"), ((e * 7919 % 3).cast("int") - 1).alias("y3"), (((e * 31 + u) % 3).cast("int") - 1).alias("h3"),
            ((e * 104729 % 2001 - 1000) / 50000).alias("ret"), F.col("value").alias("vol"),
        )
