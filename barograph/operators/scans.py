"""Scans: parameterised SQL, the tables of a feature build, stamped pipelines, verified inserts and write permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import asof
from barograph.operators.partitioned import Table
from barograph.sources.shared import stored


def scan(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A SELECT over `{name}` frames with `:name` parameters, never pasted into the text; a scan without rows still has its columns."""
    return spark.sql(sql, args=args or {}, **frames)


def feature_tables(bars: DataFrame, articles: DataFrame, entity_map: DataFrame, theme_map: DataFrame, comments: DataFrame, allowed: list[str], with_direction: list[str]) -> dict[str, DataFrame]:
    """The five scans of a feature build, each with its own columns and filters, which reach the files:
    prices, scored articles of allowed sources, both maps, and the comments of articles whose source has directions."""
    scored = articles.where(F.col("source").isin(allowed) & F.col("sentiment_score").isNotNull())
    counted = articles.where(F.col("source").isin(with_direction)).select("article_id", "source", "fetch_keyword", "post_time")
    return {
        "prices": bars.select("stock_id", "trade_date", "open_price", "high_price", "low_price", "close_price", "volume"),
        "articles": scored.select("article_id", "source", "fetch_keyword", "post_time", "sentiment_score"),
        "entities": entity_map.select("keyword", "stock_id"),
        "themes": theme_map.select("theme_keyword", "stock_id", "relevance_weight"),
        "comments": comments.join(counted, "article_id").select("article_id", "fetch_keyword", "post_time", "comment_seq", "comment_tag", "comment_time"),
    }


def quote_pipeline(table: Table, quotes: DataFrame, source: str, token: str) -> dict[str, int]:
    """Cleaned quotes of one provider, stamped with `source`, put over what the price table has; quotes without a close are left out."""
    clean = quotes.where(F.col("close_price").isNotNull()).withColumn("source", F.lit(source))
    return table.merge(clean, token, order=[F.desc("close_price")])


def search_pipeline(found: DataFrame, known: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found(keyword, url, post_time) of all searches, known(url) and failed(keyword) ->

    new articles, the first of each url by post time and keyword, that are not known; urls whose comments are to be
    counted, once each; and (keyword, outcome) of all keywords: FETCH_FAILED is never taken for NO_DATA, which is a search that found nothing.
    `found` has a row without url for such a search.
    """
    hits = found.where(F.col("url").isNotNull())
    w = Window.partitionBy("url").orderBy("post_time", "keyword")
    first = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    new = first.join(known.select("url"), "url", "left_anti")
    some = found.groupBy("keyword").agg(F.max(F.col("url").isNotNull()).alias("_hit"))
    every = some.join(failed.select("keyword").distinct().withColumn("_failed", F.lit(True)), "keyword", "full_outer")
    outcome = F.when(F.col("_failed"), "FETCH_FAILED").when(F.col("_hit"), "OK").otherwise("NO_DATA")
    return new, hits.select("url").distinct(), every.select("keyword", outcome.alias("outcome"))


def verified_insert(table: Table, new: DataFrame, token: str) -> DataFrame:
    """Inserts and reads back: one row for each of four checks, with what was expected and what is there.

    inserted: as many as there are new keys; old: rows that were there and are not as they were; new: inserted rows that read back
    otherwise; total. Values are compared as text, NULL as NULL, so types and order of the sources do not matter.
    """
    as_text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    snapshot = stored(as_text(table.read()), "before")  # as the files it reads are replaced
    wanted = as_text(new.select(table.columns))
    n_before, n_new = snapshot.count(), wanted.count()
    got = table.merge(new, token, "insert")["inserted"]
    after = as_text(table.read())
    changed = snapshot.exceptAll(after).count()
    missing = wanted.exceptAll(after).count()
    rows = [("inserted", n_new, got), ("old rows changed", 0, changed), ("new rows missing", 0, missing), ("total", n_before + n_new, after.count())]
    return table.spark.createDataFrame(rows, "`check` string, expected long, found long").withColumn("ok", F.col("expected") == F.col("found"))


def timeout_share(calibrated: dict[int, Column], target: str, domains: dict[str, list[int]]) -> Column:
    """The calibrated probability of class 0 among the classes of an allowed target, normalised over all of them."""
    if target not in domains:
        raise ValueError(f"unknown target {target}")
    if set(calibrated) != set(domains[target]):
        raise ValueError(f"classes {sorted(calibrated)} for {domains[target]}")
    total = sum((calibrated[k] for k in domains[target]), F.lit(0.0))
    return F.when(total >= 1e-9, calibrated[0] / total)


def figures_apart(rebuilt: DataFrame, reference: DataFrame, by: str, tolerance: float = 1e-9) -> DataFrame:
    """By, figure, rebuilt, reference where a figure of the reference is not met within `tolerance`; further figures of the other side do not matter."""
    figures = [c for c in reference.columns if c != by]
    long = lambda df, name: df.select(by, *[F.col(c).cast("double").alias(c) for c in figures]).unpivot([by], figures, "figure", name)
    both = long(reference, "reference").join(long(rebuilt, "rebuilt"), [by, "figure"], "left")
    near = F.abs(F.col("rebuilt") - F.col("reference")) <= tolerance
    return both.where(~F.coalesce(near, F.col("rebuilt").isNull() & F.col("reference").isNull())).select(by, "figure", "rebuilt", "reference")


def panel_violations(panel: DataFrame, required: list[str], key: list[str], mode: str) -> DataFrame:
    """Rule, found: required columns that are not there, folds purged in another way than exactly, and keys that do not tell rows apart."""
    spark = panel.sparkSession
    absent = [(f"column {c}", 1) for c in required if c not in panel.columns]
    out = spark.createDataFrame(absent, "rule string, found long")
    if mode in panel.columns:
        odd = panel.where(~F.coalesce(F.col(mode) == "exact", F.lit(False))).groupBy(F.concat(F.lit("purge mode "), F.coalesce(mode, F.lit("NULL"))).alias("rule")).agg(F.count(F.lit(1)).alias("found"))
        out = out.unionByName(odd)
    if not [c for c in key if c not in panel.columns]:
        twice = panel.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("found")).where("found > 0")
        out = out.unionByName(twice.select(F.lit("doubled keys").alias("rule"), "found"))
    return out


def write_permission(requests: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Requests with `allowed`, and `refused`: the names of the conditions that do not hold; NULL does not hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()]))
    return requests.withColumn("refused", F.array_join(failed, ",")).withColumn("allowed", F.col("refused") == "")


def cutoff(text: Column) -> Column:
    """Seconds of a HH:MM or HH:MM:SS cutoff, 15:30 where it is NULL or can't be read."""
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$", i)
    h, m, s = (F.when(part(i) != "", part(i).cast("int")) for i in (1, 2, 3))
    fine = (h < 24) & (m < 60) & (F.coalesce(s, F.lit(0)) < 60)
    limit = asof.CUTOFF
    return F.when(fine, h * 3600 + m * 60 + F.coalesce(s, F.lit(0))).otherwise(F.lit(limit.hour * 3600 + limit.minute * 60 + limit.second))
