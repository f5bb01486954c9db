"""Scores of titles: a first score, a cache for the undecided, answers of an outside scorer checked before they count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW, HIGH = 0.4, 0.6


def cached(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached scores of distinct titles; the job fails at one outside 0 to 1."""
    s = F.col("sentiment_score")
    bad = s.isNull() | F.isnan(s) | (s < 0) | (s > 1)
    ok = F.when(bad, F.raise_error(F.concat(F.lit("cached score out of range: "), F.coalesce(s.cast("string"), F.lit("NULL"))))).otherwise(s)
    return cache.join(titles.select("title").distinct(), "title", "left_semi").select("title", ok.alias("sentiment_score"))


def answers(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """responses(batch, json) to (batch, id, score); the job fails unless a response has just the expected ids, each once, finite from 0 to 1.

    expected(batch, id) of strings. Doubled keys show as more keys in the text than in the map.
    """
    want = expected.groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("_want"))
    m = F.from_json("json", "map<string,double>")
    keys = F.regexp_extract_all("json", F.lit(r'"([^"]*)"\s*:'), F.lit(1))
    df = responses.join(want, "batch").withColumn("_m", m).withColumn("_k", keys)
    odd = F.exists(F.map_values("_m"), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    why = F.when(F.col("_m").isNull(), "not an object").when(F.size("_k") != F.size(F.array_distinct("_k")), "doubled ids").when(F.array_sort(F.array_distinct("_k")) != F.col("_want"), "other ids than asked for").when(odd, "a score out of range")
    checked = F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.col("_m"))
    return df.select("batch", F.explode(checked).alias("id", "score"))


def hybrid(rows: DataFrame, first: Column, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with sentiment_score, new cache rows). Undecided first scores are replaced by the cache, then by `scorer`.

    scorer: distinct titles (title) -> (title, sentiment_score), called for those that the cache does not hold.
    """
    scored = rows.withColumn("_first", first)
    unsure = F.col("_first").between(LOW, HIGH)
    titles = scored.where(unsure).select("title").distinct()
    held = cached(titles, cache)
    new = scorer(titles.join(held, "title", "left_anti")).select("title", "sentiment_score")
    known = held.unionByName(new).withColumnRenamed("sentiment_score", "_better")
    out = scored.join(known, "title", "left").withColumn("sentiment_score", F.when(unsure, F.coalesce("_better", "_first")).otherwise(F.col("_first")))
    return out.drop("_first", "_better"), new


def themes(responses: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """responses(batch, json) to (batch, keyword) and (batch, theme, stock_id, name, weight): the first `most` trends with their stocks, or a plain list of keywords."""
    stock = "struct<stock_id:string,name:string,weight:double>"
    df = responses.withColumn("_r", F.from_json("json", f"struct<trends:array<struct<theme:string,stocks:array<{stock}>>>,keywords:array<string>>"))
    t = df.where(F.col("_r.trends").isNotNull()).select("batch", F.posexplode(F.slice("_r.trends", 1, most)).alias("pos", "t")).withColumn("theme", F.trim("t.theme")).where(F.col("theme") != "")
    w = Window.partitionBy("batch", "theme").orderBy("pos")
    t = t.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    plain = df.where(F.col("_r.trends").isNull()).select("batch", F.explode(F.slice(F.array_distinct(F.transform("_r.keywords", F.trim)), 1, most)).alias("keyword"))
    rows = t.select("batch", "theme", F.inline("t.stocks")).withColumn("stock_id", F.trim("stock_id")).where(F.col("stock_id") != "")
    return t.select("batch", F.col("theme").alias("keyword")).unionByName(plain), rows.select("batch", "theme", "stock_id", F.coalesce(F.trim("name"), "stock_id").alias("name"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def artifact_mode(texts: DataFrame, required: list[str], row_keys: list[str]) -> DataFrame:
    """texts(path, json) with mode REAL, EMPTY (no text) or ERROR (no object, keys missing, or a leaderboard row without its keys)."""
    m, board = F.from_json("json", "map<string,string>"), F.from_json(F.get_json_object("json", "$.leaderboard"), "array<map<string,string>>")
    has = lambda c, names: F.array_contains(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.map_contains_key(c, n)), False)
    bad = m.isNull() | F.coalesce(has(m, required), F.lit(True)) | F.coalesce(F.size(board) < 1, F.lit(True)) | F.coalesce(F.exists(board, lambda r: has(r, row_keys)), F.lit(True))
    return texts.select("path", F.when(F.col("json").isNull(), "EMPTY").when(bad, "ERROR").otherwise("REAL").alias("mode"))
