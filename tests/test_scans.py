"""Scans, pipelines, permissions, substring hits and the kept bars."""

from __future__ import annotations

import shutil
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from barograph.operators import partitioned, scans, substrings, training
from barograph.queries import ORACLES, QUERIES
from barograph.sources.fixtures import SQL_VIEWS, Views


def test_parameters_are_values_not_text(spark):
    df = spark.createDataFrame([("a", 1), ("b' OR 'x' = 'x", 2)], "s string, n int")
    find = lambda s: scans.scan(spark, "SELECT n FROM {t} WHERE s = :s", {"s": s}, t=df)
    assert [r["n"] for r in find("b' OR 'x' = 'x").collect()] == [2]
    none = find("c")
    assert none.columns == ["n"] and none.collect() == []


def test_search_outcomes_and_new_articles(spark):
    found = spark.createDataFrame([("k1", "u1", datetime(2024, 1, 2)), ("k2", "u1", datetime(2024, 1, 1)), ("k2", "u2", datetime(2024, 1, 1)), ("k3", None, None), ("k4", "u3", datetime(2024, 1, 1))], "keyword string, url string, post_time timestamp_ntz")
    known, failed = spark.createDataFrame([("u2",)], "url string"), spark.createDataFrame([("k4",), ("k5",)], "keyword string")
    new, urls, outcomes = scans.search_pipeline(found, known, failed)
    assert sorted((r["url"], r["keyword"]) for r in new.collect()) == [("u1", "k2"), ("u3", "k4")]
    assert sorted(r["url"] for r in urls.collect()) == ["u1", "u2", "u3"]
    assert dict(map(tuple, outcomes.collect())) == {"k1": "OK", "k2": "OK", "k3": "NO_DATA", "k4": "FETCH_FAILED", "k5": "FETCH_FAILED"}


def test_a_verified_insert_sees_what_was_not_written(spark, tmp_path):
    t = partitioned.Table(spark, str(tmp_path / "t"), "k long, d date, a long", ["k", "d"], "d")
    t.merge(spark.createDataFrame([(1, date(2024, 1, 1), 1)], "k long, d date, a long"), "base")
    fine = scans.verified_insert(t, spark.createDataFrame([(2, date(2024, 1, 1), None)], "k long, d date, a long"), "one")
    assert fine.where("NOT ok").isEmpty()
    clash = scans.verified_insert(t, spark.createDataFrame([(2, date(2024, 1, 1), 5), (3, date(2024, 1, 2), 3)], "k long, d date, a long"), "two")
    assert {r["check"]: (r["expected"], r["found"]) for r in clash.where("NOT ok").collect()} == {"inserted": (2, 1), "new rows missing": (0, 1), "total": (4, 3)}


def test_permissions_cutoffs_and_classes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, flag boolean")
    got = {r["id"]: (r["allowed"], r["refused"]) for r in scans.write_permission(df, {"flag": F.col("flag"), "odd": F.col("id") % 2 == 1}).collect()}
    assert got == {1: (True, ""), 2: (False, "flag,odd"), 3: (False, "flag")}
    texts = ["9:05", "09:05:30", "24:00", "12:61", "12:00:99", "", None, "noon", " 23:59 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scans.cutoff(F.col("t"))).collect()
    assert [r[0] for r in rows] == [32700, 32730, 55800, 55800, 55800, 55800, 55800, 55800, 86340]
    with pytest.raises(ValueError, match="unknown target"):
        scans.timeout_share({0: F.lit(1.0)}, "other", {"t": [0]})
    with pytest.raises(ValueError, match="classes"):
        scans.timeout_share({0: F.lit(1.0)}, "t", {"t": [0, 1]})


def test_words_in_texts_by_their_rarest_gram(spark):
    texts = ["the cat sat", "a cat", "the dogs", "", None, "catalogue", "xx yy"]
    words = ["cat", "the", "dog", "a", "at", "nothing", "catalogues", "", None, "xx yy", "t s"]
    got = substrings.hits(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert sorted((r["id"], r["w"]) for r in got) == sorted((i, w) for i, t in enumerate(texts) for w in words if t and w and w in t)


def test_texts_are_searched_once_and_rows_joined_last(spark, tmp_path):
    """Copies of a title are one text to search; rows that repeat stay, and titles without a name hold no keyword."""
    texts = spark.createDataFrame([("red ring",)] * 50 + [("ring",)] * 50 + [(None,)], "t string")
    words = spark.createDataFrame([("ring",), ("red",)], "w string")
    assert sorted(map(tuple, substrings.words_in(texts, "t", words, "w").collect())) == [("red ring", "red"), ("red ring", "ring"), ("ring", "ring")]
    rows = [(1, "red ring", "LARGE"), (1, "red ring", "LARGE"), (2, "Red bolt", "SMALL"), (3, None, "LARGE"), (4, "small ring", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, QUERIES["C16_keyword_hits"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        assert got == sorted(con.execute("WITH base AS (SELECT 1)" + ORACLES["C16_keyword_hits"].removeprefix(SQL_VIEWS)).fetchall())
    assert got.count((1, "red")) == 2


def test_a_boundary_holds_even_if_no_column_is_read(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 1, 2))], "s string, d date")
    with pytest.raises(Exception, match="at or after the boundary: 2024-01-02"):
        training.rejecting(df, "d", "2024-01-02").select("s").collect()


def test_bars_are_made_anew_when_their_files_change(spark, tmp_path):
    for name in ("lineitem", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    v = Views(spark, str(tmp_path))
    first = v.bars
    assert v.bars is first and first.count() > 0
    part = spark.read.parquet(str(tmp_path / "part.parquet")).where("p_brand <> 'Brand#1'").toPandas()
    part.to_parquet(tmp_path / "part.parquet")
    assert v.bars is not first and v.bars.where("stock_id = 'Brand#1'").isEmpty()
