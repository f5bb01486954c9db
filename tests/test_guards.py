"""What must raise, what must be empty, and hand values of parsers, caches and streaming jobs."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barograph.functions import scalar
from barograph.operators import checks, forum, learners, reports, runlog, stacking, textscores, training, universe
from barograph.streaming import jobs

D = date(2024, 1, 2)


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_cutoffs():
    assert [scalar.cutoff_seconds(x) for x in ("15:30", "09:05:07", "25:00", "x", None)] == [55800, 32707, 55800, 55800, 55800]


def test_numbers_in_full_width(spark):
    assert [one(spark, scalar.parse_number(F.lit(x))) for x in ("１２．５", "－３", "x", "1,0 0")] == [12.5, -3.0, None, 100.0]


def test_reports_without_a_table_say_what_they_hold(spark):
    rows = [(D, json.dumps({"tables": [{"title": "t", "fields": ["代號"], "data": [["1101"]]}], "stat": "OK"})), (D, "no json"), (D, None)]
    df = spark.createDataFrame(rows, "trade_date date, payload string")
    assert sorted(r["candidate_shapes"] for r in reports.unreadable(df, reports.TPEX_FIELDS).collect()) == [[], [], ["tables[0]"]]
    assert reports.parse_report(df, reports.TPEX_FIELDS, "x").count() == 0


def test_the_longest_fitting_table_is_taken_and_headers_may_carry_units(spark):
    fields = ["證券代號", "成交股數", "成交金額", "開盤價<br>(元)", "最高價", "最低價", " 收盤價　"]
    row = ["1101", "1,000", "２,000", "--", "10", "9", "9.5"]
    payload = json.dumps({"fields1": fields, "data1": [row], "fields2": fields, "data2": [row, row], "fields": fields, "data": [row]})
    df = spark.createDataFrame([(D, payload)], "trade_date date, payload string")
    got = reports.records(reports.parse_report(df, reports.TWSE_FIELDS, "x")).collect()
    assert len(got) == 2 and (got[0]["open_price"], got[0]["close_price"], got[0]["volume"], got[0]["turnover_amount"], got[0]["pe_ratio"]) == (None, 9.5, 1000, 2000, None)


def test_a_failed_first_page_is_an_error_and_a_later_one_is_not(spark):
    html = forum.ENTRY + '<div class="title"><a href="/bbs/Stock/M.1.A.html">t</a></div></div>'
    pages = lambda *h: spark.createDataFrame(list(enumerate(h)), "page_index long, html string")
    assert forum.keyword_search(pages(html, None, html), "k", "b").count() == 1
    with pytest.raises(Exception, match="unreachable"):
        forum.keyword_search(pages(None, html), "k", "b").collect()


def test_guards_of_training_rows(spark):
    df = spark.createDataFrame([("1", D, 1.0)], "stock_id string, trade_date date, sentiment double")
    with pytest.raises(ValueError, match="sentiment"):
        training.technical_only(df, ["stock_id"], ["sentiment"])
    with pytest.raises(ValueError, match="arm A"):
        training.fold_cause([], ["sentiment"], "y", "A")
    with pytest.raises(Exception, match="boundary"):
        training.rejecting(df, "trade_date", "2024-01-01").collect()
    assert training.rejecting(df, "trade_date", "2024-01-03").count() == 1
    twice = spark.createDataFrame([("1", 1), ("1", 2)], "stock_id string, regime int")
    with pytest.raises(Exception, match="twice"):
        training.lookup(df, twice, ["stock_id"]).collect()
    with pytest.raises(ValueError, match="broken"):
        training.must_be_empty(df, "broken")


def test_guards_of_the_second_stage(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, model string, arm string, p1 double")
    assert stacking.oof_matrix(rows((1, "lr", "A", 0.5)), ["k"], ["p1"]).first()["lr_A_p1"] == 0.5
    for bad, why in (((1, "lr", "B", 0.5), "arm"), ((1, "svm", "A", 0.5), "model")):
        with pytest.raises(Exception, match=f"not for the matrix: {why}"):
            stacking.oof_matrix(rows(bad), ["k"], ["p1"]).collect()
    with pytest.raises(Exception, match="twice"):
        stacking.oof_matrix(rows((1, "lr", "A", 0.5), (1, "lr", "A", 0.6)), ["k"], ["p1"]).collect()
    with pytest.raises(Exception, match="sum to zero"):
        one(spark, stacking.normalised([F.lit(0.0), F.lit(0.0)]))
    with pytest.raises(ValueError, match="missing"):
        stacking.meta_input(rows((1, "lr", "A", 0.5)), ["k"], ["q"])


def test_platt_recovers_a_logistic_curve(spark):
    df = spark.range(4000).select((F.col("id") / 4000).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000 < 1 / (1 + F.exp(-(4 * F.col("id") / 4000 - 1)))).cast("int").alias("y"))
    a, b = stacking.platt(df, "p", "y")
    assert a == pytest.approx(4, abs=0.5) and b == pytest.approx(-1, abs=0.25)


def test_scores_out_of_range_and_wrong_answers(spark):
    titles = spark.createDataFrame([("a",)], "title string")
    with pytest.raises(Exception, match="out of range"):
        textscores.cached(titles, spark.createDataFrame([("a", 1.5)], "title string, sentiment_score double")).collect()
    want = spark.createDataFrame([(1, "a"), (1, "b")], "batch int, id string")
    for text, why in (('{"a": 0.5}', "other ids"), ('{"a": 0.5, "b": 2}', "range"), ('{"a": 0.5, "a": 0.5, "b": 0.1}', "doubled"), ("[]", "not an object")):
        with pytest.raises(Exception, match=why):
            textscores.answers(spark.createDataFrame([(1, text)], "batch int, json string"), want).collect()


def test_the_run_log_takes_no_unexplained_failure(spark):
    entries = spark.createDataFrame([("s", "b", "i", "FETCH_FAILED", None)], "source string, batch_key string, item_key string, outcome string, detail string")
    log = entries.where("false").withColumn("started_at", F.lit(None).cast("timestamp"))
    with pytest.raises(Exception, match="detail missing"):
        runlog.appended(log, entries, "2024-01-01").collect()


def test_doubled_feature_rows_stop_the_panel(spark):
    f = spark.createDataFrame([("1", D), ("1", D)], "stock_id string, trade_date date")
    snaps = spark.createDataFrame([(date(2024, 1, 1), "1", True)], "effective_date date, stock_id string, included boolean")
    with pytest.raises(Exception, match="twice"):
        universe.panel(f, snaps, f.distinct()).collect()
    assert universe.panel(f.distinct(), snaps, f.distinct()).count() == 1


def test_models_of_the_factory_fit(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.col("id") / 1000).alias("x"))
    df = VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
    for name in ("lr", "rf"):
        assert learners.classifier(name, "f", "y").fit(df).transform(df).where("prediction = y").count() == 200
    with pytest.raises(ValueError, match="unknown"):
        learners.classifier("svm", "f", "y")


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    write, batch = jobs.append_once(out, ["k"]), spark.createDataFrame([(1,), (2,), (2,)], "k long")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(2,), (3,)], "k long"), 1)
    write(spark.createDataFrame([(2,), (3,)], "k long"), 1)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_of_rows_of_one_key_the_least_is_written_however_they_are_dealt(spark, tmp_path):
    rows = [(1, "b", 2.0), (1, "a", None), (1, "a", 1.0), (None, "z", 1.0), (None, "y", 9.0), (2, None, 5.0)]
    for n, order in enumerate((rows, rows[::-1])):
        out = str(tmp_path / f"out{n}")
        jobs.append_once(out, ["k"])(spark.createDataFrame(order, "k long, s string, x double").repartition(3), 0)
        got = spark.read.parquet(out).drop("batch").collect()
        assert {tuple(r) for r in got} == {(1, "a", None), (None, "y", 9.0), (2, None, 5.0)} and len(got) == 3


def test_days_close_behind_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "post_time timestamp_ntz, sentiment_score double"
    for i, rows in enumerate([[(datetime(2024, 1, 1, 9), 0.2), (datetime(2024, 1, 1, 10), 0.4)], [(datetime(2024, 1, 9, 9), 0.5)], [(datetime(2024, 1, 1, 11), 0.9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = jobs.daily_counts(jobs.files(spark, src, schema)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        assert i is not None
    got = {r["day"]: (r["n"], round(r["score"], 6)) for r in spark.read.parquet(out).collect()}
    assert got[date(2024, 1, 1)] == (2, 0.3)  # the comment of the third file came too late


def test_gaps_and_foreign_rows(spark):
    a = spark.createDataFrame([("1", D), ("2", D)], "stock_id string, trade_date date")
    assert [r["stock_id"] for r in checks.gaps(a, a.where("stock_id = '1'"), ["stock_id", "trade_date"]).collect()] == ["2"]
    assert checks.foreign_rows(a, a, "stock_id").count() == 0


def test_stage_guards(spark, tmp_path):
    from barograph.operators import guards

    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert guards.required_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="missing"):
        guards.required_columns(df, ["c"])
    assert (guards.timeout_column("target_triple_barrier"), guards.timeout_column("target_up_down")) == ("p1", "p0")
    with pytest.raises(ValueError, match="unknown target"):
        guards.timeout_column("x")
    guards.may_write({"confirmed": True})
    with pytest.raises(PermissionError, match="holdout"):
        guards.may_write({"confirmed": True, "holdout unused": False})
    (tmp_path / "f").write_bytes(b"abc")
    assert guards.file_digests(spark, str(tmp_path / "f")).first()["sha256"].startswith("ba7816bf")


def test_models_are_stored_and_read_again(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    from barograph.operators import guards

    df = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.range(20).select((F.col("id") % 2).cast("double").alias("y"), F.col("id").cast("double").alias("x")))
    model = learners.classifier("lr", "f", "y").fit(df)
    again = LogisticRegressionModel.load(guards.save_model(model, str(tmp_path / "m")))
    assert again.coefficients == model.coefficients
