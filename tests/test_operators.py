"""Hand values of the operators, and guards that must raise."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barograph.functions import scalar
from barograph.operators import asof, comments, folds, indicators, merges, metrics, universe

DAY = date(2024, 1, 1)
BARS = "stock_id string, trade_date date, open_price double, high_price double, low_price double, close_price double, volume long, turnover double"


def bars(spark, closes, stock="1101", opens=None, highs=None, lows=None):
    n = len(closes)
    rows = [(stock, DAY + timedelta(i), (opens or closes)[i], (highs or closes)[i], (lows or closes)[i], closes[i], 1000 + i, 1e6) for i in range(n)]
    return spark.createDataFrame(rows, BARS)


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_indices(spark):
    f = lambda g, p, n: one(spark, g(F.lit(float(p)), F.lit(float(n))))
    assert [round(f(scalar.bullishness, *x), 6) for x in ((5, 2), (0, 3), (0, 0))] == [0.693147, -1.386294, 0.0]
    assert [f(scalar.agreement, *x) for x in ((10, 0), (5, 5), (0, 0))] == [1.0, 0.0, 0.0]


def test_numbers_and_marks(spark):
    got = [one(spark, scalar.parse_number(F.lit(x))) for x in ("1,234", "--", "", "X", " 5　", "abc", "-3.5")]
    assert got == [1234.0, None, None, None, 5.0, None, -3.5]
    assert [one(spark, scalar.push_count(F.lit(x))) for x in ("爆", "X1", "7", "", "?")] == [100, -10, 7, 0, 0]


def test_shown_scores_are_rounded_as_doubles(spark):
    """By the digits shown the first three would be 0.29, 1.01 and -0.29."""
    got = [one(spark, scalar.rounded(F.lit(x), 2)) for x in (0.285, 1.005, -0.285, 0.125, 0.2849, 1.0)]
    assert got == [0.28, 1.0, -0.28, 0.13, 0.28, 1.0]
    assert one(spark, scalar.rounded(F.lit(None).cast("double"), 2)) is None


def test_unknown_market_raises(spark):
    with pytest.raises(Exception, match="unknown market"):
        one(spark, scalar.provider_symbol(F.lit("1"), F.lit("MARS")))


@pytest.mark.parametrize(("closes", "last"), [(list(range(100, 120)), 100.0), (list(range(120, 100, -1)), 0.0), ([100] * 20, 50.0)])
def test_rsi(spark, closes, last):
    got = [r["rsi_14"] for r in indicators.rsi(bars(spark, [float(c) for c in closes])).orderBy("trade_date").collect()]
    assert got[:14] == [50.0] * 14 and got[-1] == last


def test_bias_counts_today_and_volume_ratio_does_not(spark):
    rows = indicators.technical(bars(spark, [100.0] * 4 + [110.0, 110.0])).orderBy("trade_date").collect()
    assert rows[3]["ma5_bias"] == 0.0 and rows[4]["ma5_bias"] == pytest.approx(110 / 102 - 1)
    assert rows[4]["volume_ratio"] == 1.0 and rows[5]["volume_ratio"] == pytest.approx(1005 / 1002)


def test_barriers(spark):
    flat = [100.0] * 7
    up, both = [100.0] * 3 + [103.0] + [100.0] * 3, [100.0] * 2 + [97.0] + [100.0] * 4
    label = lambda **k: [(r["triple_barrier"], r["label_reason"]) for r in indicators.triple_barrier(bars(spark, flat, **k)).orderBy("trade_date").collect()]
    assert label()[:2] == [(0, None)] * 2 and label()[2] == (None, "insufficient_data") and label()[6] == (None, "no_entry")
    assert label(highs=up)[0] == (1, None) and label(lows=both)[0] == (-1, None)
    assert label(highs=[100.0] * 2 + [103.0] + [100.0] * 4, lows=both)[0] == (None, "ambiguous_dual_barrier")
    assert label(highs=[100.0] * 2 + [None] + [100.0] * 4)[0] == (None, "insufficient_data")
    assert label(opens=[100.0, None] + [100.0] * 5)[0] == (None, "no_entry")


def test_the_future_does_not_change_the_past(spark):
    a, b = [100.0 + i % 3 for i in range(20)], [100.0 + i % 3 for i in range(19)] + [500.0]
    past = lambda c: [tuple(r) for r in indicators.technical(bars(spark, c)).orderBy("trade_date").drop("close_price").collect()][:19]
    assert past(a) == past(b)


def test_each_stock_has_its_own_calendar(spark):
    left = spark.createDataFrame([("a", date(2024, 1, 2)), ("b", date(2024, 1, 2)), ("a", date(2024, 1, 9)), ("a", None)], "stock_id string, eff date")
    cal = spark.createDataFrame([("a", date(2024, 1, 3)), ("b", date(2024, 1, 2)), ("b", date(2024, 1, 5))], "stock_id string, trade_date date")
    got = sorted((r["stock_id"], r["trade_date"]) for r in asof.forward(left, "eff", cal, ["stock_id"]).collect())
    assert got == [("a", date(2024, 1, 3)), ("b", date(2024, 1, 2))]


def test_cutoff(spark):
    ts = [datetime(2024, 1, 1, 15, 30), datetime(2024, 1, 1, 15, 30, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    assert sorted(r[0] for r in df.select(asof.effective_date(F.col("t"))).collect()) == [date(2024, 1, 1), date(2024, 1, 2)]


def test_comment_years_and_resets(spark):
    c = spark.createDataFrame([(1, i, md, datetime(2024, 1, 1, h)) for i, (md, h) in enumerate([(1230, 1), (None, 2), (102, 3), (101, 1)])], "article_id long, comment_seq int, md int, comment_time timestamp_ntz")
    got = [r["year_inferred"] for r in comments.infer_years(c, F.lit(2023), F.lit(1229)).orderBy("comment_seq").collect()]
    assert got == [2023, None, 2024, 2025] and comments.time_resets(c).first()["suspect"]


def test_universe_looks_back_only(spark):
    b = bars(spark, [100.0] * 100)
    later = bars(spark, [100.0] * 100, stock="2202").where(F.col("trade_date") > "2024-04-01")
    first = lambda df: sorted(tuple(r) for r in universe.build(df).where("effective_date = '2024-04-01'").collect())
    assert first(b) == first(b.unionByName(later)) and len(first(b)) == 1


def test_doubled_panel_rows_raise(spark):
    b = bars(spark, [100.0] * 100)
    assert universe.panel(b, universe.build(b), b).count() > 0
    with pytest.raises(Exception, match="twice: 1101"):
        universe.panel(b.unionByName(b), universe.build(b), b).collect()
    got = universe.doubled_keys(b.unionByName(b.limit(1)), ["stock_id", "trade_date"]).collect()
    assert [tuple(r) for r in got] == [("1101", DAY, 2)]


def test_failed_empty_and_fetched_days_differ(spark):
    """Three statuses; a failed day is NULL in all eight columns even where some articles came, an empty one has zeros but no sentiment."""
    from barograph.operators import sentiment

    b = bars(spark, [100.0] * 4)
    ts = lambda d: datetime(2024, 1, d, 9)
    articles = spark.createDataFrame([(1, "forum", "k", ts(1), 0.9), (2, "forum", "k", ts(3), 0.8)], "article_id long, source string, fetch_keyword string, post_time timestamp_ntz, sentiment_score double")
    entities = spark.createDataFrame([("k", "1101")], "keyword string, stock_id string")
    themes = spark.createDataFrame([], "theme_keyword string, stock_id string, relevance_weight double")
    log = spark.createDataFrame([("k", date(2024, 1, 2), "OK"), ("k", date(2024, 1, 4), "FETCH_FAILED")], "item_key string, batch_date date, outcome string")
    log = log.unionByName(spark.createDataFrame([("k", date(2024, 1, 1), "NO_DATA")], log.schema))
    rows = [r.asDict() for r in sentiment.daily_features(b, articles, entities, themes, log, ["forum"]).orderBy("trade_date").collect()]
    assert [r["source_status"] for r in rows] == ["SUCCESS", "SUCCESS_EMPTY", "SOURCE_FAILED", "SOURCE_FAILED"]
    assert [r["article_count"] for r in rows] == [1, 0, None, None]
    assert (rows[1]["sentiment"], rows[1]["bullishness"], rows[1]["agreement"]) == (None, 0.0, 0.0)
    assert all(rows[2][c] is None for c in sentiment.OWNED) and len(sentiment.OWNED) == 8
    assert rows[0]["sentiment_lag1"] == 0.5 and rows[1]["sentiment_lag1"] == 0.9


def test_purge_and_embargo(spark):
    b = bars(spark, [100.0] * 60)
    panel = indicators.targets(b).select("stock_id", "trade_date", "label_end_date")
    rows = folds.WalkForward(train=20, test=10, embargo=2).split(panel).collect()
    train = {f: sorted((r["trade_date"] - DAY).days for r in rows if r["fold"] == f and r["role"] == "train") for f in range(4)}
    assert train[0] == list(range(15))  # five labels reach into the test
    assert not {30, 31} & set(train[1]) and not {30, 31} & set(train[2])
    with pytest.raises(ValueError, match="positive"):
        folds.WalkForward(train=0).bounds(panel)


def test_auc_of_ties_and_of_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 0, 0.1), ("c", 1, 0.3)], "g string, y int, p double")
    assert {r["g"]: r["auc"] for r in metrics.auc(df, ["g"]).collect()} == {"a": 0.5, "b": 1.0, "c": 0.5}


def test_an_upsert_twice_is_one(spark):
    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 2)], [(2, 5), (3, 6), (3, 7)]))
    once = merges.upsert(old, new, ["k"], [F.desc("v")])
    twice = merges.upsert(once, new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1), (2, 5), (3, 7)]


def test_rsi_with_missing_closes_over_many_blocks(spark):
    import random

    import pandas as pd

    rnd = random.Random(4)
    closes = [None if rnd.random() < 0.15 or 40 <= i < 60 else 100 + rnd.gauss(0, 3) for i in range(300)]
    change = pd.Series(closes, dtype=float).diff()
    up, down = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (change, -change))
    want = (100 - 100 / (1 + up / down)).fillna(50.0).tolist()
    got = [r["rsi_14"] for r in indicators.rsi(bars(spark, closes), block=16).orderBy("trade_date").collect()]
    # blocks of 16 carry four ends: what is older weighs under (13 / 14) ** 64
    assert got == pytest.approx(want, abs=0.5)
    assert [r["rsi_14"] for r in indicators.rsi(bars(spark, closes)).orderBy("trade_date").collect()] == pytest.approx(want, abs=1e-9)
