"""Queries over bars: indicators, labels, as-of, universe, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import asof, indicators, merkle, universe
from barograph.plans.registry import query
from barograph.sources.fixtures import Views

W = "(PARTITION BY stock_id ORDER BY trade_date"
SQL_TECH = f""", r AS (SELECT *, coalesce(ln(close_price / lag(close_price) OVER {W})), 0.0) AS return_1d FROM bars),
tech AS (SELECT *, coalesce(stddev_samp(return_1d) OVER {W} ROWS 4 PRECEDING) * sqrt(252.0), 0.0) AS volatility_5d, coalesce(stddev_samp(return_1d) OVER {W} ROWS 19 PRECEDING) * sqrt(252.0), 0.0) AS volatility_20d,
  (high_price - low_price) / nullif(close_price, 0) AS amplitude,
  CASE WHEN count(close_price) OVER {W} ROWS 4 PRECEDING) < 5 THEN 0.0 ELSE close_price / avg(close_price) OVER {W} ROWS 4 PRECEDING) - 1 END AS ma5_bias,
  CASE WHEN count(close_price) OVER {W} ROWS 19 PRECEDING) < 20 THEN 0.0 ELSE close_price / avg(close_price) OVER {W} ROWS 19 PRECEDING) - 1 END AS ma20_bias,
  CASE WHEN count(volume) OVER {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) < 5 THEN 1.0 ELSE volume / nullif(avg(volume) OVER {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) END AS volume_ratio
  FROM r)
"""
TECH = ["return_1d", "volatility_5d", "volatility_20d", "amplitude", "ma5_bias", "ma20_bias", "volume_ratio"]
TECH_SQL_COLS = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in TECH)


def rounded(df: DataFrame, names: list[str], digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


@query("E01_E04_E06_technical", SQL_TECH + f"SELECT stock_id, trade_date, {TECH_SQL_COLS} FROM tech")
def technical(v: Views) -> DataFrame:
    return rounded(indicators.technical(v.bars), TECH).select("stock_id", "trade_date", *TECH)


@query("E02_E03_rsi", """, d AS (SELECT stock_id, trade_date, row_number() OVER w AS i, greatest(close_price - lag(close_price) OVER w, 0.0) AS u, greatest(lag(close_price) OVER w - close_price, 0.0) AS dn FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)),
f AS (SELECT stock_id, trade_date, i, CAST(NULL AS DOUBLE) AS au, CAST(NULL AS DOUBLE) AS ad FROM d WHERE i = 1
  UNION ALL SELECT d.stock_id, d.trade_date, d.i, CASE WHEN f.au IS NULL THEN d.u ELSE f.au * (1 - 1.0::DOUBLE / 14) + d.u / 14 END, CASE WHEN f.ad IS NULL THEN d.dn ELSE f.ad * (1 - 1.0::DOUBLE / 14) + d.dn / 14 END
  FROM f JOIN d ON d.stock_id = f.stock_id AND d.i = f.i + 1)
SELECT stock_id, trade_date, round(CASE WHEN i < 15 THEN 50.0 WHEN ad = 0 THEN CASE WHEN au > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + au / ad) END, 6) AS rsi_14 FROM f""")
def rsi(v: Views) -> DataFrame:
    return rounded(indicators.rsi(v.bars.select("stock_id", "trade_date", "close_price")), ["rsi_14"], 6).select("stock_id", "trade_date", "rsi_14")


@query("E12_E13_targets", f", t AS (SELECT *, lead(close_price) OVER {W}) AS nc, lead(trade_date, 5) OVER {W}) AS label_end_date FROM bars) SELECT stock_id, trade_date, nc AS target_close, round(ln(nc / close_price), 8) + 0.0 AS target_return, CAST(ln(nc / close_price) > 0 AS INTEGER) AS target_up, label_end_date FROM t")
def targets(v: Views) -> DataFrame:
    return rounded(indicators.targets(v.bars), ["target_return"]).select("stock_id", "trade_date", "target_close", "target_return", "target_up", "label_end_date")


SQL_TB = f""", tb AS (SELECT *, list(struct_pack(h := high_price, l := low_price)) OVER {W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS days, lead(open_price) OVER {W}) AS e, lead(trade_date, 5) OVER {W}) AS label_end_date_tb FROM bars),
tc AS (SELECT *, coalesce(len(days), 0) AS n, coalesce(list_filter(list_transform(coalesce(days, []), lambda x: CASE WHEN x.h >= e * 1.02 AND x.l <= e * 0.985 THEN 8 WHEN x.h >= e * 1.02 THEN 1 WHEN x.l <= e * 0.985 THEN -1 ELSE 0 END), lambda x: x <> 0)[1], 0) AS f FROM tb),
labels3 AS (SELECT stock_id, trade_date, CASE WHEN n = 0 THEN 'no_entry' WHEN n < 5 THEN 'insufficient_data' WHEN f = 8 THEN 'ambiguous_dual_barrier' END AS label_reason, CASE WHEN n = 5 AND f <> 8 THEN f END AS triple_barrier, label_end_date_tb FROM tc)
"""


@query("E14_triple_barrier", SQL_TB + "SELECT * FROM labels3")
def triple_barrier(v: Views) -> DataFrame:
    return indicators.triple_barrier(v.bars).select("stock_id", "trade_date", "label_reason", "triple_barrier", "label_end_date_tb")


@query("E15_J07_tail_labels", SQL_TB + f"SELECT * FROM labels3 QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 6")
def tail_labels(v: Views) -> DataFrame:
    return indicators.tail_labels(v.bars, 6).select("stock_id", "trade_date", "label_reason", "triple_barrier", "label_end_date_tb")


@query("D17_label_distribution", SQL_TB + "SELECT stock_id, coalesce(label_reason, CAST(triple_barrier AS VARCHAR)) AS label, count(*) AS n FROM labels3 GROUP BY 1, 2")
def label_distribution(v: Views) -> DataFrame:
    df = indicators.triple_barrier(v.bars)
    return df.groupBy("stock_id", F.coalesce("label_reason", F.col("triple_barrier").cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("D19_D20_label_ratios", SQL_TB + "SELECT stock_id, count(*) AS n, round(count(*) FILTER (triple_barrier = 0) / count(triple_barrier), 8) AS timeout_ratio, round(count(*) FILTER (label_reason = 'ambiguous_dual_barrier') / count(*), 8) AS ambiguous_ratio, count(*) FILTER (label_reason = 'ambiguous_dual_barrier') / count(*) > 0.1 AS escalate FROM labels3 GROUP BY 1")
def label_ratios(v: Views) -> DataFrame:
    df = indicators.triple_barrier(v.bars)
    n, vague = F.count(F.lit(1)), F.count_if(F.col("label_reason").eqNullSafe(indicators.AMBIGUOUS))
    return df.groupBy("stock_id").agg(n.alias("n"), F.round(F.try_divide(F.count_if(F.col("triple_barrier") == 0), F.count("triple_barrier")), 8).alias("timeout_ratio"), F.round(vague / n, 8).alias("ambiguous_ratio"), (vague / n > 0.1).alias("escalate"))


@query("E22_E24_curves", f", r AS (SELECT *, coalesce(ln(close_price / lag(close_price) OVER {W})), 0.0) AS r, coalesce(lag(volume % 10) OVER {W}), 0) / 10.0 >= 0.5 AS up FROM bars), c AS (SELECT *, exp(sum(r) OVER {W} ROWS UNBOUNDED PRECEDING)) AS eq, exp(sum(CASE WHEN up THEN r ELSE -r END) OVER {W} ROWS UNBOUNDED PRECEDING)) AS st FROM r), m AS (SELECT *, max(eq) OVER {W} ROWS UNBOUNDED PRECEDING) AS top FROM c) SELECT stock_id, trade_date, round(eq - 1, 8) + 0.0 AS buy_and_hold, round(st - 1, 8) + 0.0 AS sign_strategy, round(eq / top - 1, 8) + 0.0 AS drawdown FROM m")
def curves(v: Views) -> DataFrame:
    """The sign strategy goes by a score of the day before, here a digit of its volume."""
    score = F.coalesce(F.lag(F.col("volume") % 10).over(indicators.by_stock()), F.lit(0)) / 10
    return rounded(indicators.equity_curves(v.bars, score >= 0.5), ["buy_and_hold", "sign_strategy", "drawdown"]).select("stock_id", "trade_date", "buy_and_hold", "sign_strategy", "drawdown")


@query("E23_chart_means", f"SELECT stock_id, trade_date, round(avg(close_price) OVER {W} ROWS 4 PRECEDING), 8) AS ma5, round(avg(close_price) OVER {W} ROWS 19 PRECEDING), 8) AS ma20 FROM bars")
def chart_means(v: Views) -> DataFrame:
    return v.bars.select("stock_id", "trade_date", F.round(indicators.rolling_mean("close_price", 5), 8).alias("ma5"), F.round(indicators.rolling_mean("close_price", 20), 8).alias("ma20"))


@query("E19_month_first_days", "SELECT min(trade_date) AS first_day FROM bars GROUP BY date_trunc('month', trade_date)")
def month_first(v: Views) -> DataFrame:
    return universe.month_first_days(v.bars).select("first_day")


SQL_UNIVERSE = """, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)),
eff AS (SELECT min(trade_date) AS effective_date, min(i) AS i FROM cal GROUP BY date_trunc('month', trade_date) HAVING min(i) > 60),
win AS (SELECT eff.effective_date, eff.i AS e, cal.trade_date, cal.i FROM eff JOIN cal ON cal.i BETWEEN eff.i - 60 AND eff.i - 1),
obs AS (SELECT effective_date, e, stock_id, list(turnover ORDER BY turnover) AS t, count(*) AS observation_days, max(i) AS last_i FROM win JOIN bars USING (trade_date) GROUP BY ALL),
med AS (SELECT *, CAST(floor((CASE WHEN len(t) > 30 THEN t[len(t) - 30] ELSE 0.0 END + CASE WHEN len(t) > 29 THEN t[len(t) - 29] ELSE 0.0 END) / 2) AS BIGINT) AS median_turnover FROM (SELECT effective_date, e, stock_id, observation_days, last_i, t FROM obs)),
reasons AS (SELECT *, CASE WHEN NOT regexp_matches(stock_id, '^Brand#[1-9][0-9]*$') THEN 'not_common_stock_code' WHEN last_i < e - 20 THEN 'no_recent_activity' WHEN median_turnover = 0 THEN 'zero_median_turnover' END AS early FROM med),
ranked AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY effective_date, early IS NULL ORDER BY median_turnover DESC, stock_id) END AS r FROM reasons),
universe AS (SELECT effective_date, stock_id, median_turnover, observation_days, CAST(CASE WHEN r <= 15 THEN r END AS INTEGER) AS rank, coalesce(r <= 15, FALSE) AS included, CASE WHEN early IS NOT NULL THEN early WHEN r > 15 THEN 'outside_top_15' END AS exclusion_reason FROM ranked)
"""


@query("I01_D09_E21_universe", SQL_UNIVERSE + "SELECT * FROM universe")
def build_universe(v: Views) -> DataFrame:
    return universe.build(v.bars, top=15, code_pattern=r"^Brand#[1-9][0-9]*$")


@query("C07_backward_asof", SQL_UNIVERSE + ", e AS (SELECT DISTINCT effective_date FROM universe) SELECT stock_id, trade_date, (SELECT max(effective_date) FROM e WHERE e.effective_date <= trade_date) AS effective_date FROM bars")
def backward(v: Views) -> DataFrame:
    snaps = universe.effective_days(v.bars).select(F.col("trade_date").alias("effective_date"))
    return asof.backward(v.bars.select("stock_id", "trade_date"), "trade_date", snaps, "effective_date").select("stock_id", "trade_date", "effective_date")


SQL_PANEL = SQL_UNIVERSE + f""", ef AS (SELECT DISTINCT effective_date FROM universe), ends AS (SELECT stock_id, trade_date, close_price, lead(trade_date, 5) OVER {W}) AS label_end_date FROM bars),
panel AS (SELECT b.stock_id, b.trade_date, u.effective_date, b.close_price, b.label_end_date FROM ends b JOIN universe u ON u.stock_id = b.stock_id AND u.included AND u.effective_date = (SELECT max(effective_date) FROM ef WHERE ef.effective_date <= b.trade_date))
"""


@query("I02_C08_C09_panel", SQL_PANEL + "SELECT * FROM panel")
def panel(v: Views) -> DataFrame:
    bars = v.bars
    return universe.panel(bars.select("stock_id", "trade_date", "close_price"), universe.build(bars, top=15, code_pattern=r"^Brand#[1-9][0-9]*$"), bars)


@query("B19_doubled_keys", "SELECT stock_id, trade_date, CAST(1 + CAST(volume % 50 = 0 AS INTEGER) + CAST(volume % 75 = 0 AS INTEGER) AS BIGINT) AS n FROM bars WHERE volume % 50 = 0 OR volume % 75 = 0")
def doubled_keys(v: Views) -> DataFrame:
    b = v.bars.select("stock_id", "trade_date", "volume")
    return universe.doubled_keys(b.unionByName(b.where("volume % 50 = 0")).unionByName(b.where("volume % 75 = 0")), ["stock_id", "trade_date"])


@query("F02_top_rows", "SELECT stock_id, trade_date, turnover FROM bars ORDER BY turnover DESC, stock_id, trade_date LIMIT 20")
def top_rows(v: Views) -> DataFrame:
    return v.bars.select("stock_id", "trade_date", "turnover").orderBy(F.desc("turnover"), "stock_id", "trade_date").limit(20)


@query("F03_last_rows", "SELECT stock_id, trade_date, close_price FROM bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 10")
def last_rows(v: Views) -> DataFrame:
    return indicators.tail(v.bars.select("stock_id", "trade_date", "close_price"), 10)


@query("F08_batches", "SELECT stock_id, CAST((row_number() OVER (ORDER BY stock_id) - 1) // 10 AS BIGINT) AS batch FROM (SELECT DISTINCT stock_id FROM bars)")
def batches(v: Views) -> DataFrame:
    stocks = v.table("part").select(F.col("p_brand").alias("stock_id")).join(v.bars.select("stock_id"), "stock_id", "left_semi").distinct()
    return stocks.select("stock_id", F.floor((F.row_number().over(Window.orderBy("stock_id")) - 1) / 10).alias("batch"))


@query("D25_report_qa", """, d AS (SELECT trade_date, count(*) AS n, list(turnover ORDER BY turnover) AS t FROM bars GROUP BY 1)
SELECT trade_date, n, t[n // 2 + 1] AS upper_median, coalesce(abs(n - lag(n) OVER (ORDER BY trade_date)) / lag(n) OVER (ORDER BY trade_date) <= 0.02, TRUE) AS steady, n = 25 AS conserved, t[n // 2 + 1] BETWEEN 10000 AND 200000 AS in_band FROM d""")
def report_qa(v: Views) -> DataFrame:
    return universe.report_qa(v.bars, expected=25, band=(10_000.0, 200_000.0))


@query("D11_max_date", "SELECT stock_id, max(trade_date) AS last_day, arg_max(close_price, trade_date) AS last_close, arg_min(close_price, trade_date) AS first_close FROM bars GROUP BY 1")
def max_date(v: Views) -> DataFrame:
    return v.bars.groupBy("stock_id").agg(F.max("trade_date").alias("last_day"), F.max_by("close_price", "trade_date").alias("last_close"), F.min_by("close_price", "trade_date").alias("first_close"))


@query("D12_feature_lag", "SELECT (SELECT max(trade_date) FROM bars) AS price_day, (SELECT max(trade_date) FROM bars WHERE volume % 7 = 0) AS feature_day, count(DISTINCT trade_date) AS behind FROM bars WHERE trade_date > (SELECT max(trade_date) FROM bars WHERE volume % 7 = 0)")
def feature_lag(v: Views) -> DataFrame:
    b = v.bars.select("trade_date", "volume")
    last = b.agg(F.max("trade_date").alias("price_day"), F.max(F.when(F.col("volume") % 7 == 0, F.col("trade_date"))).alias("feature_day"))
    late = b.join(F.broadcast(last), b["trade_date"] > last["feature_day"], "left_semi").agg(F.countDistinct("trade_date").alias("behind"))
    return last.join(F.broadcast(late))  # one row beside one row


@query("C14_anti_missing_rows", "SELECT stock_id, trade_date FROM bars GROUP BY 1, 2 HAVING count(*) FILTER (volume % 5 <> 0) = 0")
def missing_rows(v: Views) -> DataFrame:
    b = v.bars.select("stock_id", "trade_date", "volume")
    return b.select("stock_id", "trade_date").join(b.where(F.col("volume") % 5 != 0), ["stock_id", "trade_date"], "left_anti")


@query("G04_set_operations", "SELECT d, side FROM ((SELECT DISTINCT trade_date AS d, 'both' AS side FROM bars WHERE stock_id = 'Brand#1' INTERSECT SELECT trade_date, 'both' FROM bars WHERE stock_id = 'Brand#2') UNION ALL (SELECT trade_date, 'only_first' FROM bars WHERE stock_id = 'Brand#1' EXCEPT SELECT trade_date, 'only_first' FROM bars WHERE stock_id = 'Brand#2'))")
def set_operations(v: Views) -> DataFrame:
    one, two = (v.bars.where(F.col("stock_id") == f"Brand#{i}").select(F.col("trade_date").alias("d")) for i in (1, 2))
    return one.intersect(two).withColumn("side", F.lit("both")).unionByName(one.subtract(two).withColumn("side", F.lit("only_first")))


@query("D16_fingerprint", """, r AS (SELECT substr(md5(stock_id), 1, 2) AS shelf, stock_id, strftime(trade_date, '%Y-%m') AS month, trade_date, md5(stock_id || '|' || trade_date || '|' || volume) AS p FROM bars),
m AS (SELECT shelf, stock_id, month, count(*) AS n, md5(string_agg(p, '' ORDER BY trade_date)) AS p FROM r GROUP BY 1, 2, 3), s AS (SELECT shelf, stock_id, sum(n) AS n, md5(string_agg(p, '' ORDER BY month)) AS p FROM m GROUP BY 1, 2),
h AS (SELECT shelf, sum(n) AS n, md5(string_agg(p, '' ORDER BY stock_id)) AS p FROM s GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, md5(string_agg(p, '' ORDER BY shelf)) AS print FROM h""")
def fingerprint(v: Views) -> DataFrame:
    return merkle.Tree(v.bars, ["stock_id", "trade_date", "volume"]).root
