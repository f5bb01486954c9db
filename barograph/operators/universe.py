"""Point-in-time universes: monthly snapshots ranked by the zero-filled median turnover of 60 days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import asof

WINDOW_DAYS, RECENT_DAYS = 60, 20


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct days with their number from 1; one row a trading day."""
    return bars.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")).cast("long"))


def month_first_days(bars: DataFrame) -> DataFrame:
    """E19"""
    return bars.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min("trade_date").alias("first_day"))


def effective_days(bars: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """First days of months that have a full window before them."""
    cal = calendar(bars)
    first = cal.groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.min("trade_date").alias("trade_date"), F.min("i").alias("i"))
    return first.where(F.col("i") > window).select("trade_date", "i")


def build(bars: DataFrame, top: int = 150, code_pattern: str = r"^[1-9]\d{3}$", window: int = WINDOW_DAYS) -> DataFrame:
    """One row for each snapshot day and stock seen in the window strictly before it.

    The window is joined as days: each of the 60 day offsets names one day, so a bar meets the few snapshots
    it belongs to by equality. Days without a bar count as turnover 0 in the median, without being made.
    """
    cal = calendar(bars)
    days = effective_days(bars, window).select(F.col("trade_date").alias("effective_date"), F.col("i").alias("e"), F.explode(F.sequence(F.col("i") - window, F.col("i") - 1)).alias("i"))
    inside = bars.select("stock_id", "trade_date", "turnover").join(cal.join(days, "i"), "trade_date")
    seen = inside.groupBy("effective_date", "e", "stock_id").agg(F.sort_array(F.collect_list("turnover")).alias("t"), F.count(F.lit(1)).alias("observation_days"), F.max("i").alias("last_i"))
    zeros = window - F.size("t")
    half = [F.coalesce(F.when(F.lit(k) >= zeros, F.get("t", F.lit(k) - zeros)), F.lit(0.0)) for k in (window // 2 - 1, window // 2)]
    seen = seen.withColumn("median_turnover", F.floor((half[0] + half[1]) / 2).cast("long"))
    early = F.when(~F.col("stock_id").rlike(code_pattern), "not_common_stock_code").when(F.col("last_i") < F.col("e") - RECENT_DAYS, "no_recent_activity").when(F.col("median_turnover") == 0, "zero_median_turnover")
    seen = seen.withColumn("early", early)
    order = Window.partitionBy("effective_date", F.col("early").isNull()).orderBy(F.desc("median_turnover"), "stock_id")
    seen = seen.withColumn("r", F.when(F.col("early").isNull(), F.row_number().over(order)))
    return seen.select(
        "effective_date", "stock_id", "median_turnover", "observation_days", F.when(F.col("r") <= top, F.col("r")).alias("rank"),
        F.coalesce(F.col("r") <= top, F.lit(False)).alias("included"), F.coalesce("early", F.when(F.col("r") > top, f"outside_top_{top}")).alias("exclusion_reason"),
    )


def doubled_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with how often; summed in every task before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def panel(features: DataFrame, snapshots: DataFrame, prices: DataFrame, horizon: int = 5, as_of=None) -> DataFrame:
    """Feature rows of stocks that the last snapshot on or before the day includes, with label_end_date.

    label_end_date comes from the price calendar; as_of cuts the features. The job fails at doubled (stock, day) rows; `doubled_keys` lists them.
    """
    if as_of is not None:
        features = features.where(F.col("trade_date") <= F.lit(as_of))
    once = Window.partitionBy("stock_id", "trade_date")
    doubled = F.raise_error(F.concat(F.lit("feature rows occur twice: "), "stock_id", F.lit(" "), F.col("trade_date").cast("string")))
    features = features.withColumn("stock_id", F.when(F.count(F.lit(1)).over(once) > 1, doubled).otherwise(F.col("stock_id")))
    found = asof.backward(features, "trade_date", snapshots, "effective_date")
    member = snapshots.where("included").select("effective_date", "stock_id")
    ends = prices.select("stock_id", "trade_date", F.lead("trade_date", horizon).over(Window.partitionBy("stock_id").orderBy("trade_date")).alias("label_end_date"))
    out = found.join(member, ["effective_date", "stock_id"]).join(ends, ["stock_id", "trade_date"], "left")
    return out.select(*features.columns, "effective_date", "label_end_date")


def report_qa(bars: DataFrame, expected: int, band: tuple[float, float], most_change: float = 0.02) -> DataFrame:
    """By day: rows, the upper of the middle turnovers, whether rows changed little since the day before, are as many as expected, and the middle lies in its band.

    A day's turnovers, one a stock, are sorted in one array; the window without a key runs over days.
    """
    days = bars.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("turnover")).alias("_t"))
    before = F.lag("n").over(Window.orderBy("trade_date"))
    days = days.withColumn("upper_median", F.get("_t", F.floor(F.col("n") / 2).cast("int")))
    steady = F.coalesce(F.abs(F.col("n") - before) / before <= most_change, F.lit(True))
    return days.select("trade_date", "n", "upper_median", steady.alias("steady"), (F.col("n") == expected).alias("conserved"), F.col("upper_median").between(*band).alias("in_band"))
