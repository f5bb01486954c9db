"""Technical indicators and targets over each stock's own calendar: row frames, one sort a stock.

All expect stock_id, trade_date, close_price, ...; windows share one partitioning and order, so a chain of
them costs one exchange. NULL is the only missing value. Series are as long as a stock has trading days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def by_stock():
    """Made anew each time, as a window needs a session."""
    return Window.partitionBy("stock_id").orderBy("trade_date")


def frame(start: int, end: int):
    return by_stock().rowsBetween(start, end)


def log_return(close: Column) -> Column:
    """Log of the ratio to the day before; the first day and impossible ratios give 0."""
    return F.coalesce(F.log(F.try_divide(close, F.lag(close).over(by_stock()))), F.lit(0.0))


def volatility(returns: Column, n: int) -> Column:
    """Yearly sample deviation of the last n returns; under two rows 0."""
    return F.coalesce(F.stddev_samp(returns).over(frame(-(n - 1), 0)) * F.sqrt(F.lit(252.0)), F.lit(0.0))


def amplitude(high: Column, low: Column, close: Column) -> Column:
    """E05"""
    return F.try_divide(high - low, close)


def ma_bias(close: Column, n: int) -> Column:
    """Distance from the mean of the last n closes, today included; 0 until all n are known."""
    mean = F.avg(close).over(frame(-(n - 1), 0))
    return F.when(F.count(close).over(frame(-(n - 1), 0)) < n, F.lit(0.0)).otherwise(F.try_divide(close - mean, mean))


def volume_ratio(volume: Column, n: int = 5) -> Column:
    """To the mean of the n days before, today excluded; 1 until all n are known."""
    return F.when(F.count(volume).over(frame(-n, -1)) < n, F.lit(1.0)).otherwise(F.try_divide(volume.cast("double"), F.avg(volume).over(frame(-n, -1))))


def technical(bars: DataFrame) -> DataFrame:
    """E01, E04 to E07 added to bars."""
    c = F.col("close_price")
    return (
        bars.withColumn("return_1d", log_return(c))
        .withColumn("volatility_5d", volatility(F.col("return_1d"), 5))
        .withColumn("volatility_20d", volatility(F.col("return_1d"), 20))
        .withColumn("amplitude", amplitude(F.col("high_price"), F.col("low_price"), c))
        .withColumn("ma5_bias", ma_bias(c, 5))
        .withColumn("ma20_bias", ma_bias(c, 20))
        .withColumn("volume_ratio", volume_ratio(F.col("volume")))
    )


def rsi(bars: DataFrame, n: int = 14, block: int = 256) -> DataFrame:
    """Wilder's index, rsi_14 added.

    The averages follow y' = c y + d x at each known change, with d = 1 - c = a / (a + (1 - a)**gap), a = 1 / n and
    the gap in rows since the last known one; a row without a change keeps the average. Such a chain is a running
    sum of d x / Q times Q, the running product of c; Q is started anew each `block` known changes, so it stays
    above 1e-9, and what went before comes in as the last four blocks' ends: older ones weigh under 1e-30.
    50 until n changes are known, 100 where only gains were.
    """
    a, w = 1.0 / n, by_stock()
    change = F.col("close_price").cast("double") - F.lag("close_price").over(w)
    at = F.row_number().over(w)
    df = bars.withColumn("_x", change).withColumn("_i", at)
    last = F.last(F.when(F.col("_x").isNotNull(), F.col("_i")), ignorenulls=True).over(frame(Window.unboundedPreceding, -1))
    df = df.withColumn("_k", F.count("_x").over(frame(Window.unboundedPreceding, 0))).withColumn("_last", last)
    old = F.pow(F.lit(1 - a), F.col("_i") - F.col("_last"))
    c = F.when(F.col("_x").isNotNull() & F.col("_last").isNotNull(), old / (old + a))
    df = df.withColumn("_c", c).withColumn("_b", F.floor(F.greatest(F.col("_k") - 1, F.lit(0)) / block))
    inside = Window.partitionBy("stock_id", "_b").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_q", F.exp(F.sum(F.coalesce(F.log("_c"), F.lit(0.0))).over(inside)))
    gain = {"_up": F.greatest(F.col("_x"), F.lit(0.0)), "_down": F.greatest(-F.col("_x"), F.lit(0.0))}
    share = F.coalesce(1 - F.col("_c"), F.lit(1.0))
    for name, x in gain.items():
        df = df.withColumn(name, F.col("_q") * F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), share * x / F.col("_q"))).over(inside), F.lit(0.0)))
    def end(column: str, k: int) -> Column:
        """Value at the end of the k-th block before; blocks have no gaps, rows are already in their order."""
        return F.max_by(column, "trade_date").over(Window.partitionBy("stock_id").orderBy("_b").rangeBetween(-k, -k))

    df = df.select("*", *[end(col, k).alias(f"{col}_{k}") for k in range(1, 5) for col in ("_q", *gain)])
    carried = []
    for g in gain:
        total, product = F.lit(0.0), F.lit(1.0)
        for k in range(1, 5):
            total = total + product * F.coalesce(F.col(f"{g}_{k}"), F.lit(0.0))
            product = product * F.coalesce(F.col(f"_q_{k}"), F.lit(0.0))
        carried.append(F.col(g) + F.col("_q") * total)
    up, down = carried
    value = F.when(down == 0, F.when(up > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + up / down))
    return df.withColumn("rsi_14", F.when(F.col("_k") < n, F.lit(50.0)).otherwise(value)).select(*bars.columns, "rsi_14")


def targets(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Next close, next log return, its sign, and the day a label of `horizon` rows ends."""
    c = F.col("close_price")
    ahead = F.lead(c).over(by_stock())
    r = F.log(F.try_divide(ahead, c))
    return bars.withColumn("target_close", ahead).withColumn("target_return", r).withColumn("target_up", (r > 0).cast("int")).withColumn("label_end_date", F.lead("trade_date", horizon).over(by_stock()))


AMBIGUOUS = "ambiguous_dual_barrier"


def triple_barrier(bars: DataFrame, up: float = 0.02, down: float = 0.015, horizon: int = 5) -> DataFrame:
    """First touch of a barrier above or below tomorrow's open within `horizon` days -> label, reason, label_end_date_tb.

    Label 1, -1 or, when time runs out, 0; null with a reason: no_entry (no next day or no open there),
    insufficient_data (days or bars missing), ambiguous_dual_barrier (both barriers in one day). The label ends with
    the `horizon`-th day ahead, which is null where there is none. All looks ahead share one window.
    """
    w = by_stock()
    days = range(1, horizon + 1)
    ahead = {f"_{c[0]}{k}": F.lead(c, k).over(w) for k in days for c in ("high_price", "low_price")}
    df = bars.withColumns(ahead | {"_entry": F.lead("open_price").over(w), "_next": F.lead("trade_date").over(w), "label_end_date_tb": F.lead("trade_date", horizon).over(w)})
    top, floor = F.col("_entry") * (1 + up), F.col("_entry") * (1 - down)

    def touch(k: int) -> Column:
        high, low = F.col(f"_h{k}"), F.col(f"_l{k}")
        return F.when(high.isNull() | low.isNull(), 9).when((high >= top) & (low <= floor), 8).when(high >= top, 1).when(low <= floor, -1)

    df = df.withColumn("_first", F.coalesce(*[touch(k) for k in days], F.lit(0)))
    reason = (
        F.when(F.col("_next").isNull(), "no_entry").when(F.col("label_end_date_tb").isNull(), "insufficient_data").when(F.col("_entry").isNull(), "no_entry")
        .when(F.col("_first") == 9, "insufficient_data").when(F.col("_first") == 8, AMBIGUOUS)
    )
    return df.withColumn("label_reason", reason).withColumn("triple_barrier", F.when(reason.isNull(), F.col("_first"))).drop(*ahead, "_entry", "_next", "_first")


def tail(df: DataFrame, k: int) -> DataFrame:
    """The last k rows of each stock."""
    w = Window.partitionBy("stock_id").orderBy(F.desc("trade_date"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def tail_labels(bars: DataFrame, k: int, horizon: int = 5) -> DataFrame:
    """Labels of the last k rows from the last k + horizon bars alone."""
    return tail(triple_barrier(tail(bars, k + horizon + 1), horizon=horizon), k)


def rolling_mean(c: str, n: int) -> Column:
    """Mean of what is known in the last n rows."""
    return F.avg(c).over(frame(-(n - 1), 0))


def lag_with_warm_up(c: str, n: int, failed: Column, fill: float = 0.5) -> Column:
    """Lag by n rows; only the first n rows of a stock are filled, and not where their source failed."""
    warm = (F.row_number().over(by_stock()) <= n) & ~failed
    return F.coalesce(F.lag(c, n).over(by_stock()), F.when(warm, F.lit(fill)))


def equity_curves(bars: DataFrame, long: Column) -> DataFrame:
    """Growth of holding and of a sign strategy (`long`, else short), and the drawdown of holding."""
    w = frame(Window.unboundedPreceding, 0)
    df = bars.withColumn("_r", log_return(F.col("close_price"))).withColumn("_s", F.when(long, F.col("_r")).otherwise(-F.col("_r")))
    df = df.withColumn("_e", F.exp(F.sum("_r").over(w))).withColumn("_g", F.exp(F.sum("_s").over(w))).withColumn("_top", F.max("_e").over(w))
    return df.withColumn("buy_and_hold", F.col("_e") - 1).withColumn("sign_strategy", F.col("_g") - 1).withColumn("drawdown", F.col("_e") / F.col("_top") - 1).drop("_r", "_s", "_e", "_g", "_top")
