"""Classification, ranking, calibration, gating and strategy metrics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import selection

RISK_FREE, YEAR = 0.015, 252


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification(df: DataFrame, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, macro-F1 and Brier; 0 where a denominator is 0."""
    hit, t = F.col(p) >= threshold, F.col(y) == 1
    c = df.groupBy(*by).agg(
        F.count_if(hit & t).alias("tp"), F.count_if(hit & ~t).alias("fp"), F.count_if(~hit & t).alias("fn"), F.count_if(~hit & ~t).alias("tn"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    pr, rc, pr0, rc0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f0 = ratio(2 * pr * rc, pr + rc), ratio(2 * pr0 * rc0, pr0 + rc0)
    return c.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", pr).withColumn("recall", rc).withColumn("macro_f1", (f1 + f0) / 2)


def auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Rank AUC with ties at their mean rank; 0.5 with one class. Scores are tied up before the window, so it runs over distinct scores."""
    tied = df.groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2))
    return tied.groupBy(*by).agg(F.coalesce(F.try_divide(wins.cast("double"), (F.sum("pos") * F.sum(F.col("n") - F.col("pos"))).cast("double")), F.lit(0.5)).alias("auc"))


def per_class(df: DataFrame, by: list[str], y: str = "y3", h: str = "h3", classes: tuple = (-1, 0, 1)) -> DataFrame:
    """Precision, recall, F1 and support of each class in its row."""
    one = df.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    t, hit = F.col(y) == F.col("class"), F.col(h) == F.col("class")
    c = one.groupBy(*by, "class").agg(F.count_if(t & hit).alias("tp"), F.count_if(~t & hit).alias("fp"), F.count_if(t).alias("support"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("support"))
    return c.select(*by, "class", pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"), "support")


def strategy(df: DataFrame, by: list[str], order: list[str], signal: Column, ret: str = "ret", block: Column | None = None) -> DataFrame:
    """Hit ratio, cumulative return, yearly return and deviation, Sharpe ratio and drawdown of a sign strategy.

    `block` cuts a group's rows, in their order, into runs (a day, an hour); without it a group is one run. Rows are sorted
    within runs only, see `worst_drawdown`.
    """
    s = df.withColumn("_r", F.when(signal, F.col(ret)).otherwise(-F.col(ret))).withColumn("_run", F.lit(0) if block is None else block)
    out = s.groupBy(*by).agg(F.avg((F.col("_r") > 0).cast("double")).alias("hit_ratio"), (F.exp(F.sum("_r")) - 1).alias("cumulative_return"), (F.avg("_r") * YEAR).alias("annual_return"), (F.stddev_pop("_r") * F.sqrt(F.lit(float(YEAR)))).alias("annual_volatility"))
    fall = worst_drawdown(s, by, "_run", order, "_r")
    out = out.join(fall, by) if by else out.join(F.broadcast(fall))  # one row beside one row
    return out.withColumn("sharpe", ratio(F.col("annual_return") - RISK_FREE, F.col("annual_volatility")))


def worst_drawdown(df: DataFrame, by: list[str], run: str, order: list[str], r: str) -> DataFrame:
    """By, max_drawdown of the running sum of log returns: a scan over two levels.

    A run gives four numbers: its sum, the least and greatest value of its own running sum, and its own deepest fall from the
    top so far. Over runs in order, the sum of those before lifts a run's values, and the highest top before is what
    they may fall from too. No window goes over more than one run's rows, or one row a run.
    """
    w = Window.partitionBy(*by, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", F.sum(r).over(w)).withColumn("_d", F.col("_s") - F.max("_s").over(w))
    runs = rows.groupBy(*by, run).agg(F.sum(r).alias("_all"), F.min("_s").alias("_low"), F.max("_s").alias("_top"), F.min("_d").alias("_own"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_lift", F.coalesce(F.sum("_all").over(before), F.lit(0.0))).withColumn("_peak", F.max(F.col("_lift") + F.col("_top")).over(before))
    fall = F.least("_own", F.col("_lift") + F.col("_low") - F.col("_peak"))
    return runs.groupBy(*by).agg((F.exp(F.min(fall)) - 1).alias("max_drawdown"))


def reliability(df: DataFrame, by: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Equal bins with literal edges i * (1 / bins), the last one closed; an empty bin is there with NULL means."""
    edge = [i * (1.0 / bins) for i in range(bins)]
    at = sum((F.col(p) >= e).cast("int") for e in edge[1:])
    found = df.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    grid = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(found, [*by, "bin"], "left").fillna(0, ["n"])


def theta_grid(df: DataFrame, by: list[str], p: str = "p", steps: int = 121, step: float = 0.005, parts: int = 100) -> DataFrame:
    """By, thetas: fixed steps and the exact percentiles 1 to `parts` of the scores, distinct and in order."""
    fixed = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.round(k * step, 6))
    own = selection.quantiles(df, p, [k / parts for k in range(1, parts + 1)], by)
    return own.select(*by, F.array_sort(F.array_distinct(F.concat(fixed, F.transform("q", lambda x: F.round(x, 6))))).alias("thetas"))


def curve_at(df: DataFrame, grid: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """D40 on any grid: rows are summed by score, scores by the first theta that keeps them; the curve is a running sum over thetas."""
    counts = df.groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 0).alias("good"))
    placed = counts.join(F.broadcast(grid), by).withColumn("_at", F.size(F.filter("thetas", lambda t: t < F.col("_p") - 1e-9)))  # a row a group
    each = placed.groupBy(*by, "_at").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    full = grid.select(*by, F.posexplode("thetas").alias("_at", "theta")).join(each, [*by, "_at"], "left").fillna(0, ["n", "good"])
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col(y) == 0).alias("_base"))
    run = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("_kept", F.sum("n").over(run)).withColumn("_right", F.sum("good").over(run)).join(F.broadcast(total), by)
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return full.select(*by, "theta", d("_kept", "_all").alias("coverage"), d("_right", "_kept").alias("precision"), d("_right", "_base").alias("recall"), F.try_divide(d("_right", "_kept"), d("_base", "_all")).alias("lift"))


def terciles(df: DataFrame, by: str, y: str = "y", p: str = "p", least: int = 10) -> DataFrame:
    """Rank AUC within thirds of a column; NULL under `least` positives. The two cuts are one broadcast row."""
    q = selection.quantiles(df, by, [1 / 3, 2 / 3]).select(F.col("q").alias("_q"))
    named = df.join(F.broadcast(q)).withColumn("regime", F.when(F.col(by) <= F.col("_q")[0], "low").when(F.col(by) <= F.col("_q")[1], "mid").otherwise("high"))
    n = named.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("positives"))
    return auc(named, ["regime"], y, p).join(n, "regime").withColumn("auc", F.when(F.col("positives") >= least, F.col("auc")))


def threshold_curve(df: DataFrame, by: list[str], y: str = "y", p: str = "p", steps: int = 121, step: float = 0.005) -> DataFrame:
    """For each threshold, what stays at or below it: coverage, precision, recall and lift.

    Rows fall into steps first; the curve is a running sum over `steps` counts, whatever the number of rows.
    """
    t, keep = F.col(p), F.col(y) == 0
    at = F.ceil(F.round(t / step, 9)).cast("int")
    counts = df.groupBy(*by, F.least(at, F.lit(steps)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("good"))
    grid = df.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))) if by else df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    run = Window.partitionBy(*(by or [F.lit(0)])).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    full = grid.join(counts, [*by, "k"], "left").fillna(0, ["n", "good"])
    full = full.withColumn("kept", F.sum("n").over(run)).withColumn("right", F.sum("good").over(run)).withColumn("all", F.sum("n").over(whole)).withColumn("base", F.sum("good").over(whole))
    precision = F.try_divide(F.col("right").cast("double"), F.col("kept").cast("double"))
    out = full.where(F.col("k") < steps).select(*by, (F.round(F.col("k") * step, 6)).alias("theta"), ratio(F.col("kept"), F.col("all")).alias("coverage"), precision.alias("precision"), ratio(F.col("right"), F.col("base")).alias("recall"), F.try_divide(precision, ratio(F.col("base"), F.col("all"))).alias("lift"))
    return out


def choose_threshold(curve: DataFrame, coverage: float, lift: float, recall: float, by: list[str] | None = None) -> DataFrame:
    """The feasible row, of each group or of all, with most recall, then precision, then the least threshold."""
    ok = curve.where((F.col("coverage") >= coverage) & (F.col("lift") >= lift) & (F.col("recall") >= recall))
    if by:
        first = Window.partitionBy(*by).orderBy(F.desc("recall"), F.desc("precision"), "theta")
        return ok.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return ok.orderBy(F.desc("recall"), F.desc("precision"), "theta").limit(1)


def brier_multiclass(df: DataFrame, by: list[str], y: str, probs: dict[int, str]) -> DataFrame:
    """D36"""
    total = sum((F.col(c) - (F.col(y) == k).cast("double")) ** 2 for k, c in probs.items())
    return df.groupBy(*by).agg(F.avg(total).alias("brier"))
