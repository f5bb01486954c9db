"""Queries of folds, metrics, calibration, gating, stacking and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import folds, forests, indicators, learners, merges, metrics, selection
from barograph.plans.prices import W
from barograph.plans.registry import query
from barograph.sources.fixtures import Views

SPLIT = folds.WalkForward(train=250, test=60, embargo=5)
SQL_FOLDS = f""", pan AS (SELECT stock_id, trade_date, lead(trade_date, 5) OVER {W}) AS label_end_date FROM bars),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)),
fo AS (SELECT k AS fold, k * 60 + 1 AS a, k * 60 + 250 AS b, k * 60 + 251 AS c, k * 60 + 310 AS d FROM range(1000) r(k) WHERE k * 60 + 310 <= (SELECT max(i) FROM cal)),
bar AS (SELECT fold, d + j AS i FROM fo, range(1, 6) q(j)),
sp AS (SELECT f.fold, CASE WHEN c1.i < f.c THEN 'train' ELSE 'test' END AS role, p.stock_id, p.trade_date, p.label_end_date, s.trade_date AS test_start, c1.i AS i
  FROM fo f JOIN cal c1 ON c1.i BETWEEN f.a AND f.d JOIN pan p ON p.trade_date = c1.trade_date JOIN cal s ON s.i = f.c),
folded AS (SELECT fold, role, stock_id, trade_date FROM sp WHERE role = 'test' OR (label_end_date < test_start AND NOT EXISTS (SELECT 1 FROM bar WHERE bar.i = sp.i AND bar.fold < sp.fold)))
"""


def _panel(v: Views) -> DataFrame:
    return indicators.targets(v.bars.select("stock_id", "trade_date", "close_price")).select("stock_id", "trade_date", "label_end_date")


@query("I03_I04_I05_folds", SQL_FOLDS + "SELECT * FROM folded")
def fold_rows(v: Views) -> DataFrame:
    return SPLIT.split(_panel(v))


@query("I06_fold_sizes", SQL_FOLDS + "SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows, count(DISTINCT CASE WHEN role = 'train' THEN trade_date END) AS train_days, count(DISTINCT CASE WHEN role = 'train' THEN trade_date END) < 245 AS skipped FROM folded GROUP BY 1")
def fold_sizes(v: Views) -> DataFrame:
    return SPLIT.sizes(SPLIT.split(_panel(v)))


SQL_CM = """, cm AS (SELECT model, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn, avg((p - y) ** 2) AS brier FROM preds GROUP BY 1),
pr AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS rc, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM cm)
"""


@query("D26_D28_classification", SQL_CM + "SELECT model, tp, fp, fn, tn, round(brier, 8) AS brier, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(pr, 8) AS precision, round(rc, 8) AS recall, round((2 * pr * rc / (pr + rc) + 2 * p0 * r0 / (p0 + r0)) / 2, 8) AS macro_f1 FROM pr")
def classification(v: Views) -> DataFrame:
    df = metrics.classification(v.preds, ["model"])
    return df.withColumns({c: F.round(c, 8) for c in ("brier", "accuracy", "precision", "recall", "macro_f1")})


@query("D27_auc", ", r AS (SELECT model, y, (rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2) AS r FROM preds) SELECT model, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc FROM r GROUP BY 1")
def auc(v: Views) -> DataFrame:
    return metrics.auc(v.preds, ["model"]).withColumn("auc", F.round("auc", 8))


@query("D29_strategy", ", s AS (SELECT model, ts, event_id, CASE WHEN p >= 0.5 THEN ret ELSE -ret END AS r FROM preds), e AS (SELECT *, exp(sum(r) OVER (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS e FROM s), d AS (SELECT *, e / max(e) OVER (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e) SELECT model, round(avg(CAST(r > 0 AS INTEGER)), 8) AS hit_ratio, round(exp(sum(r)) - 1, 6) AS cumulative_return, round(avg(r) * 252, 6) AS annual_return, round(stddev_pop(r) * sqrt(252.0), 6) AS annual_volatility, round(min(dd), 6) AS max_drawdown, round((avg(r) * 252 - 0.015) / (stddev_pop(r) * sqrt(252.0)), 6) AS sharpe FROM d GROUP BY 1")
def strategy(v: Views) -> DataFrame:
    df = metrics.strategy(v.preds, ["model"], ["ts", "event_id"], F.col("p") >= 0.5, block=F.col("d"))
    return df.withColumn("hit_ratio", F.round("hit_ratio", 8)).withColumns({c: F.round(c, 6) for c in ("cumulative_return", "annual_return", "annual_volatility", "max_drawdown", "sharpe")})


SQL_PC = """, pc AS (SELECT model, c.class, count(*) FILTER (y3 = c.class AND h3 = c.class) AS tp, count(*) FILTER (y3 <> c.class AND h3 = c.class) AS fp, count(*) FILTER (y3 = c.class) AS support FROM preds, (VALUES (-1), (0), (1)) c(class) GROUP BY 1, 2),
pcm AS (SELECT model, class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support, coalesce(2 * tp / nullif(support + tp + fp, 0), 0) AS f1 FROM pc)
"""


@query("D30_per_class", SQL_PC + "SELECT model, class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM pcm")
def per_class(v: Views) -> DataFrame:
    return metrics.per_class(v.preds, ["model"]).withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query("D33_D35_model_ranking", SQL_PC + "SELECT model, round(avg(f1), 8) AS macro_f1, rank() OVER (ORDER BY round(avg(f1), 8) DESC, model) AS place FROM pcm GROUP BY 1")
def ranking(v: Views) -> DataFrame:
    m = metrics.per_class(v.preds, ["model"]).groupBy("model").agg(F.round(F.avg("f1"), 8).alias("macro_f1"))
    return m.withColumn("place", F.rank().over(Window.orderBy(F.desc("macro_f1"), "model")).cast("long"))


@query("D34_D49_majority", "SELECT fold, arg_max(y3, row(n, -y3)) AS majority FROM (SELECT fold, y3, count(*) AS n FROM preds GROUP BY 1, 2) GROUP BY 1")
def majority(v: Views) -> DataFrame:
    c = v.preds.groupBy("fold", "y3").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("fold").agg(F.max_by("y3", F.struct("n", -F.col("y3"))).alias("majority"))


@query("D36_multiclass_brier", "SELECT fold, round(avg(CASE y3 WHEN 1 THEN (p - 1) ** 2 + 2 * ((1 - p) / 2) ** 2 ELSE p ** 2 + ((1 - p) / 2 - 1) ** 2 + ((1 - p) / 2) ** 2 END), 8) AS brier FROM preds GROUP BY 1")
def multiclass_brier(v: Views) -> DataFrame:
    df = v.preds.withColumn("q", (1 - F.col("p")) / 2)
    return metrics.brier_multiclass(df, ["fold"], "y3", {-1: "q", 0: "q", 1: "p"}).withColumn("brier", F.round("brier", 8))


EDGES = " + ".join(f"CAST(p >= CAST('{(i * 0.1)!r}' AS DOUBLE) AS INTEGER)" for i in range(1, 10))


@query("D37_reliability", f", b AS (SELECT model, {EDGES} AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS observed FROM (SELECT * REPLACE (CASE WHEN p >= 0.3 AND p < 0.4 THEN p + 0.5 ELSE p END AS p) FROM preds) GROUP BY 1, 2) SELECT model, CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed FROM (SELECT DISTINCT model FROM b) m CROSS JOIN range(10) r(k) LEFT JOIN b USING (model) WHERE b.bin = k UNION ALL SELECT model, 3, 0, NULL, NULL FROM (SELECT DISTINCT model FROM b)")
def reliability(v: Views) -> DataFrame:
    moved = v.preds.withColumn("p", F.when((F.col("p") >= 0.3) & (F.col("p") < 0.4), F.col("p") + 0.5).otherwise(F.col("p")))  # so one bin is empty
    return metrics.reliability(moved, ["model"]).withColumns({c: F.round(c, 8) for c in ("mean_p", "observed")})


SQL_CURVE = """, g AS (SELECT model, round(k * 0.005, 6)::DOUBLE AS theta FROM (SELECT DISTINCT model FROM preds), range(121) r(k)),
cu AS (SELECT g.model, theta, count(*) FILTER (p <= theta + 1e-9) AS kept, count(*) FILTER (p <= theta + 1e-9 AND y = 0) AS good, count(*) AS n, count(*) FILTER (y = 0) AS base FROM g JOIN preds USING (model) GROUP BY 1, 2),
curve AS (SELECT model, theta, kept / n AS coverage, good / nullif(kept, 0) AS precision, good / base AS recall, good / nullif(kept, 0) / (base / n) AS lift FROM cu)
"""


@query("D38_D40_threshold_curve", SQL_CURVE + "SELECT model, theta, round(coverage, 8) AS coverage, round(precision, 8) AS precision, round(recall, 8) AS recall, round(lift, 8) AS lift FROM curve")
def curve(v: Views) -> DataFrame:
    return metrics.threshold_curve(v.preds, ["model"]).withColumns({c: F.round(c, 8) for c in ("coverage", "precision", "recall", "lift")})


@query("D41_threshold_choice", SQL_CURVE + "SELECT model, theta, round(recall, 8) AS recall FROM curve WHERE coverage >= 0.3 AND lift >= 0.9 AND recall >= 0.2 ORDER BY recall DESC, precision DESC, theta, model LIMIT 1")
def choice(v: Views) -> DataFrame:
    return metrics.choose_threshold(metrics.threshold_curve(v.preds, ["model"]), 0.3, 0.9, 0.2).select("model", "theta", F.round("recall", 8).alias("recall"))


@query("D43_terciles", ", t AS (SELECT quantile_cont(vol, [1.0 / 3, 2.0 / 3]) AS q FROM preds), l AS (SELECT CASE WHEN vol <= q[1] THEN 'low' WHEN vol <= q[2] THEN 'mid' ELSE 'high' END AS regime, CASE WHEN vol > q[2] THEN 0 ELSE y END AS y, p FROM preds, t), r AS (SELECT regime, y, (rank() OVER (PARTITION BY regime ORDER BY p) + (count(*) OVER (PARTITION BY regime, p) - 1) / 2) AS r FROM l) SELECT regime, count(*) AS n, count(*) FILTER (y = 1) AS positives, CASE WHEN count(*) FILTER (y = 1) >= 10 THEN round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) END AS auc FROM r GROUP BY 1")
def terciles(v: Views) -> DataFrame:
    """The highest third has no positives here, so its AUC is NULL."""
    p = v.preds
    cut = selection.quantiles(p, "vol", [2 / 3]).select(F.col("q")[0].alias("_c"))  # one row
    return metrics.terciles(p.join(F.broadcast(cut)).withColumn("y", F.when(F.col("vol") > F.col("_c"), 0).otherwise(F.col("y"))).drop("_c"), "vol").withColumn("auc", F.round("auc", 8))


SQL_GRID = """, pq AS (SELECT model, quantile_cont(p, [k / 100.0 FOR k IN range(1, 101)]) AS q FROM preds GROUP BY 1),
th AS (SELECT DISTINCT model, round(t, 6) AS theta FROM (SELECT model, unnest(q) AS t FROM pq UNION ALL SELECT model, k * 0.005::DOUBLE FROM pq, range(121) r(k))),
cg AS (SELECT th.model, theta, count(*) FILTER (p <= theta + 1e-9) AS kept, count(*) FILTER (p <= theta + 1e-9 AND y = 0) AS good, count(*) AS n, count(*) FILTER (y = 0) AS base FROM th JOIN preds USING (model) GROUP BY 1, 2)
"""


@query("D39_D40_percentile_curve", SQL_GRID + "SELECT model, theta, round(kept / n, 8) AS coverage, round(good / nullif(kept, 0), 8) AS precision, round(good / base, 8) AS recall, round(good / nullif(kept, 0) / (base / n), 8) AS lift FROM cg")
def percentile_curve(v: Views) -> DataFrame:
    p = v.preds
    return metrics.curve_at(p, metrics.theta_grid(p, ["model"]), ["model"]).withColumns({c: F.round(c, 8) for c in ("coverage", "precision", "recall", "lift")})


@query("I08_wide_means", ", w AS (SELECT d, fold, round(avg(p) FILTER (model = 'm0'), 8) AS m0, round(avg(p) FILTER (model = 'm1'), 8) AS m1, round(avg(p) FILTER (model = 'm2'), 8) AS m2, round(avg(p) FILTER (model = 'm3'), 8) AS m3 FROM preds GROUP BY 1, 2) SELECT * FROM w")
def stacking(v: Views) -> DataFrame:
    wide = v.preds.groupBy("d", "fold").pivot("model", ["m0", "m1", "m2", "m3"]).agg(F.avg("p"))
    return wide.select("d", "fold", *[F.round(m, 8).alias(m) for m in ("m0", "m1", "m2", "m3")])


@query("I14_scalers", "SELECT model, round(avg(vol), 6) AS mean, round(stddev_pop(vol), 6) AS deviation, round(median(vol), 6) AS middle, round(quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25), 6) AS spread FROM preds GROUP BY 1")
def scalers(v: Views) -> DataFrame:
    q = selection.quantiles(v.preds, "vol", [0.25, 0.5, 0.75], ["model"])
    s = v.preds.groupBy("model").agg(F.avg("vol").alias("mean"), F.stddev_pop("vol").alias("deviation")).join(q, "model")
    return s.select("model", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round(F.col("q")[1], 6).alias("middle"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("spread"))


@query("I13_ridge", """, n AS (SELECT count(*) AS n, sum(p) AS sp, sum(p * p) AS pp, sum(p * vol) AS pv, sum(vol) AS sv, sum(vol * vol) AS vv, sum(2 * y - 1) AS t, sum(p * (2 * y - 1)) AS pt, sum(vol * (2 * y - 1)) AS vt FROM preds),
m AS (SELECT n + 0.001::DOUBLE AS a, sp AS b, sv AS c, pp + 0.001 AS d, pv AS e, vv + 0.001 AS f, t, pt, vt FROM n),
z AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM m)
SELECT term, round(w, 6) + 0.0 AS weight FROM (SELECT 'bias' AS term, (t * (d * f - e * e) - b * (pt * f - e * vt) + c * (pt * e - d * vt)) / det AS w FROM z UNION ALL SELECT 'p', (a * (pt * f - e * vt) - t * (b * f - e * c) + c * (b * vt - pt * c)) / det FROM z UNION ALL SELECT 'vol', (a * (d * vt - pt * e) - b * (b * vt - pt * c) + t * (b * e - d * c)) / det FROM z)""")
def ridge(v: Views) -> DataFrame:
    w = learners.ridge_weights(v.preds, ["p", "vol"], "y")
    return v.spark.createDataFrame([(k, round(float(x), 6) + 0.0) for k, x in w.items()], "term string, weight double")


@query("I12_I15_forest")
def forest(v: Views) -> DataFrame:
    """A random forest for each fold, trained on the folds before it; trees are random, so rows alone are compared."""
    df = v.preds.select("event_id", "fold", "y", "p", "vol", "ret")
    return forests.forest_by_fold(df, ["p", "vol", "ret"], "y", "fold", "event_id")


OLD, NEW = "volume % 3 <> 0", "volume % 3 <> 1"


@query("A15_A26_upsert", f"SELECT stock_id, trade_date, close_price FROM bars WHERE {OLD} AND NOT {NEW} UNION ALL SELECT stock_id, trade_date, close_price + 1 FROM bars WHERE {NEW}")
def upsert(v: Views) -> DataFrame:
    b = v.bars.select("stock_id", "trade_date", "close_price", "volume")
    new = b.where(NEW).withColumn("close_price", F.col("close_price") + 1)
    return merges.upsert(b.where(OLD), new, ["stock_id", "trade_date"], [F.desc("volume")]).drop("volume")


@query("A16_A18_insert_ignore", f"SELECT stock_id, trade_date, close_price FROM bars WHERE {NEW} AND NOT {OLD}")
def insert_ignore(v: Views) -> DataFrame:
    b = v.bars.select("stock_id", "trade_date", "close_price", "volume")
    return merges.insert_ignore(b.where(OLD).drop("volume"), b.where(NEW), ["stock_id", "trade_date"], [F.desc("volume")]).select("stock_id", "trade_date", "close_price")


@query("A19_write_once", "SELECT article_id, coalesce(push_count, 7) AS push_count FROM articles")
def write_once(v: Views) -> DataFrame:
    a = v.articles.select("article_id", "push_count")
    return merges.write_once(a, a.withColumn("push_count", F.lit(7).cast("long")), ["article_id"], ["push_count"])


@query("A20_E16_keyed_update", "SELECT article_id, CASE WHEN article_id % 2 = 0 THEN NULL ELSE sentiment_score END AS sentiment_score FROM articles")
def keyed_update(v: Views) -> DataFrame:
    a = v.articles.select("article_id", "sentiment_score")
    new = a.where("article_id % 2 = 0").withColumn("sentiment_score", F.lit(None).cast("double"))
    return merges.update(a, new, ["article_id"], ["sentiment_score"])


@query("A21_owned_merge", f"SELECT coalesce(o.stock_id, n.stock_id) AS stock_id, coalesce(o.trade_date, n.trade_date) AS trade_date, coalesce(n.close_price + 1, o.close_price) AS close_price, o.volume AS volume FROM (SELECT * FROM bars WHERE {OLD}) o FULL JOIN (SELECT * FROM bars WHERE {NEW}) n ON o.stock_id = n.stock_id AND o.trade_date = n.trade_date")
def owned_merge(v: Views) -> DataFrame:
    b = v.bars.select("stock_id", "trade_date", "close_price", "volume")
    return merges.owned_merge(b.where(OLD), b.where(NEW).withColumn("close_price", F.col("close_price") + 1), ["stock_id", "trade_date"], ["volume"])


@query("C17_G05_H16_differences", f"""SELECT stock_id, trade_date, CASE WHEN bool_or(o) AND bool_or(n) THEN 'both' WHEN bool_or(o) THEN 'left_only' ELSE 'right_only' END AS side, CASE WHEN bool_or(o) AND bool_or(n) THEN 'close_price' ELSE '' END AS changed
FROM (SELECT stock_id, trade_date, volume, TRUE AS o, FALSE AS n FROM bars WHERE {OLD} UNION ALL SELECT stock_id, trade_date, volume, FALSE, TRUE FROM bars WHERE {NEW}) GROUP BY 1, 2 HAVING NOT (bool_or(o) AND bool_or(n)) OR max(volume) FILTER (o) % 2 = 0""")
def differences(v: Views) -> DataFrame:
    b = v.bars.select("stock_id", "trade_date", "close_price", "volume")
    new = b.where(NEW).withColumn("close_price", F.when(F.col("volume") % 2 == 0, F.col("close_price") + 1).otherwise(F.col("close_price") + 1e-9))
    return merges.differences(b.where(OLD), new, ["stock_id", "trade_date"], ["close_price", "volume"])
