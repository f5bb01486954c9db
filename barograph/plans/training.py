"""Queries of training preparation, fold reports, the second stage and calibration quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import stacking, training
from barograph.plans.models import SQL_FOLDS
from barograph.plans.registry import query
from barograph.sources.fixtures import Views

KEYS = ["stock_id", "trade_date"]
#: A feature table by arithmetic on volume, the same text in both dialects: values in hundredths, NULL at a period of its own.
_PERIOD = {"return_1d": 1009, "rsi_14": 13, "volatility_5d": 1013, "volatility_20d": 17, "amplitude": 1019, "ma5_bias": 1021, "ma20_bias": 19, "volume_ratio": 1031, "sentiment": 3, "sentiment_3d": 5, "sentiment_5d": 4, "sentiment_lag1": 7, "sentiment_lag2": 11, "bullishness": 3, "agreement": 3}
COLUMNS = {c: f"CASE WHEN volume % {m} <> 0 THEN CAST((volume * {i + 3}) % 101 AS DOUBLE) / 100 END" for i, (c, m) in enumerate(_PERIOD.items())} | {"article_count": "volume % 4", "target": "CASE WHEN volume % 23 <> 0 THEN volume % 2 END"}
SQL_FEAT = ", feat AS (SELECT stock_id, trade_date, close_price, " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM bars)\n"


def feat(v: Views) -> DataFrame:
    return v.bars.select(*KEYS, "close_price", *[F.expr(e).alias(c) for c, e in COLUMNS.items()])


def _cols(names: list[str]) -> str:
    return ", ".join(["stock_id", "trade_date", *names])


@query("B11_arm_b", SQL_FEAT + f"SELECT {_cols(training.ARM_B)} FROM feat")
def arm_b(v: Views) -> DataFrame:
    return training.arm(feat(v), "B", KEYS)


@query("B12_multimodal", SQL_FEAT + "SELECT " + _cols([c if c in training.SENTIMENT and c != "article_count" else f"coalesce(CAST({c} AS DOUBLE), {50.0 if c == 'rsi_14' else 0.0}) AS {c}" for c in training.ARM_B]) + " FROM feat")
def multimodal(v: Views) -> DataFrame:
    return training.multimodal(feat(v), KEYS)


@query("B13_technical_only", SQL_FEAT + "SELECT " + _cols([f"coalesce({c}, 0.0) AS {c}" for c in training.TECHNICAL]) + " FROM feat")
def technical_only(v: Views) -> DataFrame:
    return training.technical_only(feat(v), KEYS)


_MISSING = " OR ".join(f"{c} IS NULL" for c in training.ARM_A)


@query("B14_fold_data", SQL_FEAT + f"SELECT {_cols(['target', 'sentiment'])} FROM feat WHERE target IS NOT NULL AND NOT ({_MISSING})")
def fold_data(v: Views) -> DataFrame:
    return training.fold_data(feat(v), training.ARM_B, training.SENTIMENT, "target").select(*KEYS, "target", "sentiment")


@query("B14_exclusions", SQL_FEAT + f"SELECT stock_id, count(*) AS rows, count(*) FILTER (target IS NULL) AS n_target_null_excluded, count(*) FILTER (target IS NOT NULL AND ({_MISSING})) AS n_feature_null_excluded FROM feat GROUP BY 1")
def exclusions(v: Views) -> DataFrame:
    return training.excluded(feat(v), ["stock_id"], training.ARM_B, training.SENTIMENT, "target")


@query("B15_row_sets", SQL_FEAT + "SELECT stock_id, trade_date, 'left_only' AS side FROM feat WHERE article_count = 0 UNION ALL SELECT stock_id, trade_date, 'right_only' FROM feat WHERE article_count = 1")
def row_sets(v: Views) -> DataFrame:
    f = feat(v)
    return training.row_set_difference(f.where("article_count <> 1"), f.where("article_count <> 0"), KEYS)


@query("B16_B17_signal_rows", SQL_FEAT + "SELECT stock_id, count(*) FILTER (article_count > 0 OR sentiment_5d IS NOT NULL) AS signal_rows, count(*) AS rows FROM feat WHERE stock_id IN (SELECT stock_id FROM feat WHERE sentiment IS NOT NULL) GROUP BY 1")
def signal_rows(v: Views) -> DataFrame:
    f = feat(v)
    return f.join(training.sentiment_stocks(f), "stock_id", "left_semi").groupBy("stock_id").agg(F.count_if(training.signal_mask()).alias("signal_rows"), F.count(F.lit(1)).alias("rows"))


@query("B18_before_boundary", "SELECT stock_id, trade_date FROM bars")
def before_boundary(v: Views) -> DataFrame:
    return training.rejecting(v.bars.select(*KEYS), "trade_date", "2100-01-01")


@query("C21_regime_lookup", "SELECT event_id, fold, fold % 2 AS regime FROM preds")
def regime_lookup(v: Views) -> DataFrame:
    dim = v.spark.range(6).select(F.col("id").cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("regime"))
    return training.lookup(v.preds.select("event_id", "fold"), dim, ["fold"])


SQL_EDGE = """, dy AS (SELECT fold, d, row_number() OVER (PARTITION BY fold ORDER BY d) <= 5 AS edge FROM (SELECT DISTINCT fold, d FROM preds)),
pe AS (SELECT fold, edge, k.class, count(*) FILTER (y3 = k.class AND h3 = k.class) AS tp, count(*) FILTER (y3 <> k.class AND h3 = k.class) AS fp, count(*) FILTER (y3 = k.class) AS support FROM preds JOIN dy USING (fold, d), (VALUES (-1), (0), (1)) k(class) GROUP BY 1, 2, 3),
bi AS (SELECT fold, edge, class, coalesce(2 * tp / nullif(support + tp + fp, 0), 0) AS f1 FROM pe WHERE (fold, class) IN (SELECT (fold, class) FROM pe WHERE support > 0 GROUP BY fold, class HAVING count(*) = 2)),
bf AS (SELECT fold, round(avg(f1) FILTER (edge), 8) AS boundary_macro_f1, round(avg(f1) FILTER (NOT edge), 8) AS interior_macro_f1, count(DISTINCT class) AS common_classes FROM bi GROUP BY 1)
"""


def _edges(v: Views) -> DataFrame:
    b = training.boundary_interior(v.preds, ["fold"], "d", 5)
    return b.withColumns({c: F.round(c, 8) for c in ("boundary_macro_f1", "interior_macro_f1")})


@query("D31_boundary_interior", SQL_EDGE + "SELECT * FROM bf")
def boundary_interior(v: Views) -> DataFrame:
    return _edges(v)


@query("D32_leakage_summary", SQL_EDGE + ", s AS (SELECT count(*) AS n_folds, median(boundary_macro_f1 - interior_macro_f1) AS m, avg(CAST(boundary_macro_f1 > interior_macro_f1 AS INTEGER)) AS f FROM bf) SELECT n_folds, round(m, 6) AS median_delta, round(f, 6) AS frac_positive, f >= 0.7 AND m >= 0.05 AS flagged FROM s")
def leakage(v: Views) -> DataFrame:
    return training.leakage_summary(_edges(v)).withColumns({c: F.round(c, 6) for c in ("median_delta", "frac_positive")})


SQL_FOLD_F1 = """, ff AS (SELECT {by}, fold, avg(f1) AS f FROM (SELECT {by}, fold, k.class, coalesce(2 * count(*) FILTER (y3 = k.class AND h3 = k.class) / nullif(count(*) FILTER (y3 = k.class) + count(*) FILTER (h3 = k.class), 0), 0) AS f1 FROM {rows}, (VALUES (-1), (0), (1)) k(class) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT {by}, round(median(f), 8) AS median, round(avg(f), 8) AS mean, round(min(f), 8) AS least, round(max(f), 8) AS greatest FROM ff GROUP BY 1"""
SPREAD = ["median", "mean", "least", "greatest"]


@query("D33_fold_summary", SQL_FOLD_F1.format(by="model", rows="preds"))
def fold_summary(v: Views) -> DataFrame:
    return training.fold_summary(v.preds, ["model"]).withColumns({c: F.round(c, 8) for c in SPREAD})


@query("M38_subsets", ", su AS (SELECT *, 'full' AS subset FROM preds UNION ALL SELECT *, 'signal' FROM preds WHERE ret > 0 UNION ALL SELECT *, 'confident' FROM preds WHERE p >= 0.8)" + SQL_FOLD_F1.format(by="subset", rows="su"))
def subsets(v: Views) -> DataFrame:
    return training.subset_summary(v.preds, {"full": F.lit(True), "signal": F.col("ret") > 0, "confident": F.col("p") >= 0.8}).withColumns({c: F.round(c, 8) for c in SPREAD})


SQL_GATE = "count(*) AS n, count(*) FILTER (p <= 0.3) AS kept, round(count(*) FILTER (p <= 0.3) / count(*), 8) AS coverage, round(count(*) FILTER (p <= 0.3 AND y = 0) / nullif(count(*) FILTER (p <= 0.3), 0), 8) AS precision, round(count(*) FILTER (p <= 0.3 AND y = 0) / nullif(count(*) FILTER (y = 0), 0), 8) AS recall, round(count(*) FILTER (y = 0) / count(*), 8) AS random_precision"


@query("D42_D44_gate_rule", f"SELECT model, {SQL_GATE} FROM preds GROUP BY 1")
def gate_rule(v: Views) -> DataFrame:
    return training.gate_metrics(v.preds, ["model"], F.col("p") <= 0.3).withColumns({c: F.round(c, 8) for c in ("coverage", "precision", "recall", "random_precision")})


@query("D45_fold_stability", f"SELECT fold, {SQL_GATE} FROM preds GROUP BY 1")
def fold_stability(v: Views) -> DataFrame:
    return training.gate_metrics(v.preds, ["fold"], F.col("p") <= 0.3).withColumns({c: F.round(c, 8) for c in ("coverage", "precision", "recall", "random_precision")})


SETS = "CASE fold % 2 WHEN 0 THEN 'technical' ELSE 'multimodal' END"


@query("D46_M42_leaderboard", f""", sc AS (SELECT model, {SETS} AS feature_set, round(avg(CAST(y3 = h3 AS INTEGER)), 8) AS macro_f1, round(avg(CAST((p >= 0.5) = (ret > 0) AS INTEGER)), 8) AS hit_ratio FROM preds GROUP BY 1, 2),
pt AS (SELECT s.model, s.feature_set, s.macro_f1, s.hit_ratio, 0.7 * s.macro_f1 + 0.3 * s.hit_ratio AS points, s.macro_f1 - b.macro_f1 AS alpha FROM sc s LEFT JOIN sc b ON b.model = s.model AND b.feature_set = 'technical')
SELECT model, feature_set, macro_f1, hit_ratio, round(points, 7) AS points, round(alpha, 7) AS alpha, CAST(row_number() OVER (ORDER BY points DESC, model, feature_set) AS INTEGER) AS place, row_number() OVER (ORDER BY points DESC, model, feature_set) = 1 AS champion FROM pt""")
def leaderboard(v: Views) -> DataFrame:
    s = v.preds.groupBy("model", F.when(F.col("fold") % 2 == 0, "technical").otherwise("multimodal").alias("feature_set")).agg(F.round(F.avg((F.col("y3") == F.col("h3")).cast("double")), 8).alias("macro_f1"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("ret") > 0)).cast("double")), 8).alias("hit_ratio"))
    return training.leaderboard(s).withColumns({c: F.round(c, 7) for c in ("points", "alpha")})


@query("D50_importances", ", w AS (SELECT model, 'f' || fold AS feature, abs(sum(ret)) AS a FROM preds GROUP BY 1, 2), i AS (SELECT model, feature, round(a / sum(a) OVER (PARTITION BY model), 6) AS importance FROM w) SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i")
def importances(v: Views) -> DataFrame:
    w = v.preds.groupBy("model", F.concat(F.lit("f"), F.col("fold").cast("string")).alias("feature")).agg(F.sum("ret").alias("weight"))
    return training.importances(w, ["model"])


@query("I21_latest_signal", SQL_FEAT + "SELECT stock_id, max(trade_date) AS trade_date, arg_max(coalesce(agreement, 0.0), trade_date) AS probability, CASE WHEN arg_max(coalesce(agreement, 0.0), trade_date) >= 0.5 THEN 'UP' ELSE 'DOWN' END AS signal FROM feat GROUP BY 1")
def latest_signal(v: Views) -> DataFrame:
    return training.latest_signal(feat(v).withColumn("agreement", F.coalesce("agreement", F.lit(0.0))), "agreement")


@query("I16_pairs", "SELECT m AS model, a AS arm FROM (SELECT DISTINCT ['lr', 'rf', 'lgbm', 'xgb'][CAST(substr(model, 2) AS INTEGER) + 1] AS m FROM preds), (VALUES ('A'), ('B')) q(a) WHERE m <> 'lr' OR a = 'A'")
def pairs(v: Views) -> DataFrame:
    name = F.get(F.array(*[F.lit(m) for m in training.MODELS]), F.substring("model", 2, 1).cast("int"))
    return training.model_arm_pairs(v.spark).join(v.preds.select(name.alias("model")).distinct(), "model", "left_semi")


@query("D49_priors", "SELECT fold, y3, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fold), 8) AS prior FROM preds GROUP BY 1, 2")
def priors(v: Views) -> DataFrame:
    return training.class_priors(v.preds, ["fold"], "y3").withColumn("prior", F.round("prior", 8))


SQL_SEGMENTS = SQL_FOLDS + ", sg AS (SELECT f.fold, s.trade_date AS test_start, e.trade_date AS test_end FROM fo f JOIN cal s ON s.i = f.c JOIN cal e ON e.i = f.d)\n"
HOLDOUT = "1996-06-01"


@query("I07_G08_segments", SQL_SEGMENTS + f"SELECT *, CASE WHEN test_end < DATE '{HOLDOUT}' THEN 'oof' WHEN test_start >= DATE '{HOLDOUT}' THEN 'holdout' ELSE 'neither' END AS segment FROM sg")
def fold_segments(v: Views) -> DataFrame:
    from barograph.operators.universe import calendar
    from barograph.plans.models import SPLIT

    panel = v.bars.select(*KEYS)
    cal, bounds = calendar(panel), SPLIT.bounds(panel)
    day = lambda c, name: cal.select(F.col("i").alias(c), F.col("trade_date").alias(name))
    return stacking.segments(bounds.join(day("test_from", "test_start"), "test_from").join(day("test_to", "test_end"), "test_to").select("fold", "test_start", "test_end"), HOLDOUT)


SQL_OOF = """, ro AS (SELECT user_id AS u, d, fold, ['lr', 'rf', 'lgbm', 'xgb'][CAST(user_id % 4 AS INTEGER) + 1] AS model, CAST(sum(CAST(round(p * 1000) AS BIGINT)) * 200000 + count(*) AS BIGINT) // (2 * count(*)) AS p FROM preds JOIN (SELECT event_id, user_id FROM events) USING (event_id) GROUP BY ALL),
oof AS (SELECT d, fold, max(p) FILTER (model = 'lr') AS lr_A_p1, max(p) FILTER (model = 'rf') AS rf_A_p1, max(p) FILTER (model = 'lgbm') AS lgbm_A_p1, max(p) FILTER (model = 'xgb') AS xgb_A_p1 FROM (SELECT d, fold, model, (CAST(2 * sum(p) + 100 * count(*) AS BIGINT) // (200 * count(*))) / 1e6::DOUBLE AS p FROM ro GROUP BY ALL) GROUP BY 1, 2)
"""


def _oof_rows(v: Views) -> DataFrame:
    u = v.table("events").select("event_id", "user_id")
    name = F.get(F.array(*[F.lit(m) for m in training.MODELS]), (F.col("user_id") % 4).cast("int"))
    # means to 8 and then to 6 places, rounded once each, over whole numbers: sums do not depend on their order
    one = v.preds.join(u, "event_id").groupBy("user_id", "d", "fold", name.alias("model")).agg(F.sum(F.round(F.col("p") * 1000).cast("long")).alias("s"), F.count(F.lit(1)).alias("n")).withColumn("p", F.expr("(s * 200000 + n) div (2 * n)"))
    two = one.groupBy("d", "fold", "model").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    return two.select("d", "fold", "model", (F.expr("(2 * s + 100 * n) div (200 * n)") / F.lit(1e6)).alias("p1"), F.lit("A").alias("arm"))


def _oof(v: Views) -> DataFrame:
    return stacking.oof_matrix(_oof_rows(v), ["d", "fold"], ["p1"])


@query("I08_oof_matrix", SQL_OOF + "SELECT * FROM oof")
def oof_matrix(v: Views) -> DataFrame:
    return _oof(v)


@query("I09_second_stage_purge", "SELECT event_id, d, CASE WHEN fold = 0 THEN 'meta_eval' WHEN event_id % 5 = 0 OR d + 5 >= DATE '2024-01-20' THEN 'purged' ELSE 'meta_train' END AS segment FROM preds")
def second_stage(v: Views) -> DataFrame:
    df = v.preds.select("event_id", "d", F.when(F.col("fold") == 0, "meta_eval").otherwise("meta_train").alias("segment"), F.when(F.col("event_id") % 5 != 0, F.date_add("d", 5)).alias("label_end_date"))
    return stacking.second_stage_purge(df, "2024-01-20").drop("label_end_date")


WIDE = [f"{m}_A_p1" for m in training.MODELS]


@query("I10_meta_input", SQL_OOF + f"SELECT d, fold, {', '.join(WIDE)} FROM oof WHERE {' AND '.join(f'{c} IS NOT NULL' for c in WIDE)}")
def meta_input(v: Views) -> DataFrame:
    return stacking.meta_input(_oof(v), ["d", "fold"], WIDE)


@query("I10_meta_exclusions", SQL_OOF + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n FROM oof" for c in WIDE) + " UNION ALL SELECT 'any', count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in WIDE) + ") FROM oof")
def meta_exclusions(v: Views) -> DataFrame:
    return stacking.meta_exclusions(_oof(v), WIDE)


@query("I11_H15_H17_long_predictions", SQL_OOF + " UNION ALL ".join(f"SELECT d, fold, '{m}' AS model, CASE WHEN 1 - {m}_A_p1 >= {m}_A_p1 THEN 0 ELSE 1 END AS prediction FROM oof WHERE {m}_A_p1 IS NOT NULL" for m in training.MODELS))
def long_predictions(v: Views) -> DataFrame:
    df = _oof(v).withColumns({f"{m}_A_{t}": e for m in training.MODELS for t, e in (("0", 1 - F.col(f"{m}_A_p1")),)})
    return stacking.long_predictions(df, ["d", "fold"], training.MODELS, [0, 1])


@query("H17_H18_normalise", "SELECT event_id, round(1 / (1 + exp(-greatest(least(p * 30 - 15, 10), -10))), 8) AS sig, round((p + 0.1) / (2 * p + 0.3), 8) AS first FROM preds")
def normalise(v: Views) -> DataFrame:
    p = F.col("p")
    return v.preds.select("event_id", F.round(stacking.sigmoid(p * 30 - 15), 8).alias("sig"), F.round(stacking.normalised([p + 0.1, p + 0.2])[0], 8).alias("first"))


def _sql_newton(steps: int) -> str:
    """Platt's Newton steps one after another; six reach the fixed point to more digits than are compared."""
    out = ["w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        out.append(f"s{k} AS MATERIALIZED (SELECT a, b, sum(e * p) - 1e-6 * a AS ga, sum(e) AS gb, sum(v * p * p) + 1e-6 AS aa, sum(v * p) AS ab, sum(v) + 1e-12 AS bb FROM (SELECT a, b, p, y - q AS e, q * (1 - q) AS v FROM (SELECT a, b, p, y, 1 / (1 + exp(-(a * p + b))) AS q FROM preds, w{k} WHERE fold < 3)) GROUP BY a, b)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT a + (ga * bb - gb * ab) / (aa * bb - ab * ab) AS a, b + (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM s{k})")
    return ", " + ",\n".join(out) + f"\nSELECT event_id, p, round(1 / (1 + exp(-(a * p + b))), 6) AS calibrated FROM preds, w{steps} WHERE fold >= 3"


@query("I17_platt", _sql_newton(6))
def platt(v: Views) -> DataFrame:
    """Platt's two numbers on folds 0 to 2, applied to the others."""
    a, b = stacking.platt(v.preds.where("fold < 3"), "p", "y")
    return v.preds.where("fold >= 3").select("event_id", "p", F.round(1 / (1 + F.exp(-(a * F.col("p") + b))), 6).alias("calibrated"))


@query("I19_calibration_quality", """, cq AS (SELECT fold, y, p, p * p AS q FROM preds), r AS (SELECT fold, y, (rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2) AS r FROM cq),
a AS (SELECT fold, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS x FROM r GROUP BY 1)
SELECT fold, x AS auc_before, x AS auc_after, (SELECT count(DISTINCT p) FROM cq c WHERE c.fold = a.fold) AS values_before, (SELECT count(DISTINCT p) FROM cq c WHERE c.fold = a.fold) AS values_after, TRUE AS monotone, TRUE AS preserved, abs(x - (1 - x)) <= 0.02 AS mirrored FROM a""")
def calibration_quality(v: Views) -> DataFrame:
    df = v.preds.withColumn("q", F.col("p") * F.col("p"))
    return stacking.calibration_quality(df, ["fold"], "p", "q", "y").withColumns({c: F.round(c, 8) for c in ("auc_before", "auc_after")})


@query("I20_holdout_isolation", "SELECT count(*) FILTER (d < DATE '2024-01-20') AS before, count(*) FILTER (d >= DATE '2024-01-20') AS after, count(*) FILTER (d >= DATE '2024-01-20') = 0 AS isolated, count(*) FILTER (d < DATE '2024-01-20') = 0 AS holdout_only FROM preds")
def holdout_isolation(v: Views) -> DataFrame:
    return stacking.holdout_isolation(v.preds, "d", "2024-01-20")


def _sql_logistic(steps: int) -> str:
    out = ["m AS (SELECT DISTINCT fold AS m FROM preds WHERE fold > (SELECT min(fold) FROM preds))", "t AS MATERIALIZED (SELECT m, event_id, fold, y, p FROM preds JOIN m ON fold <= m)", "w0 AS (SELECT m, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a FROM m)"]
    for k in range(steps):
        out.append(f"s{k} AS MATERIALIZED (SELECT m, a, b, sum(e) AS gb, sum(e * p) - a AS ga, sum(v) AS bb, sum(v * p) AS ab, sum(v * p * p) + 1 AS aa FROM (SELECT m, a, b, p, y - q AS e, q * (1 - q) AS v FROM (SELECT m, a, b, p, y, 1 / (1 + exp(-(a * p + b))) AS q FROM t JOIN w{k} USING (m) WHERE fold < m)) GROUP BY m, a, b)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT m, a + (ga * bb - gb * ab) / (aa * bb - ab * ab) AS a, b + (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM s{k})")
    return ", " + ",\n".join(out) + f"\nSELECT event_id, fold, round(1 / (1 + exp(-(a * p + b))), 6) AS probability FROM t JOIN w{steps} USING (m) WHERE fold = m"


@query("I12_I15_logistic", _sql_logistic(6))
def logistic(v: Views) -> DataFrame:
    """A logistic model for each fold on the folds before it, all in the same jobs."""
    from barograph.operators import learners

    return learners.logistic_by_fold(v.preds.select("event_id", "fold", "y", "p"), ["p"], "y", "fold", "event_id").withColumn("probability", F.round("probability", 6))
