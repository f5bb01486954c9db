"""Training rows: feature arms, fold cleaning with counted causes, row-set guards, leakage and fold summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators.metrics import per_class, ratio

#: The columns of each arm.
ARM_A = ["return_1d", "rsi_14", "volatility_5d", "volatility_20d", "amplitude", "ma5_bias", "ma20_bias", "volume_ratio"]
TECHNICAL = ["close_price", *ARM_A]
SENTIMENT = ["sentiment", "sentiment_3d", "sentiment_5d", "sentiment_lag1", "sentiment_lag2", "bullishness", "agreement", "article_count"]
ARM_B = [*ARM_A, *SENTIMENT]
LEGACY = [*TECHNICAL, *SENTIMENT]
ARMS = {"technical": TECHNICAL, "A": ARM_A, "B": ARM_B, "legacy": LEGACY}
MODELS = ["lr", "rf", "lgbm", "xgb"]
LEAK_SHARE, LEAK_DELTA = 0.70, 0.05


def must_be_empty(violations: DataFrame, what: str) -> None:
    """Raises with up to five of the rows; reads no more than it needs."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def arm(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """B11"""
    return df.select(*keys, *ARMS[name])


def multimodal(df: DataFrame, keys: list[str]) -> DataFrame:
    """NULL sentiment stays, an unknown index is 50, all else 0."""
    kept = [c for c in SENTIMENT if c != "article_count"]
    return df.select(*keys, *[F.col(c) if c in kept else F.coalesce(F.col(c).cast("double"), F.lit(50.0 if c == "rsi_14" else 0.0)).alias(c) for c in ARM_B])


def technical_only(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Raises if a sentiment column is asked for; NULL is 0."""
    columns = columns or TECHNICAL
    if leaked := set(columns) & set(SENTIMENT):
        raise ValueError(f"sentiment columns in a technical set: {sorted(leaked)}")
    return df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def fold_cause(features: list[str], sentiment: list[str], target: str, arm: str = "B") -> Column:
    """Why a row may not be trained on: target_null, then feature_null (sentiment may be NULL), or NULL if it may."""
    if arm == "A" and sentiment:
        raise ValueError("arm A has no sentiment columns")
    missing = reduce(lambda a, c: a | F.col(c).isNull(), [c for c in features if c not in sentiment], F.lit(False))
    return F.when(F.col(target).isNull(), "target_null").when(missing, "feature_null")


def fold_data(df: DataFrame, features: list[str], sentiment: list[str], target: str, arm: str = "B") -> DataFrame:
    """The rows that stay."""
    return df.where(fold_cause(features, sentiment, target, arm).isNull())


def excluded(df: DataFrame, by: list[str], features: list[str], sentiment: list[str], target: str, arm: str = "B") -> DataFrame:
    """Rows, and rows excluded by each cause."""
    why = fold_cause(features, sentiment, target, arm)
    count = lambda c: F.count_if(why.eqNullSafe(c))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), count("target_null").alias("n_target_null_excluded"), count("feature_null").alias("n_feature_null_excluded"))


def row_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, by multiplicity; empty if both arms hold the same rows."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("left_only")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right_only")))


def signal_mask() -> Column:
    """B16"""
    return (F.coalesce("article_count", F.lit(0)) > 0) | F.col("sentiment_5d").isNotNull()


def sentiment_stocks(df: DataFrame) -> DataFrame:
    """Stocks that ever had sentiment."""
    return df.where(F.col("sentiment").isNotNull()).select("stock_id").distinct()


def rejecting(df: DataFrame, date: str, boundary) -> DataFrame:
    """The same rows; the job fails at the first one on or after the boundary."""
    late = F.col(date) >= F.lit(boundary)
    said = F.concat(F.lit("row at or after the boundary: "), F.col(date).cast("string"))
    return df.where(F.when(late, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))  # a filter: a column that nobody reads is not computed


def lookup(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on a dimension of unique keys; the job fails where a key is there twice, as rows would double."""
    counted = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in dim.columns if c not in keys])
    value = [c for c in dim.columns if c not in keys]
    guarded = counted.select(*keys, *[F.when(F.col("_n") > 1, F.raise_error(F.lit("a key of the dimension occurs twice"))).otherwise(F.col(c)).alias(c) for c in value])
    return df.join(guarded, keys, "left")


def boundary_interior(df: DataFrame, by: list[str], date: str, horizon: int, y: str = "y3", h: str = "h3", classes: tuple = (-1, 0, 1)) -> DataFrame:
    """Macro-F1 of the first `horizon` test days and of the others, over the classes that both sides have."""
    w = Window.partitionBy(*by).orderBy(date)
    days = df.select(*by, date).distinct().withColumn("_edge", F.row_number().over(w) <= horizon)  # distinct days of a fold
    c = per_class(df.join(days, [*by, date]), [*by, "_edge"], y, h, classes)
    there = c.where("support > 0").groupBy(*by, "class").agg(F.count_distinct("_edge").alias("_sides")).where("_sides = 2").drop("_sides")
    side = lambda edge, n: F.avg(F.when(F.col("_edge") == edge, F.col("f1"))).alias(n)
    return c.join(there, [*by, "class"]).groupBy(*by).agg(side(True, "boundary_macro_f1"), side(False, "interior_macro_f1"), F.count_distinct("class").alias("common_classes"))


def leakage_summary(folds: DataFrame) -> DataFrame:
    """Whether the boundary days are better in most folds, and by how much."""
    d = folds.select((F.col("boundary_macro_f1") - F.col("interior_macro_f1")).alias("d")).where(F.col("d").isNotNull())
    s = d.agg(F.count(F.lit(1)).alias("n_folds"), F.median("d").alias("median_delta"), F.avg((F.col("d") > 0).cast("double")).alias("frac_positive"))
    return s.withColumn("flagged", F.coalesce((F.col("frac_positive") >= LEAK_SHARE) & (F.col("median_delta") >= LEAK_DELTA), F.lit(False)))


def fold_summary(df: DataFrame, by: list[str], fold: str = "fold", y: str = "y3", h: str = "h3") -> DataFrame:
    """Median, mean, least and greatest macro-F1 over folds."""
    f = per_class(df, [*by, fold], y, h).groupBy(*by, fold).agg(F.avg("f1").alias("f"))
    return f.groupBy(*by).agg(F.median("f").alias("median"), F.avg("f").alias("mean"), F.min("f").alias("least"), F.max("f").alias("greatest"))


def subset_summary(df: DataFrame, subsets: dict[str, Column], fold: str = "fold") -> DataFrame:
    """fold_summary over each named subset of the rows; a row may be in several."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in subsets.items()]))
    return fold_summary(df.withColumn("subset", F.explode(names)), ["subset"], fold)


def gate_metrics(df: DataFrame, by: list[str], keep: Column, y: str = "y") -> DataFrame:
    """What a gate keeps: rows, coverage, precision and recall of y = 0; NULL where nothing is kept."""
    good = F.col(y) == 0
    n, kept, right, base = F.count(F.lit(1)), F.count_if(keep), F.count_if(keep & good), F.count_if(good)
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return df.groupBy(*by).agg(n.alias("n"), kept.alias("kept"), d(kept, n).alias("coverage"), d(right, kept).alias("precision"), d(right, base).alias("recall"), d(base, n).alias("random_precision"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """scores(model, feature_set, macro_f1, hit_ratio) ranked by .7 F1 + .3 hits, with each one's lead over its model's technical set."""
    base = scores.where("feature_set = 'technical'").select("model", F.col("macro_f1").alias("_base"))
    out = scores.join(base, "model", "left").withColumn("points", 0.7 * F.col("macro_f1") + 0.3 * F.col("hit_ratio")).withColumn("alpha", F.col("macro_f1") - F.col("_base")).drop("_base")
    w = Window.orderBy(F.desc("points"), "model", "feature_set")  # a row a model and feature set
    return out.withColumn("place", F.row_number().over(w)).withColumn("champion", F.col("place") == 1)


def importances(weights: DataFrame, by: list[str]) -> DataFrame:
    """weights(feature, weight) to shares of absolute weight, equal ones where all are 0, and their rank."""
    w, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    a = F.abs("weight")
    share = F.when(F.sum(a).over(w) > 0, a / F.sum(a).over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return weights.withColumn("importance", F.round(share, 6)).withColumn("rank", F.row_number().over(order)).drop("weight")


def latest_signal(df: DataFrame, probability: str) -> DataFrame:
    """Each stock's last row with its signal, UP from 0.5 on."""
    last = df.groupBy("stock_id").agg(F.max_by(F.struct("trade_date", probability), "trade_date").alias("r"))
    return last.select("stock_id", "r.trade_date", F.col(f"r.{probability}").alias("probability"), F.when(F.col(f"r.{probability}") >= 0.5, "UP").otherwise("DOWN").alias("signal"))


def model_arm_pairs(spark) -> DataFrame:
    """I16: every model on both arms, but the linear one, which can't take NULL sentiment, on A alone."""
    return spark.createDataFrame([(m, a) for m in MODELS for a in ("A", "B") if m != "lr" or a == "A"], "model string, arm string")


def class_priors(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """The share of each class."""
    c = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("prior", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))))
