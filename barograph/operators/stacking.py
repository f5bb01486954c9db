"""Second stage: segments of folds, the out-of-fold matrix, its purge and input, long predictions, and calibration quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators.metrics import auc
from barograph.operators.training import MODELS

TOKENS = {-1: "m1", 0: "0", 1: "p1"}


def segments(folds: DataFrame, holdout) -> DataFrame:
    """folds(fold, test_start, test_end) with `segment`: oof, holdout, or neither for a fold that straddles the day."""
    day = F.lit(holdout).cast("date")
    return folds.withColumn("segment", F.when(F.col("test_end") < day, "oof").when(F.col("test_start") >= day, "holdout").otherwise("neither"))


def oof_matrix(rows: DataFrame, keys: list[str], probs: list[str], models: list[str] | None = None) -> DataFrame:
    """rows(keys, model, arm, probs) pivoted to one row a key with {model}_A_{prob} columns, NULL where a model has none.

    The job fails on another arm than A, an unknown model, or a key that a model has twice.
    """
    names = models or MODELS
    bad = F.when(F.col("arm") != "A", "arm").when(~F.col("model").isin(names), "model")
    checked = rows.withColumn("model", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("not for the matrix: "), bad))).otherwise(F.col("model")))
    once = lambda p: F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key occurs twice"))).otherwise(F.first(p))
    wide = checked.groupBy(*keys).pivot("model", names).agg(*[once(p).alias(p) for p in probs])
    single = len(probs) == 1
    return wide.select(*keys, *[F.col(m if single else f"{m}_{p}").alias(f"{m}_A_{p}") for m in names for p in probs])


def second_stage_purge(df: DataFrame, boundary) -> DataFrame:
    """Training rows of the second stage whose label reaches into its evaluation, or has no end, become `purged`."""
    late = F.col("label_end_date").isNull() | (F.col("label_end_date") >= F.lit(boundary).cast("date"))
    return df.withColumn("segment", F.when((F.col("segment") == "meta_train") & late, "purged").otherwise(F.col("segment")))


def meta_input(df: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """The allowed columns of complete rows; raises for a column that is not there."""
    if absent := [c for c in allowed if c not in df.columns]:
        raise ValueError(f"columns missing: {absent}")
    return df.select(*keys, *allowed).dropna(subset=allowed)


def meta_exclusions(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Column, n: rows that each column alone would exclude, and any of them."""
    n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in allowed], F.count_if(F.array_contains(F.array(*[F.col(c).isNull() for c in allowed]), True)).alias("any"))
    return n.unpivot([], [*allowed, "any"], "column", "n")


def argmax(probs: dict[int, Column]) -> Column:
    """Class of the greatest probability, the first of equal ones; NULL if all are."""
    best = F.greatest(*probs.values())
    out = F.lit(None).cast("int")
    for k, p in reversed(list(probs.items())):
        out = F.when(p == best, F.lit(k)).otherwise(out)
    return out


def long_predictions(df: DataFrame, keys: list[str], models: list[str], classes: list[int]) -> DataFrame:
    """Wide {model}_A_{token} columns to one row a key and model with its class, rows without one left out."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), argmax({k: F.col(f"{m}_A_{TOKENS[k]}") for k in classes}).alias("prediction")) for m in models])
    return df.select(*keys, F.inline(each)).where(F.col("prediction").isNotNull())


def sigmoid(z: Column, limit: float = 10.0) -> Column:
    """H17, I13"""
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-limit)), F.lit(limit))))


def normalised(probs: list[Column]) -> Column:
    """An array of shares; the job fails where the sum is about zero."""
    total = sum(probs[1:], probs[0])
    return F.when(total < 1e-9, F.raise_error(F.lit("one-vs-rest probabilities sum to zero"))).otherwise(F.array(*[p / total for p in probs]))


def two_columns(p: Column) -> list[Column]:
    """Probabilities of class 0 and 1 of a single column."""
    return [(1 - p).alias("p0"), p.alias("p1")]


def platt(train: DataFrame, p: str, y: str, steps: int = 12) -> tuple[float, float]:
    """(a, b) of sigmoid(a p + b) by Newton steps on sums; two numbers, nearly unpenalised (C = 1e6)."""
    a = b = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) * F.col(p) + F.lit(b))))
        e, v, x = F.col(y) - q, q * (1 - q), F.col(p)
        s = train.agg(F.sum(e * x).alias("ga"), F.sum(e).alias("gb"), F.sum(v * x * x).alias("aa"), F.sum(v * x).alias("ab"), F.sum(v).alias("bb")).first()
        if s["gb"] is None:
            return 0.0, 0.0
        ga, aa, bb = s["ga"] - 1e-6 * a, s["aa"] + 1e-6, s["bb"] + 1e-12
        det = aa * bb - s["ab"] ** 2
        da, db = (ga * bb - s["gb"] * s["ab"]) / det, (aa * s["gb"] - s["ab"] * ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def calibration_quality(df: DataFrame, by: list[str], before: str, after: str, y: str) -> DataFrame:
    """AUC before and after, whether it is kept or mirrored, distinct values, and whether the map never falls."""
    a = auc(df, by, y, before).withColumnRenamed("auc", "auc_before")
    b = auc(df, by, y, after).withColumnRenamed("auc", "auc_after")
    pairs = df.select(*by, F.col(before).alias("_x"), F.col(after).alias("_y")).distinct()
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_x")  # over distinct scores
    falls = pairs.withColumn("_f", F.coalesce(F.col("_y") < F.lag("_y").over(w) - 1e-12, F.lit(False)))
    c = falls.groupBy(*by).agg(F.count_distinct("_x").alias("values_before"), F.count_distinct("_y").alias("values_after"), (~F.bool_or("_f")).alias("monotone"))
    out = a.join(b, by).join(c, by) if by else a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    near = lambda x: F.abs(F.col("auc_after") - x) <= 0.02
    return out.withColumn("preserved", near(F.col("auc_before"))).withColumn("mirrored", near(1 - F.col("auc_before")))


def holdout_isolation(df: DataFrame, date: str, holdout) -> DataFrame:
    """One row: rows before and from the holdout day on, and whether there are only such before, or only such after."""
    late = F.col(date) >= F.lit(holdout).cast("date")
    c = df.agg(F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
    return c.withColumn("isolated", F.col("after") == 0).withColumn("holdout_only", F.col("before") == 0)
