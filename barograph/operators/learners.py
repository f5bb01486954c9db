"""Models: ridge by normal equations, logistic models by Newton steps, Spark's own classifiers, scalers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import selection


def ridge_weights(df: DataFrame, features: list[str], y: str, penalty: float = 1e-3) -> dict[str, float]:
    """(X'X + penalty I) w = X'(2y - 1), a column of ones first; sums on the executors, the small system here."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    t = 2 * F.col(y) - 1
    k = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(cols[i] * t).alias(f"t{i}") for i in range(k)]).first()
    if row["t0"] is None:
        return dict.fromkeys(["bias", *features], 0.0)
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
    return dict(zip(["bias", *features], np.linalg.solve(gram, [row[f"t{i}"] for i in range(k)]), strict=True))


def logistic_by_fold(df: DataFrame, features: list[str], y: str, fold: str, key: str, penalty: float = 1.0, steps: int = 12) -> DataFrame:
    """Key, fold, probability of every fold but the first by a logistic model of the rows before it.

    Newton steps on sums: one groupBy a step gives the gradient and second derivatives of all folds' models at once; the
    driver solves a small system a fold. The squared weights are penalised, the bias is not. Rows with a NULL label or feature are left out.
    """
    ids = sorted(r[0] for r in df.select(fold).distinct().collect())  # a few folds
    known = df.dropna(subset=[y, *features]).select(F.col(key).alias("_key"), F.col(y).cast("double").alias("_y"), F.col(fold).alias("_fold"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    k = len(features) + 1
    rows = known.withColumn("_model", F.explode(F.array(*[F.lit(i) for i in ids[1:]]))).where(F.col("_fold") <= F.col("_model"))
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(len(features))]]
    weights = {m: np.zeros(k) for m in ids[1:]}

    def probability():
        table = F.create_map(*[v for m, w in weights.items() for v in (F.lit(m), F.array(*[F.lit(float(a)) for a in w]))])
        own = table[F.col("_model")]
        return 1 / (1 + F.exp(-sum((own[i] * x[i] for i in range(1, k)), own[0] * x[0])))

    ridge = penalty * np.diag([0.0, *[1.0] * len(features)])
    train = rows.where(F.col("_fold") < F.col("_model"))
    for _ in range(steps if weights else 0):
        t = train.withColumn("_p", probability())
        e, v = F.col("_y") - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
        sums = t.groupBy("_model").agg(*[F.sum(e * x[i]).alias(f"g{i}") for i in range(k)], *[F.sum(v * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
        moved = 0.0
        for r in sums:
            w = weights[r["_model"]]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge
            step = np.linalg.lstsq(h, np.array([r[f"g{i}"] for i in range(k)]) - ridge @ w, rcond=None)[0]
            weights[r["_model"]] = w + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    told = rows.where(F.col("_fold") == F.col("_model"))
    return told.select(F.col("_key").alias(key), F.col("_fold").alias(fold), (probability() if weights else F.lit(0.5)).alias("probability"))


def ridge_predict(df: DataFrame, weights: dict[str, float], limit: float = 10.0):
    """Sigmoid of the clipped linear score."""
    z = sum((F.lit(w) if k == "bias" else F.lit(w) * F.col(k).cast("double") for k, w in weights.items()), F.lit(0.0))
    return df.withColumn("probability", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-limit)), F.lit(limit)))))


def scaled(df: DataFrame, train: DataFrame, by: list[str], columns: list[str], robust: bool = False) -> DataFrame:
    """Columns less mean or median, by population deviation or interquartile range (1 where that is 0), as `train` has them."""
    out = df
    for c in columns:
        if robust:
            q = selection.quantiles(train, c, [0.25, 0.5, 0.75], by)
            known = q.select(*by, F.col("q")[1].alias(f"_m_{c}"), (F.col("q")[2] - F.col("q")[0]).alias(f"_d_{c}"))
        else:
            known = train.groupBy(*by).agg(F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_d_{c}"))
        out = out.join(known, by, "left") if by else out.join(F.broadcast(known))  # one row
    wide = lambda c: F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}"))
    return out.select(*[((F.col(c) - F.col(f"_m_{c}")) / wide(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def classifier(name: str, features: str, label: str, seed: int = 42):
    """Lr, rf or a boosted forest (lgbm and xgb share Spark's own, at their own depth and rate)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"featuresCol": features, "labelCol": label}
    if name == "lr":
        return LogisticRegression(maxIter=500, **common)
    if name == "rf":
        return RandomForestClassifier(numTrees=50, maxDepth=5, seed=seed, **common)
    if name in ("lgbm", "xgb"):
        return GBTClassifier(maxIter=50, maxDepth=4, stepSize=0.05, seed=seed, **common)
    raise ValueError(f"unknown model {name}")
