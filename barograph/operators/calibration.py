"""Calibrators fitted on some folds and applied to others: isotonic by pooling adjacent violators, and one a class.

Rows are summed by distinct score first. Scores in order are dealt over partitions; each pools its own neighbours, and
the blocks that are left, of all partitions, are pooled again in order: pooling parts and then their blocks gives the
blocks of the whole. Labels are 0 and 1, so the means of the blocks are fractions that rise, and at most some
n ** (2 / 3) of them have denominators that sum up to n rows: that many blocks, not n rows, meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_FOLDS, EVAL_FOLDS = (27, 28, 29), (30, 31, 32)
_BLOCKS = "lo double, hi double, n long, s long"


def disjoint(fit: list[int] | tuple[int, ...], evaluate: list[int] | tuple[int, ...]) -> None:
    """Raises if a fold is in both sets."""
    if both := sorted(set(fit) & set(evaluate)):
        raise ValueError(f"folds in both sets: {both}")


def only_folds(df: DataFrame, fold: str, allowed: list[int] | tuple[int, ...]) -> DataFrame:
    """The same rows; the job fails at one of another fold."""
    odd = ~F.coalesce(F.col(fold).isin(list(allowed)), F.lit(False))
    said = F.concat(F.lit("not a fold to fit on: "), F.coalesce(F.col(fold).cast("string"), F.lit("NULL")))
    return df.where(F.when(odd, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))  # a filter, as a column that nobody reads is not computed


def pooled(blocks: Iterator[tuple[float, float, int, int]]) -> list[list]:
    """Blocks (lo, hi, rows, ones) in order of scores, neighbours pooled until the means rise; whole numbers are compared."""
    out: list[list] = []
    for lo, hi, n, s in blocks:
        out.append([lo, hi, int(n), int(s)])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, s = out.pop()
            out[-1] = [out[-1][0], hi, out[-1][2] + n, out[-1][3] + s]
    return out


def _frame(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(pooled(b[["lo", "hi", "n", "s"]].itertuples(index=False, name=None)), columns=["lo", "hi", "n", "s"])


def isotonic(train: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, lo, hi, n, s, value: the blocks of the isotonic fit of 0/1 labels; rows without score or label do not count."""
    by = by or []
    kinds = [train.select(*by).schema[c].simpleString().split(":", 1)[1] for c in by]
    head = ", ".join(f"`{c}` {k}" for c, k in zip(by, kinds, strict=True))
    schema = f"{head}, {_BLOCKS}" if head else _BLOCKS
    tied = train.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("s"))
    tied = tied.select(*by, "lo", F.col("lo").alias("hi"), "n", "s")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # sorted; each batch of a partition is pooled alone
            for key, rows in b.groupby(by, sort=False, dropna=False) if by else [((), b)]:
                done = _frame(rows)
                yield pd.concat([pd.DataFrame({c: [k] * len(done) for c, k in zip(by, key, strict=True)}), done], axis=1)

    first = tied.repartitionByRange(*by, "lo").sortWithinPartitions(*by, "lo").mapInPandas(part, schema)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        done = _frame(rows.sort_values("lo"))
        return pd.concat([pd.DataFrame({c: [rows[c].iloc[0]] * len(done) for c in by}), done], axis=1)

    out = first.groupBy(*by).applyInPandas(whole, schema)
    return out.withColumn("value", F.col("s").cast("double") / F.col("n"))


class Isotonic:
    """A fitted calibrator: flat within a block, linear between blocks, flat beyond the ends. Its knots, two a block, are on the driver."""

    def __init__(self, blocks: DataFrame):
        b = blocks.select("lo", "hi", "value").toPandas().sort_values("lo")
        self.x, self.v = b[["lo", "hi"]].to_numpy().ravel(), b["value"].repeat(2).to_numpy()

    def __call__(self, score: Column) -> Column:
        x, v = self.x, self.v

        @F.pandas_udf("double")
        def at(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s, x, v) if len(x) else np.full(len(s), np.nan)).where(s.notna().to_numpy())

        return at(score.cast("double"))


class Platt:
    """sigmoid(a score + b)."""

    def __init__(self, a: float, b: float):
        self.a, self.b = a, b

    def __call__(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.a) * score + F.lit(self.b))))


def fit(train: DataFrame, p: str, y: str, fold: str, method: str, folds: list[int] | tuple[int, ...] = FIT_FOLDS):
    """A calibrator, a function of a score column, fitted on rows of the given folds alone."""
    rows = only_folds(train, fold, folds)
    if method == "isotonic":
        return Isotonic(isotonic(rows, p, y))
    if method == "sigmoid":
        from barograph.operators.stacking import platt

        return Platt(*platt(rows, p, y))
    raise ValueError(f"unknown method {method}")


def one_vs_rest(train: DataFrame, scores: dict[int, str], y: str) -> dict[int, Isotonic]:
    """I17, three classes: an isotonic calibrator for each class's own score, all fitted in one job."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score"), (F.col(y) == k).cast("int").alias("hit")) for k, c in scores.items()]))
    rows = train.where(F.col(y).isNotNull()).select(each.alias("x")).select("x.*")
    blocks = isotonic(rows, "score", "hit", ["class"]).toPandas()  # n ** (2 / 3) rows a class at most
    spark = train.sparkSession
    kinds = "class int, lo double, hi double, n long, s long, value double"
    return {k: Isotonic(spark.createDataFrame(blocks[blocks["class"] == k], kinds)) for k in scores}
