"""Purged and embargoed walk-forward folds as joins of day numbers, no loop over folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators.universe import calendar


@dataclass(frozen=True)
class WalkForward:
    """Sizes in trading days; step defaults to test."""

    train: int = 250
    test: int = 60
    step: int | None = None
    embargo: int = 5
    expanding: bool = False
    horizon: int = 5
    least_train: int | None = None

    def bounds(self, panel: DataFrame) -> DataFrame:
        """Fold, first and last day numbers of train and test; one row a fold, counted from 0."""
        if min(self.train, self.test, self.step or 1) < 1 or self.embargo < 0:
            raise ValueError("sizes must be positive")
        step = self.step or self.test
        n = calendar(panel).agg(F.max("i").alias("n"))
        folds = n.where(F.col("n") >= self.train + self.test).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - self.train - self.test) / step).cast("long"))).alias("fold"))
        start = F.col("fold") * step
        return folds.select("fold", (F.lit(1) if self.expanding else start + 1).cast("long").alias("train_from"), (start + self.train).alias("train_to"), (start + self.train + 1).alias("test_from"), (start + self.train + self.test).alias("test_to"))

    def split(self, panel: DataFrame) -> DataFrame:
        """(fold, role, stock_id, trade_date) for panel(stock_id, trade_date, label_end_date).

        Train rows go whose label ends on or after the fold's first test day, or is unknown, and those within
        `embargo` days after the test of an earlier fold. Days meet folds first, rows then join by day.
        """
        cal, folds = calendar(panel), self.bounds(panel)
        first = cal.select(F.col("i").alias("test_from"), F.col("trade_date").alias("test_start"))
        folds = folds.join(first, "test_from")
        day = folds.withColumn("i", F.explode(F.sequence("train_from", "test_to"))).withColumn("role", F.when(F.col("i") < F.col("test_from"), "train").otherwise("test"))
        barred = folds.select(F.col("fold").alias("earlier"), F.explode(F.sequence(F.col("test_to") + 1, F.col("test_to") + self.embargo)).alias("i")) if self.embargo else None
        if barred is not None:
            least = barred.groupBy("i").agg(F.min("earlier").alias("earlier"))
            day = day.join(least, "i", "left").where((F.col("role") == "test") | F.col("earlier").isNull() | (F.col("earlier") >= F.col("fold")))
        named = day.join(cal, "i").select("fold", "role", "trade_date", "test_start")
        rows = panel.select("stock_id", "trade_date", "label_end_date").join(named, "trade_date")
        keep = (F.col("role") == "test") | F.coalesce(F.col("label_end_date") < F.col("test_start"), F.lit(False))
        return rows.where(keep).select("fold", "role", "stock_id", "trade_date")

    def sizes(self, split: DataFrame) -> DataFrame:
        """Rows and days of each fold; folds with fewer train days than `least_train` are marked."""
        least = self.least_train if self.least_train is not None else max(1, self.train - self.horizon)
        c = split.groupBy("fold").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_rows") for r in ("train", "test")], F.count_distinct(F.when(F.col("role") == "train", F.col("trade_date"))).alias("train_days"))
        return c.withColumn("skipped", F.col("train_days") < least)

    def usable(self, split: DataFrame) -> DataFrame:
        """The rows of folds that have enough train days; fold numbers stay. Sizes are a row a fold."""
        return split.join(F.broadcast(self.sizes(split).where(~F.col("skipped")).select("fold")), "fold", "left_semi")
