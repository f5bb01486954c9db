"""Gradient boosted trees by histograms, level by level, all folds in the same jobs.

Features are put into quantile bins once. A round fits one tree a model: for each level one groupBy gives the sums of
gradients and second derivatives by (model, node, feature, bin), whatever the rows; the best split of each node is the one with
the largest gain, and a leaf is worth -G / (H + penalty). Model k is trained on the folds before k and tells fold k, so a
row is there once for each model it trains and once for the one that tells it. Rows of one fold, label and bins always have
the same margin, so the rounds run over these cells and how many rows each has: at most folds * labels * bins ** features of
them, whatever the rows, and never more than rows. Gradients are summed as whole millionths, so trees depend neither on
the order of sums nor on cells. Splits, some 2 ** depth numbers a model and round, are all the driver keeps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import selection
from barograph.sources.shared import stored

UNIT = 1_000_000
#: Rounds, depth and rate of the two library models, and the penalty that each has by default.
ROUNDS, DEPTH, RATE, PENALTY = 50, 4, 0.05, {"xgb": 1.0, "lgbm": 0.0}


def edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Inner borders of `bins` bins by exact quantiles; equal ones once."""
    shares = [k / bins for k in range(1, bins)]
    out = {}
    for c in features:
        row = selection.quantiles(df, c, shares).first()
        out[c] = sorted(set(row["q"])) if row else []
    return out


def binned(value: Column, borders: list[float]) -> Column:
    """How many borders lie below the value; a NULL is below all."""
    return reduce(lambda a, b: a + F.coalesce((value > b).cast("int"), F.lit(0)), borders, F.lit(0))


class Boosted:
    """Fitted trees: splits[round][model][node of a level] = (feature, bin), leaves[round][model][node] = value."""

    def __init__(self, features: list[str], borders: dict[str, list[float]], depth: int, rate: float):
        self.features, self.borders, self.depth, self.rate = features, borders, depth, rate
        self.splits: list[dict[int, dict[tuple[int, int], tuple[int, int]]]] = []
        self.leaves: list[dict[int, dict[int, float]]] = []

    def node(self, r: int, model: Column, levels: int) -> Column:
        """The node of a row after `levels` levels of round r: 0 to 2 ** levels - 1; a node without a split leads left."""
        at: Column = F.lit(0)
        for level in range(levels):
            right = F.lit(0)
            for m, nodes in self.splits[r].items():
                for (k, n), (f, b) in nodes.items():
                    if k == level:
                        right = F.when((model == m) & (at == n), (F.col(f"_b{f}") > b).cast("int")).otherwise(right)
            at = at * 2 + right
        return at

    def step(self, r: int, model: Column, node: Column) -> Column:
        """What round r adds to the margin."""
        out: Column = F.lit(0.0)
        for m, values in self.leaves[r].items():
            for n, v in values.items():
                out = F.when((model == m) & (node == n), F.lit(v)).otherwise(out)
        return self.rate * out


def rows_in_bins(df: DataFrame, features: list[str], y: str, fold: str, key: str, borders: dict[str, list[float]]) -> DataFrame:
    return df.where(F.col(y).isNotNull()).select(F.col(key).alias("_key"), F.col(y).cast("int").alias("_y"), F.col(fold).alias("_fold"), *[binned(F.col(c), borders[c]).alias(f"_b{i}") for i, c in enumerate(features)])


def _cells(rows: DataFrame, bins: list[str], ids: list[int]) -> DataFrame:
    """_y, _fold and bins with the number of rows, once for each model that they train and for the one that tells them."""
    models = F.array(*[F.lit(k) for k in ids[1:]])
    cells = rows.groupBy("_y", "_fold", *bins).agg(F.count(F.lit(1)).alias("_n"))
    return cells.withColumn("_model", F.explode(models)).where(F.col("_fold") <= F.col("_model")).withColumn("_train", F.col("_fold") < F.col("_model"))


def fit_by_fold(df: DataFrame, features: list[str], y: str, fold: str, key: str, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, penalty: float = PENALTY["xgb"], bins: int = 32, told: Callable[[Boosted], None] | None = None) -> DataFrame:
    """key, fold, probability for every row of all folds but the first; borders come from the first fold, which all models train on.

    Rows without label are left out; a NULL feature falls into the lowest bin.
    """
    ids = sorted(r[0] for r in df.select(fold).distinct().collect())  # a few folds
    borders = edges(df.where(F.col(fold) == ids[0]), features, bins) if ids else dict.fromkeys(features, [])
    model = Boosted(features, borders, depth, rate)
    each_row, own = rows_in_bins(df, features, y, fold, key, borders), [f"_b{i}" for i in range(len(features))]
    rows = stored(_cells(each_row, own, ids).withColumn("_margin", F.lit(0.0)), "boosting")
    m = F.col("_model")
    for r in range(rounds):
        p = 1 / (1 + F.exp(-F.col("_margin")))
        graded = rows.where("_train").withColumn("_g", F.round((p - F.col("_y")) * UNIT).cast("long") * F.col("_n")).withColumn("_h", F.round(p * (1 - p) * UNIT).cast("long") * F.col("_n"))
        model.splits.append({})
        for level in range(depth):
            placed = graded.withColumn("_node", model.node(r, m, level))
            each = placed.select("_model", "_node", "_g", "_h", F.posexplode(F.array(*own)).alias("_f", "_b"))
            sums = each.groupBy("_model", "_node", "_f", "_b").agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h"))
            for s in best_splits(sums, penalty).collect():  # models times nodes
                model.splits[r].setdefault(s["_model"], {})[level, s["_node"]] = (s["_f"], s["_b"])
        node = model.node(r, m, depth)
        leaves = graded.groupBy("_model", node.alias("_node")).agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()  # models times leaves
        model.leaves.append({})
        for x in leaves:
            model.leaves[r].setdefault(x["_model"], {})[x["_node"]] = -(x["g"] / UNIT) / (x["h"] / UNIT + penalty) if x["h"] or penalty else 0.0
        rows = stored(rows.withColumn("_margin", F.col("_margin") + model.step(r, m, node)), "boosting")
    if told:
        told(model)
    told_cells = rows.where("NOT _train").select("_y", "_fold", *own, (1 / (1 + F.exp(-F.col("_margin")))).alias("probability"))
    return each_row.join(told_cells, ["_y", "_fold", *own]).select(F.col("_key").alias(key), F.col("_fold").alias(fold), "probability")


def best_splits(sums: DataFrame, penalty: float) -> DataFrame:
    """Of sums by (model, node, feature, bin) the split with the most gain of each node: rows of the bins up to _b go left.

    Both sides must have some second derivative; equal gains go to the first feature and bin, and a node without gain has no row.
    """
    w = Window.partitionBy("_model", "_node", "_f").orderBy("_b")
    upto, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_model", "_node", "_f")
    x = lambda c, over: F.sum(c).over(over) / F.lit(float(UNIT))
    df = sums.withColumns({"gl": x("_g", upto), "hl": x("_h", upto), "g": x("_g", all_), "h": x("_h", all_)})
    worth = lambda g, h: g * g / (h + F.lit(float(penalty)))
    gain = worth(F.col("gl"), F.col("hl")) + worth(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - worth(F.col("g"), F.col("h"))
    fair = df.where((F.col("hl") > 0) & (F.col("h") - F.col("hl") > 0)).withColumn("gain", F.round(gain, 9)).where("gain > 0")
    best = Window.partitionBy("_model", "_node").orderBy(F.desc("gain"), "_f", "_b")
    return fair.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("_model", "_node", "_f", "_b", "gain")
