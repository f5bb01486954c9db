"""Random forests of gini trees by histograms, level by level, the trees of all folds in the same jobs.

Features are put into quantile bins once. Rows of one fold, label and bins are alike to every tree, so what is fitted are
these cells: at most folds * labels * bins ** features of them, whatever the rows, and never more than rows. A tree's
bootstrap takes each row a Poisson(1) number of times, so a cell of n rows a Poisson(n) number, drawn from the cell's own
seed. A level is one pass: tasks count the bootstrapped rows of their cells by (model, tree, node, feature, bin, label) and
Spark sums the counts. They are whole numbers, so forests do not depend on how rows are dealt. As in Spark's forest a node
looks at about the square root of the features, splits where gini falls most, and two leaves of one prediction are merged; a
probability is the mean of the leaves' shares. Nodes, some 2 ** depth a tree, are all the driver keeps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import boosting
from barograph.sources.shared import stored

TREES, DEPTH, BINS, SEED = 50, 5, 32, 42


class Forests:
    """The trees of all models as heaps, by model, tree and node: feature (-1: a leaf), bin (up to it rows go left), counts by label."""

    def __init__(self, folds: list, trees: int, depth: int, features: int, seed: int):
        self.folds, self.trees, self.depth, inner = folds, trees, depth, 2**depth - 1
        shape = len(folds), trees, 2 * inner + 1
        self.feature, self.bin, self.counts = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros((*shape, 2), np.int64)
        drawn = np.random.default_rng(seed).random((len(folds), trees, inner, features))
        self.may = drawn.argsort(-1).argsort(-1) < math.ceil(math.sqrt(features))

    def node(self, m: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Of rows of bins: the node of each tree after `levels` levels; a leaf keeps its rows."""
        at, each = np.zeros((len(bins), self.trees), np.int64), np.arange(self.trees)[None, :]
        for _ in range(levels):
            f = self.feature[m][each, at]
            right = np.take_along_axis(bins, np.maximum(f, 0), 1) > self.bin[m][each, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def split(self, m: int, t: int, node: int, f: int, b: int, left: list[int], right: list[int]) -> None:
        self.feature[m, t, node], self.bin[m, t, node] = f, b
        self.counts[m, t, 2 * node + 1], self.counts[m, t, 2 * node + 2] = left, right

    def merge_leaves(self) -> None:
        """A node above two leaves that predict the same label becomes a leaf, from below upwards."""
        says = self.counts[..., 1] > self.counts[..., 0]
        for n in range(2**self.depth - 2, -1, -1):
            left, right = 2 * n + 1, 2 * n + 2
            alike = (self.feature[..., left] < 0) & (self.feature[..., right] < 0) & (says[..., left] == says[..., right])
            self.feature[..., n] = np.where(alike, -1, self.feature[..., n])

    def probability(self, m: int, bins: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees; one whose bootstrap was empty has no vote, and without votes it is a half."""
        n = self.counts[m][np.arange(self.trees)[None, :], self.node(m, bins, self.depth)]
        total = n.sum(-1)
        votes = (total > 0).sum(1)
        share = (n[..., 1] / np.maximum(total, 1)).sum(1)
        return np.where(votes > 0, share / np.maximum(votes, 1), 0.5)


def bags(cell: int, n: int, trees: int, seed: int) -> np.ndarray:
    """How often the bootstrap of each tree takes rows of a cell of n rows."""
    return np.random.Generator(np.random.Philox(key=[cell & (1 << 64) - 1, seed])).poisson(n, trees)


def fit_cells(known: DataFrame, own: list[str], trees: int, seed: int) -> DataFrame:
    """_y, _fold, bins and _w, the times that each tree takes rows of the cell."""
    cells = known.groupBy("_y", "_fold", *own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.xxhash64("_y", "_fold", *own))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            taken = [bags(c, n, trees, seed) for c, n in zip(b["_cell"].tolist(), b["_n"].tolist(), strict=True)]
            yield b.drop(columns=["_n", "_cell"]).assign(_w=taken)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name not in ("_n", "_cell"))
    cores = known.sparkSession.sparkContext.defaultParallelism
    dealt = cells.repartition(2 * cores, "_cell")  # few bytes but many trees: all cores get some
    return stored(dealt.mapInPandas(draw, f"{schema}, _w array<long>"), "cells")


def level_sums(cells: DataFrame, own: list[str], forests: Forests, level: int, bins: int) -> DataFrame:
    """m, t, node, f, b, n0, n1: bootstrapped rows by label of the nodes of a level, for the features that each may look at."""
    first, wide, k = 2**level - 1, 2**level, len(own)
    shape = forests.trees, wide, k, bins, 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        base = np.arange(forests.trees)[None, :] * wide - first
        for b in batches:
            at_bins, w, y = b[own].to_numpy(np.int64), np.stack(b["_w"].to_list()), b["_y"].to_numpy(np.int64)
            for m, fold in enumerate(forests.folds):
                mine = (b["_fold"] < fold).to_numpy()
                if not mine.any():
                    continue
                node = forests.node(m, at_bins[mine], level)
                here = (node >= first) & (w[mine] > 0)  # leaves above are done
                sums = total.setdefault(m, np.zeros(math.prod(shape)))
                for f in range(k):
                    cell = (((node + base) * k + f) * bins + at_bins[mine][:, f : f + 1]) * 2 + y[mine][:, None]
                    sums += np.bincount(cell[here], w[mine][here], len(sums))
        for m, sums in total.items():
            n = sums.reshape(shape) * forests.may[m][:, first : first + wide, :, None, None]
            t, node, f, b = np.nonzero(n.sum(-1))
            two = n[t, node, f, b].astype(np.int64)
            yield pd.DataFrame({"m": m, "t": t, "node": node + first, "f": f, "b": b, "n0": two[:, 0], "n1": two[:, 1]})

    made = cells.mapInPandas(count, "m int, t int, node int, f int, b int, n0 long, n1 long")
    return made.groupBy("m", "t", "node", "f", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def best_splits(sums: DataFrame) -> DataFrame:
    """m, t, node, f, b, l0, l1, n0, n1, gain: of each node the split by which gini falls most, NULL gain if none has rows on both sides.

    Equal gains go to the first feature and bin.
    """
    side = Window.partitionBy("m", "t", "node", "f")
    upto = side.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    df = sums.select("m", "t", "node", "f", "b", *[F.sum(c).over(w).alias(a) for c, w, a in (("n0", upto, "l0"), ("n1", upto, "l1"), ("n0", side, "n0"), ("n1", side, "n1"))])
    apart = lambda a, b: a * b / (a + b)  # noqa: E731  half of rows times gini
    c = {x: F.col(x).cast("double") for x in ("l0", "l1", "n0", "n1")}
    r0, r1 = c["n0"] - c["l0"], c["n1"] - c["l1"]
    fall = 2 * (apart(c["n0"], c["n1"]) - apart(c["l0"], c["l1"]) - apart(r0, r1)) / (c["n0"] + c["n1"])
    df = df.withColumn("gain", F.when((r0 + r1 > 0) & (c["l0"] + c["l1"] > 0), F.round(fall, 12)))
    best = Window.partitionBy("m", "t", "node").orderBy(F.desc_nulls_last("gain"), "f", "b")
    return df.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def forest_by_fold(df: DataFrame, features: list[str], y: str, fold: str, key: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, bins: int = BINS, told: Callable[[Forests], None] | None = None) -> DataFrame:
    """For each fold but the first, a forest of the rows before it; (key, fold, probability).

    Borders of the bins come from the first fold, which all models train on. Folds are few. Rows with a NULL label or a
    NULL or NaN feature are left out.
    """
    whole = df.dropna(subset=[y, *features])
    ids = sorted(r[0] for r in whole.select(fold).distinct().collect())
    borders = boosting.edges(whole.where(F.col(fold) == ids[0]), features, bins) if ids else dict.fromkeys(features, [])
    own = [f"_b{i}" for i in range(len(features))]
    each_row = boosting.rows_in_bins(whole, features, y, fold, key, borders)
    cells = fit_cells(each_row, own, trees, seed)
    forests = Forests(ids[1:], trees, depth, len(features), seed)
    for level in range(depth if forests.folds else 0):
        for s in best_splits(level_sums(cells, own, forests, level, bins)).collect():  # models times trees times nodes
            if level == 0:
                forests.counts[s["m"], s["t"], 0] = s["n0"], s["n1"]
            if s["gain"] is not None and s["gain"] > 0:
                forests.split(s["m"], s["t"], s["node"], s["f"], s["b"], [s["l0"], s["l1"]], [s["n0"] - s["l0"], s["n1"] - s["l1"]])
    forests.merge_leaves()
    if told:
        told(forests)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, k in enumerate(forests.folds):
                mine = b[b["_fold"] == k]
                if len(mine):
                    yield mine.assign(probability=forests.probability(m, mine[own].to_numpy(np.int64)))

    kinds = cells.select("_fold", *own).distinct()
    said = kinds.mapInPandas(tell, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema) + ", probability double")
    return each_row.join(said, ["_fold", *own]).select(F.col("_key").alias(key), F.col("_fold").alias(fold), "probability")
