"""Hard negatives by one-dimensional distance keys.

Largest inner products become nearest neighbours: each vector x gets one more component, sqrt(M^2 - |x|^2) with M
the largest length, and a query 0 there; then |q - x|^2 = |q|^2 + M^2 - 2 qx. Each augmented vector belongs to its
nearest pivot, and the pair (pivot, distance to it) is its key. Rows are stored in the order of the keys. Cells are
runs of the keys of one pivot; there are as many as give each some CELL rows, up to PIVOTS * BINS, and a cell that
is too large for one task is dealt over chunks.

By the triangle inequality a row of key k under a pivot at distance t from the query is at least |t - k| and at most
t + k away. A search reads the cells by that least distance, so the key interval around t grows at both ends in every
pivot at once: first the cells that hold a sixteenth of the rows, then a fourth, then all. It ends for a query
when its k best are nearer than the least distance of all that was not read, or when no cell is left that reaches
into its annulus: a query asks for the first k of scores within [low, high], so what is surely too near is not read
either. Results are exact; pivots and cell borders, taken from a bounded sample of SAMPLE rows, only decide what is read.

Scores are inner products of whole numbers below 2**53, so sums of doubles are exact in any order.

Defined cases: rows without vec_id, label or vector, or with a null or non-finite component, take no part, nor do
vectors whose squared length reaches 2**53; vectors of different lengths count as filled up with zeros; repeated
rows are rows of their own, one being the other's best positive; ties go to the smaller vec_id; anchors without a
positive or without a fitting negative give no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm.common import materialise, table

PIVOTS, BINS, SAMPLE = 32, 16, 4096
#: Rows of a cell and of a chunk, queries that meet a chunk in one task, and the shares of the rows that may matter to a query read after each round.
CELL, CHUNK, QUERIES_AT_ONCE = 2048, 8192, 2048
SHARES = (1 / 16, 1 / 4, 1.0)
#: Distances are doubles: what they decide keeps this part of the largest length from the edge.
SLACK = 2e-6
POSITIVES, NEGATIVES = 5, 3


def prepared(rows: DataFrame) -> DataFrame:
    """rid (any unique long), vec_id, label, v (whole numbers as doubles) of the rows that take part; written once."""
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = rows.where(known).where(~F.exists("embedding", odd))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    out = fine.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v")).withColumn("norm2", size).where(F.col("norm2") < 2.0**53)
    return materialise(out.withColumn("rid", F.monotonically_increasing_id()), "vectors")


def _matrix(v: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(v), dims))
    for i, x in enumerate(v):
        out[i, : len(x)] = x
    return out


def _augmented(v: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: the row nearest to the mean, then again and again the one farthest from all chosen; equal rows once."""
    chosen = [int(_distances(sample, sample.mean(0)[None]).argmin())]
    near = _distances(sample, sample[chosen])[:, 0]
    while len(chosen) < n and near.max() > 0.5:  # whole numbers: what is not equal is 1 apart, but for the added component
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Index:
    """Rows in the order of their keys. `cells`, at most PIVOTS * BINS, holds each cell's pivot, first and last key and rows."""

    def __init__(self, base: DataFrame):
        head = base.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m2"), F.max(F.size("v")).alias("dims")).first()
        self.rows, self.m2, self.dims = head["n"], head["m2"] or 0.0, head["dims"] or 0
        self.slack = SLACK * (1 + self.m2**0.5)
        pieces = max(1, self.rows // CELL)
        wide = max(1, min(BINS, round(pieces**0.5)))
        sample = base.select("v", F.xxhash64("vec_id", "rid").alias("h")).orderBy("h").limit(SAMPLE).toPandas()["v"]
        m2, dims = self.m2, self.dims
        drawn = _augmented(_matrix(sample, dims), m2)
        self.pivots = pivots = _far_apart(drawn, min(PIVOTS, -(-pieces // wide))) if self.rows else np.zeros((0, dims + 1))
        edges: list[np.ndarray] = []
        if self.rows:
            d = _distances(drawn, pivots)
            own = d.argmin(1)
            edges = [np.unique(np.quantile(d[own == p, p], np.arange(1, wide) / wide)) if (own == p).any() else np.zeros(0) for p in range(len(pivots))]

        def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                d = _distances(_augmented(_matrix(b["v"], dims), m2), pivots)
                own = d.argmin(1)
                k = d[np.arange(len(b)), own]
                cell = [p * BINS + int(np.searchsorted(edges[p], x, side="right")) for p, x in zip(own, k, strict=True)]
                yield pd.DataFrame({"rid": b["rid"], "vec_id": b["vec_id"], "label": b["label"], "v": b["v"], "cell": cell, "key": k})

        keyed = base.select("rid", "vec_id", "label", "v")
        made = keyed.mapInPandas(key, "rid long, vec_id long, label long, v array<double>, cell int, key double")
        self.table = materialise(made.repartitionByRange("cell", "key", "rid").sortWithinPartitions("cell", "key", "rid"), "keyed")
        cells = self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
        self.cells = cells.orderBy("cell").toPandas()
        chunks = {int(c): -(-int(n) // CHUNK) for c, n in zip(self.cells["cell"], self.cells["n"], strict=True)}
        self.chunks = base.sparkSession.createDataFrame(list(chunks.items()), "cell int, chunks int")

    def read(self, cells: list[int]) -> DataFrame:
        """The rows of some cells, which lie together in the files, with their chunk."""
        rows = self.table.where(F.col("cell").isin(cells)).join(F.broadcast(self.chunks), "cell")
        return rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")).drop("chunks")


def _reach(index: Index):
    """Tasks' part: for queries(rid, v, near, far, read) the cells to be read next, and the distance up to which all is read then."""
    pivots, dims, slack = index.pivots, index.dims, index.slack
    at, n = index.cells["cell"].to_numpy() // BINS, index.cells["n"].to_numpy()
    cell, first, last = (index.cells[c].to_numpy() for c in ("cell", "first", "last"))

    def plan(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
        for big in batches:
            for k in range(0, len(big), 1024):
                b = big.iloc[k : k + 1024]
                near, far, done = (b[c].to_numpy()[:, None] for c in ("near", "far", "read"))
                t = _distances(np.hstack([_matrix(b["v"], dims), np.zeros((len(b), 1))]), pivots)[:, at]
                least = np.maximum(np.maximum(t - last, first - t), 0) - slack
                matters = (least <= far) & (t + last + slack >= near)
                order = np.argsort(least, axis=1, kind="stable")
                counts = np.cumsum(np.take_along_axis(matters * n, order, 1), 1)
                enough = (counts >= share * counts[:, -1:]).argmax(1)[:, None]
                upto = np.full((len(b), 1), np.inf) if share >= 1 else np.take_along_axis(np.take_along_axis(least, order, 1), enough, 1)
                chosen = matters & (least > done) & (least <= upto)
                yield pd.DataFrame({"rid": b["rid"].to_numpy(), "upto": upto[:, 0], "cells": [cell[r].tolist() for r in chosen]})

    return plan


def _scan(dims: int, k: int, same: bool):
    """Tasks' part: one chunk against the queries that read its cell -> rid, w, score, vec_id, k at most a query and window."""

    def scan(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"rid": [], "w": [], "score": [], "vec_id": []}, dtype="int64")]
        rows = rows.sort_values("vec_id", kind="stable")  # of equal scores the first is that of the smallest id
        x, ids, labels, rids = _matrix(rows["v"], dims).T, rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["rid"].to_numpy()
        for at in range(0, len(asking) if len(rows) else 0, 128):
            part = asking.iloc[at : at + 128]
            own, label, each = part["rid"].to_numpy(), part["label"].to_numpy()[:, None], np.arange(len(part))
            s = _matrix(part["v"], dims) @ x
            s[(labels != label) | (rids == own[:, None]) if same else labels == label] = np.nan
            windows = part["low"].map(len).to_numpy()
            low, high = (_matrix(part[c], windows.max()) for c in ("low", "high"))
            for w in range(windows.max()):
                fits = (s >= low[:, w : w + 1]) & (s <= high[:, w : w + 1]) & (w < windows)[:, None]
                left = np.where(fits, s, -np.inf)
                for _ in range(k):
                    best = left.argmax(1)
                    score = left[each, best]
                    there = score > -np.inf
                    if not there.any():
                        break
                    out.append(pd.DataFrame({"rid": own[there], "w": w, "score": score[there].astype("int64"), "vec_id": ids[best[there]]}))
                    left[each, best] = -np.inf
        return pd.concat(out)

    return scan


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """queries(rid, v, label, low, high), a row a query, with arrays of score windows -> rid, w (window), rank from 1,
    score, vec_id: the first k rows of each window, of the query's own label without itself, or of other labels.

    One job a round; queries that are certain drop out after it. Chunks and blocks of queries meet by
    (cell, chunk, block), so no task holds more than CHUNK rows, some 2 * QUERIES_AT_ONCE queries and their hits.
    """
    spark, m2, slack = queries.sparkSession, index.m2, index.slack
    q2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    distance = lambda score: F.sqrt(F.greatest(q2 + m2 - 2 * score, F.lit(0.0)))
    todo = queries.withColumn("near", distance(F.array_max("high"))).withColumn("far", distance(F.array_min("low")) + slack).withColumn("read", F.lit(float("-inf")))
    todo, best, total = materialise(todo, "queries"), None, queries.count()
    blocks = max(1, -(-total // QUERIES_AT_ONCE))
    plan, w = _reach(index), Window.partitionBy("rid", "w").orderBy(F.desc("score"), "vec_id")
    for share in SHARES:
        read = materialise(todo.select("rid", "v", "near", "far", "read").mapInPandas(lambda b, s=share: plan(b, s), "rid long, upto double, cells array<int>"), "reach")
        asked = todo.join(read, "rid").withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
        asking = asked.select("rid", "v", "label", "low", "high", "block", F.explode("cells").alias("cell")).join(F.broadcast(index.chunks), "cell")
        asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        # a block of queries reads a cell's rows once; (cell, block) pairs that occur are PIVOTS * BINS * blocks at most
        pairs = read.join(todo.select("rid"), "rid").select(F.explode("cells").alias("cell"), F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block")).distinct()
        pairs = materialise(pairs, "pairs")
        cells = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # PIVOTS * BINS at most
        met = index.read(cells).join(pairs, "cell").groupBy("cell", "chunk", "block").cogroup(asking.groupBy("cell", "chunk", "block"))
        hits = met.applyInPandas(_scan(index.dims, k, same), "rid long, w int, score long, vec_id long")
        hits = hits if best is None else hits.unionByName(best.select(hits.columns))
        best = materialise(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
        kth = best.where(F.col("rank") == k).groupBy("rid").agg(F.count(F.lit(1)).alias("full"), F.min("score").alias("worst"))
        left = asked.drop("read", "cells", "block").join(kth, "rid", "left")
        certain = (F.col("full") == F.size("low")) & (distance(F.col("worst")) + slack < F.col("upto"))
        done = F.coalesce(certain, F.lit(False)) | (F.col("far") < F.col("upto"))
        todo = materialise(left.where(~done).withColumn("read", F.col("upto")).select(todo.columns), "queries")
        if share >= 1 or todo.isEmpty():
            break
    return best if best is not None else spark.createDataFrame([], "rid long, w int, score long, vec_id long, rank int")


def mine(rows: DataFrame, anchors: DataFrame | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, embedding).

    Anchors are the rows whose vec_id is among anchors(vec_id), by default those divisible by 50. Each anchor's
    positives are the first rows of its label; the negatives of a pair the first rows of other labels whose score is
    between low and high per cent of the positive's.
    """
    base = prepared(rows)
    index = Index(base)
    chosen = base.where(F.col("vec_id") % 50 == 0) if anchors is None else base.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi")
    asks = chosen.select("rid", "v", "label", "vec_id")
    every = [F.array(F.lit(x)).alias(c) for c, x in (("low", float("-inf")), ("high", float("inf")))]
    best = search(index, asks.select("rid", "v", "label", *every), positives, same=True).select("rid", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    s = F.col("positive_score")
    # an annulus needs low <= high: nothing lies between the shares of a score below 0
    able = materialise(best.where(s >= 0).withColumn("lo", F.ceil(s * low / 100).cast("double")).withColumn("hi", F.floor(s * high / 100).cast("double")).where("lo <= hi"), "pairs")
    each = able.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("w", "lo", "hi"))).alias("of"))
    asking = asks.join(each, "rid").select("rid", "v", "label", F.transform("of", lambda x: x["lo"]).alias("low"), F.transform("of", lambda x: x["hi"]).alias("high"))
    found = search(index, asking, negatives, same=False).select("rid", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    # windows are numbered among those that can hold something
    numbered = able.withColumn("w", F.row_number().over(Window.partitionBy("rid").orderBy("w")) - 1)
    out = numbered.join(found, ["rid", "w"]).join(asks.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


QUERIES = {"op11_distance_keys": op11_distance_keys}
ORACLES: dict[str, str] = {
    "op11_distance_keys": """WITH b AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, o.vec_id, o.label = a.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score FROM b a JOIN b o ON a.vec_id % 50 = 0 AND o.r <> a.r),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""
}
