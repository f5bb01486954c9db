"""Connected components by hooking to smaller neighbours and pointer jumping, as Spark joins; no part comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import forget, join_skewed, materialise


def _roots(parent: DataFrame) -> DataFrame:
    """parent(id, comp) with comp < id, a forest -> the same with the root of each; hot parents meet a broadcast."""
    total = parent.count()
    while True:
        counts = parent.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        up = parent.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        jumped = materialise(join_skewed(parent, up, "comp", counts, "n", total).select("id", F.coalesce("root", "comp").alias("comp"), F.col("root").isNotNull().alias("moved")), "roots")
        forget(parent)
        if jumped.where("moved").isEmpty():
            return jumped
        parent = jumped


def _relabelled(edges: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Distinct edges (a, b), a > b, between the labels of their ends; edges within one label go."""
    for side in ("a", "b"):
        counts = edges.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        named = labels.select(F.col("id").alias(side), F.col("comp").alias("_label"))
        edges = join_skewed(edges, named, side, counts, "n", total).withColumn(side, F.coalesce("_label", side)).drop("_label")
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def followed(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(id, comp) led on to the components that their own components belong to, found(id, comp)."""
    counts = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    up = found.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    return join_skewed(labels, up, "comp", counts, "n", max(1, labels.count())).select("id", F.coalesce("root", "comp").alias("comp"))


def roots(parent: DataFrame) -> DataFrame:
    """A forest parent(id, comp), materialised, comp < id, an id once -> (id, comp) of all its nodes, roots among them; no rows for none."""
    if parent.isEmpty():
        return parent
    found = _roots(parent).select("id", "comp")
    return materialise(found.unionByName(found.select(F.col("comp").alias("id"), "comp").distinct()), "labels")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (id, comp): comp is the least id reachable. Ids without an edge do not appear.

    Nulls in either column drop the edge, loops and repeated edges do no harm, no edges give no rows.
    Each round hooks a node to its least smaller neighbour, follows the hooks to their roots and draws the
    edges anew between roots; at least every second root goes, and edges inside a component are gone.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    labels = None
    while total := edges.count():
        hooks = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")), "hooks")
        found = _roots(hooks)
        older_edges, older = edges, labels
        edges = materialise(_relabelled(edges, found, total), "edges")
        both = found.select("id", "comp")
        if labels is not None:  # what was a root before may have a new one
            both = followed(labels, found).unionByName(both)
        labels = materialise(both, "labels")
        for read in (older_edges, found, *([older] if older is not None else [])):
            forget(read)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    # roots never hook: they name themselves
    return labels.unionByName(labels.select(F.col("comp").alias("id"), "comp").distinct())
