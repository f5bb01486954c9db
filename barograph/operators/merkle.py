"""A Merkle tree over a table: rows to months, months to stocks, stocks to 256 shelves, shelves to one print.

A node's print is the md5 of its children's prints in order, so no task holds a history: a month has its days, a
stock its months, a shelf (the first byte of the stock's md5) its stocks. Two tables are compared from the top:
only where prints differ do the children meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.sources.shared import stored

LEVELS = ["shelf", "stock_id", "month"]


def leaves(df: DataFrame, columns: list[str], group: str = "stock_id", date: str = "trade_date") -> DataFrame:
    """shelf, stock_id, month, n, print: a node a month; its rows are put in order by day and then by their own print."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    month = F.date_format(date, "yyyy-MM")
    rows = F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), row.alias("p"))))
    shelf = F.substring(F.md5(F.col(group).cast("binary")), 1, 2)
    return df.groupBy(shelf.alias("shelf"), F.col(group).alias("stock_id"), month.alias("month")).agg(F.count(F.lit(1)).alias("n"), _print(rows))


def _print(children: Column) -> Column:
    return F.md5(F.array_join(F.transform(children, lambda c: c["p"]), "").cast("binary")).alias("print")


def above(nodes: DataFrame, keys: list[str], child: str) -> DataFrame:
    """The parents, by `keys`, of nodes told apart by `child`."""
    return nodes.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _print(F.sort_array(F.collect_list(F.struct(F.col(child).alias("c"), F.col("print").alias("p"))))))


class Tree:
    """All levels of a table, the months written once; `levels[k]` has the first k of LEVELS as keys."""

    def __init__(self, df: DataFrame, columns: list[str]):
        nodes = stored(leaves(df, columns), "leaves")
        self.levels = {len(LEVELS): nodes}
        for k in range(len(LEVELS) - 1, -1, -1):
            nodes = above(nodes, LEVELS[:k], LEVELS[k])
            self.levels[k] = nodes

    @property
    def root(self) -> DataFrame:
        """n, print: one row."""
        return self.levels[0]


def changed(a: Tree, b: Tree) -> DataFrame:
    """stock_id, month, rows_a, rows_b where the two tables differ; 0 where one has nothing there.

    Level by level: of the nodes under a differing parent those whose prints differ.
    """
    found = None
    for k in range(1, len(LEVELS) + 1):
        keys, sides = LEVELS[:k], []
        for name, tree in (("a", a), ("b", b)):
            nodes = tree.levels[k] if found is None else tree.levels[k].join(found.select(*keys[:-1]), keys[:-1], "left_semi")
            sides.append(nodes.select(*keys, F.col("n").alias(f"n_{name}"), F.col("print").alias(f"print_{name}")))
        found = sides[0].join(sides[1], keys, "full_outer").where(~F.col("print_a").eqNullSafe(F.col("print_b")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select("stock_id", "month", zero("n_a").alias("rows_a"), zero("n_b").alias("rows_b"))
