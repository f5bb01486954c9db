"""Exact quantiles without gathering a group: selection by histogram refinement.

The values between the least and the greatest are counted in BINS equal parts; the part that holds a wanted rank
becomes the next range, from the least to the greatest value really in it, so every level parts at least these two.
Ranges of GATHER rows or fewer are sorted in one array, and a range of one value is done. A level is one pass with
partial sums: BINS counts a range, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.sources.shared import stored

BINS, GATHER = 2048, 2048


def at_ranks(df: DataFrame, value: str, ranks: DataFrame, by: list[str], bins: int = BINS, gather: int = GATHER) -> DataFrame:
    """ranks(by, rank), ranks from 0 -> by, rank, value: the value that stands there when a group is sorted; NULLs and NaNs do not count.

    A group has a bounded number of ranks. Groups and ranks together are joined to the rows once a level.
    """
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    keys = [f"_k{i}" for i in range(len(by))]
    if not keys:
        rows, keys = rows.withColumn("_k", F.lit(0)), ["_k"]
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n"))
    named = ranks.select(*([F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("_k")]), "rank")
    todo = stored(named.join(ends, keys).where(F.col("rank").between(0, F.col("n") - 1)).withColumn("before", F.lit(0).cast("long")), "ranks")
    done: list[DataFrame] = []
    span = ["lo", "hi"]
    while True:
        done.append(todo.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        todo = todo.where("lo < hi")
        wide, small = todo.where(F.col("n") > gather), todo.where(F.col("n") <= gather)
        # the ranges of a group are equal or apart, so a row is in one at most
        inside = lambda part: rows.join(part.select(*keys, *span).distinct(), keys).where(F.col("_x").between(F.col("lo"), F.col("hi")))
        sorted_ = inside(small).groupBy(*keys, *span).agg(F.sort_array(F.collect_list("_x")).alias("_all"))
        done.append(small.join(sorted_, [*keys, *span]).select(*keys, "rank", F.get("_all", (F.col("rank") - F.col("before")).cast("int")).alias("value")))
        if wide.isEmpty():
            break
        share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counts = inside(wide).groupBy(*keys, *span, F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*keys, *span).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_less", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        place = F.col("rank") - F.col("before")
        met = wide.join(counts, [*keys, *span]).where((place >= F.col("_less")) & (place < F.col("_less") + F.col("_n")))
        todo = stored(met.select(*keys, "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("n"), (F.col("before") + F.col("_less")).alias("before")), "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "rank", "value")


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, **limits: int) -> DataFrame:
    """by, q: array of the exact quantiles at `shares`, linear between neighbours; groups without values have no row."""
    by = by or []
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    asked = counted.select(*by, F.posexplode(F.array(*[F.lit(s) * (F.col("_n") - 1) for s in shares])).alias("_i", "_at")).withColumn("_low", F.floor("_at"))
    asked = stored(asked.withColumn("_part", F.col("_at") - F.col("_low")), "asked")
    ranks = asked.select(*by, "_low").union(asked.where("_part > 0").select(*by, F.col("_low") + 1)).distinct().withColumnRenamed("_low", "rank")
    found = stored(at_ranks(df, value, ranks, by, **limits), "found")
    low = found.withColumnsRenamed({"rank": "_low", "value": "_a"})
    high = found.select(*by, (F.col("rank") - 1).alias("_low"), F.col("value").alias("_b"))
    both = asked.join(low, [*by, "_low"]).join(high, [*by, "_low"], "left")
    value_ = F.when(F.col("_part") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).otherwise(F.col("_a"))
    return both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value_.alias("v")))), lambda x: x["v"]).alias("q")).where(F.size("q") > 0)
