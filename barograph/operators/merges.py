"""Keyed writes as new frames: upsert, insert-ignore, write-once and owned columns, safe to run twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """New rows win; among new rows of a key the last by `order`."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return old.join(new, keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Only the rows to be added: the first of each key that is not there yet."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").join(old, keys, "left_anti")


def write_once(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values only where the old one is NULL."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(renamed, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(old.columns)


def update(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keyed overwrite; a NULL in `new` overwrites too."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = old.join(renamed, keys, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(old.columns)


def owned_merge(old: DataFrame, new: DataFrame, keys: list[str], owned_by_old: list[str]) -> DataFrame:
    """Rows of either side; a column is the new one's where it has the key, save those that others own."""
    a, b = old.withColumn("_a", F.lit(True)).alias("a"), new.withColumn("_b", F.lit(True)).alias("b")
    out = a.join(b, keys, "full_outer")
    pick = [F.col(k) for k in keys] + [F.col(f"a.{c}") if c in owned_by_old else F.when(F.col("_b"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns if c not in keys]
    return out.select(*pick)


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys on one side only, or with columns that differ; the changed columns' names."""
    x, y = a.select(*keys, *columns).withColumn("_a", F.lit(True)).alias("x"), b.select(*keys, *columns).withColumn("_b", F.lit(True)).alias("y")
    j = x.join(y, keys, "full_outer")
    numeric = {f.name for f in a.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    same = {c: F.coalesce(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= tolerance, F.col(f"x.{c}").isNull() & F.col(f"y.{c}").isNull()) if c in numeric else F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns}
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    changed = F.array_compact(F.array(*[F.when(~s, F.lit(c)) for c, s in same.items()]))
    out = j.select(*keys, side.alias("side"), F.when(side == "both", F.array_join(changed, ",")).otherwise("").alias("changed"))
    return out.where((F.col("side") != "both") | (F.col("changed") != ""))


def affected(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of `old` a keyed update by `new` reaches, to be held against what was expected."""
    return old.join(new.select(*keys).distinct(), keys, "left_semi").agg(F.count(F.lit(1)).alias("affected"))


def of_known_source(df: DataFrame, column: str, sources: list[str]) -> DataFrame:
    """The same rows; the job fails at one whose source is none of the known."""
    odd = ~F.coalesce(F.col(column).isin(sources), F.lit(False))
    return df.withColumn(column, F.when(odd, F.raise_error(F.concat(F.lit("unknown source "), F.coalesce(column, F.lit("NULL"))))).otherwise(F.col(column)))


def by_known_source(df: DataFrame, column: str, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and those that are refused because their source is none of the known, or NULL."""
    known = F.coalesce(F.col(column).isin(sources), F.lit(False))
    return df.where(known), df.where(~known)
