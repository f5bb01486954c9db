"""Keyed writes to a table of Parquet folders, one a partition: upsert, insert-ignore, write-once and update.

Copy on write: only the partitions that the new rows fall into are read, merged and put in place of the old ones by
a dynamic partition overwrite; the files of all others stay as they are. A merge is staged first, under a token of
the caller's: repeated with the same token, after a failure at whatever point, it puts the same staged rows in
place again, so a merge takes effect once. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MODES = ("upsert", "insert", "once", "update")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Table:
    """A table at `path` with `keys`, of which `part` is a function: rows of a key never change their partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], part: str):
        self.spark, self.path, self.keys, self.part = spark, path.rstrip("/"), keys, part
        self.schema = T.StructType([f for f in spark.createDataFrame([], schema).schema.fields if f.name != part] + [f for f in spark.createDataFrame([], schema).schema.fields if f.name == part])

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def read(self) -> DataFrame:
        if not _there(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)

    def files(self) -> DataFrame:
        """part, files, print: how many files each partition has, and a digest of their names, sizes and times."""
        rows = self.read().select(F.col(self.part), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").cast("string").alias("n"), F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct()
        each = F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "f", "n", "t"))), "\n")  # a partition's files
        return rows.groupBy(self.part).agg(F.count(F.lit(1)).alias("files"), F.md5(each.cast("binary")).alias("print"))

    def write(self, rows: DataFrame) -> None:
        """Puts rows in place of the partitions they fall into; a file a partition and task, tasks by partition."""
        rows.select(self.columns).repartition(self.part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)

    def merge(self, new: DataFrame, token: str, mode: str = "upsert", columns: list[str] | None = None, order: list[Column] | None = None, check: Column | None = None) -> dict[str, int]:
        """Merges `new` and returns how many rows were inserted and updated.

        upsert: new rows win, `columns` alone where given (others stay what they were); insert: keys that are there stay; once:
        `columns` are set where they were NULL; update: only keys that are there, `columns` overwritten, by NULL too.
        Of new rows with equal keys the first by `order` counts; without an order they must not occur. Rows for
        which `check` is not true end the merge before anything is put in place.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        stage, done = f"{self.path}__{token}", f"{self.path}__{token}/_SUCCESS"
        if not _there(self.spark, done):
            self._merged(new, mode, columns, order, check).write.mode("overwrite").parquet(stage)
        kinds = self.schema.add("_kind", "string")
        staged = self.spark.read.schema(T.StructType(kinds.fields)).parquet(stage)
        self.schema = T.StructType(kinds.fields[:-1])
        counts = {r["_kind"]: r["n"] for r in staged.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts.get("inserted", 0) + counts.get("updated", 0):
            self.write(staged.drop("_kind"))
        return {k: counts.get(k, 0) for k in ("inserted", "updated")}

    def forget(self, token: str) -> None:
        """Deletes what a merge staged, once it need not be repeated any more."""
        _drop(self.spark, f"{self.path}__{token}")

    def _merged(self, new: DataFrame, mode: str, columns: list[str] | None, order: list[Column] | None, check: Column | None) -> DataFrame:
        """All rows of the partitions touched, with what became of each: inserted, updated or kept."""
        own = [c for c in self.columns if c not in self.keys and c != self.part]
        set_ = own if columns is None else columns
        given = [c for c in own if c in new.columns]
        new = new.select(*self.keys, *([self.part] if self.part not in self.keys else []), *given)
        if check is not None:
            said = F.concat(F.lit("may not be written: "), *[x for k in self.keys for x in (F.coalesce(F.col(k).cast("string"), F.lit("NULL")), F.lit(" "))])
            new = new.withColumn(self.keys[0], F.when(F.coalesce(check, F.lit(False)), F.col(self.keys[0])).otherwise(F.raise_error(said).cast(self.schema[self.keys[0]].dataType)))
        w = Window.partitionBy(*self.keys)
        if order:
            new = new.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_r")
        else:
            twice = F.raise_error(F.lit("a key occurs twice among the new rows")).cast("boolean")
            new = new.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True))).drop("_n")
        touched = new.select(self.part).distinct()
        old = self.read().join(touched, self.part, "left_semi").withColumn("_old", F.lit(True)).alias("o")
        both = old.join(new.withColumn("_new", F.lit(True)).alias("n"), [*self.keys] if self.part in self.keys else [*self.keys, self.part], "full_outer")
        was, comes = F.col("_old").isNotNull(), F.col("_new").isNotNull()
        values = []
        for c in own:
            mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in given else F.lit(None)
            if c not in set_ or mode == "insert":
                v = F.when(was, mine).otherwise(theirs)
            elif mode == "once":
                v = F.coalesce(mine, theirs)
            else:
                v = F.when(comes, theirs).otherwise(mine)
            values.append(v.cast(self.schema[c].dataType).alias(c))
        changed = comes & was & (F.lit(True) if mode in ("upsert", "update") else F.lit(False))
        if mode == "once":
            changed = comes & was & F.exists(F.array(*[F.col(f"o.{c}").isNull() & F.col(f"n.{c}").isNotNull() for c in set_]), lambda x: x)
        kind = F.when(~was, "inserted").when(changed, "updated").otherwise("kept")
        out = both.select(*[F.col(k) for k in dict.fromkeys([*self.keys, self.part])], *values, kind.alias("_kind"))
        if mode in ("update", "once"):
            out = out.where(F.col("_kind") != "inserted")
        return out.select(*self.columns, "_kind")
