"""What the training-data operators share: tables, the shared folder, hot keys and gapless ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The separators of the word rule `[^\x20\x09-\x0D]+`, as a Java and Python character class.
SPACE_CLASS = r"[ \x09-\x0D]"


#: Most bytes of a batch that goes to a Python worker; texts of thousands of rows at once would be held as Arrow, as strings and in the JVM.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; batches for Python are kept small for the session, unless it says how large they are."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; the warehouse stands in where none is set (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_barograph"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, fixes what tasks decided."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what `materialise` wrote for this frame, once nothing that is still to run reads it."""
    if path := getattr(df, "written_to", None):
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def in_pandas(df: DataFrame, run, schema: str, ids: list[str]) -> DataFrame:
    """`mapInPandas` that hands the long columns `ids` through as text.

    pandas makes doubles of a batch of longs with a null in it, and so other ids of those beyond 2**53.
    """
    out = T._parse_datatype_string(schema)
    said = T.StructType([T.StructField(f.name, T.StringType() if f.name in ids else f.dataType) for f in out.fields])
    made = df.select(*[F.col(c).cast("string").alias(c) if c in ids else F.col(c) for c in df.columns]).mapInPandas(run, said)
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out.fields])


def unused(name: str, taken: list[str]) -> str:
    """`name`, or with underscores what no column of `taken` is called, whatever the case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def text_bytes(text: Column) -> Column:
    """UTF-8 length; null counts none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """The fold rule of the contracts: crc32 of doc_id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def hot_keys(counts: DataFrame, key: str, n: str, total: int, share: int) -> DataFrame:
    """Keys that hold more than 1/share of all rows: fewer than `share` by arithmetic, so safe to broadcast."""
    return counts.where(F.col(n) * F.lit(share) > F.lit(total)).select(key)


def join_skewed(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, n: str, total: int, how: str = "left", share: int = 1000) -> DataFrame:
    """Join on a key of which some values hold a large part of `left`; `right` has one row a key.

    Values over 1/share of all rows (under `share` of them, so their list may come to the driver) meet a
    broadcast of their rows of `right`; all the others are shuffled, none of them more than 1/share of the rows.
    Where there are no such values it is a plain join. No row is left out.
    """
    hot = [F.lit(row[0]) for row in hot_keys(counts, key, n, total, share).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    warm = left.where(~is_hot).join(right, key, how)
    return warm.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def gapless_rank(df: DataFrame, groups: list[str], spread: Column, order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Position of each row within its group, from 0 and without gaps, in no task that holds a whole group.

    Rows of a group are spread over `buckets` parts and numbered there; the parts' sizes, summed up in
    order, give each part its start. `groups` times `buckets` sizes are broadcast, so the number of groups
    must be bounded by a parameter. Call it on a materialised frame: sizes and numbers read it twice.
    """
    part = df.withColumn("_part", F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = part.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    numbered = part.withColumn("_in", inside - 1)
    return numbered.join(F.broadcast(starts), [*groups, "_part"]).withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_start", "_in")


def open_store(uri: str):
    """(pyarrow file system, path) of a folder in the shared store, for tasks that write or read whole files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_atomic(uri: str, name: str, data: bytes) -> None:
    """Write under another name, then move: a second attempt of the same task replaces equal bytes."""
    store, base = open_store(uri)
    store.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as out:
        out.write(data)
    store.move(tmp, f"{base}/{name}")
