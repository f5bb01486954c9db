"""Models that are stored with what they were made of, read again for the newest rows, and digests of written tables.

A model goes into a folder: its numbers as one JSON line, or the files of the library's own writer, beside a
signature: the kind, the features in their order, the last training day and the digest of the numbers. Reading holds the
signature against what the caller expects, and the digest against what is there.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; NumPy numbers and arrays as their Python values, dates as text."""

    def plain(x):
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, np.ndarray):
            return x.tolist()
        if hasattr(x, "isoformat"):
            return x.isoformat()
        raise TypeError(f"no JSON for {type(x).__name__}")

    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=plain, ensure_ascii=False, allow_nan=False)


def _signature(kind: str, features: list[str], cut, numbers: str) -> dict:
    return {"kind": kind, "features": features, "cut": str(cut), "sha256": hashlib.sha256(numbers.encode()).hexdigest()}


def save(spark: SparkSession, path: str, kind: str, features: list[str], cut, model) -> None:
    """Replaces what is at `path`. `model` is a dict of numbers, or a model of the library, whose writer is used."""
    numbers = canonical(model) if isinstance(model, dict) else canonical({"uid": model.uid})
    if not isinstance(model, dict):
        model.write().overwrite().save(f"{path}/library")
    row = [(canonical(_signature(kind, features, cut, numbers)), numbers)]
    spark.createDataFrame(row, "signature string, numbers string").coalesce(1).write.mode("overwrite").json(f"{path}/model")


def load(spark: SparkSession, path: str, kind: str, features: list[str], cut, reader=None):
    """The model's numbers, or what `reader` (a model class of the library) reads; raises if anything of the signature is not as expected."""
    row = spark.read.schema("signature string, numbers string").json(f"{path}/model").first()
    found, wanted = json.loads(row["signature"]), _signature(kind, features, cut, row["numbers"])
    if wrong := sorted(k for k in wanted if found.get(k) != wanted[k]):
        raise ValueError("stored model differs in " + ", ".join(f"{k} ({found.get(k)} for {wanted[k]})" for k in wrong))
    return json.loads(row["numbers"]) if reader is None else reader.load(f"{path}/library")


def latest_rows(df: DataFrame, group: str = "stock_id", date: str = "trade_date") -> DataFrame:
    """The newest row of each group; only a row a group and task is shuffled."""
    w = Window.partitionBy(group).orderBy(F.desc(date))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def drivers(weights: dict[str, float], features: list[str], n: int = 3) -> Column:
    """Names of the n features that add most to a linear score, whatever their sign, the first named of equal ones."""
    each = F.array(*[F.struct((-F.abs(F.lit(float(weights[c])) * F.col(c).cast("double"))).alias("w"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(features)])
    return F.array_join(F.transform(F.slice(F.array_sort(each), 1, n), lambda x: x["c"]), ",")


def text_digests(spark: SparkSession, path: str) -> DataFrame:
    """Part, rows, sha256 of each file of a table of lines, hashed where it is read; part is the folder's value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    part = F.url_decode(F.regexp_extract("path", r"=([^/]*)/[^/]*$", 1))
    lines = F.length(F.regexp_replace(F.decode("content", "UTF-8"), "[^\n]", ""))
    return files.select(part.alias("part"), lines.cast("long").alias("rows"), F.sha2("content", 256).alias("sha256"))
