"""The corpus pipeline: documents that are toxic, of low quality or near copies go; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the first three return the
columns of documents, the last one row a piece. `run` writes each stage to the shared folder as Parquet and
reads it back as the next stage's input.

Defined cases: null and empty texts are not toxic, fail the quality rules' least of words, and so never reach the
packing; rows without doc_id go through all stages, and of near copies one with doc_id stays before one without;
repeated rows are near copies of each other; no documents, or none that stay, give no rows; documents may carry
further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barograph.llm import minhash, packing, quality_rules, toxicity
from barograph.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: fitted on the labelled rows among `docs`."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the language references are those of `docs`."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 on five-word shingles at 0.8: the least doc_id of each group stays."""
    return minhash.keep_one(docs, 5, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of at most 1024 tokens and their places in the sequences."""
    return packing.pack(materialise(packing.pieces(docs), "pieces"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("near-duplicates", drop_near_copies), ("packing", pack)]
#: The classifier and the tokenizer are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
