"""Ids beyond 2**53 beside nulls, truncated archives, clashing names and rows that repeat."""

from __future__ import annotations

import gzip
import io
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barograph.llm import minhash, packing, registry, sharding, toxicity, warc

BIG = 2**60
IDS = [BIG + 1, None, BIG + 2, BIG + 3, None, -BIG - 1, 2**63 - 1]


@pytest.fixture(scope="module")
def large_ids(tmp_path_factory) -> str:
    """Ids that doubles cannot hold, with nulls in the same batch; the first and third texts are equal."""
    d = tmp_path_factory.mktemp("large-ids")
    words = [" ".join(f"{w}{i}" for i in range(80)) + "." for w in ("alpha", "beta", "alpha", "gamma", "delta", "epsilon", "zeta")]
    docs = {"doc_id": pa.array(IDS, pa.int64()), "text": words, "lang": ["en"] * 7, "source": ["web"] * 7, "n_chars": pa.array([BIG + 5, None, *[BIG + 7] * 5], pa.int64())}
    pq.write_table(pa.table(docs), d / "documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array(IDS, pa.int64()), "url": ["u"] * 7, "html": words}), d / "pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([BIG + 1, BIG + 3], pa.int64()), "quality": [1, 0], "toxic": [0, 1]}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([BIG + 9], pa.int64()), "text": [words[3]]}), d / "benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if n.split("_")[0] not in ("op4", "op11", "op13")])
def test_ids_of_documents_are_exact(spark, large_ids, name):
    assert Counter(r["doc_id"] for r in registry.QUERIES[name](spark, large_ids).collect()) == Counter(IDS)


def test_ids_of_pages_are_exact_and_revisits_found(spark, large_ids):
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in registry.QUERIES["op4_warc_normaliser"](spark, large_ids).collect())
    assert got == Counter((i, "revisit", BIG + 1) if i == BIG + 2 else (i, "response", None) for i in IDS)


def test_the_pipeline_keeps_ids_and_other_columns(spark, large_ids):
    from barograph.llm.common import table

    docs = table(spark, large_ids, "documents")
    kept = toxicity.keep_clean(docs, toxicity.EMPTY)
    assert kept.schema == docs.schema and Counter(map(tuple, kept.collect())) == Counter(map(tuple, docs.collect()))
    import corpus_pipeline

    assert {r["doc_id"] for r in corpus_pipeline.run(spark, large_ids).collect()} <= set(IDS)


def test_near_copies_keep_a_column_named_as_the_key(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 77), (2, text, 78), (3, "other words of no kin at all", 79)], "doc_id long, text string, _row_key long")
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.select("doc_id", "_row_key").collect())) == [(1, 77), (3, 79)]


def test_truncated_archives_raise():
    records = [warc.record("response", str(i), "u", b"x" * 200, 200, "S") for i in range(3)]
    one, each = gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)
    for whole in (one, each):
        assert len(list(warc.records(warc.inflated(io.BytesIO(whole))))) == 3
        for cut in (1, 8, len(whole) // 2):  # within the trailer, all of it, within the data
            with pytest.raises(ValueError):
                list(warc.records(warc.inflated(io.BytesIO(whole[:-cut]))))


def test_rows_that_repeat_fill_few_shards(spark):
    """A third of the rows is one text without id: most of it lies in half of the shards (eight would hold it), and counts stay even."""
    rows = [(None, "the same text again and again")] * 2000 + [(i, f"text {i} of its own") for i in range(4000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 6000 and max(counts.values()) - min(counts.values()) <= 1
    hot = Counter(r["shard"] for r in got if r["doc_id"] is None)
    assert sum(sorted(hot.values(), reverse=True)[:12]) >= 1800
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert max(slots.values()) == 1


def test_patterns_never_need_more_sequences_than_best_fit():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1024, 15_000), np.minimum(1023, rng.geometric(1 / 20, 20_000)), np.full(900, 100), np.clip(rng.lognormal(5.5, 0.8, 40_000).astype(int), 1, 1023)):
        have = np.bincount(lengths, minlength=1025)
        assert sum(c for _, c in packing.plan(have, 1024)) <= sum(c for _, c in packing.best_fit(have, 1024))
    fitted, left = packing.fitted(have, 1024, packing.STAGES[1])
    assert left < 0.8 * have.sum() and sum(c for _, c in fitted) < sum(c for _, c in packing.best_fit(have, 1024))
    pairs = packing.patterns(np.bincount([1000, 24, 512, 512, 300, 700, 24], minlength=1025), 1024)
    assert {(1000, 24), (512, 512), (700, 300, 24)} <= set(pairs)


def test_simple8b_files_are_packed_in_little_memory():
    """Many blocks, in more than one step of them: the ids come back, and packing needs less than 40 bytes an id beside them."""
    import tracemalloc

    from barograph.llm import simple8b

    ids = (np.random.default_rng(3).zipf(1.3, 3_000_000) % 49_000).astype("<u4")
    ids[::9999] = 2**32 - 1
    tracemalloc.start()
    data = simple8b.dump(np.arange(1), np.array([len(ids)]), ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (simple8b.load(data)[2] == ids).all() and most < 40 * len(ids)


def test_batches_for_python_are_small(spark, tmp_path):
    """Rows of 20,000 characters: no batch holds more than some 8 MB of text, and what the session sets stays."""
    from barograph.llm import common

    spark.conf.unset(common.BATCH_BYTES[0])
    spark.range(1500).selectExpr("id", "repeat('x', 20000) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    sizes = docs.mapInPandas(lambda bs: (b.assign(n=b["text"].str.len().sum())[["n"]].head(1) for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == 30_000_000 and max(r["n"] for r in sizes) < 9_000_000
    spark.conf.set(common.BATCH_BYTES[0], "1m")
    common.table(spark, str(tmp_path), "documents")
    assert spark.conf.get(common.BATCH_BYTES[0]) == "1m"
    spark.conf.unset(common.BATCH_BYTES[0])
