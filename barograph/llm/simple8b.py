"""Token ids in Simple-8b: word-aligned selectors, escapes and per-block offsets.

A 64-bit word holds a 4-bit selector and as many ids as its width allows. Selector 0 is the escape: the next
word is one id as it is. Ids are packed in blocks of BLOCK; every block starts on a word of its own, and the
offset table says which, so that blocks encode and decode independently and all in step, as array operations.

File (little-endian): magic `S8B1`, u32 ids a block, u64 documents, u64 ids, u64 blocks, u64 words; then i64
doc_id and u64 id count of each document, u64 first word of each block, and the words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import in_pandas, materialise, new_path, open_store, table, write_atomic
from barograph.llm.tokens import word_bpe

MAGIC, BLOCK, END_ID, NO_ID = b"S8B1", 256, 2, -(2**63)
#: Blocks that are packed in step: some 50 bytes of working memory an id, whatever the size of the file.
IN_STEP = 4096
#: ids a word by selector (fixed by the format); selector 0 escapes, 15 holds one id of up to 60 bits.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 30, 60])
#: Bits of the ids below 2 ** 16, which those of most vocabularies are.
_SHORT = np.ceil(np.log2(np.arange(1, (1 << 16) + 1))).astype(np.uint8)
_ORDER = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 0]


def bit_length(ids: np.ndarray) -> np.ndarray:
    """Bits that each u64 id needs, 0 for 0."""
    if not len(ids) or ids.max() < len(_SHORT):
        return _SHORT[ids]
    out = np.zeros(len(ids), np.uint8)
    rest = ids
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        big = high > 0
        out += big * np.uint8(step)
        rest = np.where(big, high, rest)
    return out + (rest > 0)


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids; IN_STEP blocks advance together, a word a step."""
    words, starts, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for at in range(0, len(ids), IN_STEP * BLOCK):
        w, s = _pack_some(ids[at : at + IN_STEP * BLOCK].astype(np.uint64))
        words.append(w)
        starts.append(s + np.uint64(before))
        before += len(w)
    return np.concatenate(words), np.concatenate(starts)


def _pack_some(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    pos = np.arange(n)
    block_end = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)[pos // BLOCK]
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    # the widest of the next k ids for each k of a selector, nothing beyond the block's end; each from two shorter runs
    width = np.zeros((blocks, BLOCK + COUNTS.max()), np.uint8)
    wide = np.zeros(blocks * BLOCK, np.uint8)
    wide[:n] = bit_length(ids)
    width[:, :BLOCK] = wide.reshape(blocks, BLOCK)
    widest = {1: width}
    half = 1
    for k in sorted(set(COUNTS.tolist()) - {1}):  # none is more than twice the one before
        m = widest[half].copy()
        np.maximum(m[:, : half - k], widest[half][:, k - half :], out=m[:, : half - k])
        widest[k], half = m, k
    chosen = np.zeros((blocks, BLOCK), np.int8)
    for s in _ORDER[-2::-1]:  # a selector of more ids goes before those of fewer
        chosen[widest[int(COUNTS[s])][:, :BLOCK] <= BITS[s]] = s
    selector = chosen.reshape(-1)[:n]
    at = np.arange(blocks) * BLOCK
    live = np.arange(blocks)
    heads = np.zeros(n, bool)
    while len(live):
        here = at[live]
        heads[here] = True
        at[live] = here = here + COUNTS[selector[here]]
        live = live[here < end[live]]
    where = np.flatnonzero(heads)
    sel = selector[where]
    size = np.where(sel == 0, 2, 1)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    words = np.zeros(size.sum(), np.uint64)
    stop = block_end[where]
    for s in np.unique(sel):
        w = where[sel == s]
        if s == 0:
            words[first[sel == s] + 1] = ids[w]
            continue
        value = np.full(len(w), np.uint64(s) << np.uint64(60), np.uint64)
        for j in range(COUNTS[s]):
            inside = w + j < stop[sel == s]
            value[inside] |= ids[w[inside] + j] << np.uint64(j * BITS[s])
        words[first[sel == s]] = value
    starts = first[np.searchsorted(where, np.arange(blocks) * BLOCK)]
    return words, starts.astype(np.uint64)


def unpack_words(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids again: blocks step through their words together."""
    out = np.zeros(n, np.uint64)
    blocks = len(starts)
    at, pos = starts.astype(np.int64), np.arange(blocks) * BLOCK
    end = np.minimum(pos + BLOCK, n)
    live = np.arange(blocks)
    while len(live):
        w = words[at[live]]
        sel = (w >> np.uint64(60)).astype(np.int64)
        for s in np.unique(sel):
            mine = live[sel == s]
            if s == 0:
                out[pos[mine]] = words[at[mine] + 1]
                continue
            value, mask = w[sel == s], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                inside = pos[mine] + j < end[mine]
                out[pos[mine][inside] + j] = (value[inside] >> np.uint64(j * BITS[s])) & mask
        at[live] += np.where(sel == 0, 2, 1)
        pos[live] += COUNTS[sel]
        live = live[pos[live] < end[live]]
    return out


def dump(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts = pack_words(ids)
    head = np.array([len(doc_ids), len(ids), len(starts), len(words)], "<u8").tobytes()
    return MAGIC + np.array([BLOCK], "<u4").tobytes() + head + b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), counts.astype("<u8"), starts.astype("<u8"), words.astype("<u8")))


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file; raises ValueError where the bytes are not of this format."""
    if data[:4] != MAGIC or len(data) < 40 or int(np.frombuffer(data, "<u4", 1, 4)[0]) != BLOCK:
        raise ValueError("not a Simple-8b token file")
    docs, n, blocks, words = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    if len(data) != 40 + 8 * (2 * docs + blocks + words):
        raise ValueError("length does not match the header")
    part = np.frombuffer(data, "<u8", offset=40)
    doc_ids, rest = part[:docs].view("<i8"), part[docs:]
    counts, starts, body = rest[:docs], rest[docs : docs + blocks], rest[docs + blocks :]
    return doc_ids, counts.astype(np.int64), unpack_words(body, starts, n)


def write_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, file_ids: int = 4_000_000) -> DataFrame:
    """Encode and write `docs` in ascending doc_id order; returns file, docs, ids, sorted by file name.

    Ranges of doc_id go to tasks, each sorted; a task starts a new file at `file_ids` ids, so neither a task
    nor a file holds more than that at once. File names sort as the ids do: range, then file in it.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cols = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = cols.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), word_bpe(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int] = []
        k = 0
        size = 0

        def flush() -> pd.DataFrame:
            counts = np.array([len(x) // 4 for x in ids])
            name = f"{part:06d}-{k:06d}.s8b"
            write_atomic(folder, name, dump(np.array(names), counts, np.frombuffer(b"".join(ids), "<u4")))
            return pd.DataFrame({"file": [name], "docs": [len(names)], "ids": [int(counts.sum())]})

        for b in batches:
            for doc_id, x in zip(b["doc_id"], encoder.encode(list(b["text"])), strict=True):
                ids.append(x + end)
                names.append(NO_ID if pd.isna(doc_id) else int(doc_id))
                size += len(x) // 4 + 1
                if size >= file_ids:
                    yield flush()
                    ids, names, size, k = [], [], 0, k + 1
        if ids:
            yield flush()

    return materialise(in_pandas(ranged, write, "file string, docs long, ids long", ["doc_id"]), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """files(file, ids) -> doc_id, start, n_tokens, ids_crc32, each file decoded by one task.

    The files' first ids are sums over the list of files, a few numbers for millions of ids each.
    """
    listed = sorted((r["file"], r["ids"]) for r in files.select("file", "ids").collect())
    first = np.concatenate([[0], np.cumsum([n for _, n in listed])])
    schema = "file string, first long"
    spark = files.sparkSession
    rows = spark.createDataFrame([(f, int(a)) for (f, _), a in zip(listed, first, strict=False)], schema).repartition(max(1, min(len(listed), 10_000)), "file")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(folder)
        for b in batches:
            for name, at in zip(b["file"], b["first"], strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    doc_ids, counts, ids = load(f.read())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts, ends, strict=True)]
                shown = pd.Series(doc_ids.astype(np.int64)).astype("Int64").mask(doc_ids == NO_ID)
                yield pd.DataFrame({"doc_id": shown, "start": at + ends - counts, "n_tokens": counts, "ids_crc32": crc})

    return rows.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the end id alone; a null doc_id, stored as the least integer, comes first and is read back as null (the file format has no other room for it, so a doc_id of that very value is read as null too); rows that repeat a doc_id follow each other."""
    folder = new_path(spark, "tokens-s8b")
    return read_files(write_files(table(spark, sf_dir, "documents"), folder), folder)


QUERIES = {"op9_simple8b": op9_simple8b}
ORACLES: dict[str, str] = {}
