"""Best-fit packing by patterns: fit repeat counts of few-piece patterns to the length histogram.

Texts become pieces of at most `size` tokens. The histogram of piece lengths (as many counts as there are
lengths) comes to the driver; patterns of few lengths that fill a sequence are enumerated, their repeat counts
fitted to the histogram by non-negative least squares, rounded down within what is there, and refitted on the
rest; what remains is packed best fit, longest first, by counts. Where that needs more sequences than best fit
alone, best fit it is. Each run of the plan
says which ranks of a length go to which sequences, so pieces find their place from their rank alone.

Defined cases: null and empty texts are the end id alone; pieces of the full size stand alone under
negative sequence ids; rows that repeat are packed each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import gapless_rank, in_pandas, materialise, table
from barograph.llm.tokens import byte_bpe

SIZE, END_ID = 1024, 2
STEPS = 300
#: Pairs alone suit lengths that are spread evenly; all patterns, in part and twice, suit most others.
STAGES = (((2, 1.0),), ((SIZE, 0.8), (SIZE, 0.8)))
_RANK_BITS = 44


def pieces(docs: DataFrame, size: int = SIZE, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and number, any that tells pieces apart once they are written; a longer text's first piece takes the remainder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, number = byte_bpe(tokenizer_path), TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"], encoder.encode(list(b["text"])), strict=True):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    length = (n % size or size) if k == 0 else size
                    rows.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), number))
                    at, k, number = at + length, k + 1, number + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return in_pandas(docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, number long", ["doc_id"])


def patterns(have: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Every pattern of few documents that fills a sequence of the present lengths.

    All pairs and triples of lengths whose sum is `size`; for each length as many copies as fit, with the one or two
    lengths that close the rest; and each length with the longest that still fits. As many patterns as there are pieces
    for four of them at most, those first whose scarcest length is most frequent: more could not all be used.
    """
    lengths = np.flatnonzero(have)
    there = have > 0
    below = np.maximum.accumulate(np.where(there, np.arange(len(have)), 0))
    found: list[np.ndarray] = []

    def exact(heads: np.ndarray) -> None:
        """Heads of equal width that one present length closes; the closer is not longer than the head's last."""
        rest = size - heads.sum(1)
        whole = heads[rest == 0]
        if len(whole):
            found.append(whole)
        ok = (rest > 0) & (rest <= heads[:, -1])
        ok[ok] = there[rest[ok]]
        if ok.any():
            found.append(np.hstack([heads[ok], rest[ok, None]]))

    exact(lengths[:, None])
    for n in lengths:  # pairs of a longer and a shorter, one row of them at a time
        exact(np.stack([np.full((lengths <= n).sum(), n), lengths[lengths <= n]], 1))
        for copies in range(size // n, max(1, size // n - 4), -1):
            rest = size - copies * n
            close = int(below[rest])
            if copies > 2 and close:
                tail = [close] if close == rest else [close, int(below[rest - close])]
                found.append(np.array([[n] * copies + [x for x in tail if x]]))
            elif copies > 2 and not rest:
                found.append(np.full((1, copies), n))
        if close := int(below[size - n]):
            found.append(np.array([[n, close]]))
    most = max(256, int(have.sum()) // 4)
    rows = [(int(have[p].min()), tuple(sorted(map(int, p), reverse=True))) for block in found for p in _scarce_first(block, have, most)]
    rows = sorted(dict.fromkeys(rows), key=lambda r: (-r[0], r[1]))
    return [p for _, p in rows[:most]]


def _scarce_first(block: np.ndarray, have: np.ndarray, most: int) -> np.ndarray:
    return block if len(block) <= most else block[np.argsort(-have[block].min(1), kind="stable")[:most]]


def nnls_counts(have: np.ndarray, found: list[tuple[int, ...]]) -> np.ndarray:
    """x >= 0 that brings the patterns' lengths nearest to `have`, by accelerated projected gradient."""
    rows = np.concatenate([np.array(p) for p in found])
    cols = np.repeat(np.arange(len(found)), [len(p) for p in found])
    n = len(have)
    ones = np.bincount(cols, minlength=len(found)).astype(float)
    step = 1.0 / max(1.0, float((np.bincount(rows, ones[cols], n)).max()))  # bounds the norm of A'A by its row sums
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(STEPS):
        rest = np.bincount(rows, y[cols], n) - have
        new = np.maximum(0.0, y - step * np.bincount(cols, rest[rows], len(found)))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def best_fit(have: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: bins with the same content move together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    for length in np.flatnonzero(have)[::-1]:
        length, left = int(length), int(have[length])
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = size // length
                whole, odd = divmod(left, each)
                for k, c in ((each, whole), (odd, 1)):
                    if k and c:
                        open_bins.setdefault(size - k * length, []).append(((length,) * k, c))
                left = 0
            else:
                content, c = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                used = min(c, left)
                if used < c:
                    open_bins.setdefault(room, []).append((content, c - used))
                open_bins.setdefault(room - length, []).append(((*content, length), used))
                left -= used
    for bins in open_bins.values():
        done += bins
    return done


def fitted(have: np.ndarray, size: int, stages: tuple[tuple[int, float], ...]) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(pattern, repeats) and how many pieces no pattern took, which are packed best fit.

    A stage is (most pieces of a pattern, part of its count that is placed): only full patterns are placed, and what a part
    leaves keeps the rest flexible.
    """
    rest, out = have.astype(np.int64).copy(), []
    for width, part in stages:
        found = [p for p in patterns(rest, size) if len(p) <= width and sum(p) == size]
        if not found:
            continue
        x = nnls_counts(rest.astype(float), found)
        for i in np.argsort(-x, kind="stable"):
            want = int(np.floor(x[i] * part + 1e-9))
            if want < 1:
                break
            kinds, times = np.unique(np.array(found[i]), return_counts=True)
            c = min(want, int((rest[kinds] // times).min()))
            if c > 0:
                rest[kinds] -= c * times
                out.append((found[i], c))
    return out + best_fit(rest, size), int(rest.sum())


def plan(have: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up `have` (counts by length, 0 to size) exactly: of the ways in STAGES, and best fit alone,
    that with the fewest sequences, of equal ones that whose patterns take most pieces."""
    made = [(best_fit(have, size), int(have.sum())), *[fitted(have, size, s) for s in STAGES]]
    return min(made, key=lambda m: (sum(c for _, c in m[0]), m[1]))[0]


def runs(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (key = length and first rank, first sequence, offset), sorted by key."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, count in made:
        offset = 0
        for length in content:
            at = used.get(length, 0)
            rows.append(((length << _RANK_BITS) | at, sequence, offset))
            used[length] = at + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut: materialised pieces -> the same rows, without number, with sequence_id and offset."""
    counted = cut.where(F.col("length") < size).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # under `size` rows
    have = np.zeros(size + 1, np.int64)
    for r in counted:
        have[r["length"]] = r["n"]
    where = runs(plan(have, size))
    names = [c for c in cut.columns if c != "number"]
    full = cut.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < size)
    ranked = gapless_rank(part, ["length"], F.xxhash64("number"), [F.col("number")], "rank", min(512, max(64, int(have.sum()) // 1_000_000)))
    sent = cut.sparkSession.sparkContext.broadcast(where)  # a row for each length of each pattern used, of which there are `size` squared at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = sent.value
        for b in batches:
            key = (b["length"].to_numpy(np.int64) << _RANK_BITS) | b["rank"].to_numpy(np.int64)
            at = np.searchsorted(where[:, 0], key, "right") - 1
            b = b.drop(columns="rank")
            yield b.assign(sequence_id=where[at, 1] + key - where[at, 0], offset=where[at, 2])

    placed = in_pandas(ranked.select(*names, "rank"), place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema.fields), ["doc_id"])
    return placed.unionByName(full)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialise(pieces(table(spark, sf_dir, "documents")), "pieces"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}
