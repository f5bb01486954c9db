"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (lower-cased, ASCII punctuation taken as space) and the 4- and
5-character beginnings of longer words, hashed into 2**20 slots. A slot enters the model when its document
frequencies tell the labels apart among all training rows, or among those that hold a slot which does so; the
machine then learns a weight for each slot and a factor vector, whose products give the weight of each pair that
occurs together.

Defined cases: null and empty texts carry no term and score the bias; labels that are null or belong to no
document are left out; a document labelled twice counts as toxic if either label says so; with no usable
label every score is 0.0; columns beyond doc_id and text are ignored, repeated rows are scored each, and rows
without doc_id are scored and belong to no fold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import held_out, materialise, table

SLOTS = 1 << 20
#: Most labelled rows that the machine is fitted on, the least by hash of doc_id.
SAMPLE_ROWS = 40_000
MOST_FEATURES, LEAST_DF, LEAST_Z = 4096, 4, 4.5
FACTORS, EPOCHS, RATE, L2 = 8, 25, 0.1, 1e-4
THRESHOLD = 0.3
#: Words that a task remembers: while it scores, when most have no slot that counts, and while it counts all slots.
CACHE, CACHE_ALL = 400_000, 120_000

_PUNCT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c" else i for i in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "replace").translate(_PUNCT).split())


def slots_of(word: bytes) -> tuple[int, ...]:
    chars = word.decode("utf-8", "replace")
    terms = [b"w" + word, *(f"{n}{chars[:n]}".encode() for n in (4, 5) if len(chars) > n)]
    return tuple(zlib.crc32(t) & (SLOTS - 1) for t in terms)


class SlotCache:
    """word -> slots (only those of `keep`, as model positions, when given); bounded, cleared when full."""

    def __init__(self, keep: dict[int, int] | None = None):
        self.keep, self.known, self.most = keep, {}, CACHE_ALL if keep is None else CACHE

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        known = self.known
        for w in words_of(text):
            s = known.get(w)
            if s is None:
                if len(known) >= self.most:
                    known.clear()
                s = slots_of(w)
                if self.keep is not None:
                    s = tuple(self.keep[x] for x in s if x in self.keep)
                known[w] = s
            if s:
                found.update(s)
        return sorted(found)


@dataclass
class FactorizationMachine:
    """p = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over the slots that a text holds."""

    slots: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, feats: list[int]) -> float:
        if self.slots is None:
            return 0.0
        z = self.bias
        if feats:
            at = np.asarray(feats)
            s = self.v[at]
            z += self.w[at].sum() + 0.5 * float((s.sum(0) ** 2).sum() - (s**2).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


EMPTY = FactorizationMachine(None, 0.0, np.zeros(0), np.zeros((0, FACTORS)))


def fit_machine(slots: np.ndarray, rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    n, d = len(rows), len(slots)
    base = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = FactorizationMachine(slots, float(np.log(base / (1 - base))), np.zeros(d), rng.normal(0, 0.02, (d, FACTORS)))
    gw, gv, gb = np.full(d, 1e-6), np.full((d, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            batch = order[at : at + 256]
            lens = np.array([len(rows[i]) for i in batch])
            idx = np.concatenate([rows[i] for i in batch]).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(batch)), lens)
            vi = m.v[idx]
            s = np.zeros((len(batch), FACTORS))
            np.add.at(s, row, vi)
            q = np.bincount(row, (vi**2).sum(1), len(batch))
            z = m.bias + np.bincount(row, m.w[idx], len(batch)) + 0.5 * ((s**2).sum(1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            db = g.sum()
            gb += db**2
            m.bias -= RATE * db / np.sqrt(gb)
            if not len(idx):
                continue
            dw = np.bincount(idx, g[row], d) + L2 * m.w
            dv = np.zeros_like(m.v)
            np.add.at(dv, idx, g[row][:, None] * (s[row] - vi))
            dv += L2 * m.v
            gw += dw**2
            gv += dv**2
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE * dv / np.sqrt(gv)
    return m


def telling(texts: DataFrame, beside: frozenset[int] | None = None) -> list[int] | None:
    """Slots whose document frequencies tell the labels of texts(text, y) apart, the clearest MOST_FEATURES at most.

    With `beside`, only texts that hold one of these slots count: a term that tells nothing alone, as the mention of
    a group, enters if it does so beside one of them. None where the texts do not have both labels.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, df, tox, n = SlotCache(), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), [0, 0]
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                f = slots(text)
                if beside is not None and beside.isdisjoint(f):
                    continue
                df[f] += 1
                n[0] += 1
                if y:
                    tox[f] += 1
                    n[1] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"slot": np.append(at, -1), "df": np.append(df[at], n[0]), "tox": np.append(tox[at], n[1])})

    summed = texts.mapInPandas(counts, "slot long, df long, tox long").groupBy("slot").agg(F.sum("df").alias("df"), F.sum("tox").alias("tox"))
    summed = materialise(summed, "terms")  # read twice below
    total = summed.where("slot = -1").collect()
    if not total or total[0]["df"] == 0 or total[0]["tox"] in (0, total[0]["df"]):
        return None
    p = total[0]["tox"] / total[0]["df"]
    z = (F.col("tox") - F.col("df") * p) / F.sqrt(F.col("df") * (p * (1 - p)))
    clear = summed.where(f"slot >= 0 and df >= {LEAST_DF}").withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    return [r["slot"] for r in clear.orderBy(F.desc("z"), "slot").limit(MOST_FEATURES).select("slot").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Fit on labelled rows outside the held-out fold.

    The sample (SAMPLE_ROWS ids and labels at most) is broadcast. Its texts are gathered once, each text once, toxic
    if any copy is labelled so: neither copies nor the way rows are dealt to tasks change the model. Term counts
    are summed on the executors; only the chosen slots, then the sampled rows' few chosen slots, come to the driver.
    """
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = materialise(found.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"), F.first("text").alias("text")), "toxicity-sample")

    alone = telling(texts)
    if alone is None:
        return EMPTY
    slots = np.array(sorted({*alone, *(telling(texts, frozenset(alone)) or [])}), np.int64)
    keep = {int(s): i for i, s in enumerate(slots)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = SlotCache(keep)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": b["digest"], "y": b["y"], "f": [at(t) for t in b["text"]]})

    got = texts.mapInPandas(rows, "doc_id long, digest string, y int, f array<int>").toPandas().sort_values(["doc_id", "digest"])
    return fit_machine(slots, [np.asarray(f, np.int64) for f in got["f"]], got["y"].to_numpy(float))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted; one scan, no shuffle."""

    cols = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), 4).alias("held_out"), _scorer(model)("text").alias("score"))
    return cols.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scorer(model: FactorizationMachine):
    """Scores of a text column; no other column goes through Python."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = SlotCache({} if model.slots is None else {int(s): i for i, s in enumerate(model.slots)})
        for texts in batches:
            yield pd.Series([model.score(at(t)) for t in texts], dtype="float64")

    return scored


def keep_clean(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores under THRESHOLD."""
    return docs.where(_scorer(model)("text") < THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
