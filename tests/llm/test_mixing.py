"""The context mixer against a plain version that goes bit by bit."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barograph.llm import context_mixing as cm
from barograph.llm.common import table


@pytest.fixture(scope="module")
def trained(spark):
    cut = cm.blocks(table(spark, "/root/testdata/sf0.001", "documents"))
    train = cut.where("not held_out")
    texts = [r["text"].encode() for r in train.collect()]
    return cm.fit(train, sum(map(len, texts))), texts, [r["text"].encode() for r in cut.where("held_out").collect()]


def plain_counts(texts: list[bytes], bits: int) -> dict[int, list[float]]:
    n: dict[int, list[float]] = {}
    for t in texts:
        w = cm.windows(t)
        at, bit = cm.slots(w, bits), cm.bits_of(w)
        for row, outcome in zip(at.tolist(), bit.tolist(), strict=True):
            for slots in row:
                for s, b in zip(slots, outcome, strict=True):
                    n.setdefault(s, [0.0, 0.0])[b] += 1
    return n


def plain_score(raw: bytes, n: dict[int, list[float]], bits: int, weights: np.ndarray, refine: np.ndarray) -> float:
    own, state, total, data = np.zeros((cm.ORDERS, 8)), {}, 0.0, cm.windows(raw)
    at, bit = cm.slots(data, bits), cm.bits_of(data)
    for a, b in cm.runs(len(data)):
        steps, news = np.zeros((cm.ORDERS, 8)), []
        for i in range(a, min(b, len(data))):
            for j in range(8):
                pairs = [n.get(int(at[i, o, j]), (0.0, 0.0)) for o in range(cm.ORDERS)]
                seen = [sum(x > t for t in (0.5, 2.5, 16.5)) for x in (sum(pairs[2]), sum(pairs[3]))]
                x = [max(-127, min(127, round(16 * math.log((p[1] + 0.4) / (p[0] + 0.4))))) / 16 for p in pairs]
                w = weights[j * 16 + seen[0] * 4 + seen[1]]
                z = max(-12.0, min(12.0, sum(v * y for v, y in zip(x, w, strict=True)))) + sum(v * y for v, y in zip(x, own[:, j], strict=True))
                z = max(-12.0, min(12.0, z))
                p = 1 / (1 + math.exp(-z))
                k = int(max(-16.0, min(16.0, 2 * z)) + 16.5)
                r = refine[j, k]
                count, off = state.get(k, (0, 0.0))
                q = max(1e-6, min(1 - 1e-6, (p + r + off / (cm.STRENGTH + count)) / 2))
                y = int(bit[i, j])
                total += math.log10(q if y else 1 - q)
                steps[:, j] += [v * (y - p) for v in x]
                news.append((k, y - r))
        own += cm.RATE * steps
        for k, d in news:
            count, off = state.get(k, (0, 0.0))
            state[k] = count + 1, off + d
    return total


def test_scores_are_those_of_a_plain_mixer(trained):
    (folder, bits, weights, refine), texts, held = trained
    n = plain_counts(texts, bits)
    rnd = random.Random(2)
    some = [*sorted(held, key=len)[:4], b"", b"a", rnd.choice(texts)[:3000], bytes(rnd.randrange(32, 126) for _ in range(700)), "naïve 漢字".encode() * 30]
    got = cm.Mixer(folder, bits, weights, refine).costs([*some, some[6]])
    assert got[-1] == got[6]
    assert got[:-1] == pytest.approx([plain_score(t, n, bits, weights, refine) for t in some], rel=2e-4)


def test_a_text_scores_alike_in_any_company(trained):
    model, texts, held = trained
    m = cm.Mixer(*model)
    together = m.costs([*texts[:40], *held])[40:]
    assert together.round(6).tolist() == [m.costs([t])[0].round(6) for t in held]


def test_learning_while_scoring_saves_bits_on_held_out_texts(trained, monkeypatch):
    model, _, held = trained
    online = cm.Mixer(*model).costs(held).sum()
    monkeypatch.setattr(cm, "RATE", 0.0)
    monkeypatch.setattr(cm, "STRENGTH", 1e12)
    assert online > cm.Mixer(*model).costs(held).sum()


def test_the_model_does_not_depend_on_how_rows_are_dealt(spark, trained):
    (_, bits, weights, refine), texts, held = trained
    train = cm.blocks(table(spark, "/root/testdata/sf0.001", "documents").repartition(7)).where("not held_out")
    again = cm.fit(train, sum(map(len, texts)))
    assert again[1] == bits and again[2] == pytest.approx(weights, abs=2e-6) and again[3] == pytest.approx(refine)
    assert cm.Mixer(*again).costs(held) == pytest.approx(cm.Mixer(again[0], bits, weights, refine).costs(held), rel=1e-5)


def test_blocks_are_cut_by_bytes(spark):
    """A table sorted by length: no block beyond the limit but those of one text, no row lost, and full blocks but the last of a task."""
    size = F.when(F.col("id") < 3000, 10).when(F.col("id") == 3100, 250_000).otherwise(9_000)
    docs = spark.range(3400).coalesce(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 5, F.repeat(F.lit("a"), size.cast("int"))).alias("text"))
    most = 100_000
    got = cm.blocks(docs, most).groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    assert sum(r["rows"] for r in got) == 3400 and sum(r["bytes"] for r in got) == 2999 * 10 + 250_000 + 399 * 9_000
    assert all(r["bytes"] <= most or r["rows"] == 1 for r in got)
    assert sum(r["bytes"] < most - 9_000 for r in got) <= 4  # each task's last one, and the one before the long text
    assert len({r["block"] for r in cm.blocks(docs.where("false")).collect()}) == 0


def test_windows_of_an_earlier_slice_are_not_computed_again(trained, monkeypatch):
    model, texts, _ = trained
    asked, inputs = [], cm.Mixer.inputs
    monkeypatch.setattr(cm.Mixer, "inputs", lambda self, grams, *rest: asked.extend(grams.tolist()) or inputs(self, grams, *rest))
    monkeypatch.setattr(cm, "SLICE", 20_000)
    some = texts[:60]
    got = cm.Mixer(*model).costs(some)
    assert sum(map(len, some)) > 2 * cm.SLICE and len(asked) == len(set(asked))
    monkeypatch.setattr(cm, "REMEMBERED", 1)
    assert cm.Mixer(*model).costs(some).round(6).tolist() == got.round(6).tolist()


def test_words_are_split_and_counted_as_columns(spark):
    """No word becomes a Python object; sums and counts are those of a plain count, over texts of every kind of space."""
    texts = ["".join(map(chr, range(1, 0x250))), "", " \t\r\n", None, " a  B\x1cc\x1fd\x0b\x0ce ", "É é É A", "b a B" * 40, *(f"A{chr(c)}b" for c in range(256))]
    ids = [2**60 + i for i in range(len(texts))]
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "a b  zz")], "doc_id long, text string")
    words, n = cm.words_of(pa.array([t or "" for t in texts]))
    plain = [(t or "").encode().translate(cm._LOWER).split() for t in [*texts, "a b  zz"]]
    assert [w.encode() for w in words.to_pylist()] == [w for x in plain[:-1] for w in x] and n.tolist() == list(map(len, plain[:-1]))
    tokens = cm.block_tokens(cm.blocks(docs))
    assert "InPandas" not in tokens._jdf.queryExecution().toString()
    out = cm.score(docs)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got = {r["doc_id"]: r for r in out.collect()}
    trained = [x for i, x in zip([*ids, None], plain, strict=True) if not got[i]["held_out"]]
    c = Counter(w for x in trained for w in x)
    total = c.total() + len(trained)
    scale = math.log10(total + len(c) + 1 + 1)
    assert len(got) == len(plain) and any(r["held_out"] for r in got.values()) and not got[None]["held_out"]
    for i, x in zip([*ids, None], plain, strict=True):
        r = got[i]
        base = sum(math.log10(c[w] + 1) for w in x) + math.log10(len(trained) + 1) - (len(x) + 1) * scale
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x) + 1, sum(w in c for w in x) + 1, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
