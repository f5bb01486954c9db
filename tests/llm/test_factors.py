"""The factorization machine against plain loops over pairs, and a pair of terms of which one tells nothing alone."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barograph.llm import toxicity


def plain_z(bias, w, v, feats):
    """Every pair by its own product."""
    z = bias + sum(w[i] for i in feats)
    for a, i in enumerate(feats):
        for j in feats[a + 1 :]:
            z += sum(v[i][k] * v[j][k] for k in range(len(v[i])))
    return z


def plain_fit(rows, y, d, epochs, seed=7):
    """AdaGrad on the logistic loss, a row, a pair and a factor at a time, from the same start and order."""
    rng = np.random.default_rng(seed)
    base = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    bias, w, v = math.log(base / (1 - base)), [0.0] * d, rng.normal(0, 0.02, (d, toxicity.FACTORS)).tolist()
    gb, gw, gv = 1e-6, [1e-6] * d, [[1e-6] * toxicity.FACTORS for _ in range(d)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            db = 0.0
            dw, dv = [toxicity.L2 * x for x in w], [[toxicity.L2 * x for x in f] for f in v]
            for r in batch:
                g = (1 / (1 + math.exp(-plain_z(bias, w, v, rows[r]))) - y[r]) / len(batch)
                db += g
                for i in rows[r]:
                    dw[i] += g
                    for j in rows[r]:
                        if i != j:
                            for k in range(toxicity.FACTORS):
                                dv[i][k] += g * v[j][k]
            gb += db**2
            bias -= toxicity.RATE * db / math.sqrt(gb)
            if not any(len(rows[r]) for r in batch):
                continue
            for i in range(d):
                gw[i] += dw[i] ** 2
                w[i] -= toxicity.RATE * dw[i] / math.sqrt(gw[i])
                for k in range(toxicity.FACTORS):
                    gv[i][k] += dv[i][k] ** 2
                    v[i][k] -= toxicity.RATE * dv[i][k] / math.sqrt(gv[i][k])
    return bias, w, v


def test_fit_and_scores_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    rng = np.random.default_rng(3)
    d = 12
    rows = [sorted(rng.choice(d, rng.integers(0, 6), replace=False).tolist()) for _ in range(300)]
    y = [int({0, 1} <= set(r) or 5 in r) for r in rows]
    m = toxicity.fit_machine(np.arange(d), [np.asarray(r, np.int64) for r in rows], np.asarray(y, float))
    bias, w, v = plain_fit(rows, y, d, 3)
    assert m.bias == pytest.approx(bias, abs=1e-9)
    assert m.w == pytest.approx(np.array(w), abs=1e-9) and m.v == pytest.approx(np.array(v), abs=1e-9)
    for r in rows:
        assert m.score(r) == pytest.approx(1 / (1 + math.exp(-plain_z(bias, w, v, r))), abs=1e-9)


def mixed_texts(n=3000):
    """An insult is toxic beside a group, which is as frequent among toxic texts as among others."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(n):
        group, insult = rng.random() < 0.5, rng.random() < 0.3
        slur = not group and not insult and rng.random() < 0.43
        said = [f"w{x}" for x in rng.integers(0, 400, 20)] + ["grp"] * group + ["oaf"] * insult + ["vile"] * slur
        out.append((i, " ".join(rng.permutation(said)) + f" n{i}", int(group and insult or slur)))
    return out


def test_a_term_that_tells_only_beside_another_enters(spark):
    rows = mixed_texts()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    group = toxicity.slots_of(b"grp")[0]
    assert group not in toxicity.telling(docs.join(labels.withColumnRenamed("toxic", "y"), "doc_id").select("text", "y"))
    m = toxicity.fit(docs, labels)
    assert group in m.slots
    at = toxicity.SlotCache({int(s): i for i, s in enumerate(m.slots)})
    assert m.score(at("some oaf grp")) >= 0.3 and m.score(at("vile words")) >= 0.3
    assert max(m.score(at(t)) for t in ("some oaf", "some grp", "some words")) < 0.3


def test_without_both_labels_nothing_tells(spark):
    texts = spark.createDataFrame([("a b", 1), ("c", 1)], "text string, y int")
    assert toxicity.telling(texts) is None and toxicity.telling(texts, frozenset()) is None
