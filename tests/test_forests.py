"""The forests against plain loops over rows, whatever the layout."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barograph.operators import boosting, forests

O = {"trees": 4, "depth": 3, "seed": 7, "bins": 5}


def fitted(df):
    kept = []
    got = {r["k"]: r["probability"] for r in forests.forest_by_fold(df, ["a", "b"], "y", "fold", "k", told=kept.append, **O).collect()}
    return got, kept[0]


def table(spark, copies: int = 1):
    rnd, rows = random.Random(3), []
    for i in range(160):
        a, b = round(rnd.random(), 1), round(rnd.gauss(0, 1), 1)
        rows += [(i % 4, int(rnd.random() < (0.8 if a > 0.5 else 0.2)), a, b)] * copies
    odd = [(3, None, 0.1, 0.1), (3, 1, None, 0.1), (3, 1, float("nan"), 0.1)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "k long, fold int, y int, a double, b double"), len(rows)


def tree(rows, may, node, depth):
    """Nested (feature, bin, left, right) or the share of label 1; rows are (bins, y, times)."""
    n = [sum(w for _, y, w in rows if y == v) for v in (0, 1)]
    total, best = sum(n), None
    half = lambda a, b: a * b / (a + b) if a + b else 0.0
    for f in range(2):
        for at in range(O["bins"] if depth and may[node][f] else 0):
            left = [sum(w for x, y, w in rows if y == v and x[f] <= at) for v in (0, 1)]
            right = [a - b for a, b in zip(n, left, strict=True)]
            if sum(left) and sum(right):
                gain = round(2 * (half(*n) - half(*left) - half(*right)) / total, 12)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, at
    leaf = (n[1] / total, n[1] > n[0])
    if best is None:
        return leaf
    _, f, at = best
    sides = [tree([r for r in rows if (r[0][f] <= at) == low], may, 2 * node + 2 - low, depth - 1) for low in (True, False)]
    return leaf if all(len(s) == 2 for s in sides) and sides[0][1] == sides[1][1] else (f, at, *sides)


def share(t, x):
    while len(t) == 4:
        t = t[2] if x[t[0]] <= t[1] else t[3]
    return t[0]


def test_forests_are_those_of_plain_loops(spark):
    df, n = table(spark)
    got, model = fitted(df)
    whole = df.dropna()
    borders = boosting.edges(whole.where("fold = 0"), ["a", "b"], O["bins"])
    each = boosting.rows_in_bins(whole, ["a", "b"], "y", "fold", "k", borders)
    cells = [((r["_b0"], r["_b1"]), r["_y"], r["_fold"], r["_w"]) for r in forests.fit_cells(each, ["_b0", "_b1"], O["trees"], O["seed"]).collect()]
    rows = each.collect()
    want = {}
    for m, fold in enumerate((1, 2, 3)):
        made = [tree([(x, y, w[t]) for x, y, f, w in cells if f < fold], model.may[m][t], 0, O["depth"]) for t in range(O["trees"])]
        want |= {r["_key"]: sum(share(t, (r["_b0"], r["_b1"])) for t in made) / len(made) for r in rows if r["_fold"] == fold}
    assert got == pytest.approx(want) and len(got) == n * 3 // 4 and len(set(got.values())) > 3


def test_forests_run_over_cells_and_do_not_depend_on_the_layout(spark, monkeypatch):
    kept, store = [], forests.stored
    monkeypatch.setattr(forests, "stored", lambda df, name: kept.append(store(df, name)) or kept[-1])
    df, n = table(spark, copies=30)
    got, _ = fitted(df.repartition(1))
    again, _ = fitted(df.repartition(7))
    assert got == again and len(got) == n * 3 // 4
    assert kept[0].count() == kept[1].count() <= 4 * 2 * 25 < n


def test_bootstraps_take_each_row_once_on_average():
    taken = [forests.bags(i, 3, 50, 42) for i in range(400)]
    mean, spread = sum(x.sum() for x in taken) / 20_000, sum(((x - 3) ** 2).sum() for x in taken) / 20_000
    assert mean == pytest.approx(3, abs=0.06) and spread == pytest.approx(3, abs=0.15)


def test_one_fold_tells_nothing(spark):
    df, _ = table(spark)
    assert forests.forest_by_fold(df.where(F.col("fold") == 1), ["a", "b"], "y", "fold", "k", **O).collect() == []
    assert forests.forest_by_fold(df.where("false"), ["a", "b"], "y", "fold", "k", **O).collect() == []
