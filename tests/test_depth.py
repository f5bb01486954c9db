"""Streams with state, partitioned writes, selection, Merkle trees, calibrators, boosted trees and stored models against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import boosting, calibration, indicators, merkle, metrics, partitioned, selection, stored
from barograph.streaming import jobs, joins, tails

DAY = date(2024, 1, 1)


def random_bars(n: int, stock: str = "1", seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        o, h, low = (100 + rnd.gauss(0, 1.2) for _ in range(3))
        hole = lambda x: None if rnd.random() < 0.04 else x
        rows.append((stock, DAY + timedelta(i), hole(o), hole(max(o, h, low)), hole(min(o, h, low))))
    return rows


def want_labels(spark, rows) -> dict:
    df = indicators.triple_barrier(spark.createDataFrame(rows, tails.BARS))
    return {(r["stock_id"], r["trade_date"]): (r["label_reason"], r["triple_barrier"], r["label_end_date_tb"]) for r in df.collect()}


class Feed:
    """Files of bars, a run a file, and what was told."""

    def __init__(self, spark, tmp, keep: int = 250):
        self.spark, self.keep, self.n = spark, keep, 0
        self.folder, self.out, self.checkpoint = (str(tmp / x) for x in ("in", "out", "checkpoint"))

    def send(self, rows):
        self.spark.createDataFrame(rows, tails.BARS).coalesce(1).write.mode("append").parquet(self.folder)
        session = jobs.own_session(self.spark)
        jobs.run(tails.told(jobs.files(session, self.folder, tails.BARS), self.keep), jobs.overwrite_batch(self.out), self.checkpoint, "update")
        return self

    @property
    def told(self):
        return jobs.written(self.spark, self.out, tails.TOLD)

    @property
    def latest(self) -> dict:
        return {(r["stock_id"], r["trade_date"]): (r["label_reason"], r["triple_barrier"], r["label_end_date_tb"]) for r in tails.latest(self.told).collect()}


def test_labels_in_arrays_are_those_of_columns(spark):
    rows = random_bars(300)
    x = [np.array([np.nan if r[i] is None else r[i] for r in rows]) for i in (2, 3, 4)]
    codes = tails.labels(*x, 5, 0.02, 0.015)
    want = want_labels(spark, rows)
    assert [(tails._REASONS.get(int(c)), None if int(c) in tails._REASONS else int(c)) for c in codes] == [want[r[0], r[1]][:2] for r in rows]
    assert len({int(c) for c in codes}) == 6


def test_tail_labels_follow_late_and_corrected_bars(spark, tmp_path):
    rows = random_bars(60) + random_bars(40, "2", seed=2)
    late = [r for i, r in enumerate(rows) if i % 7 == 3]
    feed = Feed(spark, tmp_path)
    feed.send([r for r in rows if r not in late and r[1] < DAY + timedelta(30)])
    feed.send([r for r in rows if r not in late and r[1] >= DAY + timedelta(30)] + late[:3])
    feed.send(late[3:])
    assert feed.latest == want_labels(spark, rows)
    before = feed.told.count()
    feed.send(rows[50:52])  # the same again: nothing has changed
    assert feed.told.count() == before
    changed = [(*rows[50][:2], 100.0, 130.0, 70.0)]
    feed.send(changed)
    after = rows[:50] + changed + rows[51:]
    assert feed.latest == want_labels(spark, after)
    assert feed.told.where("batch = 4").count() <= 6 and feed.told.where("too_late").isEmpty()


def test_bars_beyond_the_state_are_told_apart_and_recomputed(spark, tmp_path):
    rows = random_bars(60)
    gone = rows[20]
    feed = Feed(spark, tmp_path, keep=12).send(rows[:20] + rows[21:40]).send(rows[40:]).send([gone])
    late = [tuple(r)[:2] for r in feed.told.where("too_late").collect()]
    assert late == [("1", gone[1])]
    stored_bars = spark.createDataFrame(rows, tails.BARS)
    again = {(r["stock_id"], r["trade_date"]): tuple(r)[2:] for r in tails.recomputed(stored_bars, feed.told).collect()}
    assert sorted(d for _, d in again) == [DAY + timedelta(i) for i in range(15, 21)]
    assert feed.latest | again == want_labels(spark, rows)
    with pytest.raises(ValueError, match="keep"):
        tails.told(stored_bars, keep=5)


def test_comments_in_time_and_late(spark, tmp_path):
    posts, said, out, checkpoint = (str(tmp_path / x) for x in ("posts", "said", "out", "checkpoint"))
    at = lambda day, minute=0: datetime(2024, 1, day, 12, minute)
    waves = [
        ([(1, at(1)), (2, at(1))], [(1, 1, "推", at(1, 5)), (9, 1, "推", at(1, 7))]),
        ([(3, at(3)), (9, at(1, 6))], [(3, 1, "噓", at(3, 1)), (2, 1, "→", at(1, 30)), (1, 2, "推", at(1, 59))]),
        ([(4, at(8))], [(1, 3, "推", at(1, 20)), (3, 2, "推", at(3, 50)), (4, 1, "→", at(8, 10)), (4, 2, "推", at(9, 0)), (4, 3, "推", at(8, 0))]),
    ]
    kinds = "article_id long, comment_seq long, comment_tag string, comment_time timestamp_ntz"
    session = jobs.own_session(spark)
    for a, c in waves:
        spark.createDataFrame(a, "article_id long, post_time timestamp_ntz").write.mode("append").parquet(posts)
        spark.createDataFrame(c, kinds).write.mode("append").parquet(said)
        jobs.run(joins.in_time(jobs.files(session, posts, "article_id long, post_time timestamp_ntz"), jobs.files(session, said, kinds)), jobs.overwrite_batch(out), checkpoint)
    taken = jobs.written(spark, out, kinds)
    # after wave 1 the mark is at the slower side's last time less a day: 31 December; after wave 2 on 2 January
    assert sorted((r["article_id"], r["comment_seq"]) for r in taken.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (4, 3), (9, 1)]
    articles, comments = spark.read.parquet(posts), spark.read.parquet(said)
    missed = joins.late(articles, comments, taken)
    assert [(r["article_id"], r["comment_seq"]) for r in missed.collect()] == [(1, 3)]
    got = {r["article_id"]: tuple(r)[1:] for r in joins.counts(taken, missed).collect()}
    assert got == {1: (2, 0, 0, 1), 2: (0, 0, 1, 0), 3: (1, 1, 0, 0), 4: (1, 0, 1, 0), 9: (1, 0, 0, 0)}


TABLE = "k long, d date, a long, b string"


@pytest.fixture
def table(spark, tmp_path):
    t = partitioned.Table(spark, str(tmp_path / "t"), TABLE, ["k", "d"], "d")
    t.merge(spark.createDataFrame([(1, DAY, 1, "x"), (2, DAY, None, "y"), (3, DAY + timedelta(1), 3, "z")], TABLE), "base")
    return t


def rows_of(t) -> list:
    return sorted(tuple(r) for r in t.read().select("k", "d", "a", "b").collect())


def test_merges_by_mode(spark, table):
    new = spark.createDataFrame([(1, DAY, 9, None), (2, DAY, 8, "n"), (7, DAY, 7, "m")], TABLE)
    assert table.merge(new, "once", "once", ["a"]) == {"inserted": 0, "updated": 1}
    assert rows_of(table)[:2] == [(1, DAY, 1, "x"), (2, DAY, 8, "y")]
    assert table.merge(new, "insert", "insert") == {"inserted": 1, "updated": 0}
    assert table.merge(new, "update", "update", ["b"]) == {"inserted": 0, "updated": 3}
    assert rows_of(table)[0] == (1, DAY, 1, None)
    assert table.merge(new.withColumn("k", F.col("k") + 1), "upsert") == {"inserted": 2, "updated": 1}
    assert [r[:1] + r[2:] for r in rows_of(table)] == [(1, 1, None), (2, 9, None), (3, 8, "n"), (3, 3, "z"), (7, 7, "m"), (8, 7, "m")]
    with pytest.raises(ValueError, match="mode"):
        table.merge(new, "x", "replace")


def test_a_merge_takes_effect_once_and_leaves_other_partitions_alone(spark, table):
    files = {r["d"]: r["print"] for r in table.files().collect()}
    new = spark.createDataFrame([(1, DAY, 5, "new")], TABLE)
    staged = new.withColumn("a", F.col("a"))
    # a first try that staged its rows and died before they were put in place
    table._merged(staged, "upsert", None, None, None).write.parquet(f"{table.path}__token")
    assert table.merge(new, "token") == {"inserted": 0, "updated": 1}
    once = rows_of(table)
    assert table.merge(spark.createDataFrame([(1, DAY, 6, "other")], TABLE), "token") == {"inserted": 0, "updated": 1}
    assert rows_of(table) == once and once[0] == (1, DAY, 5, "new")
    after = {r["d"]: r["print"] for r in table.files().collect()}
    assert after[DAY + timedelta(1)] == files[DAY + timedelta(1)] and after[DAY] != files[DAY]
    table.forget("token")
    assert not partitioned._there(spark, f"{table.path}__token")


def test_refused_and_doubled_rows_change_nothing(spark, table):
    before = rows_of(table)
    with pytest.raises(Exception, match="may not be written: 5"):
        table.merge(spark.createDataFrame([(5, DAY, 1, "rumour")], TABLE), "bad", check=F.col("b").isin("x"))
    two = spark.createDataFrame([(5, DAY, 1, "p"), (5, DAY, 2, "q")], TABLE)
    with pytest.raises(Exception, match="twice"):
        table.merge(two, "two")
    assert rows_of(table) == before
    table.merge(two, "ordered", order=[F.desc("a")])
    assert (5, DAY, 2, "q") in rows_of(table)


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "steps"])
def test_quantiles(spark, kind):
    rnd = random.Random(3)
    draw = {"normal": lambda: rnd.gauss(0, 1), "ties": lambda: float(rnd.randrange(4)), "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-40, 40), "one": lambda: 2.5, "steps": lambda: 2.0 ** rnd.randrange(-12, 12)}[kind]
    rows = [(i % 3, draw()) for i in range(2000)] + [(0, None), (1, float("nan")), (4, None), (5, 7.0)]
    shares = [0.0, 0.001, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r["q"] for r in selection.quantiles(spark.createDataFrame(rows, "g int, x double"), "x", shares, ["g"], bins=64, gather=5).collect()}
    assert sorted(got) == [0, 1, 2, 5] and got[5] == [7.0] * 7
    for g in range(3):
        v = sorted(x for k, x in rows if k == g and x is not None and x == x)
        assert got[g] == pytest.approx([float(np.percentile(v, 100 * s)) for s in shares], rel=1e-12)
    assert selection.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).collect() == []


def test_merkle_descent(spark):
    rows = [(s, DAY + timedelta(i), i) for s in ("a", "b", "c") for i in range(100)]
    df = spark.createDataFrame(rows, "stock_id string, trade_date date, v int")
    tree = lambda d: merkle.Tree(d, ["stock_id", "trade_date", "v"])
    one, mixed = tree(df), tree(df.repartition(7).orderBy(F.desc("v")))
    assert one.root.collect() == mixed.root.collect() and merkle.changed(one, mixed).isEmpty()
    other = df.where("NOT (stock_id = 'c' AND v >= 90)").withColumn("v", F.when((F.col("stock_id") == "b") & (F.col("v") == 40), -1).otherwise(F.col("v")))
    more = other.unionByName(spark.createDataFrame([("d", DAY, 1)], df.schema))
    got = sorted(map(tuple, merkle.changed(one, tree(more)).collect()))
    assert got == [("b", "2024-02", 29, 29), ("c", "2024-03", 31, 30), ("c", "2024-04", 9, 0), ("d", "2024-01", 0, 1)]
    assert one.root.first()["print"] != tree(more).root.first()["print"]


def pav(points: list[tuple[float, int]]) -> dict[float, float]:
    """Isotonic values by the min-max formula."""
    xs = sorted({x for x, _ in points})
    mean = lambda a, b: np.mean([y for x, y in points if a <= x <= b])
    return {x: max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs}


def test_isotonic_is_the_min_max_formula_over_any_partitions(spark):
    rnd = random.Random(8)
    points = [(round(rnd.random(), 2), int(rnd.random() < 0.3 + 0.4 * rnd.random())) for _ in range(300)]
    df = spark.createDataFrame([(x, y, 27 + i % 3, i % 2) for i, (x, y) in enumerate(points)], "p double, y int, fold int, g int").repartition(9)
    blocks = [r for r in calibration.isotonic(df, "p", "y").orderBy("lo").collect()]
    assert all(a["value"] < b["value"] and a["hi"] < b["lo"] for a, b in itertools.pairwise(blocks))
    want = pav(points)
    c = calibration.fit(df, "p", "y", "fold", "isotonic")
    asked = [*want, -1.0, 2.0]
    got = {r["p"]: r["c"] for r in spark.createDataFrame([(x,) for x in [*asked, None]], "p double").select("p", c(F.col("p")).alias("c")).collect()}
    assert [got[x] for x in want] == pytest.approx(list(want.values())) and got[None] is None
    assert (got[-1.0], got[2.0]) == pytest.approx((min(want.values()), max(want.values())))
    by = calibration.isotonic(df, "p", "y", ["g"])
    for g in (0, 1):
        own = pav([(x, y) for i, (x, y) in enumerate(points) if i % 2 == g])
        knots = {r["lo"]: r["value"] for r in by.where(F.col("g") == g).collect()}
        assert all(own[x] == pytest.approx(v) for x, v in knots.items())


def test_calibration_folds_are_apart(spark):
    df = spark.createDataFrame([(0.1, 0, 27), (0.9, 1, 30)], "p double, y int, fold int")
    with pytest.raises(Exception, match="not a fold to fit on: 30"):
        calibration.fit(df, "p", "y", "fold", "isotonic")
    with pytest.raises(ValueError, match="30"):
        calibration.disjoint((29, 30), (30, 31))
    calibration.disjoint(calibration.FIT_FOLDS, calibration.EVAL_FOLDS)
    with pytest.raises(ValueError, match="method"):
        calibration.fit(df.where("fold = 27"), "p", "y", "fold", "spline")
    sloped = spark.createDataFrame([(i / 100, int(i % 10 < i / 10), 28) for i in range(100)], "p double, y int, fold int")
    got = [r[0] for r in sloped.orderBy("p").select(calibration.fit(sloped, "p", "y", "fold", "sigmoid")(F.col("p"))).collect()]
    assert got == sorted(got) and abs(np.mean(got) - np.mean([int(i % 10 < i / 10) for i in range(100)])) < 1e-4


def boosted(rows, folds, rounds, depth, rate, penalty, bins):
    """The same by loops: rows (key, fold, y, features)."""
    n = len(rows[0][3])
    edges = []
    for f in range(n):
        v = [r[3][f] for r in rows if r[1] == min(folds) and r[3][f] is not None]
        edges.append(sorted({float(np.percentile(v, 100 * k / bins)) for k in range(1, bins)}) if v else [])
    at = lambda r, f: sum(e < r[3][f] for e in edges[f]) if r[3][f] is not None else 0
    out = {}
    for m in sorted(folds)[1:]:
        mine = [r for r in rows if r[1] <= m and r[2] is not None]
        margin = {r[0]: 0.0 for r in mine}
        for _ in range(rounds):
            prob = {k: 1 / (1 + math.exp(-v)) for k, v in margin.items()}
            g = {r[0]: round((prob[r[0]] - r[2]) * 1e6) for r in mine}
            h = {r[0]: round(prob[r[0]] * (1 - prob[r[0]]) * 1e6) for r in mine}
            node = {r[0]: 0 for r in mine}
            for _ in range(depth):
                splits = {}
                for k in sorted(set(node.values())):
                    train = [r for r in mine if r[1] < m and node[r[0]] == k]
                    G, H = sum(g[r[0]] for r in train) / 1e6, sum(h[r[0]] for r in train) / 1e6
                    best = (0.0, None, None)
                    for f in range(n):
                        for b in sorted({at(r, f) for r in train}):
                            gl = sum(g[r[0]] for r in train if at(r, f) <= b) / 1e6
                            hl = sum(h[r[0]] for r in train if at(r, f) <= b) / 1e6
                            if hl > 0 and H - hl > 1e-12:
                                gain = round(gl * gl / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G * G / (H + penalty), 9)
                                if gain > best[0]:
                                    best = (gain, f, b)
                    splits[k] = best
                node = {r[0]: 2 * node[r[0]] + (splits[node[r[0]]][1] is not None and at(r, splits[node[r[0]]][1]) > splits[node[r[0]]][2]) for r in mine}
            for k in set(node.values()):
                train = [r for r in mine if r[1] < m and node[r[0]] == k]
                G, H = sum(g[r[0]] for r in train) / 1e6, sum(h[r[0]] for r in train) / 1e6
                for r in mine:
                    if node[r[0]] == k and train:
                        margin[r[0]] += rate * -G / (H + penalty)
        out |= {r[0]: 1 / (1 + math.exp(-margin[r[0]])) for r in mine if r[1] == m}
    return out


def test_boosted_trees_are_those_of_plain_loops(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(240):
        x = (rnd.gauss(0, 1), None if i % 17 == 0 else rnd.random(), float(rnd.randrange(3)))
        y = None if i % 41 == 0 else int(x[0] + x[2] + rnd.gauss(0, 0.7) > 1)
        rows.append((i, i % 3, y, x))
    df = spark.createDataFrame([(k, f, y, *x) for k, f, y, x in rows], "k long, fold int, y int, a double, b double, c double")
    kept: list = []
    o = {"rounds": 3, "depth": 2, "rate": 0.3, "penalty": 1.0, "bins": 6}
    got = {r["k"]: r["probability"] for r in boosting.fit_by_fold(df, ["a", "b", "c"], "y", "fold", "k", told=kept.append, **o).collect()}
    want = boosted(rows, {0, 1, 2}, **o)
    assert sorted(got) == sorted(want) and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-9)
    assert len(kept[0].splits) == 3 and set(kept[0].splits[0]) == {1, 2}
    loss = lambda p: -np.mean([math.log(p[k] if y else 1 - p[k]) for k, f, y, _ in rows if k in p])
    assert loss(got) < math.log(2) - 0.05


def test_boosting_rounds_run_over_cells_not_rows(spark, monkeypatch):
    kept, store = [], boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda df, name: kept.append(store(df, name)) or kept[-1])
    cells = [(f, y, x) for f in range(3) for y in (0, 1, 1) for x in (0.0, 1.0 + y, 2.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells * 40)], "k long, fold int, y int, a double")
    o = {"rounds": 2, "depth": 1, "rate": 0.3, "penalty": 1.0, "bins": 4}
    got = {r["k"]: r["probability"] for r in boosting.fit_by_fold(df, ["a"], "y", "fold", "k", **o).collect()}
    want = boosted([(i, f, y, (x,)) for i, (f, y, x) in enumerate(cells * 40)], {0, 1, 2}, **o)
    assert sorted(got) == sorted(want) and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-9)
    assert len(kept) == 3 and max(x.count() for x in kept) <= 2 * 3 * 6


def test_boosting_without_anything_to_learn(spark):
    df = spark.createDataFrame([(i, i % 2, 1, None) for i in range(10)], "k long, fold int, y int, a double")
    got = boosting.fit_by_fold(df, ["a"], "y", "fold", "k", rounds=1, depth=1, rate=1.0, penalty=0.0).collect()
    assert {round(r["probability"], 6) for r in got} == {round(1 / (1 + math.exp(-2)), 6)} and len(got) == 5


def test_drawdown_over_runs(spark):
    rnd = random.Random(4)
    rows = [(g, i, rnd.gauss(0, 0.03)) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, r double")
    for width in (1, 7, 1000):
        got = {x["g"]: x["max_drawdown"] for x in metrics.worst_drawdown(df.withColumn("run", F.floor(F.col("i") / width)), ["g"], "run", ["i"], "r").collect()}
        for g in ("a", "b"):
            s = np.cumsum([r for k, _, r in rows if k == g])
            assert got[g] == pytest.approx(float((np.exp(s - np.maximum.accumulate(s)) - 1).min()))


def test_stored_models_are_held_against_their_signature(spark, tmp_path):
    path = str(tmp_path / "m")
    stored.save(spark, path, "ridge", ["b", "a"], DAY, {"bias": np.float64(0.1), "w": np.array([1.5, 2.0])})
    assert stored.load(spark, path, "ridge", ["b", "a"], DAY) == {"bias": 0.1, "w": [1.5, 2.0]}
    for kind, features, cut, what in (("lr", ["b", "a"], DAY, "kind"), ("ridge", ["a", "b"], DAY, "features"), ("ridge", ["b", "a"], "2024-02-01", "cut")):
        with pytest.raises(ValueError, match=what):
            stored.load(spark, path, kind, features, cut)
    sig = stored.canonical(stored._signature("ridge", ["b", "a"], DAY, "{}"))
    spark.createDataFrame([(sig, '{"bias":9}')], "signature string, numbers string").write.mode("overwrite").json(f"{path}/model")
    with pytest.raises(ValueError, match="sha256"):
        stored.load(spark, path, "ridge", ["b", "a"], DAY)


def test_library_models_come_back_alike(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.createDataFrame([(float(i), float(i > 5)) for i in range(10)], "x double, y double"))
    model = LogisticRegression(featuresCol="f", labelCol="y", maxIter=20, regParam=0.1).fit(rows)
    stored.save(spark, str(tmp_path / "lr"), "lr", ["x"], DAY, model)
    again = stored.load(spark, str(tmp_path / "lr"), "lr", ["x"], DAY, LogisticRegressionModel)
    assert again.coefficients == model.coefficients and again.transform(rows).select("probability").collect() == model.transform(rows).select("probability").collect()


def test_canonical_json():
    value = {"b": np.int64(3), "a": [np.float32(0.5), np.bool_(True), None], "d": DAY, "é": np.array([[1, 2]])}
    assert stored.canonical(value) == '{"a":[0.5,true,null],"b":3,"d":"2024-01-01","é":[[1,2]]}'
    with pytest.raises(ValueError):
        stored.canonical({"x": float("nan")})
    with pytest.raises(TypeError):
        stored.canonical({"x": object()})


def test_drivers_of_a_linear_score(spark):
    df = spark.createDataFrame([(1.0, -5.0, 0.1), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(stored.drivers({"bias": 9, "a": 1.0, "b": 0.5, "c": 30.0}, ["a", "b", "c"], 2)).collect()]
    assert got == ["c,b", "a,b"]
