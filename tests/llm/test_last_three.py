"""Hard negatives, decontamination and conversation repair against plain versions, on small tables and awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barograph.llm import hard_negatives, registry, repair, winnowing
from tests.llm.conftest import rows_of

LOWER = {i: i + 32 for i in range(65, 91)}


def run(spark, name: str, sf_dir: str) -> list:
    return registry.QUERIES[name](spark, sf_dir).collect()


def negatives_of(rows) -> Counter:
    base = []
    for r in rows:
        v, i, label = r["embedding"], r["vec_id"], r["label"]
        if v is None or i is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in w) < 2**53:
            base.append((i, (label + 1) % 10 if i % 7 == 0 else label, w))
    want: Counter = Counter()
    for k, (anchor, label, v) in enumerate(base):
        if anchor % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i, other == label) for j, (i, other, w) in enumerate(base) if j != k)
        for s, i, _ in [x for x in scored if x[2]][:5]:
            fits = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            for n, (t, j, _) in enumerate(fits[:3]):
                want[anchor, i, n + 1, j, -s, -t] += 1
    return want


def test_op11(spark, sf_dir):
    got = run(spark, "op11_distance_keys", sf_dir)
    assert Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == negatives_of(rows_of(sf_dir, "embeddings"))


def test_search_reads_a_part_and_is_exact_over_many_cells(spark, monkeypatch):
    """Clustered vectors, small cells and chunks: later rounds are needed by some queries only, results stay those of a full scan."""
    for c, v in (("CELL", 20), ("CHUNK", 16), ("QUERIES_AT_ONCE", 8)):
        monkeypatch.setattr(hard_negatives, c, v)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 0.05
    rows = [{"vec_id": i, "label": int(i % 4), "embedding": [float(np.float32(c)) for c in v]} for i, v in enumerate(x)]
    df = spark.createDataFrame([(r["vec_id"], r["label"], r["embedding"]) for r in rows], "vec_id long, label int, embedding array<float>")
    moved = [r | {"label": r["label"]} for r in rows]
    got = hard_negatives.mine(df).collect()
    want = negatives_of([r | {"label": (r["label"] - 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]} for r in moved])
    assert Counter(map(tuple, got)) == want and len(got) > 100
    index = hard_negatives.Index(hard_negatives.prepared(df))
    assert len(index.cells) > 10 and index.cells["n"].sum() == 900


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_of(docs, items) -> list[tuple]:
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for r in items:
        w = words(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(r["item_id"])
    sizes = {len(k) for k in windows}
    out = []
    for d in docs:
        w, hit, found = words(d["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k] - {None}
        ids = sorted(map(str, found))
        out.append((d["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("sent", [winnowing.SENT, 0])
def test_op12(spark, sf_dir, sent, monkeypatch):
    """With and without broadcasts."""
    monkeypatch.setattr(winnowing, "SENT", sent)
    got = run(spark, "op12_winnowing", sf_dir)
    want = hits_of(rows_of(sf_dir, "documents"), rows_of(sf_dir, "benchmark"))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == Counter(want)
    assert any(x[5] for x in want)


def test_op12_plan_has_no_python(spark, awkward):
    assert not re.search("Python|Pandas|Arrow", registry.QUERIES["op12_winnowing"](spark, awkward)._jdf.queryExecution().toString())


def test_winnowing_keeps_every_shared_run_of_ten_words(spark):
    """Whatever surrounds ten shared words, both sides keep one fingerprint in common."""
    rnd = random.Random(11)
    shared = [f"s{i}" for i in range(10)]
    texts = [" ".join([rnd.choice("abcdefg") for _ in range(rnd.randrange(30))] + shared + [rnd.choice("abcdefg") for _ in range(rnd.randrange(30))]) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kept = [set(r[0]) for r in winnowing.with_kept(df.select(winnowing.words(df["text"]).alias("_words"))).select("_kept").collect()]
    assert set.intersection(*kept)


def test_spans_are_as_long_as_what_is_shared(spark):
    item = " ".join(f"i{n}" for n in range(60))
    text = "before " + " ".join(f"i{n}" for n in range(5, 58)) + " between " + " ".join(f"i{n}" for n in range(12)) + " short i1 i2 i3 end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((r["start"], r["length"]) for r in winnowing.hit_spans(docs, items).collect())
    assert got == [(1, 53), (55, 12)]


def shortest(symbols: list[tuple[str, str]]) -> tuple[int, str]:
    """Uniform-cost search over (cost, labels): symbols are (initial, fault or '')."""
    grammar = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    todo, done = [(0, "", 0, 0)], set()
    while True:
        cost, path, i, state = heapq.heappop(todo)
        if i == len(symbols) and state in (0, 3):
            return cost, path
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in "ua":
            if (state, r) in grammar:
                heapq.heappush(todo, (cost + 2, path + "I", i, grammar[state, r]))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(todo, (cost + 3, path + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, initial) in grammar:
                    heapq.heappush(todo, (cost + more, path + "K", i + 1, grammar[state, initial]))
                for r in "ua":
                    if (state, r) in grammar:
                        heapq.heappush(todo, (cost + 2 + more, path + "R", i + 1, grammar[state, r]))


def repair_of(rows) -> list[tuple]:
    by: dict = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(r)
    out = []
    for conv, own in by.items():
        after = []
        for r in own:
            say = lambda x: " " if x is None else str(x)
            kind = zlib.crc32(f"{say(conv)}:{say(r['turn'])}".encode()) % 20
            role, text = say(r["role"]), say(r["text"])
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(r["turn"], role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in after:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in after if t is not None]
        initials = [r[:1] for _, r, _ in after]
        cost, audit = shortest(list(zip(initials, faults, strict=True)))
        lines, k, want = [], 0, {0: "user", 1: "user", 2: "assistant", 3: "user"}
        state = 0
        for e in audit:
            role, text = ("", "") if e == "I" else after[k][1:]
            k += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else want[state]
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        count = Counter(faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_op13(spark, sf_dir):
    got = run(spark, "op13_fst_repair", sf_dir)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(repair_of(rows_of(sf_dir, "conversations")))


def test_shortest_paths_of_many_short_conversations():
    rnd = random.Random(2)
    shared: tuple = (repair.Composed(), [], {})
    for _ in range(4000):
        symbols = [(rnd.choice("suax"), rnd.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randrange(8))]
        path = repair.Path(*shared)
        for initial, fault in symbols:
            path.add(initial + {"": ".", "truncated": "~"}.get(fault, "!"))
        assert path.solve() == shortest(symbols)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "a?"), (1, 3, "user", "a?"), (1, 4, "tool", "x."), (2, 0, "user", " "), (2, 1, "assistant", None)]
    got = sorted(map(tuple, repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert got == [(1, 0, "K", "system", "Be brief."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hello."), (1, 3, "K", "user", "a?"), (1, 4, "R", "assistant", "x.")]
