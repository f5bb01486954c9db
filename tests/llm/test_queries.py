"""Every query against a plain brute-force version, on the small tables and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from barograph.llm import packing, quality_rules, registry
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def run(spark, name: str, sf_dir: str) -> list:
    return registry.QUERIES[name](spark, sf_dir).collect()


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def held(doc_id, m: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % m == 2


def crc_ids(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_an_empty_table_gives_no_rows(spark, name, empty):
    assert run(spark, name, empty) == []


def test_op1(spark, sf_dir):
    got, docs = run(spark, "op1_label_propagation", sf_dir), rows_of(sf_dir, "documents")
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, texts = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        texts[r["text_crc32"], r["size"]][r["shard"]] += 1
    counts = [len(slots[s]) for s in range(24)]
    assert set(slots) <= set(range(24)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    # links between copies are seldom cut where a group fits a shard; hashing would cut nearly all
    room = len(docs) // 24
    groups = [c for c in texts.values() if 1 < sum(c.values()) <= room]
    if groups:
        assert sum(max(c.values()) for c in groups) >= 0.7 * sum(sum(c.values()) for c in groups)


def test_op2(spark, sf_dir):
    want = Counter()
    for d in rows_of(sf_dir, "documents"):
        raw = (d["text"] or "").encode()
        p = raw + b"\xff" * ((576 - len(raw) % 576) % 576 if raw else 576)
        want[d["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    got = run(spark, "op2_signature_sniffing", sf_dir)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"], r["n_bytes"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())


def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t


def want_pieces(docs) -> Counter:
    t, want = tokenizer("byte_bpe_50k.json"), Counter()
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[d["doc_id"], k, a, b - a, crc_ids(ids[a:b])] += 1
    return want


def check_places(got) -> None:
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in places.values():
        v.sort()
        assert v[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(v)) and sum(v[-1]) <= 1024
    least = math.ceil(sum(r["length"] for r in got) / 1024)
    assert len(places) <= max(least + 2, 1.02 * least)


def test_op3(spark, sf_dir):
    got = run(spark, "op3_best_fit_packing", sf_dir)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want_pieces(rows_of(sf_dir, "documents"))
    check_places(got)


def test_op4(spark, sf_dir):
    pages = rows_of(sf_dir, "pages")
    sha = [base64.b32encode(hashlib.sha1((p["html"] or "").encode()).digest()).decode() for p in pages]
    first: dict = {}
    for p, s in zip(pages, sha, strict=True):
        if p["page_id"] is not None:
            first[s] = min(first.get(s, p["page_id"]), p["page_id"])
    want = Counter()
    for p, s in zip(pages, sha, strict=True):
        again = p["page_id"] is not None and p["page_id"] > first[s]
        want[p["page_id"], len((p["html"] or "").encode()), s, "revisit" if again else "response", first[s] if again else None] += 1
    assert bag(run(spark, "op4_warc_normaliser", sf_dir)) == want


def base_of(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    at = defaultdict(list)
    for i in range(n - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def js(p, q) -> float:
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) / 2 for x in (a, b) if x > 0)
    return math.sqrt(max(total, 0.0))


def histograms(text: str | None, lang: str | None):
    import regex

    t, q = text or "", quality_rules
    chars = [len(regex.findall(f"[{c}]", t)) for c in q.CLASSES.values()]
    chars.append(len(t) - sum(chars))
    words = WORD.findall(t)
    p = [c / len(t) for c in chars] if t else None
    if lang not in q.COMMON_WORDS or not words:
        return p, None
    hits = Counter(q.COMMON_WORDS[lang].index(w) + 1 if (w := x.rstrip(q.TRIM).lower()) in q.COMMON_WORDS[lang] else 0 for x in words)
    return p, [hits[i] / len(words) for i in range(13)]


def half_up(x: float) -> int:
    return int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP))


def medians_of_cells(rows) -> tuple:
    """References of (language, p, q) rows: texts alike to a hundredth are one cell; medians of the cells' means, scaled to one."""
    q = quality_rules
    cells = defaultdict(list)
    for lang, p, w in rows:
        cells[lang, tuple(half_up(x * q.CELLS) for x in p), w and tuple(half_up(x * q.CELLS) for x in w)].append((p, w))
    out = []
    for side in (0, 1):
        means = [[half_up(sum(half_up(x * q.UNITS) for x in col) / len(v)) for col in zip(*[r[side] for r in v], strict=True)] for v in cells.values() if v[0][side] is not None]
        if not means:
            out.append(None)
            continue
        cols = list(zip(*means, strict=True))
        middle = [float(np.percentile(c, 50)) for c in cols]
        if not sum(middle):
            middle = [sum(c) / len(c) for c in cols]
        out.append([round(m / sum(middle), 6) for m in middle])
    return tuple(out)


def quality_verdicts(docs) -> list[tuple]:
    q = quality_rules
    found, sums = [], defaultdict(list)
    for d in docs:
        base = base_of(d["text"])
        p, w = histograms(d["text"], d["lang"])
        found.append((d, base, p, w))
        if base[0] >= q.MIN_WORDS and len(d["text"]) >= q.MIN_CHARS:
            sums[d["lang"] if d["lang"] in q.COMMON_WORDS else "*"].append((p, w))
    refs = {}
    for key in [k for k in sums if k != "*"]:
        refs[key] = medians_of_cells([(key, *r) for r in sums[key]])
    if sums:
        refs["*"] = (medians_of_cells([(k, *r) for k, v in sums.items() for r in v])[0], None)
    out = []
    for d, base, p, w in found:
        rp, rw = refs.get(d["lang"] if d["lang"] in q.COMMON_WORDS else "*", (None, None))
        far = p is not None and rp is not None and len(d["text"]) >= q.MIN_CHARS and js(p, rp) > q.CHAR_LIMIT
        far |= w is not None and rw is not None and base[0] >= q.MIN_WORDS and js(w, rw) > q.WORD_LIMIT
        out.append((d["doc_id"], *base, not base[5] and not far))
    return out


def test_op5(spark, sf_dir):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in run(spark, "op5_quality_rules", sf_dir))
    assert got == Counter(quality_verdicts(rows_of(sf_dir, "documents")))


@pytest.mark.parametrize("share", [1 / 3, 1 / 2])
@pytest.mark.parametrize("kind", ["copies", "near copies"])
def test_op5_is_not_judged_by_one_junk_text_of_many_copies(spark, share, kind):
    """One rejected text, repeated up to that share of its language, changes no labelled row's verdict."""
    from pyspark.sql import functions as F

    from barograph.llm.common import table

    d = "/root/testdata/sf0.01"
    quality = {x["doc_id"]: x["quality"] for x in rows_of(d, "labels")}
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text", "lang")
    verdicts = lambda df: {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, ["doc_id"]).select("row.doc_id", "kept", "base_failed").collect() if not r["base_failed"] and quality.get(r["doc_id"]) is not None}
    alone = verdicts(docs)
    bad = sorted(i for i, kept in alone.items() if quality[i] == 0 and not kept)
    assert len(bad) >= 15 and all(kept for i, kept in alone.items() if quality[i] == 1)
    n = int(docs.count() * share / (1 - share)) + 1
    text = F.col("text") if kind == "copies" else F.concat("text", F.lit(" x"), F.col("k").cast("string"))
    junk = docs.where(F.col("doc_id") == bad[0]).crossJoin(spark.range(n).withColumnRenamed("id", "k")).select(F.lit(-1).cast("long").alias("doc_id"), text.alias("text"), "lang")
    assert verdicts(docs.unionByName(junk)) == alone


def groups_of(docs, k: int) -> list[tuple]:
    """(doc_id, set size, component) by comparing every pair of distinct sets."""
    sets = []
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    kinds = [s for s in dict.fromkeys(sets) if s]
    for a, b in itertools.combinations(kinds, 2):
        if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            root[find(a)] = find(b)
    least: dict = {}
    for d, s in zip(docs, sets, strict=True):
        if s and d["doc_id"] is not None:
            least[find(s)] = min(least.get(find(s), d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], len(s), least.get(find(s), d["doc_id"]) if s else d["doc_id"]) for d, s in zip(docs, sets, strict=True)]


def test_op6(spark, sf_dir):
    got, want = run(spark, "op6_minhash_near_dedup", sf_dir), groups_of(rows_of(sf_dir, "documents"), 4)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("changed", [0, 4])
def test_op6_hands_out_few_links(spark, changed):
    """One group of N near copies, all alike or (with four of its words changed in each) about 0.8 from each other: 2 N links at most, none lost."""
    import random

    from barograph.llm import minhash

    n, rnd = 600, random.Random(changed)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(n):
        w = base.copy()
        for at in rnd.sample(range(160), changed):
            w[at] = f"x{rnd.randrange(3)}"
        texts.append(" ".join([*w, f"end{i}"]))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, doc_id long, text string").repartition(4)
    sig = minhash.signatures(rows, 4).select(minhash.F.col("key").alias("id"), minhash.F.explode("bands").alias("bucket"))
    links, _ = minhash.class_links(rows.select(minhash.F.col("key").alias("id")), sig, rows, 4, 80)
    assert sum(x.count() for x in links) <= 2 * n
    got = minhash.near_duplicates(rows.select("doc_id", "text"), 4, 80).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(groups_of([{"doc_id": i, "text": t} for i, t in enumerate(texts)], 4))


def test_components_of_any_graph(spark):
    import random

    from barograph.llm.components import components

    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rnd.randrange(300, 360), rnd.randrange(300, 360)) for _ in range(45)] + [(5, 5), (None, 4), (3, None), (8, 9), (9, 8), (9, 8)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["id"], r["comp"]) for r in got) == sorted((x, find(x)) for x in list(root))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_loses_no_text_that_is_not_a_copy(spark):
    from barograph.llm import minhash

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    near = a.replace("a40", "changed")
    given = [(None, c), (None, a), (1, a), (1, b), (1, b), (0, near), (7, d), (None, d), (8, ""), (8, ""), (9, ""), (None, "")]
    rows = minhash.keep_one(spark.createDataFrame(given, "doc_id long, text string"), 5, 80).collect()
    assert bag(rows) == Counter([(None, c), (0, near), (1, b), (7, d), (8, ""), (9, ""), (None, "")])


def test_op7(spark, sf_dir):
    got, docs = run(spark, "op7_nbest_segmentation", sf_dir), rows_of(sf_dir, "documents")
    assert len(got) == len(docs) and all(r["round_trip"] for r in got)
    assert all([x["score"] for x in r["nbest"]] == sorted((x["score"] for x in r["nbest"]), reverse=True) for r in got)


def test_op8(spark, sf_dir):
    docs = rows_of(sf_dir, "documents")
    token = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
    train = Counter(w for d in docs if not held(d["doc_id"], 7) for w in token(d["text"]))
    n, v = sum(train.values()), len(train)
    want = defaultdict(list)
    for d in docs:
        w = token(d["text"])
        want[d["doc_id"], held(d["doc_id"], 7), len(w), sum(train[x] > 0 for x in w), n].append(sum(math.log10((train[x] + 1) / (n + 1 * (v + 1))) for x in w))
    got = defaultdict(list)
    rows = run(spark, "op8_context_mixing", sf_dir)
    for r in rows:
        got[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]].append(r["base_score"])
    assert got.keys() == want.keys()
    for k, scores in want.items():
        assert sorted(got[k]) == pytest.approx(sorted(scores), rel=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_op8_codes_held_out_texts_in_far_less_than_a_byte_each(spark):
    """With two hundred texts to learn from, order-four contexts already halve the bits of a plain byte."""
    docs = {d["doc_id"]: len((d["text"] or "").encode()) for d in rows_of("/root/testdata/sf0.001", "documents")}
    rows = [r for r in run(spark, "op8_context_mixing", "/root/testdata/sf0.001") if r["held_out"]]
    bits = -sum(r["score"] for r in rows) / math.log10(2)
    assert bits / sum(docs[r["doc_id"]] for r in rows) < 4


def test_op9(spark, sf_dir):
    t = tokenizer("word_bpe_49k.json")
    docs = sorted(rows_of(sf_dir, "documents"), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0))
    got = run(spark, "op9_simple8b", sf_dir)
    want = Counter((d["doc_id"], len(ids), crc_ids(ids)) for d in docs for ids in [t.encode(d["text"] or "", add_special_tokens=False).ids + [2]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]


def test_words_of_simple8b_hold_any_ids():
    """Every width, runs of zeros, escapes beyond 60 bits, and blocks that end short."""
    from barograph.llm.simple8b import dump, load

    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 3, 900, 50_000, 1 << 31, 1 << 59, 1 << 63):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            ids[rng.random(n) < 0.3] = 0
            doc_ids, counts, back = load(dump(np.arange(2), np.array([n // 2, n - n // 2]), ids))
            assert (back == ids).all() and counts.tolist() == [n // 2, n - n // 2] and doc_ids.tolist() == [0, 1]


def test_op10(spark, sf_dir):
    docs, got = rows_of(sf_dir, "documents"), run(spark, "op10_toxicity", sf_dir)
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((d["doc_id"], held(d["doc_id"], 4)) for d in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_op10_does_not_depend_on_how_rows_are_dealt(spark):
    from barograph.llm import toxicity
    from barograph.llm.common import table

    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    copies = docs.unionByName(docs.where("doc_id % 3 = 0"))  # copies choose nothing either
    scores = [{(r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.fit(x, labels)).collect()} for x in (docs.coalesce(1), docs.repartition(8), copies.repartition(64))]
    assert scores[0] == scores[1] == scores[2]


def test_op4_deals_archives_over_tasks(spark, monkeypatch):
    from barograph.llm import warc
    from barograph.llm.common import new_path, table

    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 5)
    folder = new_path(spark, "warc-test")
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    done = warc.normalise(warc.with_revisits(warc.write_monolithic(pages, folder)), folder)
    assert done.count() == 10 and len({f.rsplit("/", 1)[1] for f in done.inputFiles()}) > 1
    assert warc.read_archives(done, folder).count() == pages.count()


def test_op1_does_not_depend_on_the_layout(spark):
    from barograph.llm import sharding
    from barograph.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(x).collect()) for x in (docs, docs.repartition(7))]
    assert rows[0] == rows[1]


def test_op1_fills_shards_with_a_group_larger_than_one(spark):
    """A third of all rows in one group, and many small groups: the large one lies in the eleven shards that it needs beside the small ones, few of which are cut."""
    from barograph.llm import sharding

    texts = ["hot"] * 1600 + [f"g{i // 4}" for i in range(1200)] + [f"alone {i}" for i in range(2000)]
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    shards = defaultdict(Counter)
    for r in got:
        shards[texts[r["doc_id"]]][r["shard"]] += 1
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(sorted(shards["hot"].values())[-11:]) >= 0.9 * 1600
    assert sum(len(shards[f"g{i}"]) == 1 for i in range(300)) >= 240


def test_op10_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"  # the smaller tables have 14 held-out toxic rows at most, a third of them without any toxic word
    toxic = {x["doc_id"]: x["toxic"] for x in rows_of(d, "labels") if x["toxic"] is not None}
    rows = [(r["score"], toxic[r["doc_id"]]) for r in run(spark, "op10_toxicity", d) if r["held_out"] and r["doc_id"] in toxic]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= 0.95


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline
    from barograph.llm import toxicity
    from barograph.llm.common import materialise, table

    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    at, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, sf_dir), "stage-test")
        assert after.columns == names
        at[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
        before = after
    given, kept = at["toxicity"]
    slots = toxicity.SlotCache({} if model.slots is None else {int(s): i for i, s in enumerate(model.slots)})
    assert Counter(d["doc_id"] for d in kept) == Counter(d["doc_id"] for d in given if model.score(slots(d["text"])) < 0.3)
    given, kept = at["quality rules"]
    assert Counter(d["doc_id"] for d in kept) == Counter(v[0] for v in quality_verdicts(given) if v[-1])
    given, kept = at["near-duplicates"]
    assert sorted(d["doc_id"] for d in kept) == sorted({g[0] for g in groups_of(given, 5) if g[0] == g[2]})
    got = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want_pieces(kept)
    check_places(got)
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(got)


def test_pipeline_of_nothing(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []


def test_patterns_use_up_a_histogram_exactly():
    """Whatever the lengths, the plan's contents are the histogram, no content is too long, and fitted patterns place most of a smooth one."""
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 1024, 20_000), np.minimum(1023, rng.geometric(1 / 90, 30_000)), np.array([1, 1, 2, 1023]), np.full(500, 513), np.zeros(0, int)):
        have = np.bincount(lengths, minlength=1025)
        made = packing.plan(have, 1024)
        used = np.zeros_like(have)
        for content, count in made:
            assert sum(content) <= 1024 and count > 0
            np.add.at(used, list(content), count)
        assert (used == have).all()
    x = packing.nnls_counts(np.array([0, 0, 6, 4, 0, 0]), [(3, 2), (2, 2)])
    assert x == pytest.approx([4, 1], abs=0.05)


def test_piece_cut_is_defined_by_the_remainder():
    assert packing.SIZE == 1024 and packing.END_ID == 2
