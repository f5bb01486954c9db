"""Near-duplicates by min-max hashing: each permutation gives its minimum and its maximum.

80 multiplicative permutations of the 64-bit shingle hashes give 160 signature values at half the hash
evaluations; minima and maxima are banded five at a time into 32 band keys, so a pair at similarity 0.8
misses every band with probability (1 - 0.8**5)**32 = 3e-6.

1. Rows with equal shingle sets fall into one class (128-bit digest of the set), its least row key stands for
   it. Only these representatives are banded.
2. Each representative meets one other: the least key in all its buckets, the pivot. At most one link a
   representative comes of it, each to a smaller key, so that a group of near copies is a star or nearly so.
3. In buckets that still hold several components, members of another component than the bucket's pivot meet that.
4. Such buckets of three or more are also compared in blocks of 128 rows, as matrix
   products: all members outside the bucket's largest component with all others. A block hands out a spanning
   forest of the components it joins, fewer links than it has rows; no pairs of a group are ever written out.
5. Components of all links, and classes, give each row the least doc_id it can reach.

Every link is confirmed on the two full sets of 64-bit shingle hashes (two different shingles of a pair agree
once in 2**64), never on signatures. Sets are made from the whole texts again where they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import join_skewed, materialise, table, unused
from barograph.llm.components import components, followed, roots

PERMUTATIONS, ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK = 128
WORDS_KNOWN = 300_000

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHash(dict):
    """word -> 64-bit hash, bounded: it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: A Python worker's words, kept for its next tasks.
KNOWN = WordHash()


def shingles(text: str | None, k: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text gives its whole sequence as one."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    width = min(k, n)
    s = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        s += h[j : n - width + 1 + j] * _POSITION[j]
    return np.unique(mix(s + np.uint64(width)))


def set_digest(s: np.ndarray) -> bytes | None:
    if not len(s):
        return None
    return np.array([mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(), np.bitwise_xor.reduce(mix(s + np.uint64(len(s))))], np.uint64).tobytes()


def band_keys(s: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 4096):
        x = _MULT[:, None] * s[None, at : at + 4096]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return mix((np.concatenate([low, high]).reshape(BANDS, ROWS) * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """rows(key, text) -> key, n_shingles, set_id (null for texts without words), bands."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = (shingles(t, k, KNOWN) for t in b["text"])  # one text's set at a time
            rows = [(len(s), set_digest(s), band_keys(s) if len(s) else None) for s in sets]
            yield pd.DataFrame({"key": b["key"], "n_shingles": [r[0] for r in rows], "set_id": [r[1] for r in rows], "bands": [r[2] for r in rows]})

    return rows.select("key", "text").mapInPandas(make, "key long, n_shingles long, set_id binary, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, rows: DataFrame, k: int, percent: int, share: int = 1000) -> DataFrame:
    """Of pairs(a, b, ...), a row for each a and b, those whose full shingle sets reach the similarity; without the texts.

    A pivot b may stand in a third of all pairs: pairs of such a b are dealt over up to `share` parts, none with
    more than 1/share of all, and b's text goes to each of its parts. A task keeps the set of the last b. Texts
    are always joined by sort and merge, however small the pairs, so that the plan is the same at any size.
    """
    total = pairs.count()
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > total)  # fewer than `share` rows
    parts = F.broadcast(counts.select("b", F.ceil(F.col("n") * share / max(total, 1)).alias("parts")))
    texts = rows.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    goal = texts.join(pairs.select("b").distinct().hint("merge"), "b", "left_semi").join(parts, "b", "left")
    goal = goal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = pairs.join(parts, "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0))).drop("parts")
    both = dealt.join(rows.select(F.col("key").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(goal.hint("merge"), ["b", "part"])
    names = pairs.columns

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for x in batches:
            ok = []
            for a, b, ta, tb in zip(x["a"], x["b"], x["ta"], x["tb"], strict=True):
                if b != last:
                    last, kept = b, shingles(tb, k, KNOWN)
                ok.append(similar(shingles(ta, k, KNOWN), kept, percent))
            yield x.loc[ok, names]

    return both.select(*names, "ta", "tb").mapInPandas(check, pairs.schema)


def _forest(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of links between labels, a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
            yield a, b


def _block_links(x: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the components that the rows of the two roles in one block link."""
    left, right = x[x["role"] == 0], x[x["role"] == 1]
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    sets = [np.asarray(s) for s in [*left["s"], *right["s"]]]
    sizes = np.array([len(s) for s in sets])
    terms, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(terms), 8192):  # bounded width of the incidence matrices
        m = np.zeros((len(sets), min(8192, len(terms) - at)), np.float32)
        inside = (code >= at) & (code < at + 8192)
        m[row[inside], code[inside] - at] = 1
        both += m[: len(left)] @ m[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - both
    p, q = left["comp"].to_numpy(), right["comp"].to_numpy()
    i, j = np.nonzero((100 * both >= percent * union) & (p[:, None] != q[None, :]))
    return pd.DataFrame(list(_forest(p[i], q[j])), columns=["a", "b"]).astype("int64")


def with_labels(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """buckets(bucket, id, ...) with comp; a representative has a row in each of its buckets, BANDS at most."""
    return buckets.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def cross_links(members: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components inside members(bucket, id, comp) of buckets of three or more."""
    by_comp = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        by_comp.groupBy("bucket")
        .agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("major"), F.max("n").alias("most"))
        .where("size > 2 and comps > 1")
        .select("bucket", "size", "major", F.ceil((F.col("size") - F.col("most")) / BLOCK).alias("nx"), F.ceil(F.col("size") / BLOCK).alias("ny"))
    )
    mixed = materialise(mixed, "mixed")
    total = mixed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return members.select(F.col("id").alias("a"), F.col("comp").alias("b")).where("false")
    inside = materialise(join_skewed(members.select("bucket", "id", "comp"), mixed.drop("size"), "bucket", mixed, "size", total, "inner"), "inside")
    texts = rows.select(F.col("key").alias("id"), "text").join(inside.select("id").distinct().hint("merge"), "id", "left_semi")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "s": [shingles(t, k, KNOWN).view(np.int64) for t in b["text"]]})

    sets = texts.mapInPandas(sets_of, "id long, s array<long>")
    x = inside.where("comp <> major").select("bucket", "id", "comp", F.lit(0).alias("role"), F.pmod(F.xxhash64("id", F.lit(1)), "nx").alias("cx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("cy"))
    y = inside.select("bucket", "id", "comp", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("cx"), F.pmod(F.xxhash64("id", F.lit(2)), "ny").alias("cy"))
    blocks = x.unionByName(y).join(sets, "id")
    return blocks.groupBy("bucket", "cx", "cy").applyInPandas(lambda d: _block_links(d, percent), "a long, b long").distinct()


def class_links(classes: DataFrame, banded: DataFrame, rows: DataFrame, k: int, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """(the links of steps 2 to 4, the components of all of them) of classes(id, ...) and banded(id, bucket).

    Links of step 2 lead from each representative to one smaller key, a forest, so its roots are its components.
    Step 3 starts from those and finds links between them, which are few, and step 4 from what step 3 has joined.
    """
    shared = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(shared, "shared")
    total = classes.count() * BANDS
    buckets = materialise(join_skewed(banded, shared.drop("n"), "bucket", shared, "n", total, "inner"), "buckets")
    # of the texts only those with a partner in some bucket are read from here on
    rows = materialise(rows.select("key", "text").join(buckets.select(F.col("id").alias("key")).distinct().hint("merge"), "key", "left_semi"), "texts")
    pairs = buckets.where("id <> pivot").groupBy(F.col("id").alias("a")).agg(F.min("pivot").alias("b"))
    links = [materialise(confirm(materialise(pairs, "pairs"), rows, k, percent), "links")]
    labels = roots(links[0].select(F.col("a").alias("id"), F.col("b").alias("comp")))
    # a bucket whose members are all of one component has nothing left to find
    open_buckets = with_labels(buckets, labels).groupBy("bucket").agg(F.count_distinct("comp").alias("comps"), F.count(F.lit(1)).alias("n")).where("comps > 1").select("bucket", "n")
    open_buckets = materialise(open_buckets, "open-buckets")
    left = open_buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not left:
        return links, labels
    kept = materialise(with_labels(join_skewed(buckets, open_buckets.select("bucket"), "bucket", open_buckets, "n", total, "inner"), labels), "kept-buckets")
    pivots = kept.where("id = pivot").select("pivot", F.col("comp").alias("pivot_comp")).distinct()
    per_pivot = kept.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    apart = join_skewed(kept, pivots, "pivot", per_pivot, "n", left, "inner").where("comp <> pivot_comp")
    more = apart.groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.min("comp").alias("ca"), F.min("pivot_comp").alias("cb"))
    found = confirm(materialise(more, "pairs"), rows, k, percent)
    links.append(materialise(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links"))
    if not links[1].isEmpty():  # what the pivots join need not be compared in blocks
        labels = _joined(labels, links[1])
        kept = with_labels(kept.drop("comp"), labels)
    links.append(materialise(cross_links(kept.select("bucket", "id", "comp"), rows, k, percent), "links"))
    return links, labels if links[2].isEmpty() else _joined(labels, links[2])


def _joined(labels: DataFrame, between: DataFrame) -> DataFrame:
    """labels(id, comp) after links (a, b) between components; components of one representative may have no row in labels yet."""
    led = components(between)
    return materialise(followed(labels, led).unionByName(led.join(labels.select("id"), "id", "left_anti")), "labels")


def grouped(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows(key, text, doc_id), materialised, key unique -> key, doc_id, n_shingles, comp: the key of its group, null without words."""
    sig = materialise(signatures(rows, k), "signatures")
    worded = sig.where("set_id is not null")
    classes = materialise(worded.groupBy("set_id").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    banded = worded.join(classes.select(F.col("id").alias("key")), "key", "left_semi").select(F.col("key").alias("id"), F.explode("bands").alias("bucket"))
    labels = class_links(classes, banded, rows, k, percent)[1]
    named = classes.join(labels, "id", "left").select("set_id", F.coalesce("comp", "id").alias("comp"))
    out = join_skewed(sig.drop("bands"), named, "set_id", classes, "n", max(1, sig.count()), "left")
    return out.join(rows.select("key", "doc_id"), "key").select("key", "doc_id", "n_shingles", "comp")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, a row for each row.

    Defined cases: texts that are null, empty or without words have no shingles, stand alone and are kept; rows
    are judged by their texts, so two texts under one doc_id are in the groups of their own texts; a row
    without doc_id is in its text's group and kept only if no row there has one; repeated rows get the same
    component and are kept alike; other columns are ignored.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    found = materialise(grouped(rows, k, percent), "groups")
    sizes = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = join_skewed(found, sizes.drop("n"), "comp", sizes, "n", max(1, found.count()), "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one of each group of near texts, all columns: the one with the least doc_id.

    Defined cases: a row without doc_id stays unless its group has one with doc_id; different texts under one
    doc_id are judged each; texts without words are copies only of those with the same doc_id.
    """
    row_key = unused("_row_key", docs.columns)
    rows = materialise(docs.withColumn(row_key, F.monotonically_increasing_id()), "rows")
    found = grouped(rows.select(F.col(row_key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    alone = F.col("comp").isNull() & F.col("doc_id").isNotNull()
    named = found.select("key", "doc_id", F.when(alone, F.col("doc_id")).alias("wordless"), F.when(~alone, F.coalesce("comp", "key")).alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    kept = named.groupBy("wordless", "group").agg(first.alias("first")).select(F.col("first.key").alias(row_key))
    return rows.join(kept, row_key, "left_semi").select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


QUERIES = {"op6_minhash_near_dedup": op6_minhash_near_dedup}
#: Exact: every pair that shares a shingle, then components by recursion.
ORACLES = {
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END AS s
  FROM w),
cls AS (SELECT list_sort(s) AS k, min(doc_id) AS rep, len(any_value(s)) AS n FROM s GROUP BY 1),
e AS (SELECT rep, n, unnest(k) AS g FROM cls),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS id, rep AS r FROM cls UNION SELECT reach.id, two.b FROM reach JOIN two ON reach.r = two.a),
comp AS (SELECT id, min(r) AS comp FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE comp.comp END AS component_id,
  CASE WHEN len(s.s) = 0 THEN TRUE ELSE comp.comp = s.doc_id END AS kept
FROM s JOIN cls ON list_sort(s.s) = cls.k JOIN comp ON comp.id = cls.rep"""
}
