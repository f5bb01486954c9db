"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's k-gram hashes are looked at through every window of w neighbours, and each window keeps its least. With
k = 6 and w = 5 any ten words that two texts share lie in one such window of either, which keeps the same hash in
both: no shared span of ten words is missed, and a third of the hashes are stored.

1. Every run of ten item words is a window with the fingerprint it keeps, its own hash and its words. An item of
   fewer words is one window and its own fingerprint; for each such length that occurs, the texts give all their
   hashes of that length too (winnowing in windows of one).
2. Texts give their distinct fingerprints; those that an item has too name the texts to be looked at.
3. Hits are extended in these texts alone, each once however many copies it has: the hashes of all their windows
   meet the items' windows, the words are compared, and the union of all that stands makes the hit words, so a
   span runs on as long as windows follow each other.

Hashes only choose; what counts has equal words. Fingerprints and windows of the items are broadcast where their
counts, known before, are under SENT rows; beyond that the same joins are shuffled.

Defined cases: null and empty texts have no words, take no hit, and as items none; items that repeat or share an
id count once; an item without id marks words but is not listed; rows that repeat are judged each; very long
texts are whole arrays within their row; no documents give no rows, no items give no hits; other columns,
whatever their names, are ignored by `judge` but for those it is asked to carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm.common import materialise, table

#: Words of a window, of a hashed gram, and grams that one minimum is kept of.
SPAN, GRAM = 10, 6
KEEP = SPAN - GRAM + 1
#: Most rows that a join may broadcast: some 24 bytes each for fingerprints and keys, 200 for windows.
SENT = 200_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters, digits and all beyond ASCII; A-Z are lower-cased, nothing else is."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def _ahead(a: str, by: int, n: Column) -> Column:
    """`n` elements of the array column `a` from place `by` on."""
    return F.slice(a, F.lit(by + 1), F.greatest(n, F.lit(0)))


def with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """_g<length> for each asked length: hashes of that many words at every place, from _words; longer ones from halves."""
    made = {1: "_g1"}
    df = df.withColumn("_g1", F.transform("_words", lambda x: F.xxhash64(x)))

    def make(df: DataFrame, length: int) -> DataFrame:
        if length in made:
            return df
        first = 1 << ((length - 1).bit_length() - 1)  # the largest power of two below
        df = make(make(df, first), length - first)
        n = F.size("_words") - (length - 1)
        made[length] = f"_g{length}"
        return df.withColumn(f"_g{length}", F.zip_with(_ahead(made[first], 0, n), _ahead(made[length - first], first, n), lambda a, b: F.xxhash64(a, b)))

    for length in lengths:
        df = make(df, length)
    return df


def with_kept(df: DataFrame) -> DataFrame:
    """_kept: at each place the least of KEEP gram hashes from there on, so one for each run of SPAN words."""
    df, width, at = with_grams(df, [GRAM]), 1, f"_g{GRAM}"
    while width < KEEP:
        step = min(width, KEEP - width)
        n = F.size(at) - step
        df = df.withColumn(f"_m{width + step}", F.zip_with(_ahead(at, 0, n), _ahead(at, step, n), lambda a, b: F.least(a, b)))
        width, at = width + step, f"_m{width + step}"
    return df.withColumnRenamed(at, "_kept")


def windows(items: DataFrame) -> DataFrame:
    """item_id, print, hash, length, words of every window of items(item_id, text)."""
    base = materialise(items.select("item_id", words(F.col("text")).alias("_words")).where(F.size("_words") > 0), "items")
    long = with_grams(with_kept(base.where(F.size("_words") >= SPAN)), [SPAN])
    place = F.posexplode(F.arrays_zip(F.col("_kept").alias("print"), F.col(f"_g{SPAN}").alias("hash")))
    spread = long.select("item_id", "_words", place.alias("_i", "_x"))
    of_long = spread.select("item_id", "_x.print", "_x.hash", F.lit(SPAN).alias("length"), F.array_join(F.slice("_words", F.col("_i") + 1, F.lit(SPAN)), " ").alias("words"))
    short = base.where(F.size("_words") < SPAN)
    parts = [of_long]
    for n in range(1, SPAN):
        own = with_grams(short.where(F.size("_words") == n), [n])
        parts.append(own.select("item_id", F.col(f"_g{n}")[0].alias("print"), F.col(f"_g{n}")[0].alias("hash"), F.lit(n).alias("length"), F.array_join("_words", " ").alias("words")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted rows allow it."""
    return F.broadcast(df) if rows <= SENT else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def spans(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, lists): _key of the text and `at`, an array of structs (i, length, words) of windows that stand at
    place i; and _key with the ids of the items they are of, an array of strings. Only texts with a hit have rows."""
    wins = materialise(windows(items), "windows")
    lengths = sorted(r["length"] for r in wins.select("length").distinct().collect())  # SPAN of them at most
    prints = materialise(wins.select("print").distinct(), "prints")
    n_prints, n_wins = prints.count(), wins.count()
    short = [n for n in lengths if n < SPAN]
    texts = _keyed(docs.select("text")).withColumn("_words", words(F.col("text"))).where(F.size("_words") >= (lengths[0] if lengths else SPAN))
    marked = with_grams(with_kept(texts), short)
    both = F.array_distinct(F.concat("_kept", *[f"_g{n}" for n in short]))
    told = marked.select("_key", F.explode(both).alias("print")).join(_sized(prints, n_prints), "print", "left_semi")
    keys = materialise(told.select("_key").distinct(), "told")
    # each text once, whole, and nothing but what may hold a window
    found = _keyed(docs.select("text")).join(_sized(keys, keys.count()), "_key", "left_semi").dropDuplicates(["_key"])
    found = materialise(found.select("_key", words(F.col("text")).alias("_words")), "told-texts")
    each = []
    for n in lengths:
        at = with_grams(found.where(F.size("_words") >= n), [n]).select("_key", F.posexplode(f"_g{n}").alias("i", "hash"))
        own = wins.where(F.col("length") == n).select("hash", "length", "words").distinct()
        each.append(at.join(_sized(own, n_wins), "hash"))
    if not each:
        none = found.select("_key", F.array().cast("array<struct<i:int,length:int,words:string>>").alias("at")).where("false")
        return none, none.select("_key", F.array().cast("array<string>").alias("items"))
    hits = each[0]
    for e in each[1:]:
        hits = hits.unionByName(e)
    by_text = hits.groupBy("_key").agg(F.collect_list(F.struct("i", "length", "words")).alias("_at"))
    true = F.filter("_at", lambda x: F.array_join(F.slice("_words", x["i"] + 1, x["length"]), " ") == x["words"])
    sure = found.join(by_text, "_key").select("_key", F.array_sort(true).alias("at")).where(F.size("at") > 0)
    sure = materialise(sure, "hits")
    there = sure.select("_key", F.explode(F.array_distinct(F.transform("at", lambda x: x["words"]))).alias("words"))
    owners = wins.where(F.col("item_id").isNotNull()).select("words", F.col("item_id").cast("string").alias("item")).distinct()
    lists = there.join(_sized(owners, n_wins), "words").groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return sure, lists


def covered(at: Column) -> Column:
    """Words within any of the windows of `at`, sorted by place."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["i"] + x["length"] - F.greatest(a["end"], x["i"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["i"] + x["length"]).alias("end"))
    return F.aggregate(at, start, step, lambda a: a["n"])


def judge(docs: DataFrame, items: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """`row`, a struct of the columns `carry` (all of `docs` by default), n_words, n_hit, items (ids as strings,
    sorted; empty where none), contaminated; for docs(text, ...) and items(item_id, text)."""
    hits, lists = spans(docs, items)
    judged = materialise(hits.select("_key", covered(F.col("at")).cast("long").alias("n_hit")).join(lists, "_key", "left"), "judged")
    rows = _keyed(docs.select(F.struct(*[F.col(c) for c in carry or docs.columns]).alias("row"), "text")).select("row", "_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(_sized(judged, judged.count()), "_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def hit_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """text_md5, start, length, item ids' windows merged: the longest runs of hit words of each text that has any."""
    hits, _ = spans(docs, items)
    w = Window.partitionBy("_key").orderBy("i", "length")
    each = hits.select("_key", F.explode("at").alias("x")).select("_key", "x.i", "x.length")
    each = each.withColumn("_end", F.max(F.col("i") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("_run", F.count_if(F.col("_end").isNull() | (F.col("i") > F.col("_end"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = each.groupBy("_key", "_run").agg(F.min("i").alias("start"), F.max(F.col("i") + F.col("length")).alias("_to"))
    return run.select(F.lower(F.hex("_key")).alias("text_md5"), "start", (F.col("_to") - F.col("start")).alias("length"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    joined = F.array_join("items", ",")
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
QUERIES = {"op12_winnowing": op12_winnowing}
ORACLES: dict[str, str] = {
    "op12_winnowing": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS t FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p) WHERE len(w) > 0),
g AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM i), LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - n + 1, 0))) AS p)),
h AS (SELECT DISTINCT g.r, g.p, g.n FROM g SEMI JOIN i ON g.n = i.n AND g.t = i.t),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY 1),
l AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM g JOIN i ON g.n = i.n AND g.t = i.t GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN l USING (r)"""
}
