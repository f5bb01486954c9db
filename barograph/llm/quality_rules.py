"""Distribution divergence: character-class and common-word histograms against language references.

Each text gives two histograms: shares of seven character classes, and shares of its language's twelve
common words (with all other words as the last bin). The reference of a language is taken over the table's
own texts in it that are long enough, but neither copies nor a minority of junk make it: texts whose
histograms agree to a hundredth in every bin are one cell, however many they are, and the reference is the
median of the cells' means bin by bin, scaled to a sum of one. Languages without a word list share one pooled
reference of character classes. A text is rejected if either Jensen-Shannon distance (base 2, 0 to 1) passes
its limit, unless it is too short for that histogram to say anything. Only DataFrame functions are used.

Defined cases: null and empty texts have no words and fail the base rule; a null or unknown lang takes the
pooled reference; where no text is long enough there is no reference and only the base rule decides;
repeated rows are judged each; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import SPACE_CLASS, materialise, table

#: Fixed word lists: frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
#: Fixed character classes; the last is what no other holds.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r" \x09-\x0D", "stop": r".,;:?!'\"()\-", "symbol": r"#*$%&|<>"}  # space and symbol are those of the base columns
MIN_WORDS, MIN_CHARS = 50, 200
CHAR_LIMIT, WORD_LIMIT = 0.27, 0.30
TRIM = ".,;:!?"
BINS = 1 + len(COMMON_WORDS["en"])
#: Width of a reference's cells, and the whole numbers that shares are summed in: sums don't depend on their order.
CELLS, UNITS = 100, 10_000


def _arr(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lang_key(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(F.lit("*"))


def with_words(docs: DataFrame) -> DataFrame:
    return (
        docs.withColumn("_t", F.coalesce("text", F.lit("")))
        .withColumn("_w", F.array_remove(F.split("_t", SPACE_CLASS + "+"), ""))
        .withColumn("_n", F.size("_w"))
        .withColumn("_lang", lang_key(F.col("lang")))
    )


def common_only(text: Column, words: list[str]) -> Column:
    """The words of a lower-case text that ends in a space, less all that are not in the list; trailing marks go."""
    common = f"(?!(?:{'|'.join(words)})[{TRIM}]*+{SPACE_CLASS})"
    kept = F.regexp_replace(text, rf"(?<![^ \x09-\x0D]){common}[^ \x09-\x0D]++{SPACE_CLASS}*+", "")
    return F.split(kept, rf"(?<![{TRIM}])[{TRIM}]*+{SPACE_CLASS}+")


def _falling(first: Column, kinds: Column, size, less) -> Column:
    """Sizes of a value before each kind is taken out of it, one after another, and at the end.

    A fold, so that the optimizer can't write each step out again for every use of its size.
    """
    start = F.struct(first.alias("s"), F.array().cast("array<int>").alias("n"))
    step = lambda a, kind: F.struct(less(a["s"], kind).alias("s"), F.array_append(a["n"], size(a["s"])).alias("n"))
    return F.aggregate(kinds, start, step, lambda a: F.array_append(a["n"], size(a["s"])))


def with_histograms(words: DataFrame) -> DataFrame:
    """_chars: counts by class, each class taken out of what the one before left; _hits: counts of the common words."""
    classes = F.array(*[F.lit(f"[{c}]+") for c in CLASSES.values()])
    low, lists, found = F.concat(F.lower("_t"), F.lit(" ")), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for key, v in COMMON_WORDS.items():
        mine = F.col("_lang") == key
        lists, found = F.when(mine, _arr(v)).otherwise(lists), F.when(mine, common_only(low, v)).otherwise(found)
    out = (
        words.withColumn("_len", F.char_length("_t"))
        .withColumn("_cs", _falling(F.col("_t"), classes, F.char_length, lambda s, c: F.regexp_replace(s, c, F.lit(""))))
        .withColumn("_ws", _falling(found, lists, F.size, F.array_remove))
    )
    fall = lambda c, n: F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: x - y)
    return out.withColumn("_chars", F.concat(fall("_cs", len(CLASSES)), F.slice("_cs", -1, 1))).withColumn("_hits", fall("_ws", BINS - 1))


def _shares(counts: list[Column], total: Column) -> Column:
    return F.array(*[F.try_divide(c.cast("double"), total.cast("double")) for c in counts])


def with_shares(df: DataFrame) -> DataFrame:
    chars, hits = [F.col("_chars")[i] for i in range(len(CLASSES) + 1)], [F.col("_hits")[j] for j in range(BINS - 1)]
    words = [F.col("_n") - sum(hits), *hits]
    return df.withColumn("_p", F.when(F.col("_len") > 0, _shares(chars, F.col("_len")))).withColumn("_q", F.when((F.col("_n") > 0) & F.col("_hits").isNotNull(), _shares(words, F.col("_n"))))


def _centre(middle: list[float], mean: list[float]) -> list[float]:
    """Medians scaled to a sum of one; means where all medians are 0."""
    x = middle if sum(middle) > 0 else mean
    return [round(v / sum(x), 6) for v in x]


def references(made: DataFrame) -> DataFrame:
    """At most one row a listed language and one pooled row: medians over the distinct cells, rounded to six places.

    Cells are first made in every task, so that a text with many copies is one row a task. A median holds at most
    UNITS + 1 values, and only the medians, a row a language key (five at most), come to the driver.
    """
    df = made.where((F.col("_n") >= MIN_WORDS) & (F.col("_len") >= MIN_CHARS))
    bins = {f"p{i}": F.col("_p")[i] for i in range(len(CLASSES) + 1)} | {f"q{i}": F.col("_q")[i] for i in range(BINS)}
    cell = [F.transform(c, lambda x: F.round(x * CELLS).cast("int")).alias(f"{c}c") for c in ("_p", "_q")]
    cells = df.groupBy("_lang", *cell).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(x * UNITS).cast("long")).alias(c) for c, x in bins.items()])
    each = cells.select(F.explode(F.array_distinct(F.array("_lang", F.lit("*")))).alias("_lang"), *[F.round(F.col(c) / F.col("n")).cast("long").alias(c) for c in bins])
    got = each.groupBy("_lang").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in bins], *[F.avg(c).alias(f"{c}m") for c in bins]).collect()
    of = lambda r, kind: _centre(*[[r[c + end] for c in bins if c[0] == kind] for end in ("", "m")])
    rows = [(r["_lang"], of(r, "p"), None if r["_lang"] == "*" else of(r, "q")) for r in got]
    return made.sparkSession.createDataFrame(rows, "_lang string, _rp array<double>, _rq array<double>")


def js_distance(p: Column, q: Column, bins: int) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; null if either histogram is."""
    total: Column = F.lit(0.0)
    for i in range(bins):
        a, b = p[i], q[i]
        m = (a + b) / 2
        for x in (a, b):
            total = total + F.when(x > 0, x * F.log2(x / m) / 2).otherwise(0.0)
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def with_base(df: DataFrame) -> DataFrame:
    """The base columns: counts over the whole text, repeats by 3-word windows.

    Windows are compared by 64-bit hash, by which two different ones of a text agree once in 2**64. Only texts
    where two hashes agree have them sorted, neighbours compared and the covered positions counted.
    """
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    df = (
        df.withColumn("_lines", lines)
        .withColumn("n_words", F.col("_n").cast("long"))
        .withColumn("word_chars", (F.col("_len") - F.col("_chars")[list(CLASSES).index("space")]).cast("long"))
        .withColumn("n_symbols", F.col("_chars")[list(CLASSES).index("symbol")].cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    at = F.sequence(F.lit(0), F.col("_n") - 3)
    w = F.col("_w")
    df = df.withColumn("_h", F.when(F.col("_n") >= 3, F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    df = df.withColumn("_dup", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    df = df.withColumn("_s", F.when(F.col("_dup"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("w"), i.alias("i"))))))
    n = F.size("_s")
    same = F.zip_with(F.slice("_s", F.lit(1), n - 1), F.slice("_s", F.lit(2), n - 1), lambda a, b: a["w"] == b["w"])
    df = df.withColumn("_e", same)
    no = F.array(F.lit(False))
    hit = F.zip_with(F.concat(no, "_e"), F.concat("_e", no), lambda x, y: x | y)
    found = F.filter(F.zip_with("_s", hit, lambda s, x: F.when(x, s["i"])), lambda x: x.isNotNull())
    df = df.withColumn("_r", F.sort_array(found))
    m = F.size("_r")
    steps = F.zip_with(F.slice("_r", F.lit(1), m - 1), F.slice("_r", F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.col("_dup") & (m > 0), F.aggregate(steps, F.lit(3), lambda a, x: a + x)).otherwise(0)
    df = df.withColumn("n_repeat_words", covered.cast("long"))
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_verdict(df: DataFrame, refs: DataFrame) -> DataFrame:
    """char_distance, word_distance (null under the length guards) and kept. refs has five rows at most."""
    df = df.join(F.broadcast(refs), "_lang", "left")
    char = F.when(F.col("_len") >= MIN_CHARS, js_distance(F.col("_p"), F.col("_rp"), len(CLASSES) + 1))
    word = F.when(F.col("_n") >= MIN_WORDS, js_distance(F.col("_q"), F.col("_rq"), BINS))
    df = df.withColumn("char_distance", F.round(char, 6)).withColumn("word_distance", F.round(word, 6))
    far = F.coalesce(F.col("char_distance") > CHAR_LIMIT, F.lit(False)) | F.coalesce(F.col("word_distance") > WORD_LIMIT, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """`row`, a struct of the columns `carry` (all of `docs` by default), with BASE, the distances and kept.

    One pass over the texts: what it finds is written to the shared folder with the carried columns, then the
    references are taken from there and every row is judged. No shuffle of texts.
    """
    cols = docs.select(F.struct(*[F.col(c) for c in carry or docs.columns]).alias("row"), F.col("text"), F.col("lang"))
    found = with_base(with_shares(with_histograms(with_words(cols))))
    made = materialise(found.select("row", *BASE, "_lang", "_n", "_len", "_p", "_q"), "quality")
    return with_verdict(made, references(made)).select("row", *BASE, "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, all columns."""
    return judge(docs).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("row.doc_id", *BASE, "kept", "char_distance", "word_distance")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
