"""Texts and the words that they contain, by each word's rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 3
#: A gram's texts are dealt to so many parts, as one gram may stand in nearly all of them.
PARTS = 32


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text."""
    at = F.sequence(F.lit(1), F.char_length(text) - (n - 1))
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def words_in(texts: DataFrame, text: str, words: DataFrame, word: str, n: int = N) -> DataFrame:
    """text, word: each distinct text with every word of words(word) that it contains; case as it is, empty words contain nothing.

    A word has one gram, of n characters or its own length if that is less: the one that fewest texts have. So a gram that
    nearly all texts share is a word's key only if the word has no other, and the test for the whole word runs on few pairs.
    """
    known = words.select(F.col(word).alias("_word")).where(F.char_length(word) > 0).distinct()
    own = F.when(F.char_length("_word") < n, F.array("_word")).otherwise(_grams(F.col("_word"), n))
    asked = known.select("_word", F.explode(own).alias("_gram"))
    each = texts.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    all_ = F.concat(*[_grams(F.col("_text"), k) for k in range(1, n + 1)])
    wanted = asked.select("_gram").distinct()
    placed = each.withColumn("_gram", F.explode(all_)).join(wanted, "_gram", "left_semi")
    counts = placed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(counts, "_gram").groupBy("_word").agg(F.min(F.struct("_n", "_gram")).alias("_r")).select("_word", F.col("_r._gram").alias("_gram"))
    dealt = placed.withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(PARTS)).cast("int"))
    met = dealt.join(rarest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["_gram", "_part"]).where(F.contains("_text", F.col("_word")))
    return met.select(F.col("_text").alias(text), F.col("_word").alias(word))


def hits(texts: DataFrame, text: str, words: DataFrame, word: str, n: int = N) -> DataFrame:
    """Rows of `texts`, each with every word of words(word) that its text contains, as `words_in` has it."""
    found = words_in(texts, text, words, word, n).select(F.col(text).alias("_text"), word)
    return texts.join(found, F.col(text) == F.col("_text")).select(*[texts[c] for c in texts.columns], word)
