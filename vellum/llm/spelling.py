"""Spelling variants of words by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so a letter more, a letter less or a letter exchanged
changes it by a known value, in whatever order the letters stand. Words are joined whose keys differ by such a value: both
sides' keys are listed with one letter's value taken away (of the longer word alone, where a letter is added or removed). Of
two words that one change parts, the first halves are equal, or else the last halves; the equal half joins with the key, so
that words of the same letters in another order don't meet by the thousand. The order of all letters is verified after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

#: Keys are taken modulo this prime (2^61 - 1), so that sums over words of any length stay exact.
MODULUS = (1 << 61) - 1


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    wide = code.cast("decimal(7,0)")
    return F.when(code < 4096, code * code * code * code * code).otherwise((wide * wide * wide * wide * wide % F.lit(MODULUS).cast("decimal(19,0)")).cast("long"))


def anagram_key(word: Column) -> Column:
    """The same for all words of the same letters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: (s + F.when(F.length(c) > 0, letter_value(c)).otherwise(0)) % F.lit(MODULUS))


def word_counts(occurrences: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """Rows (word, n) of the words (column `word`) with so many letters and occurrences at least; null is no word."""
    long = occurrences.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _rows(words: DataFrame, kind: str) -> DataFrame:
    """Rows (half, len, key, letter, word, n) in which words with one change between them are equal in (half, len, key).

    `len` is the length of the shorter word. The change lies outside the half, and so does the letter taken away.
    """
    longer = 1 if kind == "longer" else 0
    short = F.length("word") - longer
    head = F.floor(short / 2).cast("int")
    tail = short - head
    cut = lambda s, n: F.substring("word", s, n)
    sides = [("h", cut(F.lit(1), head), cut(head + 1, F.length("word") - head)), ("t", cut(head + longer + 1, tail), cut(F.lit(1), head))]

    def listed(side: str, half: Column, rest: Column) -> Column:
        letters = F.array(F.lit("")) if kind == "as it is" else F.filter(F.array_distinct(F.split(rest, "")), lambda c: F.length(c) > 0)
        return F.transform(letters, lambda c: F.struct(F.concat(F.lit(side), half).alias("half"), c.alias("letter")))

    pairs = F.concat(*(listed(*x) for x in sides))
    out = words.select("word", "n", "key", short.cast("int").alias("len"), F.explode(pairs).alias("p"))
    value = F.lit(0).cast("long") if kind == "as it is" else letter_value(F.col("p.letter"))
    return out.select("p.half", "len", F.pmod(F.col("key") - value, F.lit(MODULUS)).alias("key"), "p.letter", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n, near, near_n), in both directions, of words that differ by exactly one inserted, deleted or replaced letter.

    `words` has different words with their counts and keys (word, n, key). Each pair comes once in each direction.
    """
    on = ["half", "len", "key"]
    two = lambda df, s: df.select(*on, *[F.col(c).alias(f"{c}{s}") for c in ("letter", "word", "n")])
    times = lambda w: F.length(w) - F.length(F.replace(F.col(w), F.col("letter1"), F.lit("")))
    # the letter taken away is the one that changes, so that no pair is found by another letter as well
    verified = (F.levenshtein("word1", "word2", 1) == 1) & (times("word1") - times("word2") == 1)

    # Spark sizes the listed rows by the table they come from, many times too low, and would gather them all to send them around
    apart = lambda df, s: two(df, s).hint("merge")
    exchange = _rows(words, "exchange")
    out = apart(exchange, 1).join(apart(exchange, 2), on).where(F.col("word1") != F.col("word2")).where(verified)
    out = out.select(F.col("word1").alias("word"), F.col("n1").alias("n"), F.col("word2").alias("near"), F.col("n2").alias("near_n"))

    added = apart(_rows(words, "longer"), 1).join(apart(_rows(words, "as it is"), 2), on).where(verified)
    half = F.floor(F.col("len") / 2).cast("int")
    once = F.col("half").startswith("h") | (F.substring("word1", F.lit(1), half) != F.substring("word2", F.lit(1), half))
    both = F.array(F.struct(F.col("word1").alias("word"), F.col("n1").alias("n"), F.col("word2").alias("near"), F.col("n2").alias("near_n")), F.struct(F.col("word2").alias("word"), F.col("n2").alias("n"), F.col("word1").alias("near"), F.col("n1").alias("near_n")))
    return out.unionByName(added.where(once).select(F.explode(both).alias("e")).select("e.*"))


def variants(words: DataFrame, scratch: Scratch, times: int = 2) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for a table of words and their counts (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest count
    (ties: smallest in code-point order), if that is at least `times` its own (2 or more); else null, and so is form_n. The root is
    where the forms lead to in the end, the word itself if it has none.

    Null and empty words are left out, repeated words are one with their counts added, null counts are 0; other columns are not
    read. An empty table gives an empty result. Forms at least double the count with every step, so chains are short; they are
    followed by doubling pointers.
    """
    if times < 2:
        raise ValueError("a form has at least twice the count")
    words = words.where(F.length("word") > 0).groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    words = scratch.keep(words.withColumn("key", anagram_key(F.col("word"))))
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    found = near_words(words).unionByName(none).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    taken = (F.col("n") > 0) & (-F.col("best.less") >= times * F.col("n"))
    found = scratch.keep(found.select("word", "n", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")))

    to = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(to.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(to)
        to = new.drop("moved")
        to._scratch_path = new._scratch_path
        if new.where("moved").isEmpty():
            break
    return found.join(to.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
