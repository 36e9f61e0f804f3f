"""Spelling variants grouped with asymmetric q-chunks, in DataFrame functions.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Of a pair the shorter word
(either one, if equally long) gives two disjoint chunks, its halves; the other gives positional grams. The one edit
touches one half only, so the other half stands in the longer word: a first half at its own place, a last half shifted by
the difference in length, which is 0 or 1. Of all positional grams only those of such lengths at such places can
join, so only they are made.

Halves of short words are shared by very many words. As the touched half is itself a shorter word with one edit, the
same holds for its two halves: one of these quarters stands as well. So the join's key is a half with a quarter: two
pieces of the word's beginning and end, which leave about a quarter of its code points open. Candidates are verified by
edit distance inside the join. Pairs that two keys find are made distinct.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that is at least `ratio`
times its own; else null. Forms lead to words at least `ratio` times as frequent, so a chain is short, and a few
doubling joins find its end, the root.

Cases. Null and empty texts have no words. Words with n of 0 or null are not frequent. Repeated rows count each. An
empty table gives an empty result. Very long words take part like others. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5


def runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, word), a row per maximal run of letters; only A-Z are lower-cased."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("word"))


def word_counts(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word) -> (word, n) of long and frequent enough words; counts are combined in the task first."""
    counted = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _keys(size: Column) -> list[tuple[Column, Column]]:
    """(code points from the beginning, from the end) of a half and a quarter, for chunk words of this size."""
    half = F.floor(size / 2).cast("int")
    first, last = F.floor(half / 2).cast("int"), F.floor((size - half) / 2).cast("int")
    none = F.lit(0)
    return [(half + last, none), (half, size - half - last), (first, size - half), (none, size - first)]


def _signed(words: DataFrame, size: Column) -> DataFrame:
    """(size, part, sign, word, n): a row per key that the word has for chunk words of this size."""
    signs = [F.struct(F.lit(k).alias("part"), F.concat(F.left("word", a), F.right("word", b)).alias("sign")) for k, (a, b) in enumerate(_keys(size))]
    return words.select(size.alias("size"), F.inline(F.array(*signs)), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n), each word once -> (a, n_a, b, n_b), every pair of near words once; b is the longer one, or the later."""
    length = F.length("word").cast("int")
    chunks = _signed(words, length).withColumnsRenamed({"word": "a", "n": "n_a"})
    grams = _signed(words, length).unionByName(_signed(words, length - 1)).withColumnsRenamed({"word": "b", "n": "n_b"})
    other = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    met = chunks.join(grams, ["size", "part", "sign"]).where(other & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words(word, n), each word once, of at least four code points -> (word, form, root, n, n_near, form_n)."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    seen_from = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]
    both = near_pairs(words).select(F.inline(F.array(*seen_from)))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    high = -F.col("best.minus") >= ratio * F.col("n")
    formed = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(high, F.col("best.form")).alias("form"), F.when(high, -F.col("best.minus")).alias("form_n")
        ),
        "variant-forms",
    )
    return formed.join(_roots(formed, ratio), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of words with a form, by doubling: a chain has at most as many steps as counts can grow by the ratio."""
    most = formed.agg(F.max("form_n").alias("n")).first()["n"]
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    steps = math.floor(math.log(most, ratio)) + 1 if most else 1
    for k in range(math.ceil(math.log2(steps))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"variant-roots-{k}")
    return roots
