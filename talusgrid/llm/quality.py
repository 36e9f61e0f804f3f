"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets counts (words, characters, symbols, repeated lines, words in repeated 3-word windows). From them come
four rates, kept as whole numbers. A log-linear histogram of each rate per language and source is a quantile sketch
with a relative error below 1/512: sketches merge by adding counts, so partial ones are summed before the shuffle,
and those of a language, and of all documents, come from adding up those of its sources. Fences are placed at the
quartiles plus a multiple of their distance, so they follow each language and source instead of fixed cutoffs.
Groups with fewer than `min_docs` documents use the fences of their language, and languages with fewer those of all.

Repeated windows are found inside the row: each window becomes one number, hash above and position below, the
numbers are sorted as primitives, and equal neighbours are repeats. For texts of a thousand words the hash part has
53 bits. So nothing is exploded or shuffled per word.

Cases. A null or empty text has no words, fails the base rule and is not kept. Null languages and sources form groups
of their own. Repeated rows are judged alike. An empty table gives an empty result. `filtered` keeps all input
columns; computed columns live in a struct and cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.llm.common import ROW, packed, stored, word_array

WINDOW = 3
MIN_WORDS = 50
MIN_DOCS = 40
SPREAD = 6
#: Rates in thousandths (word length: hundredths of a character) and the slack that a fence always leaves.
RATES = {"word_length": 60, "symbols": 20, "dup_lines": 340, "repeats": 450}
SKETCH_BITS = 10


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words inside n-word windows that occur twice or more in `words`, first ones included."""
    windows = F.size(words) - (n - 1)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(windows.cast("long"))))

    def number(i, words, step):
        hashed = F.xxhash64(*[F.get(words, i + k) for k in range(n)])
        return F.coalesce(hashed.bitwiseAND(-step).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))

    def repeats(ordered, step):
        def same(x, y):
            return F.coalesce(x.bitwiseAND(-step) == y.bitwiseAND(-step), F.lit(False))

        return F.filter(ordered, lambda x, j: same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)))

    def covered(starts):
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(n).cast("long"), F.coalesce(F.get(starts, j + 1) - p, F.lit(n).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def counted(words):
        return let(step, lambda step: let(
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: number(i, words, step))),
            lambda ordered: let(
                F.sort_array(F.transform(repeats(ordered, step), lambda x: x.bitwiseAND(step - 1))), covered
            ),
        ))

    return F.when(windows >= 2, counted(words)).otherwise(F.lit(0).cast("long"))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds struct column `counts` of the base counts and the base verdict."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.select("*", word_array(F.col(text)).alias("__words"), lines.alias("__lines"))
    counts = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__words")).cast("long").alias("word_chars"),
        (F.length(value) - F.length(F.regexp_replace(value, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    # As a generator's output, counts are computed once per row; a filter on plain columns would repeat them in every condition.
    out = counted.select("*", F.explode(F.array(counts)).alias("counts")).drop("__words", "__lines")
    failed = (F.col("counts.n_words") < MIN_WORDS) | (100 * F.col("counts.n_repeat_words") > 50 * F.col("counts.n_words"))
    return out.select("*", failed.alias("base_failed"), _rates().alias("rates"))


def _rates() -> Column:
    def part(scale: int, top: str, bottom: str) -> Column:
        return F.expr(f"(({scale} * counts.{top}) div greatest(counts.{bottom}, 1))")

    return F.struct(
        part(100, "word_chars", "n_words").alias("word_length"),
        part(1000, "n_symbols", "word_chars").alias("symbols"),
        part(1000, "n_dup_lines", "n_lines").alias("dup_lines"),
        part(1000, "n_repeat_words", "n_words").alias("repeats"),
    )


def sketch_bucket(value: Column) -> Column:
    """Lower end of the bucket of a whole number: exact below 1 024, then its ten leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def fences(rated: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """rated(lang, source, rates, base_failed) -> (lang, source, low_word_length, high_<rate> ...), one row per group."""
    long = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), sketch_bucket(F.col(f"rates.{r}")).alias("bucket")) for r in RATES]))
    fine = rated.select("lang", "source", long.alias("x")).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    fine = fine.select(F.lit(2).alias("level"), "lang", "source", "rate", "bucket", "n")
    by_lang = fine.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")).select(
        F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rate", "bucket", "n"
    )
    overall = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).select(
        F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rate", "bucket", "n"
    )
    group = Window.partitionBy("level", "lang", "source", "rate")
    merged = fine.unionByName(by_lang).unionByName(overall).select(
        "*", F.sum("n").over(group).alias("docs"), F.sum("n").over(group.orderBy("bucket")).alias("upto")
    )
    quart = [F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bucket"))) for k in (1, 3)]
    limits = merged.groupBy("level", "lang", "source", "rate").agg(F.first("docs").alias("docs"), quart[0].alias("q1"), quart[1].alias("q3"))
    slack = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])[F.col("rate")]
    reach = spread * (F.col("q3") - F.col("q1")) + slack
    limits = limits.select("level", "lang", "source", "docs", "rate", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    wide = limits.groupBy("level", "lang", "source").agg(
        F.first("docs").alias("docs"),
        F.struct(
            F.max(F.when(F.col("rate") == "word_length", F.col("low"))).alias("low_word_length"),
            *[F.max(F.when(F.col("rate") == r, F.col("high"))).alias(f"high_{r}") for r in RATES],
        ).alias("fence"),
    )
    g, m, o = (wide.where(F.col("level") == k).alias(a) for k, a in ((2, "g"), (1, "m"), (0, "o")))
    pick = F.when(F.col("g.docs") >= min_docs, F.col("g.fence")).when(F.col("m.docs") >= min_docs, F.col("m.fence")).otherwise(F.col("o.fence"))
    return (
        g.join(m, F.col("g.lang").eqNullSafe(F.col("m.lang")))
        .join(F.broadcast(o), F.lit(True))  # one row
        .select("g.lang", "g.source", pick.alias("fence"))
    )


def _inside() -> Column:
    high = [F.col(f"rates.{r}") <= F.col(f"fence.high_{r}") for r in RATES]
    ok = F.col("rates.word_length") >= F.col("fence.low_word_length")
    for h in high:
        ok = ok & h
    return ~F.col("base_failed") & F.coalesce(ok, F.lit(False))


def _judged(rated: DataFrame, limits: DataFrame) -> DataFrame:
    same = F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source"))
    return rated.alias("d").join(limits.alias("f"), same, "left").select("d.*", "fence").select("*", _inside().alias("kept"))


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """docs(doc_id, text, lang, source) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    rated = stored(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-counts")
    limits = fences(rated.where(~F.col("base_failed")), min_docs, spread)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(rated, limits).select("doc_id", *[f"counts.{c}" for c in names], "base_failed", "kept")


def filtered(docs: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """Rows of docs that pass, with all their columns.

    Texts are not shuffled: fences are one row per language and source, broadcast where their measured size allows it.
    """
    rows = with_counts(docs.select(packed(docs), "lang", "source", "text")).drop("text")
    limits = stored(fences(rows.drop(ROW).where(~F.col("base_failed")), min_docs, spread), "quality-fences")
    return _judged(rows, limits).where("kept").select(f"{ROW}.*")
