"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. Every source may be repeated up to `max_epochs` times. Where its share by weight exceeds that, it is
clamped and the excess is shared again by weight, until no source is above its cap. Sorting the sources by
cap / weight makes the clamped ones a prefix, so the fixed point is found with running sums instead of rounds.

Sampling. A source with target t and size s takes every document floor(t / s) times and one more time those whose
seeded key is at most a cut. The cut is placed where the running size in key order meets the words that are still
missing: first among 4 096 ranges of keys, then among the documents of one range. So a hot source is never
gathered, documents are decided row by row, and a rerun takes the same ones.

Cases. Null and empty texts have size 0. The null source is a source of its own, last in order. Keys are made of
doc_id and text, so rows with null or repeated ids are decided one by one; only rows equal in both share a key and are
taken or left together. An empty table gives an empty result. A source without words has target 0. Other input columns are carried only by `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.llm.common import ROW, packed, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
RANGE_DIGITS = 3


def row_key(doc_id: Column, text: Column, seed: str) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.md5(named.cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """(source, size) of documents -> (source, source_size, target), one row per source.

    The two windows run over one row per source, after map-side sums.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", weight.alias("weight"))
    capped = sources.select("*", (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")).select("*", (F.col("cap") / F.col("weight")).alias("ratio"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(total) * F.lit(float(share))
    left = wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = capped.select("*", (left / open_weight).alias("level"))
    level = F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(total)
    return levels.select(
        "source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target")
    )


def _cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut): documents with a key up to cut are taken once more; "" takes none."""
    ranges = sizes.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size"))
    in_order = Window.partitionBy("source").orderBy("range")
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    plan = targets.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("whole"))
    plan = plan.select("*", missing.alias("missing"))
    running = ranges.select("source", "range", "range_size", (F.sum("range_size").over(in_order) - F.col("range_size")).alias("before"))
    same = F.col("p.source").eqNullSafe(F.col("r.source"))
    edge = (
        running.alias("r")
        .join(plan.alias("p"), same)
        .where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("range_size") > F.col("missing")))
        .select("p.source", "range", "before", "missing")
    )
    hit = sizes.alias("s").join(
        edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.substring("s.key", 1, RANGE_DIGITS) == F.col("e.range"))
    )
    keys = hit.groupBy("e.source", "key").agg(F.sum("size").alias("key_size"), F.first("before").alias("before"), F.first("missing").alias("missing"))
    by_key = Window.partitionBy("source").orderBy("key")
    middle = F.col("before") + F.sum("key_size").over(by_key) - F.col("key_size") / 2
    inside = keys.select("source", "key", (middle <= F.col("missing")).alias("taken"))
    last = inside.groupBy("source").agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("last"))
    cut = edge.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select(
        "e.source", F.coalesce("last", "range").alias("cut")
    )
    return plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        "p.source", "source_size", "target", "whole", F.when(F.col("p.missing") > 0, F.coalesce("cut", F.lit(""))).otherwise("").alias("cut")
    )


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    return stored(sized, "mix-sizes")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows(source, key, ...) meet the plan of their source; the first digit of the key splits a hot source 16 ways."""
    digits = F.explode(F.array(*[F.lit(d) for d in "0123456789abcdef"])).alias("digit")
    same = F.col("s.__source").eqNullSafe(F.col("c.source")) & (F.substring("s.key", 1, 1) == F.col("c.digit"))
    return rows.alias("s").join(cuts.select("*", digits).alias("c"), same)


def _copies() -> Column:
    return (F.col("c.whole") + (F.col("key") <= F.col("c.cut")).cast("int")).cast("long")


def mix_plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, source, size, source_size, target, copies), one row per input row."""
    sizes = _sizes(docs, seed)
    cuts = _cuts(sizes, source_targets(sizes, weights, share, max_epochs))
    return _with_cuts(sizes.withColumnRenamed("source", "__source"), cuts).select(
        "doc_id", F.col("__source").alias("source"), "size", "source_size", "target", _copies().alias("copies")
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The mix itself: rows of docs, each as often as the plan says, with the columns of docs.

    Texts do not move: the plan reaches them as one row per source, which Spark broadcasts where its measured
    size is under the session's limit and else joins by key.
    """
    sizes = _sizes(docs, seed)
    cuts = stored(_cuts(sizes, source_targets(sizes, weights, share, max_epochs)), "mix-cuts")
    rows = docs.select(packed(docs), F.col("source").alias("__source"), row_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    taken = _with_cuts(rows, cuts).select(ROW, _copies().alias("copies"))
    return taken.where("copies > 0").select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{ROW}.*")
