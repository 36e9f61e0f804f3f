"""Exact percentiles with linear interpolation at any table size, in a fixed number of passes for all columns together.

Wanted order statistics are bracketed with mergeable sketches, one aggregate for all of them; a second aggregate counts
the values below every bracket end. A bracket holds about 1 / 2 500 of the values it came from, so one round serves
hundreds of millions of values, two serve trillions. Brackets of at most BRACKET values are then sorted, again in one
aggregate. The result is exact because the counts, not the sketches, decide. Jobs: two per round and one more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.operators.joins import lookup_join
from talusgrid.sources.workspace import cut_lineage

BRACKET = 100_000
SKETCH_ACCURACY = 10_000
MARGIN = 2.0 / SKETCH_ACCURACY


@dataclass
class Target:
    """The value of 0-based `rank` in a column: between `low` and `high` (both exclusive), with `below` values up to low."""

    column: str
    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    def inside(self) -> Column:
        x = F.col(self.column)
        ok = x.isNotNull()
        if self.low is not None:
            ok = ok & (x > self.low)
        return ok if self.high is None else ok & (x < self.high)

    def take(self, threshold: float, under: int, upto: int) -> None:
        """Narrows by a threshold with `under` values below it and `upto` values not above it."""
        if self.value is not None or (self.low is not None and threshold <= self.low) or (self.high is not None and threshold >= self.high):
            return
        if self.rank < under:
            self.high, self.size = threshold, under - self.below
        elif self.rank < upto:
            self.value = threshold
        else:
            self.low, self.size, self.below = threshold, self.size - (upto - self.below), upto


def _sides(p: float) -> list[float]:
    return [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]


def _narrow(df: DataFrame, targets: list[Target], thresholds: dict[str, set[float]]) -> None:
    wanted = [(c, t) for c, ts in thresholds.items() for t in sorted(ts)]
    counts = df.agg(*[F.count_if(F.col(c) < t) for c, t in wanted], *[F.count_if(F.col(c) <= t) for c, t in wanted]).first()
    for k, (c, t) in enumerate(wanted):
        for target in targets:
            if target.column == c:
                target.take(t, counts[k], counts[len(wanted) + k])


def exact_percentiles(df: DataFrame, wanted: dict[str, list[float]], bracket: int = BRACKET) -> dict[str, list[float]]:
    """{column: [probabilities]} -> {column: [percentiles]}; NULLs are left out, no values give NaN."""
    df = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    sides = {c: sorted({s for p in ps for s in _sides(p)}) for c, ps in wanted.items()}
    first = df.agg(
        *[F.count(c) for c in wanted], *[F.percentile_approx(c, sides[c], SKETCH_ACCURACY) for c in wanted]
    ).first()
    sizes = {c: first[k] for k, c in enumerate(wanted)}
    targets = {
        (c, r): Target(c, r, sizes[c])
        for c, ps in wanted.items() if sizes[c]
        for p in ps for r in (math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1)))
    }
    full = [c for c in wanted if sizes[c]]
    if full:
        _narrow(df, list(targets.values()), {c: set(first[len(sizes) + list(wanted).index(c)]) for c in full})
    while large := [t for t in targets.values() if t.value is None and t.size > bracket]:
        place = lambda t: _sides((t.rank - t.below) / max(1, t.size - 1))
        found = df.agg(*[F.percentile_approx(F.when(t.inside(), F.col(t.column)), place(t), SKETCH_ACCURACY) for t in large]).first()
        more: dict[str, set[float]] = {}
        for t, values in zip(large, found):
            more.setdefault(t.column, set()).update(values)
        _narrow(df, large, more)
    open_ = [t for t in targets.values() if t.value is None]
    if open_:
        lists = df.agg(*[F.sort_array(F.collect_list(F.when(t.inside(), F.col(t.column)))).alias(f"v{k}") for k, t in enumerate(open_)])
        picked = lists.select(*[F.get(f"v{k}", F.lit(t.rank - t.below)) for k, t in enumerate(open_)]).first()
        for t, value in zip(open_, picked):
            t.value = value
    return {c: [_interpolated(targets, c, sizes[c], p) for p in ps] for c, ps in wanted.items()}


def _interpolated(targets: dict[tuple[str, int], Target], column: str, size: int, p: float) -> float:
    if size == 0:
        return float("nan")
    position = p * (size - 1)
    low, high = (targets[column, r].value for r in (math.floor(position), math.ceil(position)))
    return low + (high - low) * (position - math.floor(position))


#: Points at which a bracket that is still too large is cut.
CUTS = 200
STATE = "array<struct<rank:bigint,low:double,high:double,below:bigint,size:bigint,value:double>>"


def _open(target: Column) -> Column:
    return target["value"].isNull()


def _narrowed(target: Column, cuts: Column) -> Column:
    """A target's bracket after cuts(t, under, upto), of which `under` values of the group are below t and `upto` not above."""
    rank = target["rank"]
    low = F.array_max(F.transform(F.filter(cuts, lambda k: k["upto"] <= rank), lambda k: F.struct(k["t"].alias("t"), k["upto"].alias("n"))))
    high = F.array_min(F.transform(F.filter(cuts, lambda k: k["under"] > rank), lambda k: F.struct(k["t"].alias("t"), k["under"].alias("n"))))
    hit = F.get(F.filter(cuts, lambda k: (k["under"] <= rank) & (rank < k["upto"])), 0)["t"]
    below = F.coalesce(low["n"], target["below"])
    return F.struct(
        rank.alias("rank"), F.coalesce(low["t"], target["low"]).alias("low"), F.coalesce(high["t"], target["high"]).alias("high"), below.alias("below"),
        (F.coalesce(high["n"], target["below"] + target["size"]) - below).alias("size"), F.coalesce(target["value"], hit).alias("value"),
    )


def _cut(rows: DataFrame, state: DataFrame, cuts: DataFrame, groups: int) -> DataFrame:
    """state(g, targets) narrowed by cuts(g, ts): one count of each group's values below and up to each of its cuts."""
    per_row = lookup_join(rows, cuts, ["g"], "inner", right_rows=groups).select("g", "x", F.inline(F.transform("ts", lambda t: F.struct(t.alias("t")))))
    counted = per_row.groupBy("g", "t").agg(F.count_if(F.col("x") < F.col("t")).alias("under"), F.count_if(F.col("x") <= F.col("t")).alias("upto"))
    listed = counted.groupBy("g").agg(F.collect_list(F.struct("t", "under", "upto")).alias("cuts"))
    joined = state.join(listed, "g", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<t:double,under:bigint,upto:bigint>>")))
    return joined.select("g", "n", F.transform("targets", lambda t: _narrowed(t, F.col("cuts"))).cast(STATE).alias("targets"))


def percentiles_by_group(df: DataFrame, group: str, column: str, probabilities: list[float], bracket: int = BRACKET) -> DataFrame:
    """(group, p, value): exact percentiles with linear interpolation in every group; NULL values are left out.

    The same brackets as above, kept per group in rows of a table: sketches of all groups come from one aggregate, counts
    from a second, and what is left in the brackets is sorted in a third. While a bracket holds more than `bracket` values,
    it is cut at 200 points of a sketch of its own, all groups together. Groups may be many, and one may hold most rows:
    every aggregate combines before its shuffle, and brackets meet the rows by a salted or broadcast lookup.
    """
    rows = df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("x")).where("x is not null and g is not null")
    sides = sorted({s for p in probabilities for s in _sides(p)})
    stats = cut_lineage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", sides, SKETCH_ACCURACY).alias("ts")))
    groups = stats.count()
    position = [F.lit(p) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in position for f in (F.floor, F.ceil)]))
    none = F.lit(None).cast("double")
    start = lambda r: F.struct(r.alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), none.alias("value"))
    state = stats.select("g", "n", F.transform(ranks, start).cast(STATE).alias("targets"))
    state = cut_lineage(_cut(rows, state, stats.select("g", F.array_distinct("ts").alias("ts")), groups))

    def inside(targets: Column) -> Column:
        x = F.col("x")
        return F.filter(targets, lambda t: _open(t) & (t["low"].isNull() | (x > t["low"])) & (t["high"].isNull() | (x < t["high"])))

    def bracketed(state: DataFrame) -> DataFrame:
        met = lookup_join(rows, state.select("g", F.filter("targets", _open).alias("targets")).where(F.size("targets") > 0), ["g"], "inner", right_rows=groups)
        return met.select("g", "x", F.inline(F.transform(inside(F.col("targets")), lambda t: F.struct(t["rank"].alias("rank"), t["below"].alias("below")))))

    largest = F.max(F.array_max(F.transform(F.filter("targets", _open), lambda t: t["size"])))
    while (state.agg(largest.alias("size")).first()["size"] or 0) > bracket:
        points = [k / CUTS for k in range(CUTS + 1)]
        found = bracketed(state).groupBy("g", "rank").agg(F.percentile_approx("x", points, SKETCH_ACCURACY).alias("ts"))
        cuts = found.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
        state = cut_lineage(_cut(rows, state, cuts, groups))
    sorted_ = bracketed(state).groupBy("g", "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    late = sorted_.select("g", "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    known = state.select("g", F.inline("targets")).where("value is not null").select("g", "rank", "value")
    values = late.unionByName(known).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    ends = [(F.element_at("at", F.floor(x).cast("long")), F.element_at("at", F.ceil(x).cast("long")), x - F.floor(x)) for x in position]
    each = F.array(*[F.struct(F.lit(p).alias("p"), (a + (b - a) * part).alias("value")) for p, (a, b, part) in zip(probabilities, ends, strict=True)])
    return stats.join(values, "g").select(F.col("g").alias(group), F.inline(each))
