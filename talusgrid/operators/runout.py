"""Failure events and mass transfer down the steepest-descent graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talusgrid.functions.numeric import lit
from talusgrid.functions.physics import FAILURE_DEPTH_M, STORM_HOURS, failing
from talusgrid.operators.blocks import NEIGHBOURS
from talusgrid.sources.workspace import cut_lineage

MOBILE_DEPTH_M = 1e-4
STEPS_PER_CUT = 4


def failure_onset(node_hours: DataFrame) -> DataFrame:
    """First failing hour per node that ever fails."""
    return node_hours.where(failing(F.col("fs"))).groupBy("node_id").agg(F.min("hr").alias("onset_hr"))


def releases(node_hours: DataFrame, depth_m: float = FAILURE_DEPTH_M) -> DataFrame:
    """Each node releases its slab once, at onset."""
    return failure_onset(node_hours).withColumn("depth_m", F.lit(depth_m))


def erosion_history(node_hours: DataFrame, depth_m: float = FAILURE_DEPTH_M, hours: int = STORM_HOURS) -> DataFrame:
    """Released and cumulative depth per hour, for `hours` hours and for as many more as the data have.

    The running sum sees one row per hour, not per node.
    """
    per_hour = releases(node_hours, depth_m).groupBy("onset_hr").agg(
        F.count(F.lit(1)).alias("n_released"), F.sum("depth_m").alias("released_m")
    )
    last = F.greatest(F.coalesce(F.max("hr"), F.lit(0)), F.lit(hours - 1))
    first = F.least(F.coalesce(F.min("hr"), F.lit(0)), F.lit(0))
    every_hour = node_hours.agg(F.sequence(first, last).cast("array<int>").alias("hrs")).select(F.explode("hrs").alias("hr"))
    joined = every_hour.join(per_hour, F.col("hr") == F.col("onset_hr"), "left").select(
        "hr",
        F.coalesce("n_released", F.lit(0)).alias("n_released"),
        F.coalesce("released_m", F.lit(0e0)).alias("released_m"),
    )
    so_far = W.orderBy("hr").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn("cumulative_m", F.sum("released_m").over(so_far))


def route_step(cells: DataFrame) -> DataFrame:
    """One transfer: the share `share` of each mobile cell's depth h moves to target_id.

    Every cell emits what it keeps and what it sends; one sum per receiving cell adds both up.
    That is a single shuffle with map-side combine, without a join.
    """
    moves = (F.col("h") > MOBILE_DEPTH_M) & F.col("target_id").isNotNull()
    sent = F.when(moves, F.col("h") * F.col("share")).otherwise(0e0)
    parts = F.array(
        F.struct(F.col("node_id").alias("id"), (F.col("h") - sent).alias("part")),
        F.struct(F.when(moves, F.col("target_id")).alias("id"), sent.alias("part")),
    )
    flow = cells.select(F.inline(parts)).where(F.col("id").isNotNull())
    return flow.groupBy(F.col("id").alias("node_id")).agg(F.sum("part").alias("h"))


def spread_overflow(cells: DataFrame, cap_m: float, rows, cols) -> DataFrame:
    """Depth above the cap leaves in eight equal parts to the clamped neighbours, all cells at once."""
    excess = F.greatest(F.col("h") - cap_m, F.lit(0e0))
    sized = cells.select("node_id", "r", "c", "h", excess.alias("e"), lit(rows).alias("gh"), lit(cols).alias("gw"))
    shares = ", ".join(
        f"named_struct('id', CAST(greatest(0, least(gh - 1, r + {i})) * gw"
        f" + greatest(0, least(gw - 1, c + {j})) AS BIGINT), 'part', e / 8)"
        for i, j in NEIGHBOURS
    )
    own = "named_struct('id', node_id, 'part', h - e)"
    parts = F.expr(f"CASE WHEN e > 0 THEN array({own}, {shares}) ELSE array({own}) END")
    flow = sized.select(F.inline(parts))
    return flow.groupBy(F.col("id").alias("node_id")).agg(F.sum("part").alias("h"))


def route_steps(cells: DataFrame, steps: int, cap_m: float, rows, cols) -> DataFrame:
    """`steps` rounds of transfer and overflow over cells(node_id, r, c, h, share, target_id).

    A round is two sums by receiving cell. The grid itself does not change, so only (node_id, h) goes from round to round.
    Rounds are written out from time to time, so that plans stay short and a lost executor costs a few rounds at most.
    """
    fixed, depth = cells.drop("h"), cells.select("node_id", "h")
    for step in range(steps):
        if step and step % STEPS_PER_CUT == 0:
            depth = cut_lineage(depth)
        moved = route_step(fixed.join(depth, "node_id"))
        depth = spread_overflow(fixed.select("node_id", "r", "c").join(moved, "node_id"), cap_m, rows, cols)
    return fixed.select("node_id", "r", "c").join(depth, "node_id").select("node_id", "r", "c", "h")


def mass_balance(released: DataFrame, routed: DataFrame) -> DataFrame:
    """Total depth released, total depth after routing, and their difference."""
    before = released.agg(F.sum("h").alias("released_m")).scalar()
    return routed.agg(F.sum("h").alias("routed_m")).select(
        before.alias("released_m"), "routed_m", (F.col("routed_m") - before).alias("difference_m")
    )
