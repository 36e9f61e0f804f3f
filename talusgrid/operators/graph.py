"""Neighbour graphs on a complete grid: mesh edges, clamped neighbours and steepest descent."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.numeric import lit, literal_rows
from talusgrid.operators.blocks import BLOCK, NEIGHBOURS, Window, with_halo

# The four mesh directions as (row, column) steps from target to source.
MESH_STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def mesh_edges(nodes: DataFrame, rows, cols) -> DataFrame:
    """Directed edges of the 4-connected mesh: src = dst shifted by one step.

    Ids are row-major on a complete grid, so the source id is arithmetic. The plan is a scan, an
    inline of four steps and a bounds filter: nothing is joined or shuffled.
    """
    steps = literal_rows(("d_row", "d_col"), MESH_STEPS)
    pairs = nodes.select("r", "c", F.col("node_id").alias("dst"), F.inline(steps))
    row, col = F.col("r") + F.col("d_row"), F.col("c") + F.col("d_col")
    inside = (row >= 0) & (row < lit(rows)) & (col >= 0) & (col < lit(cols))
    src = F.col("dst") + F.col("d_row") * lit(cols) + F.col("d_col")
    return pairs.where(inside).select(src.cast("long").alias("src"), "dst", "d_row", "d_col")


def edge_attributes(edges: DataFrame, dx, dy) -> DataFrame:
    """Displacement (source minus target) in metres and its length."""
    x, y = F.col("d_col") * lit(dx), F.col("d_row") * lit(dy)
    return edges.withColumns({"dx_m": x, "dy_m": y, "length_m": F.hypot(x, y)})


def clamped_neighbours(nodes: DataFrame, rows, cols) -> DataFrame:
    """Eight neighbours per cell; off-grid ones are moved to the nearest grid cell (maybe the cell itself)."""
    steps = literal_rows(("direction", "d_row", "d_col"), [(k, i, j) for k, (i, j) in enumerate(NEIGHBOURS)])
    near = nodes.select("node_id", "r", "c", F.inline(steps))
    row = F.greatest(F.lit(0), F.least(lit(rows) - 1, F.col("r") + F.col("d_row")))
    col = F.greatest(F.lit(0), F.least(lit(cols) - 1, F.col("c") + F.col("d_col")))
    return near.select("node_id", "direction", (row * lit(cols) + col).cast("long").alias("neighbour_id"))


def descend(rows: pd.DataFrame, block: int, kept: list[str]) -> pd.DataFrame:
    """Steepest descent of the core cells of one block and its one-cell halo."""
    win = Window(rows, block, 1)
    n = win.side
    z = win.fill(rows["elevation_m"].to_numpy(dtype=float), np.nan)
    ids = win.fill(rows["node_id"].to_numpy(), -1, np.int64)
    here = win.flat[win.core]
    best = np.zeros(len(here))
    target = np.full(len(here), -1, dtype=np.int64)
    step = np.zeros((2, len(here)), dtype=np.int32)
    for di, dj in NEIGHBOURS:
        there = here + di * n + dj
        drop = (z[here] - z[there]) / (math.sqrt(2) if di and dj else 1.0)
        wins = drop > best  # False for NaN
        best[wins] = drop[wins]
        target[wins] = ids[there[wins]]
        step[0, wins], step[1, wins] = di, dj
    none = target < 0
    out = pd.DataFrame(
        {
            "node_id": ids[here],
            "r": rows["r"].to_numpy()[win.core],
            "c": rows["c"].to_numpy()[win.core],
            "target_id": pd.arrays.IntegerArray(target, none),
            "d_row": step[0],
            "d_col": step[1],
            "drop": best,
        }
    )
    return pd.concat([out, rows.loc[win.core, kept].reset_index(drop=True)], axis=1)


def steepest_descent(nodes: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Neighbour with the largest drop per distance; NULL target where no neighbour is lower.

    Off-grid and NULL elevations never win; the first direction wins ties. One shuffle of
    (id, r, c, elevation) with a one-cell halo. Columns named in `carry` are passed through, which
    saves a join when a later step needs them.
    """
    kept = list(carry)
    halo = with_halo(nodes.select("node_id", "r", "c", "elevation_m", *kept), block, 1)
    schema = "node_id long, r int, c int, target_id long, d_row int, d_col int, drop double"
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in nodes.select(*kept).schema)
    return halo.groupBy("br", "bc").applyInPandas(lambda rows: descend(rows, block, kept), schema + extra)


def sinks(downslope: DataFrame) -> DataFrame:
    """Cells with no lower neighbour."""
    return downslope.where(F.col("target_id").isNull()).select("node_id", "r", "c")
