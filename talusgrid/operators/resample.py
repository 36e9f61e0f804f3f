"""Resampling of coarse grids and lattice samples at node positions.

Positions are given in units of the source grid: u along columns, v along rows, samples at whole
numbers. On a coarse grid the corner values a node needs are first gathered into one row per source
square, on the small side; nodes then meet them in a single lookup on the square they fall into.
Lattice samples with holes meet the nodes in one shuffle by block, see `lattice`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.numeric import clip, literal_rows
from talusgrid.operators.joins import BROADCAST_ROWS, lookup_join
from talusgrid.operators.lattice import at_nodes

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
HULL_GROUPS = 16
SLACK = 1e-9


def _squares(samples: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """One row (pi, pj) per square with columns <value>_<di><dj>; missing corners stay NULL."""
    spread = samples.select(row, col, *values, F.inline(literal_rows(("di", "dj"), CORNERS)))
    keyed = spread.select(
        (F.col(row) - F.col("di")).alias("pi"), (F.col(col) - F.col("dj")).alias("pj"), "di", "dj", *values
    )
    return keyed.groupBy("pi", "pj").agg(*_corner_values(values))


def _corner_values(values: list[str]) -> list[Column]:
    return [F.expr(f"max(CASE WHEN di = {i} AND dj = {j} THEN {x} END) AS {x}_{i}{j}") for x in values for i, j in CORNERS]


def bilinear(
    nodes: DataFrame, coarse: DataFrame, value: str, rows: int, cols: int, u: str = "u", v: str = "v"
) -> DataFrame:
    """Bilinear value of coarse(rr, cc, <value>) at each node, not below 0.

    The square index is bounded to the grid, so nodes outside extend the edge square linearly.
    rows x cols is the size of the coarse grid.
    """
    placed = nodes.withColumns(
        {
            "pi": clip(F.floor(F.col(v)), 0, rows - 2).cast("int"),
            "pj": clip(F.floor(F.col(u)), 0, cols - 2).cast("int"),
        }
    )
    count = rows * cols
    if count > BROADCAST_ROWS:
        # Of a large grid only the box that the nodes touch is read; its area bounds the lookup side.
        box = placed.agg(F.min("pi").alias("r0"), F.max("pi").alias("r1"), F.min("pj").alias("c0"), F.max("pj").alias("c1")).first()
        if box["r0"] is not None:
            coarse = coarse.where(F.col("rr").between(box["r0"], box["r1"] + 1) & F.col("cc").between(box["c0"], box["c1"] + 1))
            count = (box["r1"] - box["r0"] + 2) * (box["c1"] - box["c0"] + 2)
    squares = _squares(coarse, "rr", "cc", [value])
    joined = lookup_join(placed, squares, ["pi", "pj"], "left", right_rows=count)
    fv, fu = F.col(v) - F.col("pi"), F.col(u) - F.col("pj")
    corner = {(i, j): F.col(f"{value}_{i}{j}") for i, j in CORNERS}
    top = corner[0, 0] * (1 - fu) + corner[0, 1] * fu
    bottom = corner[1, 0] * (1 - fu) + corner[1, 1] * fu
    mixed = top * (1 - fv) + bottom * fv
    return joined.withColumn(value, F.when(mixed.isNotNull(), F.greatest(mixed, F.lit(0e0)))).select(
        *nodes.columns, value
    )


def linear_on_lattice(nodes: DataFrame, samples: DataFrame, values: list[str], key: str = "node_id", u: str = "u", v: str = "v") -> DataFrame:
    """Linear interpolation in the lattice triangle that contains the node, NULL where there is none.

    samples(lr, lc, <values>) holds the valid samples only, one per lattice point.
    """
    return at_nodes(nodes, samples, values, key, u, v, linear=True, nearest=False)


def nearest_on_lattice(nodes: DataFrame, samples: DataFrame, values: list[str], key: str = "node_id", u: str = "u", v: str = "v") -> DataFrame:
    """Values of the nearest valid sample; ties go to the smaller (lr, lc). Exact at any distance."""
    return at_nodes(nodes, samples, values, key, u, v, linear=False, nearest=True)


def filled(
    nodes: DataFrame, samples: DataFrame, values: list[str], key: str = "node_id", u: str = "u", v: str = "v", only: Column | None = None
) -> DataFrame:
    """Linear where the lattice allows it, nearest sample elsewhere; `only` limits the latter."""
    return at_nodes(nodes, samples, values, key, u, v, linear=True, nearest=True, only=only)


def _half_hull(points: list, sign: int) -> list:
    """Chain of extreme columns by row: convex on the low side (sign 1) or the high side (sign -1)."""
    chain: list = []
    for row, col in points:
        while len(chain) > 1:
            (r1, c1), (r2, c2) = chain[-2], chain[-1]
            if sign * ((c2 - c1) * (row - r1) - (col - c1) * (r2 - r1)) < 0:
                break
            chain.pop()
        chain.append((row, col))
    return chain


def hull_sides(row: np.ndarray, col: np.ndarray) -> tuple[list, list]:
    """Corners (row, column) of the low and the high side of the convex hull, by row; only the ends of rows can be corners."""
    sides = []
    for sign in (1, -1):
        order = np.lexsort((sign * col, row))
        ends = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
        sides.append(_half_hull(list(zip(row[ends].tolist(), col[ends].tolist(), strict=True)), sign))
    return sides[0], sides[1]


def _corners(batches):
    """The corners of the hull of all rows that come in, held as the hull of what came so far."""
    held = np.zeros((0, 2), dtype=np.int64)
    for batch in batches:
        here = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("lr", "lc")], axis=1)
        low, high = hull_sides(*np.concatenate([held, here]).T)
        held = np.array(sorted({*low, *high}), dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(held[:, k].astype(np.int32)) for k in (0, 1)], names=["lr", "lc"])


def convex_hull(samples: DataFrame) -> tuple[list, list]:
    """Low and high side of the hull of lattice samples(lr, lc).

    A hull is a summary that merges: the hull of hulls is the hull of all. Tasks send the corners of theirs, groups of
    tasks merge them, and the driver merges those. A hull in an n x n lattice has some n^(2/3) corners at most, a few
    thousand on any map, so no step holds more, however many samples there are.
    """
    schema = "lr int, lc int"
    parts = samples.select(F.col("lr").cast("int").alias("lr"), F.col("lc").cast("int").alias("lc")).where("lr is not null and lc is not null").mapInArrow(_corners, schema)
    merged = parts.repartition(HULL_GROUPS, F.spark_partition_id()).mapInArrow(_corners, schema).toArrow()
    return hull_sides(*(merged.column(c).to_numpy().astype(np.int64) for c in ("lr", "lc")))


def in_hull(sides: tuple[list, list], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether each position lies between the sides of the hull, border included."""
    if not sides[0]:
        return np.zeros(len(u), dtype=bool)
    at = [np.interp(v, *np.array(side, dtype=float).T) for side in sides]
    first, last = sides[0][0][0], sides[0][-1][0]
    with np.errstate(invalid="ignore"):
        return (v >= first) & (v <= last) & (u >= at[0] - SLACK) & (u <= at[1] + SLACK)


def inside_hull(nodes: DataFrame, samples: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Adds has_soil: whether the node lies in the convex hull of the samples (border included).

    Tasks get the corners of the hull and look for the edge beside each node, so nothing is joined or shuffled.
    """
    sides = convex_hull(samples)

    def covered(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(in_hull(sides, *(a.to_numpy(zero_copy_only=False).astype(float) for a in (x, y))))

    found = F.arrow_udf(covered, "boolean")(F.col(u).cast("double"), F.col(v).cast("double"))
    return nodes.select(*nodes.columns, found.alias("has_soil"))
