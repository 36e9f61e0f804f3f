"""Downstream reach on the steepest-descent graph.

Paths are first resolved inside each block, where the graph fits in a small array. What is left
is the graph of block exits, a few percent of the cells. Only that one is resolved by joins that
double the reach per round, and finished paths leave the rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.operators.blocks import BLOCK, with_block, with_halo
from talusgrid.operators.graph import descend
from talusgrid.operators.joins import lookup_join
from talusgrid.functions.physics import CELL_SIZE_M
from talusgrid.sources.workspace import cut_lineage

_LOCAL = "node_id long, exit_id long, straight long, diagonal long, next_id long, next_diagonal int"


def _follow_inside(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["node_id"].to_numpy()
    order = np.argsort(ids)
    target = rows["target_id"].fillna(-1).to_numpy(dtype=np.int64)
    slot = np.clip(np.searchsorted(ids, target, sorter=order), 0, len(ids) - 1)
    inside = ids[order[slot]] == target
    slanted = (rows["d_row"].to_numpy() != 0) & (rows["d_col"].to_numpy() != 0)
    here = np.arange(len(ids))
    reach = np.where(inside, order[slot], here)
    straight = (inside & ~slanted).astype(np.int64)
    diagonal = (inside & slanted).astype(np.int64)
    for _ in range(len(ids).bit_length() + 1):
        further = reach[reach]
        if np.array_equal(further, reach):
            break
        straight, diagonal, reach = straight + straight[reach], diagonal + diagonal[reach], further
    else:
        raise ValueError("the downslope graph has a cycle")
    leaves = target[reach]
    return pd.DataFrame(
        {
            "node_id": ids,
            "exit_id": ids[reach],
            "straight": straight,
            "diagonal": diagonal,
            "next_id": pd.arrays.IntegerArray(leaves, leaves < 0),
            "next_diagonal": slanted[reach].astype(np.int32),
        }
    )


def terminals(downslope: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every cell: the sink its path ends in and the straight and diagonal steps to it.

    downslope(node_id, r, c, target_id, d_row, d_col) -> (node_id, terminal_id, straight, diagonal)
    """
    return _resolved(with_block(downslope, block).groupBy("br", "bc").applyInPandas(_follow_inside, _LOCAL))


def cell_terminals(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same from cells(node_id, r, c, elevation_m): descent and paths inside blocks in one shuffle of the cells."""
    halo = with_halo(cells.select("node_id", "r", "c", "elevation_m"), block, 1)
    return _resolved(halo.groupBy("br", "bc").applyInPandas(lambda rows: _follow_inside(descend(rows, block, [])), _LOCAL))


def _resolved(local: DataFrame) -> DataFrame:
    local = cut_lineage(local)
    exits = local.where((F.col("node_id") == F.col("exit_id")) & F.col("next_id").isNotNull())
    entry = local.select(
        F.col("node_id").alias("next_id"),
        F.col("exit_id").alias("reach_id"),
        F.col("straight").alias("s"),
        F.col("diagonal").alias("d"),
        F.col("next_id").isNull().alias("done"),
    )
    hops = exits.select("exit_id", "next_id", "next_diagonal").join(entry, "next_id")
    hops = hops.select(
        "exit_id",
        "reach_id",
        (F.col("s") + 1 - F.col("next_diagonal")).alias("s"),
        (F.col("d") + F.col("next_diagonal")).alias("d"),
        "done",
    )
    hops = cut_lineage(hops)
    # Finished paths are read where they were written first; only open ones are written again.
    finished, open_paths = hops.where(F.col("done")), hops.where(~F.col("done"))
    while not open_paths.isEmpty():
        hops = finished.unionByName(open_paths)
        onward = hops.select(
            F.col("exit_id").alias("reach_id"),
            F.col("reach_id").alias("_reach"),
            F.col("s").alias("_s"),
            F.col("d").alias("_d"),
            F.col("done").alias("_done"),
        )
        # Many paths may meet in one exit, so the lookup is salted.
        longer = lookup_join(open_paths, onward, ["reach_id"], "inner").select(
            "exit_id",
            F.col("_reach").alias("reach_id"),
            (F.col("s") + F.col("_s")).alias("s"),
            (F.col("d") + F.col("_d")).alias("d"),
            F.col("_done").alias("done"),
        )
        longer = cut_lineage(longer)
        finished, open_paths = finished.unionByName(longer.where(F.col("done"))), longer.where(~F.col("done"))
    # At most block^2 cells share an exit, so this key cannot become hot.
    out = local.join(finished.select("exit_id", "reach_id", "s", "d"), "exit_id", "left")
    return out.select(
        "node_id",
        F.coalesce("reach_id", "exit_id").alias("terminal_id"),
        (F.col("straight") + F.coalesce("s", F.lit(0))).alias("straight"),
        (F.col("diagonal") + F.coalesce("d", F.lit(0))).alias("diagonal"),
    )


def path_lengths(reach: DataFrame, cell_size: float = CELL_SIZE_M) -> DataFrame:
    """Steps and metres from each cell to its sink."""
    return reach.withColumns(
        {
            "hops": F.col("straight") + F.col("diagonal"),
            "path_m": cell_size * (F.col("straight") + F.col("diagonal") * math.sqrt(2)),
        }
    )


def deposits(releases: DataFrame, reach: DataFrame) -> DataFrame:
    """Released depth per sink. The sum combines before the shuffle, so one large sink is no hot spot."""
    landed = releases.select("node_id", "depth_m").join(reach.select("node_id", "terminal_id"), "node_id")
    return landed.groupBy("terminal_id").agg(
        F.count(F.lit(1)).alias("n_releases"), F.sum("depth_m").alias("deposit_m")
    )


_THROUGH = "node_id long, target_id long, br int, bc int, exit_id long, next_id long, load double"


def _sum_downstream(target: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Per cell its load and that of all cells whose path leads through it; target is a position or -1.

    After k rounds a cell has the sums of all cells less than 2^k steps upstream, and its jump leads 2^k steps down.
    """
    total, jump = load.astype(float), target
    for _ in range(len(target).bit_length() + 1):
        going = np.flatnonzero(jump >= 0)
        if not len(going):
            return total
        total = total + np.bincount(jump[going], weights=total[going], minlength=len(total))
        jump = np.where(jump >= 0, jump[jump], -1)
    raise ValueError("the downslope graph has a cycle")


def _targets_inside(ids: np.ndarray, target: pd.Series) -> np.ndarray:
    """Position of each target among the cells of the block, -1 where it is outside or there is none."""
    order = np.argsort(ids)
    wanted = target.fillna(-1).to_numpy(dtype=np.int64)
    slot = np.clip(np.searchsorted(ids, wanted, sorter=order), 0, len(ids) - 1)
    return np.where(ids[order[slot]] == wanted, order[slot], -1)


def throughflow(cells: DataFrame, load: str, block: int = BLOCK) -> DataFrame:
    """cells(node_id, r, c, elevation_m, <load>) -> (node_id, through): the load of every cell and of all cells upstream of it.

    Descent and paths inside blocks come from one shuffle of the cells. Loads are added up at the cells where paths leave
    a block; on the forest of these exits sums double their reach per round, each a sum by the exit that a jump leads
    to, so an exit into which a third of all paths lead is combined before the shuffle. What flows into a block is then
    added to its cells and followed inside it once more. NULL loads count as 0.
    """
    halo = with_halo(cells.select("node_id", "r", "c", "elevation_m", F.coalesce(F.col(load).cast("double"), F.lit(0e0)).alias("load")), block, 1)

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        found = descend(rows, block, ["load"])
        paths = _follow_inside(found)
        return found[["node_id", "target_id", "load"]].assign(br=rows["br"].iat[0], bc=rows["bc"].iat[0], exit_id=paths["exit_id"], next_id=paths["next_id"])

    local = cut_lineage(halo.groupBy("br", "bc").applyInPandas(inside, _THROUGH))
    leaving = local.where("next_id is not null").groupBy("exit_id").agg(F.sum("load").alias("total"), F.first("next_id").alias("next_id"))
    ways = local.select(F.col("node_id").alias("next_id"), F.when(F.col("next_id").isNotNull(), F.col("exit_id")).alias("jump"))
    exits = cut_lineage(leaving.join(ways, "next_id").select("exit_id", "next_id", "total", "jump"))
    while not exits.where("jump is not null").isEmpty():
        arriving = exits.where("jump is not null").groupBy(F.col("jump").alias("exit_id")).agg(F.sum("total").alias("more"))
        onward = exits.select(F.col("exit_id").alias("jump"), F.col("jump").alias("_jump"))
        further = lookup_join(exits, onward, ["jump"], "left")
        summed = further.join(arriving, "exit_id", "left").select("exit_id", "next_id", (F.col("total") + F.coalesce("more", F.lit(0e0))).alias("total"), F.col("_jump").alias("jump"))
        exits = cut_lineage(summed)
    arriving = exits.groupBy(F.col("next_id").alias("node_id")).agg(F.sum("total").alias("more"))
    loaded = local.join(arriving, "node_id", "left").select("br", "bc", "node_id", "target_id", (F.col("load") + F.coalesce("more", F.lit(0e0))).alias("load"))

    def through(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["node_id"].to_numpy()
        return pd.DataFrame({"node_id": ids, "through": _sum_downstream(_targets_inside(ids, rows["target_id"]), rows["load"].to_numpy())})

    return loaded.groupBy("br", "bc").applyInPandas(through, "node_id long, through double")
