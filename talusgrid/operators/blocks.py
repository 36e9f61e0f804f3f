"""Square blocks of cells with a halo, the unit of work for neighbourhood operators.

A cell table has one row per (r, c). A block of `size` x `size` cells plus a halo of `halo`
cells on each side therefore never holds more than (size + 2 halo)^2 rows, however large the
grid is. Copying the halo costs about 4 halo / size of the table, and one shuffle then gives
every task all the neighbours it needs; a join on the eight neighbours would shuffle the table
eight times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128

# The eight neighbours as (row, column) steps, in the order that settles ties.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def block_index(axis: str, size: int):
    return F.floor(F.col(axis) / size).cast("int")


def with_block(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds br, bc: the block that owns the cell."""
    return cells.withColumns({"br": block_index("r", size), "bc": block_index("c", size)})


def with_halo(cells: DataFrame, size: int = BLOCK, halo: int = 1) -> DataFrame:
    """Repeats each cell for every block whose core or halo it lies in."""

    def reach(axis: str):
        low = F.floor((F.col(axis) - halo) / size)
        high = F.floor((F.col(axis) + halo) / size)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    return cells.withColumn("br", reach("r")).withColumn("bc", reach("c"))


class Window:
    """Dense view of one block group: places the rows of the group on a small array."""

    def __init__(self, rows: pd.DataFrame, size: int, halo: int):
        self.side = size + 2 * halo
        self.row0 = int(rows["br"].iat[0]) * size - halo
        self.col0 = int(rows["bc"].iat[0]) * size - halo
        self.i = rows["r"].to_numpy() - self.row0
        self.j = rows["c"].to_numpy() - self.col0
        self.core = (
            (self.i >= halo) & (self.i < halo + size) & (self.j >= halo) & (self.j < halo + size)
        )
        self.flat = self.i * self.side + self.j
        if len(np.unique(self.flat)) < len(self.flat):
            raise ValueError(f"(r, c) is not unique among the {len(rows)} rows of a block")

    def fill(self, values, empty, dtype=float) -> np.ndarray:
        grid = np.full(self.side * self.side, empty, dtype=dtype)
        grid[self.flat] = values
        return grid
