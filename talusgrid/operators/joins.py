"""Lookup joins against a smaller table, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 8


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    right_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a smaller one on `keys`.

    `right_rows` is a proven upper bound of the right side. Within BROADCAST_ROWS the right side
    is broadcast. Otherwise the left side is salted by a hash of its row and the right side is
    repeated once per salt, so that a key holding a third of all rows spreads over `salts` tasks.
    A hash, unlike a random number, gives the same salt when a lost task is run again.
    """
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(spread, [*keys, "_salt"], how).drop("_salt")

