"""Risk colours and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talusgrid.functions.numeric import clip

# Colour stops as (red, green, blue) shares for unstable, marginal and stable ground
# and for debris; position of the middle stop; depth share from which debris is drawn.
UNSTABLE = (0.753, 0.161, 0.169)
MARGINAL = (0.831, 0.722, 0.247)
STABLE = (0.180, 0.490, 0.310)
DEBRIS = (0.541, 0.353, 0.231)
MIDDLE = 0.4
DEBRIS_FROM = 0.02


def _blend(a, b, t: Column) -> Column:
    return a + t * (b - a)


def risk_channels(fs01: Column, depth01: Column) -> dict[str, Column]:
    """Red, green and blue for a stability share and a debris share, both 0-1."""
    low, high = fs01 / MIDDLE, F.least(F.lit(1e0), (fs01 - MIDDLE) / (1 - MIDDLE))
    brown = F.least(F.lit(1e0), depth01 * 2e0)
    out = {}
    for k, name in enumerate(("red", "green", "blue")):
        ground = F.when(fs01 < MIDDLE, _blend(F.lit(UNSTABLE[k]), F.lit(MARGINAL[k]), low)).otherwise(
            _blend(F.lit(MARGINAL[k]), F.lit(STABLE[k]), high)
        )
        out[name] = F.when(depth01 > DEBRIS_FROM, ground * (1 - brown) + DEBRIS[k] * brown).otherwise(ground)
    return out


def risk_class(fs: Column, depth01: Column) -> Column:
    return (
        F.when(depth01 > DEBRIS_FROM, "debris")
        .when(fs < 1, "failing")
        .when(fs <= 2, "marginal")
        .when(fs > 2, "stable")
    )


def byte_level(value: Column, top: float) -> Column:
    """0-255 share of the display range, truncated."""
    return (clip(value / top, 0e0, 1e0) * 255).cast("int").cast("short")
