"""Numeric helpers that keep NULL as NULL and follow NumPy / Python rounding."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the published Chebyshev-fitted erfc (relative error about 1e-7),
# constant term first, in powers of t = 1 / (1 + x / 2).
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def literal_rows(fields: tuple[str, ...], rows) -> Column:
    """Constant array of structs of whole numbers, for inline().

    Built as one SQL text: a call per literal would make the driver slow for long lists.
    """
    structs = ("named_struct(" + ", ".join(f"'{f}', {x}" for f, x in zip(fields, row)) + ")" for row in rows)
    return F.expr("array(" + ", ".join(structs) + ")")


def clip(x: Column, low, high) -> Column:
    """Bound x to [low, high]. greatest/least skip NULLs, so NULL is kept explicitly."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit(low)), lit(high)))


def at_least(x: Column, low) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, lit(low)))


def at_most(x: Column, high) -> Column:
    return F.when(x.isNotNull(), F.least(x, lit(high)))


def safe_ln(x: Column) -> Column:
    """ln that is NULL where the logarithm does not exist."""
    return F.when(x > 0, F.log(x))


def erfc_of(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1e0) / (F.lit(1e0) + x * 0.5e0)
    series = F.lit(ERFC_COEFFICIENTS[-1])
    for a in reversed(ERFC_COEFFICIENTS[:-1]):
        series = F.lit(a) + t * series
    return t * F.exp(-x * x + series)


def ierfc(eta: Column) -> Column:
    """First integral of erfc, for eta >= 0."""
    return F.exp(-eta * eta) / math.sqrt(math.pi) - eta * erfc_of(eta)


def ierfc_array(eta: np.ndarray) -> np.ndarray:
    """The same function on a NumPy array, for use inside Arrow functions."""
    t = 1.0 / (1.0 + 0.5 * eta)
    series = np.full_like(t, ERFC_COEFFICIENTS[-1])
    for a in reversed(ERFC_COEFFICIENTS[:-1]):
        series = a + t * series
    return np.exp(-eta * eta) / math.sqrt(math.pi) - eta * (t * np.exp(-eta * eta + series))


def with_compact_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Short numbers for legends, {label column: value column}: 2.5M, 1.2k, 340, 7.5, 0.25.

    Digits are those of Python's fixed-point format: the exact binary value is rounded, ties to
    even. Multiplying by 10 or 100 loses bits, which can turn 0.15 into a false tie, so the lost
    part is recovered with an exact two-term product and decides at ties. The steps are staged
    projections, each using the columns of the one before.
    """
    names = list(labels)

    def stage(work: DataFrame, suffix: str, make) -> DataFrame:
        return work.withColumns({f"_{n}{suffix}": make(n) for n in names})

    def col(name: str, suffix: str) -> Column:
        return F.col(f"_{name}{suffix}")

    work = stage(df, "_size", lambda n: F.abs(F.col(labels[n])))
    size = lambda n: col(n, "_size")
    work = stage(work, "_x", lambda n: F.when(size(n) >= 1e6, size(n) / 1e6).when(size(n) >= 1e3, size(n) / 1e3).otherwise(size(n)))
    work = stage(
        work,
        "_k",
        lambda n: F.when(size(n) >= 1e3, 10e0).when(size(n) >= 100, 1e0).when(size(n) >= 1, 10e0).otherwise(100e0),
    )
    work = stage(work, "_y", lambda n: col(n, "_x") * col(n, "_k"))
    work = stage(work, "_split", lambda n: col(n, "_x") * 134217729e0)
    work = stage(work, "_high", lambda n: col(n, "_split") - (col(n, "_split") - col(n, "_x")))
    work = stage(
        work,
        "_lost",
        lambda n: (col(n, "_high") * col(n, "_k") - col(n, "_y")) + (col(n, "_x") - col(n, "_high")) * col(n, "_k"),
    )
    work = stage(work, "_whole", lambda n: F.floor(col(n, "_y")))
    work = stage(work, "_part", lambda n: col(n, "_y") - col(n, "_whole"))

    def rounded(n: str) -> Column:
        tie_up = (col(n, "_lost") > 0) | ((col(n, "_lost") == 0) & (col(n, "_whole") % 2 == 1))
        return col(n, "_whole") + F.when((col(n, "_part") > 0.5) | ((col(n, "_part") == 0.5) & tie_up), 1).otherwise(0)

    work = stage(work, "_n", rounded)

    def text(n: str) -> Column:
        digits, k = col(n, "_n"), col(n, "_k")
        tens = F.concat(F.floor(digits / 10).cast("string"), F.lit("."), (digits % 10).cast("string"))
        cents = F.concat(F.floor(digits / 100).cast("string"), F.lit("."), F.lpad((digits % 100).cast("string"), 2, "0"))
        body = F.when(k == 1, digits.cast("string")).when(k == 10, tens).otherwise(cents)
        sign = F.when(F.col(labels[n]) < 0, "-").otherwise("")
        unit = F.when(size(n) >= 1e6, "M").when(size(n) >= 1e3, "k").otherwise("")
        return F.when(F.col(labels[n]).isNotNull(), F.concat(sign, body, unit))

    return work.select(*df.columns, *[text(n).alias(n) for n in names])


def half_even_step(width: int, target: int) -> int:
    """Stride that brings `width` near `target` columns (Python round: ties to even)."""
    return max(1, round(width / target))
