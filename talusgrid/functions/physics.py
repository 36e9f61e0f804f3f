"""Pore pressure, slope stability and debris mobility columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from talusgrid.functions.numeric import clip, ierfc_array, lit

G = 9.81
WATER_UNIT_WEIGHT = 9.81
TURBULENT_DRAG = 500.0
CELL_SIZE_M = 140.0
FAILURE_DEPTH_M = 1.5
WATER_TABLE_M = 2.0
STEADY_FLUX_SHARE = 0.02
STORM_HOURS = 24


def storm_weight(hour: Column, peak: Column, width: Column) -> Column:
    """Un-normalised bell curve of a single-peak storm."""
    z = (hour - peak) / width
    return F.exp(-0.5 * z * z)


def storm_shares(peak_hour: float = 14.0, width: float = 2.8, hours: int = STORM_HOURS) -> Column:
    """The storm as a constant array of hourly shares that add up to 1."""
    w = [math.exp(-0.5 * ((h - peak_hour) / width) ** 2) for h in range(hours)]
    return F.array(*[F.lit(x / sum(w)) for x in w])


def hourly_intensity(share: Column, daily_mm: Column) -> Column:
    """Rain intensity in m/s for one hour of a daily total."""
    return share * (daily_mm / 1000.0) / 3600.0


def cos_squared(slope_rad: Column) -> Column:
    return F.cos(slope_rad) * F.cos(slope_rad)


def effective_diffusivity(d0: Column, cos2: Column) -> Column:
    return d0 / F.greatest(cos2, F.lit(1e-6))


def steady_pressure(z, slope_rad: Column, ks: Column, water_table, flux_share: float = STEADY_FLUX_SHARE) -> Column:
    """Pressure head before the storm; negative above the water table."""
    beta = cos_squared(slope_rad) - (flux_share * ks) / F.greatest(ks, F.lit(1e-12))
    return beta * (lit(z) - lit(water_table))


def pressure_series(
    z,
    slope_rad: Column,
    ks: Column,
    d0: Column,
    water_table,
    amount: Column,
    shares: Column,
    bin_hours: float = 1.0,
    flux_share: float = STEADY_FLUX_SHARE,
) -> Column:
    """Pressure head at the end of every rain bin, as array<double> with one entry per bin.

    Rain of bin n at a node is `amount * shares[n]` in m/s; pass amount 1 for a free series.
    The response depends only on the lag between rain and evaluation, so a row needs one kernel
    value per lag and a lower-triangular sum. That runs as one Arrow function on whole batches:
    no shuffle, no explode. NULL parameters give NULL entries.
    """

    def respond(z, slope, ks, d0, wt, amount, shares):
        psi = _responses(z, slope, ks, d0, wt, amount, shares, bin_hours, flux_share)
        values = pa.array(psi.ravel(), type=pa.float64(), from_pandas=True)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(psi) + 1, dtype=np.int32) * psi.shape[1]), values)

    run = F.arrow_udf(respond, "array<double>")
    return run(
        lit(z).cast("double"), slope_rad, ks, d0, lit(water_table).cast("double"), amount.cast("double"), shares
    )


def _doubles(*columns: pa.Array) -> list[np.ndarray]:
    return [a.to_numpy(zero_copy_only=False).astype(float) for a in columns]


def _responses(z, slope, ks, d0, wt, amount, shares, bin_hours: float, flux_share: float) -> np.ndarray:
    """Pressure heads of one batch, a row per node and a column per rain bin; NaN where a parameter is NULL."""
    n = len(z)
    if n == 0:
        return np.zeros((0, 0))
    z, slope, ks, d0, wt, amount = _doubles(z, slope, ks, d0, wt, amount)
    rain = shares.flatten().to_numpy(zero_copy_only=False).astype(float)
    bins = len(rain) // n
    if bins * n != len(rain):
        raise ValueError("every row needs the same number of rain bins")
    rain = rain.reshape(n, bins)
    with np.errstate(invalid="ignore"):
        ks_floor = np.maximum(ks, 1e-12)
        cos2 = np.cos(slope) ** 2
        d1 = d0 / np.maximum(cos2, 1e-6)
        tau = np.arange(bins + 1) * (bin_hours * 3600.0)
        reach = d1[:, None] * tau[None, :]
        kernel = np.sqrt(reach) * ierfc_array(z[:, None] / (2.0 * np.sqrt(np.maximum(reach, 1e-12))))
        kernel[:, 0] = 0.0
        pulse = np.diff(kernel, axis=1) * (2.0 * amount / ks_floor)[:, None]
        psi = np.repeat(((cos2 - flux_share * ks / ks_floor) * (z - wt))[:, None], bins, axis=1)
        for lag in range(bins):
            psi[:, lag:] += rain[:, : bins - lag] * pulse[:, lag : lag + 1]
        return np.minimum(psi, z[:, None])


def _safety_terms(z, slope_rad: Column, friction_deg: Column, weight: Column) -> tuple[Column, Column, Column]:
    """What does not change with pressure: friction over slope, tangent of friction, and the slab's pull."""
    tan_phi = F.tan(F.radians(friction_deg))
    den = weight * lit(z) * F.sin(slope_rad) * F.cos(slope_rad)
    safe_den = F.when(F.abs(den) < 1e-6, 1e-6).otherwise(den)
    steep = F.greatest(F.tan(slope_rad), F.lit(1e-6))
    return tan_phi / steep, tan_phi, safe_den


def first_failing_bin(
    z,
    slope_rad: Column,
    ks: Column,
    d0: Column,
    water_table,
    amount: Column,
    shares: Column,
    cohesion: Column,
    friction_deg: Column,
    weight: Column,
    bin_hours: float = 1.0,
    flux_share: float = STEADY_FLUX_SHARE,
) -> Column:
    """First rain bin at whose end the factor of safety is below 1, from 0 on; NULL if there is none.

    The series of `pressure_series` never leaves the Arrow function: the terms that do not change with pressure come in
    once per row, and what is left per bin are a product, a difference and a quotient, the same as in `factor_of_safety`.
    Marked as nondeterministic, for a filter on the result would otherwise be pushed below it and run it once more.
    """

    def first(z, slope, ks, d0, wt, amount, shares, cohesion, resting, tan_phi, den):
        if len(z) == 0:
            return pa.array([], pa.int32())
        psi = _responses(z, slope, ks, d0, wt, amount, shares, bin_hours, flux_share)
        cohesion, resting, tan_phi, den = (x[:, None] for x in _doubles(cohesion, resting, tan_phi, den))
        with np.errstate(invalid="ignore"):
            fails = resting + (cohesion - psi * WATER_UNIT_WEIGHT * tan_phi) / den < 1
        return pa.array(fails.argmax(axis=1).astype(np.int32), mask=~fails.any(axis=1))

    run = F.arrow_udf(first, "int").asNondeterministic()
    return run(
        lit(z).cast("double"), slope_rad, ks, d0, lit(water_table).cast("double"), amount.cast("double"), shares,
        cohesion.cast("double"), *_safety_terms(z, slope_rad, friction_deg, weight),
    )


def factor_of_safety(z, psi: Column, slope_rad: Column, cohesion: Column, friction_deg: Column, weight: Column) -> Column:
    """Infinite-slope factor of safety. Near-flat cells get a tiny denominator instead of a division by 0."""
    resting, tan_phi, safe_den = _safety_terms(z, slope_rad, friction_deg, weight)
    return resting + (cohesion - psi * WATER_UNIT_WEIGHT * tan_phi) / safe_den


def display_fs(fs: Column) -> Column:
    return clip(fs, 0e0, 5e0)


def failing(fs: Column) -> Column:
    """FS below 1; an unknown FS never counts as failing."""
    return F.coalesce(fs < 1, F.lit(False))


def debris_acceleration(slope_rad: Column, friction_deg: Column, speed: Column, drag: float = TURBULENT_DRAG) -> Column:
    """Driving pull minus dry friction and turbulent drag, for forward motion."""
    mu = F.tan(F.radians(friction_deg))
    return G * F.sin(slope_rad) - (mu * G * F.cos(slope_rad) + G * speed * speed / drag)


def equilibrium_speed(slope_rad: Column, friction_deg: Column, drag: float = TURBULENT_DRAG) -> Column:
    """Speed at which pull and resistance balance; 0 where friction holds."""
    mu = F.tan(F.radians(friction_deg))
    net = F.sin(slope_rad) - mu * F.cos(slope_rad)
    return F.sqrt(drag * F.greatest(net, F.lit(0e0)))


def moved_share(speed: Column, seconds: float, cell_size: float = CELL_SIZE_M) -> Column:
    """Share of a cell's debris that crosses into the next cell during one step."""
    return clip(speed * seconds / cell_size, 0e0, 1e0)
