"""Soil columns: unit conversion, pedotransfer hydraulics, texture class, strength and weight.

Stages that reuse an intermediate value several times are DataFrame transforms, so that the
value stays a column and is not expanded again at each use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.numeric import clip, safe_ln

# Effective cohesion (kPa) and friction angle (degrees) per texture class.
STRENGTH_BY_TEXTURE = {
    "sand": (1.0, 33.0),
    "sandy_loam": (4.0, 30.0),
    "loam": (8.0, 28.0),
    "silt_loam": (10.0, 27.0),
    "silt": (6.0, 26.0),
    "clay_loam": (15.0, 24.0),
    "clay": (20.0, 20.0),
}

# Soil parameters assumed outside the mapped area.
DEFAULTS_OUTSIDE_COVERAGE = {
    "cohesion_kpa": 10.0,
    "friction_deg": 27.0,
    "unit_weight": 18.0,
    "ksat_m_s": 1e-6,
    "diffusivity_m2_s": 1e-5,
}


def with_fractions(df: DataFrame) -> DataFrame:
    """sand_gkg, clay_gkg, bdod_cgcm3 -> sand_pct, clay_pct, silt_pct, density_gcm3."""
    sand, clay = F.col("sand_gkg") / 10.0, F.col("clay_gkg") / 10.0
    return df.withColumns(
        {
            "sand_pct": sand,
            "clay_pct": clay,
            "silt_pct": clip(F.lit(100e0) - sand - clay, 0e0, 100e0),
            "density_gcm3": F.col("bdod_cgcm3") / 100.0,
        }
    )


def with_hydraulics(df: DataFrame) -> DataFrame:
    """Water retention, saturated conductivity and diffusivity from sand_pct and clay_pct.

    Where the wilting-point estimate is not positive its logarithm does not exist; conductivity
    and diffusivity are then NULL.
    """
    s, c = F.col("_s"), F.col("_c")
    wilt, field, sat, res = F.col("_wilt"), F.col("_field"), F.col("theta_sat"), F.col("theta_res")
    log_range = math.log(1500) - math.log(33)
    work = df.withColumns({"_s": F.col("sand_pct") / 100.0, "_c": F.col("clay_pct") / 100.0})
    # Regression coefficients of the retention curve.
    work = work.withColumns(
        {
            "_wilt": -0.024 * s + 0.487 * c + 0.006 + 0.005 * (s * c) - 0.013 * (c * c),
            "_field_raw": -0.251 * s + 0.195 * c + 0.011 + 0.006 * (s * c) - 0.027 * (c * c) + 0.452 * (s * c),
            "_above_field": 0.278 * s + 0.034 * c + 0.022 - 0.018 * (s * c) - 0.027 * (c * c),
        }
    )
    work = work.withColumn("_field", clip(F.col("_field_raw"), wilt + 0.02, 0.6))
    work = work.withColumns(
        {
            "theta_sat": clip(field + F.col("_above_field"), field + 0.02, 0.65),
            "theta_res": clip(wilt * 0.7, 0.01, field - 0.02),
            "_lambda": (safe_ln(field) - safe_ln(wilt) + 1e-9) / F.lit(log_range),
            "alpha_1_m": clip(F.lit(100e0) / clip(field * 100, 5e0, 200e0), 0.5, 20e0),
        }
    )
    work = work.withColumn("_mm_hr", 1930e0 * F.pow(sat - field, F.lit(3e0) - F.col("_lambda")))
    work = work.withColumn("ksat_m_s", clip(F.col("_mm_hr"), 0.1, 500e0) / 1000.0 / 3600.0)
    work = work.withColumn("diffusivity_m2_s", F.col("ksat_m_s") / clip(sat - res, 0.05, 1e0) * 10)
    return work.drop("_s", "_c", "_wilt", "_field_raw", "_above_field", "_field", "_lambda", "_mm_hr")


def texture_class(sand: Column, silt: Column, clay: Column) -> Column:
    """Coarse texture class. The classes overlap, so the most specific one is asked first."""
    return (
        F.when(sand >= 85, "sand")
        .when((sand >= 70) & (clay < 15), "sandy_loam")
        .when((silt >= 50) & (clay < 27), "silt_loam")
        .when(silt >= 80, "silt")
        .when((clay >= 27) & (clay < 40) & (sand < 45), "clay_loam")
        .when(clay >= 40, "clay")
        .when(sand.isNotNull() & silt.isNotNull() & clay.isNotNull(), "loam")
    )


def strength_of(texture: Column, part: int) -> Column:
    """Cohesion (part 0) or friction angle (part 1) of a class; 0 for an unknown class.

    The table has seven fixed rows, so it is a literal map inside the projection, not a join.
    """
    pairs = [F.lit(x) for name, pair in STRENGTH_BY_TEXTURE.items() for x in (name, pair[part])]
    return F.coalesce(F.create_map(*pairs)[texture], F.lit(0e0))


def with_strength(df: DataFrame, texture: str = "texture") -> DataFrame:
    return df.withColumns(
        {"cohesion_kpa": strength_of(F.col(texture), 0), "friction_deg": strength_of(F.col(texture), 1)}
    )


def unit_weight(density_gcm3: Column) -> Column:
    """Dry unit weight in kN/m3 from dry bulk density."""
    return density_gcm3 * 1000.0 * 9.81 / 1000.0


def with_soil_parameters(df: DataFrame) -> DataFrame:
    """The whole chain from raw soil samples to strength, weight and hydraulics."""
    out = with_hydraulics(with_fractions(df))
    out = out.withColumn("texture", texture_class(F.col("sand_pct"), F.col("silt_pct"), F.col("clay_pct")))
    return with_strength(out).withColumn("unit_weight", unit_weight(F.col("density_gcm3")))


def with_defaults_outside(df: DataFrame, covered: str = "has_soil") -> DataFrame:
    """Mid-range parameters where there is no soil map, so missing data is not read as weakness."""
    return df.withColumns(
        {k: F.when(F.col(covered), F.col(k)).otherwise(F.lit(v)) for k, v in DEFAULTS_OUTSIDE_COVERAGE.items()}
    )


def masked_to_zero(value: Column, covered: Column) -> Column:
    return F.when(covered, value).otherwise(F.lit(0e0))

