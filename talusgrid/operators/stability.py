"""Rain-to-stability series per node and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talusgrid.functions import physics
from talusgrid.functions.numeric import lit


def storm_profile(storms: DataFrame, hours: int = physics.STORM_HOURS) -> DataFrame:
    """storms(storm_id, peak, width) -> one row per storm and hour with shares that add up to 1."""
    w = storms.withColumn("hr", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    w = w.withColumn("weight", physics.storm_weight(F.col("hr"), F.col("peak"), F.col("width")))
    total = F.sum("weight").over(W.partitionBy("storm_id"))  # `hours` rows per storm
    return w.select("storm_id", "hr", (F.col("weight") / total).alias("share"))


def measured_shares(storm: DataFrame, amount: str = "amount") -> Column:
    """Hourly shares of a measured storm(hr, amount) as one array, ordered by hour (one row per hour)."""
    hours = storm.groupBy("hr").agg(F.sum(amount).alias("a"))
    packed = hours.agg(F.array_sort(F.collect_list(F.struct("hr", "a"))).alias("h"), F.sum("a").alias("t"))
    return packed.select(F.transform("h", lambda x: x["a"] / F.col("t")).alias("shares")).scalar()


def disaggregate_rain(nodes: DataFrame, daily_mm: str, shares: Column) -> DataFrame:
    """Daily total per node -> hourly intensity in m/s. The shares are an array, so nothing is joined."""
    hours = nodes.select("*", F.posexplode(shares).alias("hr", "share"))
    return hours.withColumn("intensity_m_s", physics.hourly_intensity(F.col("share"), F.col(daily_mm)))


def pressure_array(nodes: DataFrame, shares: Column, daily_mm: str, depth_m, water_table_m) -> DataFrame:
    """nodes with their pressure series as one array, _psi."""
    psi = physics.pressure_series(
        depth_m,
        F.radians("slope_deg"),
        F.col("ksat_m_s"),
        F.col("diffusivity_m2_s"),
        water_table_m,
        F.col(daily_mm) / 1000.0 / 3600.0,
        shares,
    )
    return nodes.withColumn("_psi", psi)


def _safety(psi: Column, depth_m) -> Column:
    fs = physics.factor_of_safety(lit(depth_m), psi, F.radians("slope_deg"), F.col("cohesion_kpa"), F.col("friction_deg"), F.col("unit_weight"))
    return physics.display_fs(fs)


def pressure_by_hour(
    nodes: DataFrame,
    shares: Column,
    daily_mm: str = "precip_mm",
    depth_m=physics.FAILURE_DEPTH_M,
    water_table_m=physics.WATER_TABLE_M,
) -> DataFrame:
    """nodes(slope_deg, ksat_m_s, diffusivity_m2_s, <daily_mm>, ...) -> one row per node and hour with psi."""
    # The outer form: for a plain explode the optimizer adds a filter on the array, pushes it far
    # down and so runs the Arrow function a second time. Arrays are never empty here.
    series = pressure_array(nodes, shares, daily_mm, depth_m, water_table_m)
    return series.select("*", F.posexplode_outer("_psi").alias("hr", "psi")).drop("_psi")


def stability_by_hour(nodes: DataFrame, shares: Column, depth_m=physics.FAILURE_DEPTH_M, **pressure) -> DataFrame:
    """Adds the factor of safety, bounded to 0-5, to the pressure series.

    Also needs cohesion_kpa, friction_deg and unit_weight. From the scan to the node-hours there
    is no shuffle.
    """
    hours = pressure_by_hour(nodes, shares, depth_m=depth_m, **pressure)
    return hours.withColumn("fs", _safety(F.col("psi"), depth_m))


def onset_by_node(
    nodes: DataFrame,
    shares: Column,
    daily_mm: str = "precip_mm",
    depth_m=physics.FAILURE_DEPTH_M,
    water_table_m=physics.WATER_TABLE_M,
) -> DataFrame:
    """Adds onset_hr: the first hour whose factor of safety is below 1, NULL if there is none.

    The series stays inside one Arrow function, which gives back the hour only; nothing is exploded, grouped or shuffled.
    """
    onset = physics.first_failing_bin(
        depth_m, F.radians("slope_deg"), F.col("ksat_m_s"), F.col("diffusivity_m2_s"), water_table_m, F.col(daily_mm) / 1000.0 / 3600.0, shares,
        F.col("cohesion_kpa"), F.col("friction_deg"), F.col("unit_weight"),
    )
    return nodes.withColumn("onset_hr", onset)
