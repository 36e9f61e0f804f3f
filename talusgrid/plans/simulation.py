"""End-to-end plans: terrain, soil and rain in, stability series and features out.

Every stage adds columns to the same node rows. Soil and rain come in by lookups from the small
side, so the node table itself is not joined to another table of its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.physics import FAILURE_DEPTH_M
from talusgrid.functions.soil import masked_to_zero, with_defaults_outside, with_soil_parameters
from talusgrid.functions.terrain import TERRAIN_FEATURES, feature_columns, rain_position, soil_pixel_valid, with_lattice_position
from talusgrid.operators import grid
from talusgrid.operators.resample import bilinear, filled, inside_hull
from talusgrid.operators.stability import onset_by_node, stability_by_hour

SOIL_VALUES = ["sand_gkg", "clay_gkg", "bdod_cgcm3"]
SOIL_FEATURES = (
    "cohesion_kpa",
    "friction_deg",
    "unit_weight",
    "ksat_m_s",
    "diffusivity_m2_s",
    "theta_sat",
    "theta_res",
    "alpha_1_m",
)


#: What a storm reads of a node, beside its position, soil and rain.
STORM_COLUMNS = ("node_id", "slope_deg")

NODE_FEATURES = (*TERRAIN_FEATURES, "precip_mm", *SOIL_FEATURES, "has_soil_data")


def feature_vectors(features: DataFrame) -> DataFrame:
    """Unified features -> (node_id, x): all of them as one array, in the order of NODE_FEATURES."""
    return features.select("node_id", F.array(*[F.col(n).cast("double") for n in NODE_FEATURES]).alias("x"))


def valid_samples(samples: DataFrame) -> DataFrame:
    return samples.where(soil_pixel_valid(F.col("sand_gkg"), F.col("bdod_cgcm3"))).select("lr", "lc", *SOIL_VALUES)


def with_soil(nodes: DataFrame, samples: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Soil parameters and coverage flag at every node, from raw lattice samples.

    Outside the hull of the samples every later step replaces the soil by defaults or zeros, so
    gaps are filled inside only.
    """
    valid = valid_samples(samples)
    covered = inside_hull(nodes, valid, u, v)
    return with_soil_parameters(filled(covered, valid, SOIL_VALUES, u=u, v=v, only=F.col("has_soil")))


def storm_nodes(
    nodes: DataFrame, samples: DataFrame, coarse_rain: DataFrame, rain_rows: int, rain_cols: int, carry: tuple[str, ...] | None = None
) -> DataFrame:
    """Nodes ready for the storm: nodes carry lattice position (u, v) and rain position (rain_u, rain_v).

    Soil meets the nodes in a function over whole rows, through which the optimizer cannot see. `carry` names the
    columns that later steps read; only these and the position travel to the soil, the others are dropped.
    """
    if carry is not None:
        nodes = nodes.select(*carry, "u", "v", "rain_u", "rain_v")
    wet = bilinear(nodes, coarse_rain, "precip_mm", rain_rows, rain_cols, "rain_u", "rain_v")
    return with_soil(wet if carry is None else wet.drop("rain_u", "rain_v"), samples)


def georeferenced(cells: DataFrame, border: int, step: int) -> DataFrame:
    """Raster cells -> the run's nodes: cropped, strided and renumbered, with degrees and positions on the soil lattice and the rain grid."""
    rows, cols = grid.grid_shape(cells)
    kept = grid.stride(grid.crop_border(cells, border, rows, cols), step)
    placed = with_lattice_position(grid.with_lonlat(kept, step, border))
    rain_u, rain_v = rain_position(F.col("lon"), F.col("lat"))
    return placed.withColumns({"rain_u": rain_u, "rain_v": rain_v})


def _storm_inputs(ready: DataFrame) -> DataFrame:
    """What the storm needs of a node; defaults outside the soil map."""
    return with_defaults_outside(ready).select(
        "node_id",
        "slope_deg",
        "precip_mm",
        "cohesion_kpa",
        "friction_deg",
        "unit_weight",
        "ksat_m_s",
        "diffusivity_m2_s",
    )


def simulate(ready: DataFrame, shares: Column) -> DataFrame:
    """Pressure head and factor of safety per node and hour; defaults outside the soil map."""
    return stability_by_hour(_storm_inputs(ready), shares).select("node_id", "hr", "psi", "fs")


def storm_releases(ready: DataFrame, shares: Column, depth_m: float = FAILURE_DEPTH_M) -> DataFrame:
    """Each node that fails releases its slab once, at its first failing hour; node-hours are never made."""
    onset = onset_by_node(_storm_inputs(ready), shares)
    return onset.where("onset_hr is not null").select("node_id", "onset_hr", F.lit(depth_m).alias("depth_m"))


def unified_features(ready: DataFrame) -> DataFrame:
    """Terrain, rain and soil features per node; soil is 0 outside the map and flagged by has_soil."""
    covered = F.col("has_soil")
    return ready.select(
        "node_id",
        *[x.alias(n) for n, x in feature_columns().items()],
        "precip_mm",
        *[masked_to_zero(F.col(n), covered).alias(n) for n in SOIL_FEATURES],
        covered.cast("double").alias("has_soil_data"),
    )
