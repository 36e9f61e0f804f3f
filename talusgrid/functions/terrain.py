"""Terrain columns: feature engineering, no-data handling, georeferencing and map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.numeric import at_least, clip

# Georeference of the terrain raster (degrees) and of the soil lattice (metres).
PIXEL_DEG = 0.0002777777777777778
LAT_TOP = 30.85000001111111
LON_LEFT = 78.84999998888891
METRES_PER_DEGREE = 111320.0
MOLLWEIDE_RADIUS = 6371007.1809
LATTICE_X0 = 7189735.290828891
LATTICE_Y0 = 3743288.1316389814
LATTICE_STEP = 250.0
RAIN_LON0, RAIN_LAT0, RAIN_STEP = -180.0, 60.0, 0.05
NODATA_LIMIT = -9000.0
SOIL_NODATA = -32768

TERRAIN_FEATURES = (
    "elevation_m",
    "slope_deg",
    "aspect_sin",
    "aspect_cos",
    "roughness",
    "twi",
    "log_flow_accum",
    "log_specific_catchment_area",
)


def null_below(x: Column, limit: float = NODATA_LIMIT) -> Column:
    """Large negative sentinels become NULL."""
    return F.when(x > limit, x)


def null_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def soil_pixel_valid(sand: Column, density: Column) -> Column:
    """A soil pixel is outside the map when sand and density are both 0 or carry the sentinel."""
    marked = (sand == SOIL_NODATA) | (density == SOIL_NODATA)
    return F.coalesce(~((sand == 0) & (density == 0)) & ~marked, F.lit(False))


def feature_columns() -> dict[str, Column]:
    """Model features of one cell; NULL aspect counts as north, skewed bands are log-scaled."""
    aspect = F.radians(F.coalesce(F.when(F.col("aspect_deg") >= -900, F.col("aspect_deg")), F.lit(0e0)))
    return {
        "elevation_m": F.col("elevation_m"),
        "slope_deg": at_least(F.col("slope_deg"), 0e0),
        "aspect_sin": F.sin(aspect),
        "aspect_cos": F.cos(aspect),
        "roughness": at_least(F.col("roughness"), 0e0),
        "twi": F.col("twi"),
        "log_flow_accum": F.log1p(at_least(F.col("flow_accum"), 0e0)),
        "log_specific_catchment_area": F.log1p(at_least(F.col("sca"), 0e0)),
    }


def longitude(c: Column, step: int, border: int) -> Column:
    return F.lit(LON_LEFT + border * PIXEL_DEG) + c * step * PIXEL_DEG


def latitude(r: Column, step: int, border: int) -> Column:
    return F.lit(LAT_TOP - border * PIXEL_DEG) - r * step * PIXEL_DEG


def metres_per_lon_degree(full_rows: Column, border: int) -> Column:
    """Length of a degree of longitude at the mean latitude of the cropped raster."""
    mean_lat = F.lit(LAT_TOP - border * PIXEL_DEG) - (full_rows * PIXEL_DEG) / 2
    return METRES_PER_DEGREE * F.cos(F.radians(mean_lat))


def mollweide_lonlat(x: Column, y: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Map metres to degrees; the asin arguments are bounded because edge pixels overshoot."""
    theta = F.asin(clip(y / (MOLLWEIDE_RADIUS * math.sqrt(2)), -1e0, 1e0))
    lat = F.asin(clip((2 * theta + F.sin(2 * theta)) / math.pi, -1e0, 1e0))
    lon = lon0 + (math.pi * x) / (2 * MOLLWEIDE_RADIUS * math.sqrt(2) * F.nullif(F.cos(theta), F.lit(0e0)))
    return F.degrees(lon), F.degrees(lat)


def with_lattice_position(df: DataFrame, lon: str = "lon", lat: str = "lat", rounds: int = 6) -> DataFrame:
    """Place lon/lat points on the soil lattice: adds lattice column u and lattice row v.

    The projection angle has no closed form, so a fixed number of Newton steps is folded over an array. As one small
    expression it stays small where filters on u and v are moved below it; nothing is shuffled.
    """
    goal = math.pi * F.sin(F.radians(F.col(lat)))

    def step(theta, _):
        slope = F.greatest(F.lit(2e0) + 2 * F.cos(2 * theta), F.lit(1e-12))
        return theta - (2 * theta + F.sin(2 * theta) - goal) / slope

    theta = F.aggregate(F.array_repeat(F.lit(0), rounds), F.radians(F.col(lat)), step)
    root = MOLLWEIDE_RADIUS * math.sqrt(2)
    x = (2 * root / math.pi) * F.radians(F.col(lon)) * F.cos(theta)
    y = root * F.sin(theta)
    return df.withColumns({"u": (x - LATTICE_X0) / LATTICE_STEP, "v": (LATTICE_Y0 - y) / LATTICE_STEP})


def rain_position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Position in rain-grid cells; samples sit at pixel centres, hence the half cell."""
    return (lon - RAIN_LON0) / RAIN_STEP - 0.5, (F.lit(RAIN_LAT0) - lat) / RAIN_STEP - 0.5
