"""Grid alignment: mosaics, bands, cropping, striding, co-registration and georeferencing.

All operators except the pivots are narrow. Grid sizes may be given as numbers or as a Column,
for example the scalar subquery that `grid_shape` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions import terrain
from talusgrid.functions.numeric import lit


def grid_shape(cells: DataFrame) -> tuple[Column, Column]:
    """(rows, columns) of a cell table as scalar subqueries: one small aggregate, no join."""
    return (
        cells.agg((F.max("r") + 1).alias("n")).scalar(),
        cells.agg((F.max("c") + 1).alias("n")).scalar(),
    )


def mosaic(tiles: DataFrame, tile_rows: int, tile_cols: int, across: int, height, width, bands: int = 1) -> DataFrame:
    """tiles(tile_id, tile_values) -> cells(r, c, value); overhanging parts of edge tiles are cut off.

    With several bands, a tile has the values of all bands of a pixel side by side, and cells also have `band`.
    A tile with another number of values is refused.
    """
    size = tile_rows * tile_cols * bands
    wrong = F.raise_error(F.format_string(f"tile %s has %s values, not {size}", F.col("tile_id"), F.size("tile_values")))
    whole = F.when(F.size("tile_values") == size, F.col("tile_values")).otherwise(wrong.cast(tiles.schema["tile_values"].dataType))
    split = tiles.select("tile_id", F.posexplode(whole).alias("at", "value"))
    cells = split.select("tile_id", F.floor(F.col("at") / bands).alias("pos"), (F.col("at") % bands).alias("band"), "value")
    return cells.select(
        *(["band"] if bands > 1 else []),
        (F.floor(F.col("tile_id") / across) * tile_rows + F.floor(F.col("pos") / tile_cols)).cast("int").alias("r"),
        ((F.col("tile_id") % across) * tile_cols + F.col("pos") % tile_cols).cast("int").alias("c"),
        F.col("value").cast("double").alias("value"),
    ).where((F.col("r") < lit(height)) & (F.col("c") < lit(width)))


def select_bands(bands: DataFrame, wanted: list[int]) -> DataFrame:
    """Long bands(band, r, c, value) -> one row per cell with a column per wanted band.

    The band list is fixed, so the pivot is one aggregate with map-side combine.
    """
    kept = bands.where(F.col("band").isin(wanted))
    out = kept.groupBy("r", "c").pivot("band", wanted).agg(F.max("value"))
    return out.select("r", "c", *[F.col(str(b)).alias(f"band_{b}") for b in wanted])


def coregister(bands: DataFrame, wanted: list[int], reference_band: int) -> DataFrame:
    """Stack bands into one row per cell; bands whose grid differs from the reference are left NULL."""
    shape = bands.groupBy("band").agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"))
    ref_shape = shape.where(F.col("band") == reference_band).agg(F.struct(F.max("max_r"), F.max("max_c")))
    same = shape.where(F.struct("max_r", "max_c") == ref_shape.scalar()).where(F.col("band").isin(wanted))
    # `same` has at most len(wanted) rows: one per band number in the list.
    fitting = bands.where(F.col("band").isin(wanted)).join(F.broadcast(same.select("band")), "band", "left_semi")
    return select_bands(fitting, wanted)


def crop_border(cells: DataFrame, border: int, rows, cols) -> DataFrame:
    inside = (
        (F.col("r") >= border)
        & (F.col("r") < lit(rows) - border)
        & (F.col("c") >= border)
        & (F.col("c") < lit(cols) - border)
    )
    return cells.where(inside).withColumns({"r": F.col("r") - border, "c": F.col("c") - border})


def stride(cells: DataFrame, step: int) -> DataFrame:
    """Keep every step-th row and column and renumber them."""
    kept = cells.where((F.col("r") % step == 0) & (F.col("c") % step == 0))
    return kept.withColumns({axis: F.floor(F.col(axis) / step).cast("int") for axis in ("r", "c")})


def mask_nodata(cells: DataFrame, sentinels: dict[str, float]) -> DataFrame:
    """Values at or below a sentinel limit become NULL."""
    return cells.withColumns({name: terrain.null_below(F.col(name), limit) for name, limit in sentinels.items()})


def with_lonlat(nodes: DataFrame, step: int, border: int) -> DataFrame:
    return nodes.withColumns(
        {
            "lon": terrain.longitude(F.col("c"), step, border),
            "lat": terrain.latitude(F.col("r"), step, border),
        }
    )


def with_metres(nodes: DataFrame, step: int, border: int, full_rows) -> DataFrame:
    """Local coordinates in metres; full_rows is the row count of the cropped raster before striding."""
    per_lon = terrain.metres_per_lon_degree(lit(full_rows), border)
    dx = terrain.PIXEL_DEG * step * per_lon
    dy = F.lit(terrain.PIXEL_DEG * step * terrain.METRES_PER_DEGREE)
    return nodes.withColumns({"x_m": F.col("c") * dx, "y_m": F.col("r") * dy})


def extent(cells: DataFrame, border: int, target_cols: int) -> DataFrame:
    """One row of map metadata of an already cropped raster, from a single aggregate."""
    stats = cells.agg(
        (F.max("r") + 1).alias("full_rows"),
        (F.max("c") + 1).alias("full_cols"),
        F.min("elevation_m").alias("elev_min"),
        F.max("elevation_m").alias("elev_max"),
    )
    px = terrain.PIXEL_DEG
    rows, cols, step = F.col("full_rows"), F.col("full_cols"), F.col("step")
    out = stats.withColumn("step", F.greatest(F.lit(1), F.rint(cols / target_cols).cast("int")))
    out = out.withColumns(
        {
            "grid_h": F.ceil(rows / step).cast("int"),
            "grid_w": F.ceil(cols / step).cast("int"),
            "lat_top": F.lit(terrain.LAT_TOP - border * px),
            "lon_left": F.lit(terrain.LON_LEFT + border * px),
        }
    )
    out = out.withColumns(
        {"lat_bottom": F.col("lat_top") - rows * px, "lon_right": F.col("lon_left") + cols * px}
    )
    mean_lat = (F.col("lat_top") + F.col("lat_bottom")) / 2
    return out.withColumns(
        {
            "width_m": (F.col("lon_right") - F.col("lon_left"))
            * (terrain.METRES_PER_DEGREE * F.cos(F.radians(mean_lat))),
            "height_m": (F.col("lat_top") - F.col("lat_bottom")) * terrain.METRES_PER_DEGREE,
        }
    )


def upsample_nearest(coarse: DataFrame, step: int, rows, cols) -> DataFrame:
    """Repeat each texture cell step x step times; a ragged edge repeats the last row or column.

    Written as an expansion of the coarse table, which is narrow: every coarse cell knows which
    full-resolution cells copy it, so no join of the fine grid is needed.
    """
    height, width = lit(rows), lit(cols)
    last_r, last_c = grid_shape(coarse)

    def copies(axis: str, last: Column, size: Column) -> Column:
        start = F.col(axis) * step
        end = F.when(F.col(axis) == last - 1, size - 1).otherwise(F.least(start + step, size) - 1)
        span = F.sequence(start.cast("int"), end.cast("int"))
        return F.explode(F.when(end >= start, span).otherwise(F.array().cast("array<int>")))

    fine = coarse.withColumnsRenamed({"r": "_r", "c": "_c"})
    fine = fine.withColumn("r", copies("_r", last_r, height))
    fine = fine.withColumn("c", copies("_c", last_c, width))
    return fine.drop("_r", "_c")
