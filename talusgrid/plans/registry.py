"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.functions import colour, numeric, physics, terrain
from talusgrid.functions import soil as soil_fn
from talusgrid.operators import drainage, frames, graph, grid, layers, resample, runout, stability, summary
from talusgrid.operators.quantiles import exact_percentiles, percentiles_by_group
from talusgrid.plans import fixtures as fx
from talusgrid.plans import simulation
from talusgrid.sources import tables
from talusgrid.sources.workspace import cut_lineage, new_table_path
from talusgrid.streaming import monitors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

BORDER = 2
STRIDE_TARGET = 40
CAP_M = 5.0
ROUTE_STEPS = 3
STEP_SECONDS = 5.0
READOUT_TIMES = [k / 2 for k in range(48)]


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6, **per_column: int | None) -> DataFrame:
    """Round double columns, because engines differ in the last bit of sin, exp, log and of sums.

    None leaves a column as it is: plain arithmetic agrees bit for bit, and rounding would only
    bring in ties.
    """

    def shown(name: str, kind: str):
        places = per_column.get(name, digits)
        return F.round(name, places).alias(name) if kind == "double" and places is not None else F.col(name)

    return df.select(*[shown(f.name, f.dataType.typeName()) for f in df.schema])


# --- scans, manifests, grid alignment -------------------------------------------------------


@query
def scan_cells(spark, sf):
    return tables.scan_bands(fx.cells(spark, sf), ["elevation_m", "slope_deg"])


@query
def manifest_missing(spark, sf):
    """Terrain strips for which no soil strip exists."""
    strip = lambda col: F.concat(F.lit("strip_"), F.lpad(col.cast("string"), 8, "0"), F.lit(".tif")).alias("name")
    return tables.missing_inputs(
        fx.cells(spark, sf).select(strip(F.col("r"))), fx.soil(spark, sf).select(strip(F.col("lr")))
    )


@query
def manifest_resolve(spark, sf):
    """Document names such as EN.25.TIF resolved against page files such as host/en-25.html."""
    wanted = tables.read_table(spark, sf, "documents").select(
        F.concat(F.upper("lang"), F.lit("."), F.col("doc_id").cast("string"), F.lit(".TIF")).alias("name")
    )
    pattern = r"^https?://([^/]+)/([a-z]+)/([0-9]+)"
    part = [F.regexp_extract("url", pattern, i) for i in (1, 2, 3)]
    catalogue = tables.read_table(spark, sf, "pages").select(
        F.concat(part[0], F.lit("/"), part[1], F.lit("-"), part[2], F.lit(".html")).alias("path")
    )
    return tables.resolve_names(wanted, catalogue)


@query
def tile_mosaic(spark, sf):
    t = fx.tiles(spark, sf)
    height = t.agg((F.floor(F.count(F.lit(1)) / 10) * 8 - 3).alias("h")).scalar()
    return grid.mosaic(t, 8, 8, across=10, height=height, width=77)


@query
def mosaic_bands(spark, sf):
    """Tiles of 4 x 4 pixels with four bands side by side, as columns of the two that are wanted."""
    cells = grid.mosaic(fx.tiles(spark, sf), 4, 4, across=10, height=F.lit(2**30), width=38, bands=4)
    return grid.select_bands(cells, [0, 2])


@query
def band_pivot(spark, sf):
    return grid.select_bands(fx.bands(spark, sf), [0, 2])


@query
def border_crop(spark, sf):
    cells = fx.cells(spark, sf)
    return grid.crop_border(cells, BORDER, *grid.grid_shape(cells)).select("node_id", "r", "c", "elevation_m")


@query
def stride_downsample(spark, sf):
    step = numeric.half_even_step(fx.COLUMNS, STRIDE_TARGET)
    return grid.stride(fx.cells(spark, sf), step).select("node_id", "r", "c", "elevation_m")


@query
def nodata_mask(spark, sf):
    cells = fx.cells(spark, sf).select("node_id", "aspect_deg")
    return grid.mask_nodata(cells, {"aspect_deg": terrain.NODATA_LIMIT})


@query
def coregister_bands(spark, sf):
    return grid.coregister(fx.bands(spark, sf), [0, 1, 2], reference_band=0)


@query
def node_lonlat(spark, sf):
    return rounded(grid.with_lonlat(fx.cells(spark, sf).select("node_id", "r", "c"), 5, 6), 10)


@query
def node_metres(spark, sf):
    cells = fx.cells(spark, sf)
    rows = cells.agg(((F.max("r") + 1) * 5).alias("n")).scalar()
    return rounded(grid.with_metres(cells.select("node_id", "r", "c"), 5, 6, rows))


@query
def extent_meta(spark, sf):
    cells = fx.cells(spark, sf)
    return rounded(grid.extent(grid.crop_border(cells, BORDER, *grid.grid_shape(cells)), BORDER, STRIDE_TARGET))


@query
def mollweide_inverse(spark, sf):
    lon, lat = terrain.mollweide_lonlat(F.col("x_m"), F.col("y_m"))
    return rounded(fx.soil(spark, sf).select("sample_id", lon.alias("lon"), lat.alias("lat")), 8)


@query
def lattice_position(spark, sf):
    """Round trip: sample metres to degrees and back to lattice units."""
    lon, lat = terrain.mollweide_lonlat(F.col("x_m"), F.col("y_m"))
    points = fx.soil(spark, sf).select("sample_id", lon.alias("lon"), lat.alias("lat"))
    return rounded(terrain.with_lattice_position(points).select("sample_id", "u", "v"), 4)


@query
def bilinear_resample(spark, sf):
    out = resample.bilinear(fx.rain_nodes(spark, sf), fx.rain(spark, sf), "mm", fx.RAIN_ROWS, fx.RAIN_COLUMNS)
    return out.select("node_id", "mm")


@query
def nearest_resample(spark, sf):
    samples = simulation.valid_samples(fx.soil(spark, sf))
    out = resample.nearest_on_lattice(fx.lattice_nodes(spark, sf), samples, simulation.SOIL_VALUES)
    return out.select("node_id", *simulation.SOIL_VALUES)


@query
def lattice_linear_resample(spark, sf):
    samples = simulation.valid_samples(fx.soil(spark, sf))
    out = resample.linear_on_lattice(fx.lattice_nodes(spark, sf), samples, simulation.SOIL_VALUES)
    return out.select("node_id", *simulation.SOIL_VALUES)


@query
def coverage_mask(spark, sf):
    samples = simulation.valid_samples(fx.soil(spark, sf))
    return resample.inside_hull(fx.lattice_nodes(spark, sf), samples).select("node_id", "has_soil")


@query
def soil_defaults(spark, sf):
    out = soil_fn.with_defaults_outside(simulation.with_soil(fx.lattice_nodes(spark, sf), fx.soil(spark, sf)))
    out = out.select("node_id", "has_soil", *soil_fn.DEFAULTS_OUTSIDE_COVERAGE)
    return rounded(out, ksat_m_s=15, diffusivity_m2_s=14)


@query
def nearest_upsample(spark, sf):
    """Every third cell repeated back to full resolution."""
    cells = fx.cells(spark, sf).select("node_id", "r", "c", "elevation_m")
    rows, cols = grid.grid_shape(cells)
    coarse = grid.stride(cells, 3).select("r", "c", "elevation_m")
    return grid.upsample_nearest(coarse, 3, rows, cols).select("r", "c", "elevation_m")


@query
def roundtrip_sink(spark, sf):
    path = new_table_path(spark, "cells")
    out = fx.cells(spark, sf).select("node_id", "r", "c", "slope_deg", "aspect_deg", "d8_code")
    tables.write_table(out, path, ["d8_code"])
    back = spark.read.parquet(path)
    return back.select(
        "node_id", "r", "c", F.round(F.col("slope_deg").cast("double"), 4).alias("slope_deg"),
        F.col("aspect_deg").cast("double").alias("aspect_deg"), F.col("d8_code").cast("int").alias("d8_code"),
    )


# --- soil and terrain science -----------------------------------------------------------------


def _texture(samples: DataFrame) -> DataFrame:
    out = soil_fn.with_fractions(samples)
    return out.withColumn(
        "texture", soil_fn.texture_class(F.col("sand_pct"), F.col("silt_pct"), F.col("clay_pct"))
    )


@query
def soil_fractions(spark, sf):
    out = soil_fn.with_fractions(fx.soil(spark, sf))
    return rounded(out.select("sample_id", "sand_pct", "silt_pct", "clay_pct", "density_gcm3"))


@query
def soil_hydraulics(spark, sf):
    out = soil_fn.with_hydraulics(soil_fn.with_fractions(fx.soil(spark, sf)))
    out = out.select("sample_id", "theta_sat", "theta_res", "ksat_m_s", "alpha_1_m", "diffusivity_m2_s")
    return rounded(out, 9, ksat_m_s=15, diffusivity_m2_s=14)


@query
def texture_class(spark, sf):
    return _texture(fx.soil(spark, sf)).select("sample_id", "texture")


@query
def texture_strength(spark, sf):
    out = soil_fn.with_strength(_texture(fx.soil(spark, sf)))
    return out.select("sample_id", "texture", "cohesion_kpa", "friction_deg")


@query
def unit_weight(spark, sf):
    out = soil_fn.with_fractions(fx.soil(spark, sf))
    return rounded(out.select("sample_id", soil_fn.unit_weight(F.col("density_gcm3")).alias("unit_weight")))


@query
def terrain_features(spark, sf):
    cells = grid.mask_nodata(fx.cells(spark, sf), {"aspect_deg": terrain.NODATA_LIMIT})
    return rounded(cells.select("node_id", *[x.alias(n) for n, x in terrain.feature_columns().items()]), 9)


@query
def feature_vector(spark, sf):
    """Features as one array in a fixed order, read back by position."""
    cells = grid.mask_nodata(fx.cells(spark, sf), {"aspect_deg": terrain.NODATA_LIMIT})
    features = terrain.feature_columns()
    packed = cells.select("node_id", F.array(*[features[n] for n in terrain.TERRAIN_FEATURES]).alias("x"))
    out = packed.select("node_id", F.posexplode("x").alias("position", "value"))
    names = F.array(*[F.lit(n) for n in terrain.TERRAIN_FEATURES])
    return rounded(out.withColumn("feature", F.get(names, F.col("position"))), 9)


def _ready_nodes(spark, sf, carry: tuple[str, ...] | None = None) -> DataFrame:
    c, r = F.col("c"), F.col("r")
    placed = fx.cells(spark, sf, spread=True).withColumns(
        {
            "u": c * 0.6e0 - 5e0,
            "v": r * 0.3e0 - 3e0,
            "rain_u": c / 20e0 - 0.5e0,
            "rain_v": (r % 100) / 20e0 - 0.5e0,
        }
    )
    rain = fx.rain(spark, sf).select("rr", "cc", F.col("mm").alias("precip_mm"))
    return simulation.storm_nodes(placed, fx.soil(spark, sf), rain, fx.RAIN_ROWS, fx.RAIN_COLUMNS, carry)


NODE_DIGITS = {"ksat_m_s": 15, "diffusivity_m2_s": 14, "theta_sat": 12, "theta_res": 12, "precip_mm": None}


@query
def unified_features(spark, sf):
    features = simulation.unified_features(_ready_nodes(spark, sf))
    return rounded(features, 9, **NODE_DIGITS)


@query
def node_vectors(spark, sf):
    """The whole feature vector of a node (terrain, rain, soil, mask) as one array, read back by position and name."""
    vectors = simulation.feature_vectors(rounded(simulation.unified_features(_ready_nodes(spark, sf)), 9, **NODE_DIGITS))
    names = F.array(*[F.lit(n) for n in simulation.NODE_FEATURES])
    out = vectors.select("node_id", F.posexplode("x").alias("position", "value"))
    return out.withColumn("feature", F.get(names, F.col("position")))


@query
def storm_shape(spark, sf):
    """One storm per event type, with the peak and width of its hours of the day."""
    hour = F.hour("ts")
    storms = tables.read_table(spark, sf, "events").groupBy(F.col("event_type").alias("storm_id")).agg(
        F.avg(hour).alias("peak"), F.stddev_pop(hour).alias("width")
    )
    return rounded(stability.storm_profile(storms), 9)


@query
def rain_disaggregate(spark, sf):
    nodes = resample.bilinear(fx.rain_nodes(spark, sf), fx.rain(spark, sf), "mm", fx.RAIN_ROWS, fx.RAIN_COLUMNS)
    out = stability.disaggregate_rain(nodes, "mm", physics.storm_shares())
    return rounded(out.select("node_id", "hr", "intensity_m_s"), 12)


@query
def ierfc(spark, sf):
    eta = (F.col("node_id") % 1200) / 100e0
    return rounded(fx.cells(spark, sf).select("node_id", numeric.ierfc(eta).alias("ierfc")), 9)


def _slope_nodes(spark, sf) -> DataFrame:
    k = F.col("node_id")
    return fx.cells(spark, sf, spread=True).select(
        "node_id",
        "slope_deg",
        (F.lit(1e-6) * (1 + k % 7)).alias("ksat_m_s"),
        (F.lit(1e-5) * (1 + k % 5)).alias("diffusivity_m2_s"),
        (F.lit(50e0) + k % 150).alias("precip_mm"),
        (F.lit(2e0) + k % 9).alias("cohesion_kpa"),
        (F.lit(20e0) + k % 14).alias("friction_deg"),
        (F.lit(16e0) + k % 5).alias("unit_weight"),
    )


@query
def steady_pressure(spark, sf):
    slope, ks = F.radians("slope_deg"), F.col("ksat_m_s")
    d1 = physics.effective_diffusivity(F.col("diffusivity_m2_s"), physics.cos_squared(slope))
    psi = physics.steady_pressure(physics.FAILURE_DEPTH_M, slope, ks, physics.WATER_TABLE_M)
    return rounded(
        _slope_nodes(spark, sf).select("node_id", psi.alias("psi"), d1.alias("d1")), 9, d1=13
    )


@query
def pressure_series(spark, sf):
    shares = stability.measured_shares(fx.storm(spark, sf))
    return rounded(stability.pressure_by_hour(_slope_nodes(spark, sf), shares).select("node_id", "hr", "psi"))


@query
def factor_of_safety(spark, sf):
    psi = (F.col("node_id") % 40) / 20e0 - 0.5e0
    fs = physics.factor_of_safety(
        F.lit(physics.FAILURE_DEPTH_M),
        psi,
        F.radians("slope_deg"),
        F.col("cohesion_kpa"),
        F.col("friction_deg"),
        F.col("unit_weight"),
    )
    return rounded(_slope_nodes(spark, sf).select("node_id", fs.alias("fs")), 4)


@query
def stability_series(spark, sf):
    shares = stability.measured_shares(fx.storm(spark, sf))
    return rounded(stability.stability_by_hour(_slope_nodes(spark, sf), shares).select("node_id", "hr", "psi", "fs"))


@query
def voellmy_mobility(spark, sf):
    slope, phi = F.radians("slope_deg"), F.col("friction_deg")
    speed = (F.col("node_id") % 25).cast("double")
    return rounded(
        _slope_nodes(spark, sf).select(
            "node_id",
            physics.debris_acceleration(slope, phi, speed).alias("acceleration"),
            physics.equilibrium_speed(slope, phi).alias("speed_eq"),
        )
    )


@query
def risk_color(spark, sf):
    fs01, depth01 = F.col("fs_q") / 255e0, F.col("depth_q") / 255e0
    hours = fx.node_hours(spark, sf).withColumns(
        {
            "fs_q": colour.byte_level(F.col("fs"), frames.FS_TOP),
            "depth_q": colour.byte_level(F.col("depth_m"), frames.DEPTH_TOP),
        }
    )
    out = hours.select(
        "node_id",
        "hr",
        *[x.alias(n) for n, x in colour.risk_channels(fs01, depth01).items()],
        colour.risk_class(F.col("fs"), depth01).alias("risk"),
    )
    return rounded(out)


@query
def fmt_label(spark, sf):
    cells = fx.cells(spark, sf)
    values = cells.select(
        "node_id",
        "flow_accum",
        (F.col("flow_accum") * 1e3).alias("large"),
        (F.col("roughness") - 5e0).alias("centred"),
        (F.col("twi") / 8e0).alias("small"),
    )
    labels = {"flow_label": "flow_accum", "large_label": "large", "centred_label": "centred", "twi_label": "small"}
    return numeric.with_compact_labels(values, labels).select("node_id", *labels)


@query
def exaggerated_height(spark, sf):
    return layers.exaggerated_height(fx.cells(spark, sf)).select("node_id", "height")


# --- graph and runout -------------------------------------------------------------------------


@query
def grid_edges4(spark, sf):
    cells = fx.cells(spark, sf)
    return graph.mesh_edges(cells, *grid.grid_shape(cells)).select("src", "dst")


@query
def edge_attrs(spark, sf):
    cells = fx.cells(spark, sf)
    rows, cols = grid.grid_shape(cells)
    dx = terrain.PIXEL_DEG * 5 * terrain.metres_per_lon_degree(rows * 5, 6)
    dy = F.lit(terrain.PIXEL_DEG * 5 * terrain.METRES_PER_DEGREE)
    edges = graph.edge_attributes(graph.mesh_edges(cells, rows, cols), dx, dy)
    return rounded(edges.select("src", "dst", "dx_m", "dy_m", "length_m"))


@query
def graph_sink(spark, sf):
    """The mesh written as a graph and read back: out-degree of every node."""
    cells, path = fx.cells(spark, sf), new_table_path(spark, "graph")
    tables.write_graph(cells.select("node_id", "r", "c", "elevation_m"), graph.mesh_edges(cells, *grid.grid_shape(cells)).select("src", "dst"), path)
    degrees = spark.read.parquet(f"{path}/edges").groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = spark.read.parquet(f"{path}/nodes")
    return nodes.join(degrees, "node_id", "left").select("node_id", "r", "c", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


@query
def d8_downslope(spark, sf):
    return rounded(graph.steepest_descent(fx.cells(spark, sf)).select("node_id", "target_id", "drop"))


@query
def d8_sinks(spark, sf):
    return graph.sinks(graph.steepest_descent(fx.cells(spark, sf)))


@query
def neighbors8_clamped(spark, sf):
    cells = fx.cells(spark, sf)
    return graph.clamped_neighbours(cells, *grid.grid_shape(cells))


@query
def runout_terminal(spark, sf):
    reach = drainage.cell_terminals(fx.cells(spark, sf))
    return reach.select("node_id", "terminal_id")


@query
def runout_length(spark, sf):
    reach = drainage.path_lengths(drainage.cell_terminals(fx.cells(spark, sf)))
    released = runout.releases(fx.node_hours(spark, sf))
    return rounded(released.join(reach, "node_id").select("node_id", "terminal_id", "hops", "path_m"))


@query
def runout_deposit(spark, sf):
    reach = drainage.cell_terminals(fx.cells(spark, sf))
    return rounded(drainage.deposits(runout.releases(fx.node_hours(spark, sf)), reach))


@query
def deposits_stored(spark, sf):
    """Deposits of a stored run: releases and paths in buckets by node, joined where they lie."""
    reach = tables.write_bucketed(drainage.cell_terminals(fx.cells(spark, sf)), "terminals", ["node_id"])
    released = tables.write_bucketed(runout.releases(fx.node_hours(spark, sf)), "releases", ["node_id"])
    return rounded(drainage.deposits(released, reach))


@query
def released_throughflow(spark, sf):
    """Depth released upstream of every cell, its own included."""
    released = runout.releases(fx.node_hours(spark, sf)).select("node_id", "depth_m")
    return rounded(drainage.throughflow(fx.cells(spark, sf).join(released, "node_id", "left"), "depth_m"))


@query
def deposit_balance(spark, sf):
    """Depth released against depth deposited: what flows through the sinks is what was released."""
    released = runout.releases(fx.node_hours(spark, sf)).select("node_id", "depth_m")
    cells = fx.cells(spark, sf)
    through = drainage.throughflow(cells.join(released, "node_id", "left"), "depth_m")
    sinks = graph.sinks(graph.steepest_descent(cells)).select("node_id")
    landed = through.join(sinks, "node_id").agg(F.sum("through").alias("deposited_m"))
    total = released.agg(F.sum("depth_m").alias("released_m")).scalar()
    return rounded(landed.select(total.alias("released_m"), "deposited_m", (F.col("deposited_m") - total).alias("difference_m")), 4)


@query
def failure_onset(spark, sf):
    return runout.failure_onset(fx.node_hours(spark, sf))


@query
def release_events(spark, sf):
    return runout.releases(fx.node_hours(spark, sf))


@query
def erosion_history(spark, sf):
    return rounded(runout.erosion_history(fx.node_hours(spark, sf)))


def _debris(spark, sf) -> DataFrame:
    """Debris on every fifth cell, moving at its equilibrium speed for a friction angle of 25 degrees."""
    k = F.col("node_id")
    speed = physics.equilibrium_speed(F.radians("slope_deg"), F.lit(25e0))
    loaded = fx.cells(spark, sf).select(
        "node_id",
        "r",
        "c",
        "elevation_m",
        F.when(k % 5 == 0, (k % 23) * 0.5e0).otherwise(0e0).alias("h"),
        physics.moved_share(speed, STEP_SECONDS).alias("share"),
    )
    return graph.steepest_descent(loaded, carry=("h", "share"))


@query
def route_step(spark, sf):
    return rounded(runout.route_step(_debris(spark, sf)))


@query
def overflow_spread(spark, sf):
    cells = fx.cells(spark, sf)
    k = F.col("node_id")
    loaded = cells.select("node_id", "r", "c", F.when(k % 5 == 0, (k % 23) * 0.5e0).otherwise(0e0).alias("h"))
    return rounded(runout.spread_overflow(loaded, CAP_M, *grid.grid_shape(cells)))


def _routed(spark, sf) -> tuple[DataFrame, DataFrame]:
    debris = cut_lineage(_debris(spark, sf))
    return debris, runout.route_steps(debris, ROUTE_STEPS, CAP_M, *grid.grid_shape(fx.cells(spark, sf)))


@query
def route_k_steps(spark, sf):
    return rounded(_routed(spark, sf)[1].select("node_id", "h"))


@query
def mass_balance(spark, sf):
    return rounded(runout.mass_balance(*_routed(spark, sf)), 4)


# --- aggregates -------------------------------------------------------------------------------


@query
def failed_fraction_hourly(spark, sf):
    return rounded(summary.failed_fraction(fx.node_hours(spark, sf)), 9)


@query
def run_summary(spark, sf):
    return rounded(summary.run_summary(fx.node_hours(spark, sf)))


@query
def hourly_rain(spark, sf):
    nodes = resample.bilinear(fx.rain_nodes(spark, sf), fx.rain(spark, sf), "mm", fx.RAIN_ROWS, fx.RAIN_COLUMNS)
    return rounded(summary.hourly_rain(nodes, "mm", physics.storm_shares()))


PROFILED = ["elevation_m", "slope_deg", "aspect_deg", "roughness", "twi", "flow_accum", "sca"]


@query
def feature_profile(spark, sf):
    cells = grid.mask_nodata(fx.cells(spark, sf), {"aspect_deg": terrain.NODATA_LIMIT})
    return rounded(summary.feature_profile(cells, PROFILED), 4)


@query
def texture_histogram(spark, sf):
    return summary.class_histogram(_texture(fx.soil(spark, sf)))


@query
def band_stats(spark, sf):
    return rounded(summary.band_stats(fx.bands(spark, sf)))


@query
def coverage_share(spark, sf):
    samples = simulation.valid_samples(fx.soil(spark, sf))
    covered = resample.inside_hull(fx.lattice_nodes(spark, sf), samples)
    return rounded(summary.coverage_share(covered, F.col("has_soil")), 9)


@query
def layer_percentiles(spark, sf):
    probabilities = [0.01, 0.02, 0.5, 0.99, 0.995]
    columns = ["roughness", "twi", "flow_accum", "elevation_m"]
    found = exact_percentiles(fx.cells(spark, sf), {c: probabilities for c in columns})
    rows = [(c, p, x) for c, xs in found.items() for p, x in zip(probabilities, xs)]
    return rounded(spark.createDataFrame(rows, "layer string, p double, value double"))


@query
def hourly_safety_percentiles(spark, sf):
    """Median and outer percentiles of the factor of safety, hour by hour."""
    return rounded(percentiles_by_group(fx.node_hours(spark, sf), "hr", "fs", [0.01, 0.25, 0.5, 0.99]), 9)


@query
def banded_median(spark, sf):
    k = F.col("node_id")
    cells = fx.cells(spark, sf).withColumns(
        {"red": k * 7 % 256, "green": F.floor(F.col("twi") * 15), "blue": k * k % 251}
    )
    return layers.banded_median(cells, ["red", "green", "blue"])


@query
def colour_stops(spark, sf):
    k = F.col("node_id")
    channels = {"shaded_red": k * 7 % 256, "shaded_green": k * 5 % 256, "shaded_blue": k * 3 % 256, "relief_red": k * 11 % 256}
    channels |= {"relief_green": F.floor(F.col("twi") * 15), "relief_blue": k * k % 251}
    drawn = {n: list(layers.LAYER_COLUMNS[n]) for n in ("hillshade-color", "color-relief")}
    return rounded(layers.colour_stops(fx.cells(spark, sf).withColumns(channels), drawn), 9)


@query
def d8_convention(spark, sf):
    return layers.direction_convention(fx.cells(spark, sf))


# --- frames and layers ------------------------------------------------------------------------


@query
def frame_at(spark, sf):
    return rounded(frames.frame_at(fx.node_hours(spark, sf), 17.25))


@query
def readout_at(spark, sf):
    failed = summary.failed_fraction(fx.node_hours(spark, sf))
    nodes = resample.bilinear(fx.rain_nodes(spark, sf), fx.rain(spark, sf), "mm", fx.RAIN_ROWS, fx.RAIN_COLUMNS)
    rain = summary.hourly_rain(nodes, "mm", physics.storm_shares())
    return rounded(frames.readouts(failed, rain, READOUT_TIMES))


@query
def layer_stretch(spark, sf):
    return rounded(layers.linear_layer(fx.cells(spark, sf), "roughness", low=0.0).select("node_id", "norm"))


@query
def layer_stretch_log(spark, sf):
    return rounded(layers.log_layer(fx.cells(spark, sf), "flow_accum").select("node_id", "norm"))


@query
def log_ticks(spark, sf):
    return rounded(layers.log_ticks(fx.cells(spark, sf), ["flow_accum", "sca"]), 4)


@query
def cyclic_direction(spark, sf):
    """A D-infinity angle in radians, negative where there is none."""
    k = F.col("node_id")
    angle = F.when(k % 31 == 0, -1e0).otherwise((k * 17 % 628) / 100e0)
    cells = fx.cells(spark, sf).withColumn("dinf_angle", angle)
    return rounded(layers.cyclic_layer(cells, "dinf_angle").select("node_id", "norm"), 9)


@query
def aspect_layer(spark, sf):
    return rounded(layers.aspect_layer(fx.cells(spark, sf)).select("node_id", "norm", "tick"), 9)


@query
def d8_legend(spark, sf):
    return layers.direction_legend(fx.cells(spark, sf))


@query
def quantize(spark, sf):
    return frames.quantised(fx.node_hours(spark, sf)).withColumns(
        {n: F.col(n).cast("int") for n in ("fs_q", "depth_q")}
    )


@query
def pack_frames(spark, sf):
    return frames.pack_frames(frames.quantised(fx.node_hours(spark, sf)), nodes_per_pack=8192)


@query
def pack_metadata(spark, sf):
    return frames.pack_metadata(fx.node_hours(spark, sf), *grid.grid_shape(fx.cells(spark, sf)))


@query
def pack_erosion(spark, sf):
    hours = fx.node_hours(spark, sf)
    fails = physics.failing(F.min("fs"))
    erosion = hours.groupBy("node_id").agg(F.when(fails, physics.FAILURE_DEPTH_M).otherwise(0e0).alias("erosion_m"))
    return frames.pack_erosion(erosion, nodes_per_pack=8192)


@query
def layer_catalog(spark, sf):
    k, z = F.col("node_id"), F.col("elevation_m")
    cells = fx.cells(spark, sf).withColumns(
        {
            "shaded_red": k * 7 % 256,
            "shaded_green": k * 5 % 256,
            "shaded_blue": k * 3 % 256,
            "relief_red": k * 11 % 256,
            "relief_green": F.floor(F.col("twi") * 15),
            "relief_blue": k * k % 251,
            "hillshade": k % 256,
            "dinf_angle": (k * 17 % 628) / 100e0,
            "hydro_dem": z + 1e0,
        }
    )
    return layers.layer_catalogue(cells, _ready_nodes(spark, sf))


@query
def soil_layers(spark, sf):
    nodes = simulation.with_soil(fx.lattice_nodes(spark, sf), fx.soil(spark, sf))
    # Written once, read twice: for the limits and for the layers.
    out = layers.soil_layers(cut_lineage(nodes.select("node_id", "has_soil", "friction_deg", "cohesion_kpa")))
    return rounded(out.select("node_id", "friction_deg_norm", "cohesion_kpa_norm"), 9)


# --- whole runs -------------------------------------------------------------------------------


@query
def storm_simulation(spark, sf):
    return rounded(simulation.simulate(_ready_nodes(spark, sf, simulation.STORM_COLUMNS), physics.storm_shares()), 5)


@query
def storm_failed_fraction(spark, sf):
    hours = simulation.simulate(_ready_nodes(spark, sf, simulation.STORM_COLUMNS), physics.storm_shares())
    return rounded(summary.failed_fraction(hours), 9)


@query
def storm_releases(spark, sf):
    return simulation.storm_releases(_ready_nodes(spark, sf, simulation.STORM_COLUMNS), physics.storm_shares())


@query
def storm_deposits(spark, sf):
    """The whole run: soil and rain at the nodes, storm, failures, and where their debris comes to rest."""
    released = simulation.storm_releases(_ready_nodes(spark, sf, simulation.STORM_COLUMNS), physics.storm_shares())
    reach = drainage.cell_terminals(fx.cells(spark, sf))
    return rounded(drainage.deposits(released, reach))


def _georeferenced_nodes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The nodes of a georeferenced run, and the same ready for the storm.

    Soil and rain are written as the run's inputs first, in the order of their grids, so that its scans skip what lies
    outside of the box of the nodes.
    """
    nodes = simulation.georeferenced(fx.cells(spark, sf, spread=True), BORDER, numeric.half_even_step(fx.COLUMNS, STRIDE_TARGET))
    soil_path, rain_path = new_table_path(spark, "soil"), new_table_path(spark, "rain")
    tables.write_grid(fx.mapped_soil(spark, sf), soil_path, "lr", "lc")
    tables.write_grid(fx.global_rain(spark, sf), rain_path, "rr", "cc")
    soil, rain = spark.read.parquet(soil_path), spark.read.parquet(rain_path)
    return nodes, simulation.storm_nodes(nodes, soil, rain, fx.GLOBAL_RAIN_ROWS, fx.GLOBAL_RAIN_COLUMNS, simulation.STORM_COLUMNS)


@query
def storm_georeferenced(spark, sf):
    """Raster to storm: crop, stride, degrees, lattice and rain positions, soil and rain at the nodes, pressure and safety by hour."""
    _, ready = _georeferenced_nodes(spark, sf)
    return rounded(simulation.simulate(ready, physics.storm_shares()), 5)


@query
def deposits_georeferenced(spark, sf):
    """The same run to its end: where the debris of the nodes that fail comes to rest on the strided grid."""
    nodes, ready = _georeferenced_nodes(spark, sf)
    released = simulation.storm_releases(ready, physics.storm_shares())
    return rounded(drainage.deposits(released, drainage.cell_terminals(nodes)))


# --- streaming --------------------------------------------------------------------------------


def _reading_stream(spark, sf) -> DataFrame:
    schema = tables.read_table(spark, sf, "events").schema
    return monitors.readings(monitors.read_stream(spark, f"{sf}/events.parquet", schema))


@query
def stream_failed_fraction(spark, sf):
    answers = monitors.run_to_table(monitors.hour_answers(_reading_stream(spark, sf)), "hour-answers")
    return rounded(monitors.shares_told(answers), 9)


@query
def stream_release_once(spark, sf):
    return monitors.run_to_table(monitors.released_once(_reading_stream(spark, sf)), "released")


@query
def stream_release_resumed(spark, sf):
    """Two runs: one over the readings up to the middle of the record, then one over all of them that knows what the first told."""
    stream = _reading_stream(spark, sf)
    ends = tables.read_table(spark, sf, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    if ends["first"] is None:
        return monitors.run_to_table(monitors.released_since(stream), "released")
    middle = ends["first"] + (ends["last"] - ends["first"]) / 2
    early = monitors.run_to_table(monitors.released_since(stream.where(F.col("ts") <= F.lit(middle).cast("timestamp"))), "released-early")
    late = monitors.run_to_table(monitors.released_since(stream, earlier=early), "released-late")
    return early.unionByName(late)
