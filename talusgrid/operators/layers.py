"""Map layers: stretches, legends and the layer catalogue.

Stretch limits are a handful of exact numbers found first; the layer itself is then a plain
projection with constants, so no join or window touches the cell table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talusgrid.functions.numeric import clip, with_compact_labels
from talusgrid.functions.terrain import null_below, null_negative
from talusgrid.operators.quantiles import exact_percentiles

# Direction codes (power-of-two convention), their compass names, and the colours
# of the nine direction classes.
ESRI_CODES = (0, 1, 2, 4, 8, 16, 32, 64, 128)
ESRI_NAMES = ("flat / nodata", "E", "SE", "S", "SW", "W", "NW", "N", "NE")
CLASS_COLOURS = (
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf",
)
COMPASS_TICKS = ("N", "E", "S", "W", "N")
DEGREE_TICKS = ("0°", "90°", "180°", "270°", "360°")
TICK_POSITIONS = (0.0, 0.25, 0.5, 0.75, 1.0)
RADIAN_LIMIT = 6.5
DEFAULT_COLOUR = (40.0, 40.0, 44.0)

# Layer order and titles.
LAYER_TITLES = {
    "hillshade-color": "Shaded relief + color",
    "color-relief": "Elevation color",
    "hillshade": "Hillshade (grayscale)",
    "slope": "Slope",
    "aspect": "Aspect",
    "roughness": "Roughness",
    "flow-accumulation": "Flow accumulation",
    "specific-catchment-area": "Specific catchment area",
    "twi": "Topographic wetness (TWI)",
    "flow-direction-dinf": "Flow direction (D∞)",
    "flow-direction-d8": "Flow direction (D8)",
    "hydro-conditioned-dem": "Hydro-conditioned DEM",
    "precipitation": "Precipitation",
    "soil-friction-angle": "Soil friction angle (est.)",
    "soil-cohesion": "Soil cohesion (est.)",
}


def stretched(value: Column, low, high) -> Column:
    """0-1 position of value between low and high; NULL stays NULL."""
    span = high - low
    span = F.greatest(F.lit(1e-6), span) if isinstance(span, Column) else max(1e-6, span)
    return (clip(value, low, high) - low) / span


def linear_limits(cells: DataFrame, column: str, low=None, high=None) -> tuple[float, float]:
    """Given limits, or the 1st and 99th percentile of the valid values."""
    if low is None or high is None:
        q = exact_percentiles(cells.select(null_below(F.col(column)).alias(column)), {column: [0.01, 0.99]})[column]
        low = q[0] if low is None else low
        high = q[1] if high is None else high
    return low, high


def linear_layer(cells: DataFrame, column: str, low=None, high=None) -> DataFrame:
    low, high = linear_limits(cells, column, low, high)
    return cells.withColumn("norm", stretched(null_below(F.col(column)), low, high))


def log_limits(cells: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """2nd and 99.5th percentile of log1p of the valid values, all columns in one pass; (0, 1) if none."""
    logs = cells.select(*[F.log1p(null_negative(F.col(c))).alias(c) for c in columns])
    found = exact_percentiles(logs, {c: [0.02, 0.995] for c in columns})
    return {c: (q[0], q[1]) if q[0] == q[0] else (0.0, 1.0) for c, q in found.items()}


def log_layer(cells: DataFrame, column: str) -> DataFrame:
    low, high = log_limits(cells, [column])[column]
    return cells.withColumn("norm", stretched(F.log1p(null_negative(F.col(column))), low, high))


def log_ticks(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Five legend ticks per log layer, at equal steps of the drawn scale, in original units."""
    limits = log_limits(cells, columns)
    ticks = F.array(
        *[
            F.struct(F.lit(c).alias("layer"), F.lit(p).alias("pos"), F.expm1(F.lit(lo + p * (hi - lo))).alias("value"))
            for c, (lo, hi) in limits.items()
            for p in TICK_POSITIONS
        ]
    )
    out = cells.sparkSession.range(1).select(F.inline(ticks))
    return with_compact_labels(out, {"label": "value"})


def cyclic_layer(cells: DataFrame, column: str) -> DataFrame:
    """Direction as a share of the full turn; radians are recognised by their small maximum."""
    valid = null_negative(F.col(column))
    top = cells.agg(F.max(valid).alias("m")).scalar()
    degrees = F.when(top <= RADIAN_LIMIT, F.degrees(valid)).otherwise(valid)
    return cells.withColumn("norm", clip(degrees, 0e0, 360e0) / 360e0)


def aspect_layer(cells: DataFrame, column: str = "aspect_deg") -> DataFrame:
    """Aspect on a fixed 0-360 scale, with the compass letter of the quarter it lies nearest to."""
    norm = stretched(null_below(F.col(column)), 0e0, 360e0)
    tick = F.get(F.array(*[F.lit(t) for t in COMPASS_TICKS]), F.floor(norm * 4 + 0.5).cast("int"))
    return cells.withColumns({"norm": norm, "tick": tick})


def direction_code(column: str) -> Column:
    """Whole-number direction code; negative or missing is 0."""
    return F.coalesce(F.rint(null_negative(F.col(column))).cast("int"), F.lit(0))


def direction_convention(cells: DataFrame, column: str = "d8_code") -> DataFrame:
    """'esri' if every code but 0 is a power of two up to 128, else 'sequential'.

    A running minimum over rows, so no set of codes has to be collected.
    """
    known = direction_code(column).isin(list(ESRI_CODES))
    return cells.agg(F.coalesce(F.bool_and(known), F.lit(True)).alias("esri")).select(
        F.when(F.col("esri"), "esri").otherwise("sequential").alias("convention")
    )


def _direction_items(esri: Column) -> Column:
    """The eight legend entries, named by compass or by number."""
    return F.array(
        *[
            F.struct(
                F.when(esri, F.lit(ESRI_CODES[k])).otherwise(F.lit(k)).alias("code"),
                F.lit(k).alias("class_index"),
                F.when(esri, F.lit(ESRI_NAMES[k])).otherwise(F.lit(f"code {k}")).alias("label"),
                F.lit(CLASS_COLOURS[k]).alias("colour"),
            )
            for k in range(1, 9)
        ]
    )


def direction_legend(cells: DataFrame, column: str = "d8_code") -> DataFrame:
    """Legend entries of the direction layer with the number of cells per entry, code 0 left out."""
    convention = direction_convention(cells, column).scalar()
    legend = cells.sparkSession.range(1).select(F.inline(_direction_items(convention == "esri")))
    counts = cells.groupBy(direction_code(column).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    # The legend has eight rows, so it is the side to broadcast; the counts are aggregated first.
    return (
        counts.join(F.broadcast(legend), "code", "right")
        .select("code", "class_index", "label", "colour", F.coalesce("n", F.lit(0)).alias("n_cells"))
    )


def banded_median(cells: DataFrame, channels: list[str], bands: int = 14, column: str = "elevation_m") -> DataFrame:
    """Median colour per elevation band; an empty band repeats the one below it.

    Colour channels are whole numbers 0-255, so a median keeps at most 256 distinct values per band.
    """
    low = cells.agg(F.min(column).alias("m")).scalar()
    high = cells.agg(F.max(column).alias("m")).scalar()
    share = F.try_divide(F.col(column) - low, high - low)
    band = F.coalesce(clip(F.floor(share * bands), 0, bands - 1), F.lit(bands - 1)).cast("int")
    medians = cells.where(F.col(column).isNotNull()).groupBy(band.alias("band")).agg(
        *[F.median(c).alias(c) for c in channels], F.count(F.lit(1)).alias("n_cells")
    )
    every = cells.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))
    below = W.orderBy("band").rowsBetween(W.unboundedPreceding, 0)  # `bands` rows in all
    joined = every.join(medians, "band", "left")
    return joined.select(
        "band",
        *[
            F.coalesce(F.last(c, ignorenulls=True).over(below), F.lit(DEFAULT_COLOUR[k % 3])).alias(c)
            for k, c in enumerate(channels)
        ],
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
    )


def colour_stops(cells: DataFrame, layers: dict[str, list[str]], bands: int = 14) -> DataFrame:
    """Legend gradient of layers drawn from colour channels: (layer, band, position, colour), position from 0 to 1.

    layers: {layer: [red, green, blue]}. All channels are reduced in one pass.
    """
    medians = banded_median(cells, [c for rgb in layers.values() for c in rgb], bands)
    hexed = lambda c: F.lpad(F.lower(F.hex(F.floor(c).cast("long"))), 2, "0")
    stops = F.array(
        *[F.struct(F.lit(n).alias("layer"), F.concat(F.lit("#"), *[hexed(F.col(c)) for c in rgb]).alias("colour")) for n, rgb in layers.items()]
    )
    position = F.col("band") / F.lit(float(max(bands - 1, 1)))
    return medians.select("band", position.alias("position"), F.inline(stops)).select("layer", "band", "position", "colour")


def exaggerated_height(cells: DataFrame, factor: float = 1.6, column: str = "elevation_m") -> DataFrame:
    low = cells.agg(F.min(column).alias("m")).scalar()
    return cells.withColumn("height", (F.col(column) - low) * factor)


def soil_layers(nodes: DataFrame) -> DataFrame:
    """Friction and cohesion layers, empty outside the soil map and stretched over covered nodes only."""
    names = ("friction_deg", "cohesion_kpa")
    seen = {n: F.when(F.col("has_soil"), F.col(n)) for n in names}
    limits = nodes.agg(
        F.struct(*[f(x).alias(f"{n}_{k}") for n, x in seen.items() for k, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    return nodes.withColumn("_limits", limits).select(
        *nodes.columns,
        *[stretched(seen[n], F.col(f"_limits.{n}_lo"), F.col(f"_limits.{n}_hi")).alias(f"{n}_norm") for n in names],
    )


# Columns that a layer is drawn from; a layer whose columns are absent is left out.
LAYER_COLUMNS = {
    "hillshade-color": ("shaded_red", "shaded_green", "shaded_blue"),
    "color-relief": ("relief_red", "relief_green", "relief_blue"),
    "hillshade": ("hillshade",),
    "slope": ("slope_deg",),
    "aspect": ("aspect_deg",),
    "roughness": ("roughness",),
    "flow-accumulation": ("flow_accum",),
    "specific-catchment-area": ("sca",),
    "twi": ("twi",),
    "flow-direction-dinf": ("dinf_angle",),
    "flow-direction-d8": ("d8_code",),
    "hydro-conditioned-dem": ("hydro_dem",),
    "precipitation": ("precip_mm",),
    "soil-friction-angle": ("friction_deg", "has_soil"),
    "soil-cohesion": ("cohesion_kpa", "has_soil"),
}


def layer_catalogue(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per available layer with its legend, in display order.

    cells holds the terrain bands, nodes the resampled rain and soil values. Legend limits come
    from one percentile pass and one range pass per table.
    """
    have = set(cells.columns) | set(nodes.columns)
    shown = [n for n in LAYER_TITLES if have.issuperset(LAYER_COLUMNS[n])]
    percentiles = {
        "roughness": ("roughness", null_below(F.col("roughness")), [0.99]),
        "twi": ("twi", null_below(F.col("twi")), [0.01, 0.99]),
        "flow-accumulation": ("flow_accum", F.log1p(null_negative(F.col("flow_accum"))), [0.02, 0.995]),
        "specific-catchment-area": ("sca", F.log1p(null_negative(F.col("sca"))), [0.02, 0.995]),
    }
    wanted = {c: (x, p) for n, (c, x, p) in percentiles.items() if n in shown}
    valid = cells.select(*[x.alias(c) for c, (x, _) in wanted.items()])
    q = exact_percentiles(valid, {c: p for c, (_, p) in wanted.items()}) if wanted else {}
    seen = {"precip_mm": F.col("precip_mm")}
    seen |= {n: F.when(F.col("has_soil"), F.col(n)) for n in ("friction_deg", "cohesion_kpa")}
    ranges = {c: x for c, x in seen.items() if c in have}
    span = nodes.agg(
        F.lit(0).alias("_"), *[f(x).alias(f"{c}_{k}") for c, x in ranges.items() for k, f in (("lo", F.min), ("hi", F.max))]
    )
    heights = cells.agg(F.struct(F.min("elevation_m").alias("lo"), F.max("elevation_m").alias("hi"))).scalar()
    esri = direction_convention(cells).scalar() == "esri" if "d8_code" in have else F.lit(False)
    span = span.withColumns({"_heights": heights, "_esri": esri})

    number = lambda x: F.lit(x).cast("double") if not isinstance(x, Column) else x
    text = lambda x: F.lit(x).cast("string")
    no_ticks = F.lit(None).cast("array<struct<pos:double,label:string>>")
    no_items = F.lit(None).cast("array<struct<color:string,label:string>>")
    items = F.transform(_direction_items(F.col("_esri")), lambda x: F.struct(x["colour"].alias("color"), x["label"].alias("label")))

    def ticks(labels) -> Column:
        marks = [F.struct(F.lit(p).alias("pos"), F.lit(t).alias("label")) for p, t in zip(TICK_POSITIONS, labels)]
        return F.array(*marks)

    def row(name: str, kind: str = "gradient", limits=(None, None), middle=None, unit="", words=(None, None), **more) -> Column:
        return F.struct(
            F.lit(name).alias("layer"),
            F.lit(LAYER_TITLES[name]).alias("title"),
            F.lit(kind).alias("kind"),
            number(limits[0]).alias("low"),
            number(limits[1]).alias("high"),
            number(middle).alias("middle"),
            F.lit(unit).alias("unit"),
            text(words[0]).alias("low_words"),
            text(words[1]).alias("high_words"),
            more.get("ticks", no_ticks).alias("ticks"),
            more.get("items", no_items).alias("items"),
            F.lit(more.get("approx")).cast("boolean").alias("approx"),
        )

    def log_row(name: str) -> Column:
        lo, hi = q[percentiles[name][0]]
        return row(name, limits=(math.expm1(lo), math.expm1(hi)), middle=math.expm1(lo + 0.5 * (hi - lo)))

    def range_of(column: str) -> tuple[Column, Column]:
        return F.col(f"{column}_lo"), F.col(f"{column}_hi")

    elevation = (F.col("_heights.lo"), F.col("_heights.hi"))
    rows = {
        "hillshade-color": lambda n: row(n, limits=elevation, unit=" m", approx=True),
        "color-relief": lambda n: row(n, limits=elevation, unit=" m", approx=True),
        "hillshade": lambda n: row(n, words=("shadowed", "sunlit")),
        "slope": lambda n: row(n, limits=(0.0, 60.0), unit="°"),
        "aspect": lambda n: row(n, "cyclic", ticks=ticks(COMPASS_TICKS)),
        "roughness": lambda n: row(n, limits=(0.0, q["roughness"][0])),
        "flow-accumulation": log_row,
        "specific-catchment-area": log_row,
        "twi": lambda n: row(n, limits=q["twi"]),
        "flow-direction-dinf": lambda n: row(n, "cyclic", ticks=ticks(DEGREE_TICKS)),
        "flow-direction-d8": lambda n: row(n, "categorical", items=items),
        "hydro-conditioned-dem": lambda n: row(n, limits=elevation, unit=" m"),
        "precipitation": lambda n: row(n, limits=range_of("precip_mm"), unit=" mm"),
        "soil-friction-angle": lambda n: row(n, limits=range_of("friction_deg"), unit="°"),
        "soil-cohesion": lambda n: row(n, limits=range_of("cohesion_kpa"), unit=" kPa"),
    }
    entries = span.select(F.posexplode(F.array(*[rows[n](n) for n in shown])).alias("display_order", "x"))
    entries = entries.select("display_order", "x.*")
    labelled = with_compact_labels(entries, {"low_text": "low", "high_text": "high", "middle_text": "middle"})
    labelled = labelled.withColumns(
        {
            "low_label": F.coalesce(F.concat("low_text", "unit"), "low_words"),
            "high_label": F.coalesce(F.concat("high_text", "unit"), "high_words"),
            "middle_label": F.concat("middle_text", "unit"),
        }
    )
    legend = F.struct(
        "kind",
        F.col("low_label").alias("minLabel"),
        F.col("high_label").alias("maxLabel"),
        F.col("middle_label").alias("midLabel"),
        "ticks",
        "items",
        F.when(F.col("middle").isNotNull(), F.lit(True)).alias("logScale"),
        "approx",
    )
    return labelled.select(
        "display_order",
        "layer",
        "title",
        "kind",
        F.col("low_label").alias("min_label"),
        F.col("high_label").alias("max_label"),
        F.to_json(legend).alias("legend_json"),
    )
