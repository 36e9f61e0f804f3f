"""Run summaries, profiles and histograms. All are algebraic aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.physics import failing
from talusgrid.functions.terrain import SOIL_NODATA
from talusgrid.operators.quantiles import exact_percentiles


def failed_fraction(node_hours: DataFrame) -> DataFrame:
    """Share of all nodes with FS below 1, per hour."""
    return node_hours.groupBy("hr").agg(F.avg(failing(F.col("fs")).cast("double")).alias("failed_frac"))


def run_summary(node_hours: DataFrame) -> DataFrame:
    """One row: nodes, nodes that ever failed, their share in percent, FS range and largest depth."""
    per_node = node_hours.groupBy("node_id").agg(
        F.min("fs").alias("lo"), F.max("fs").alias("hi"), F.max("depth_m").alias("depth")
    )
    return per_node.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(failing(F.col("lo"))).alias("n_failed"),
        (100e0 * F.avg(failing(F.col("lo")).cast("double"))).alias("failed_pct"),
        F.min("lo").alias("fs_min"),
        F.max("hi").alias("fs_max"),
        F.max("depth").alias("max_depth_m"),
    )


def hourly_rain(nodes: DataFrame, daily_mm: str, shares: Column) -> DataFrame:
    """Rain readout: the median daily total spread over the storm."""
    median = exact_percentiles(nodes, {daily_mm: [0.5]})[daily_mm][0]
    one = nodes.sparkSession.range(1)
    return one.select(F.posexplode(shares).alias("hr", "share")).select(
        "hr", (F.col("share") * F.lit(median)).alias("rain_mm")
    )


def feature_profile(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean and number of missing values per column.

    One wide aggregate, unpivoted afterwards: the table is not multiplied by the column count.
    """
    measures = {"min_value": F.min, "max_value": F.max, "mean_value": F.avg}
    wide = nodes.agg(
        *[
            F.struct(
                *[fn(F.col(c).cast("double")).alias(m) for m, fn in measures.items()],
                F.count_if(F.col(c).isNull()).alias("n_missing"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(c)[m].alias(m) for m in (*measures, "n_missing")])
            for c in columns
        ]
    )
    return wide.select(F.inline(rows))


def class_histogram(samples: DataFrame, column: str = "texture") -> DataFrame:
    return samples.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def band_stats(bands: DataFrame) -> DataFrame:
    """Range and mean per band without no-data, and the number of no-data pixels."""
    value = F.when(F.col("value") != SOIL_NODATA, F.col("value"))
    return bands.groupBy("band").agg(
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.count_if(F.col("value") == SOIL_NODATA).alias("n_nodata"),
    )


def coverage_share(samples: DataFrame, covered: Column) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(covered).alias("n_covered"),
        F.avg(covered.cast("double")).alias("share"),
    )
