"""Input views over the given tables: terrain cells, soil samples, rain grid, storm, node-hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.sources.tables import read_table

COLUMNS = 100
LATTICE_COLUMNS = 50
RAIN_ROWS = RAIN_COLUMNS = 5
HOURS = 24
GLOBAL_RAIN_ROWS, GLOBAL_RAIN_COLUMNS = 2400, 7200


def cells(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    o = read_table(spark, folder, "orders", "o_orderkey" if spread else None)
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    code = F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(pow(2, o_orderkey % 9 - 1) AS INT) END")
    row = F.floor(k / COLUMNS)
    return o.select(
        k.alias("node_id"),
        row.cast("int").alias("r"),
        (k % COLUMNS).cast("int").alias("c"),
        (F.lit(9000e0) - 5e0 * row + F.col("o_totalprice") / 10000e0).alias("elevation_m"),
        ((cust % 600) / 10e0).alias("slope_deg"),
        F.when(k % 97 == 0, F.lit(-9999e0)).otherwise(((k * 37) % 360).cast("double")).alias("aspect_deg"),
        ((cust % 91) / 7e0).alias("roughness"),
        (F.lit(3e0) + (k % 53) / 4e0).alias("twi"),
        ((k % 101) * (k % 101) * (k % 7)).cast("double").alias("flow_accum"),
        ((k % 89) * (k % 11)).cast("double").alias("sca"),
        code.alias("d8_code"),
    )


def soil(spark: SparkSession, folder: str) -> DataFrame:
    p, k = read_table(spark, folder, "part"), F.col("p_partkey")
    outside = k % 13 == 0
    row, col = F.floor(k / LATTICE_COLUMNS), k % LATTICE_COLUMNS
    return p.select(
        k.alias("sample_id"),
        row.cast("int").alias("lr"),
        col.cast("int").alias("lc"),
        (F.lit(7189735.290828891) + 250e0 * col).alias("x_m"),
        (F.lit(3743288.1316389814) - 250e0 * row).alias("y_m"),
        F.when(outside, 0e0).otherwise((F.lit(100) + F.col("p_size") * 15).cast("double")).alias("sand_gkg"),
        ((k * 7) % 46 * 10).cast("double").alias("clay_gkg"),
        F.when(outside, 0e0).otherwise(F.col("p_retailprice") - 800e0).alias("bdod_cgcm3"),
    )


def rain(spark: SparkSession, folder: str) -> DataFrame:
    """5 x 5 rain grid. Customers are averaged per nation before the join: one row per nation meets the grid."""
    per_nation = read_table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.avg("c_acctbal").alias("balance")
    )
    k = F.col("n_nationkey")
    return read_table(spark, folder, "nation").join(per_nation, "n_nationkey").select(
        k.alias("cell_id"),
        F.floor(k / RAIN_COLUMNS).cast("int").alias("rr"),
        (k % RAIN_COLUMNS).cast("int").alias("cc"),
        F.round(F.col("balance") / 50e0, 3).alias("mm"),
    )


def mapped_soil(spark: SparkSession, folder: str) -> DataFrame:
    """The soil samples 40 lattice columns further west, where the georeferenced terrain lies."""
    return soil(spark, folder).withColumns({"lc": F.col("lc") - 40, "x_m": F.col("x_m") - 40 * 250e0})


def global_rain(spark: SparkSession, folder: str) -> DataFrame:
    """Rain cells of the world grid around the terrain, one per customer, 16 in a row."""
    k = F.col("c_custkey")
    return read_table(spark, folder, "customer").select(
        (575 + F.floor(k / 16)).cast("int").alias("rr"), (5170 + k % 16).cast("int").alias("cc"), F.round(F.col("c_acctbal") / 50e0, 3).alias("precip_mm")
    )


def storm(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    return e.groupBy(F.hour("ts").alias("hr")).agg(F.round(F.sum("value"), 2).alias("amount"))


def node_hours(spark: SparkSession, folder: str) -> DataFrame:
    o, k, h = read_table(spark, folder, "orders", "o_orderkey"), F.col("o_orderkey"), F.col("hr")
    hours = o.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hr"))
    return hours.select(
        k.alias("node_id"),
        "hr",
        F.greatest(F.lit(0e0), F.least(F.lit(5e0), F.lit(3e0) - h * (F.col("o_custkey") % 20) / 100e0)).alias("fs"),
        ((k % 11) * h / 25e0).alias("depth_m"),
    )


def bands(spark: SparkSession, folder: str) -> DataFrame:
    o, k, b = read_table(spark, folder, "orders"), F.col("o_orderkey"), F.col("band")
    each = o.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("band"))
    each = each.where((b < 2) | (k % COLUMNS < 80))
    return each.select(
        "band",
        F.floor(k / COLUMNS).cast("int").alias("r"),
        (k % COLUMNS).cast("int").alias("c"),
        F.when((k + b) % 29 == 0, -32768).otherwise((F.col("o_custkey") % 500 + 10 * b).cast("int")).alias("value"),
    )


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("tile_id"), F.col("embedding").alias("tile_values"))


def lattice_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Terrain nodes placed on the soil lattice (u, v); the map is a little larger than the lattice."""
    return cells(spark, folder, spread=True).select(
        "node_id", (F.col("c") * 0.6e0 - 5e0).alias("u"), (F.col("r") * 0.3e0 - 3e0).alias("v")
    )


def rain_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Terrain nodes placed on the rain grid (u, v); both ends lie outside of it."""
    return cells(spark, folder, spread=True).select(
        "node_id",
        (F.col("c") / 20e0 - 0.5e0).alias("u"),
        ((F.col("r") % 100) / 20e0 - 0.5e0).alias("v"),
    )
