"""Table scans, input manifests and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.sources.workspace import new_table_path

SPREAD_SPLITS = 4


def read_table(spark: SparkSession, folder: str, name: str, spread_by: str | None = None) -> DataFrame:
    """Scan of one table. With `spread_by`, a scan of a few splits only is spread over the cores.

    Work that is heavy per row would otherwise run on as many cores as a small file has row groups. Only tables of at
    most SPREAD_SPLITS splits (of spark.sql.files.maxPartitionBytes each) are dealt out, so what moves is bounded on
    any cluster; larger tables are left as they are.
    """
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    splits, cores = scan.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    if spread_by is not None and splits < min(cores, SPREAD_SPLITS + 1):
        return scan.repartition(cores, spread_by)
    return scan


def scan_bands(cells: DataFrame, bands: list[str]) -> DataFrame:
    """Named bands of a wide cell table; only their columns reach the scan."""
    return cells.select("node_id", "r", "c", *bands)


def missing_inputs(required: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Required names that are not present."""
    return required.select(name).distinct().join(present.select(name).distinct(), name, "left_anti")


def name_stem(path: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def normal_name(stem: Column) -> Column:
    """Lower case, letters and digits only, so that separators and case do not matter."""
    return F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]", "")


def resolve_names(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """wanted(name) x catalogue(path) -> (name, path, n_matches); path is NULL if nothing matches.

    An exact path wins, then the first path with the same normalised stem. The catalogue is
    reduced to one row per normalised name before the join, so copies of a name cannot multiply.
    """
    names = wanted.select("name").distinct().withColumn("key", normal_name(name_stem(F.col("name"))))
    by_key = catalogue.groupBy(normal_name(name_stem(F.col("path"))).alias("key")).agg(
        F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n_matches")
    )
    exact = catalogue.select(F.col("path").alias("exact_path")).distinct()
    found = names.join(by_key, "key", "left").join(exact, F.col("name") == F.col("exact_path"), "left")
    return found.select(
        "name",
        F.coalesce("exact_path", "first_path").alias("path"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def as_stored(df: DataFrame) -> DataFrame:
    """Sinks keep 32-bit values; computation stays in double."""
    return df.select(
        *[F.col(f.name).cast("float") if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet sink. Before a partitioned write rows are rebalanced by the partition columns.

    The rebalance hint gathers a partition value into few files and splits values that are too
    large for one task, so neither many small files nor one huge task results.
    """
    out = as_stored(df)
    if partition_by:
        out.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        out.write.mode(mode).parquet(path)


def write_grid(df: DataFrame, path: str, row: str, col: str) -> None:
    """Parquet sink of a gridded table, dealt out and sorted by row and column, so that a box filter skips files and row groups."""
    df.repartitionByRange(row, col).sortWithinPartitions(row, col).write.parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    write_table(nodes, f"{folder}/nodes")
    write_table(edges, f"{folder}/edges")


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 32) -> DataFrame:
    """Table in the work folder, dealt into buckets by `keys` and sorted by them inside, a file per bucket; returned as read back.

    Tables with equal keys and bucket counts join and group by them without a shuffle.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    out = df.repartition(buckets, *keys).write.format("parquet").option("path", new_table_path(spark, name))
    out.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def write_run(node_hours: DataFrame, releases: DataFrame, folder: str) -> None:
    """Series partitioned by hour, so a frame reads one or two partitions; releases beside it."""
    write_table(node_hours, f"{folder}/node_hour", ["hr"])
    write_table(releases, f"{folder}/releases")
