import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from talusgrid.sources import tables
from talusgrid.sources.workspace import new_table_path
from talusgrid.streaming import monitors


def test_resolve_prefers_the_exact_path(spark):
    wanted = spark.createDataFrame([("Slope.tif",), ("b_map.TIF",), ("none.tif",)], "name string")
    paths = ["a/slope.tif", "Slope.tif", "z/B-Map.tif", "x/bmap.tiff"]
    got = tables.resolve_names(wanted, spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {r["name"]: (r["path"], r["n_matches"]) for r in got} == {
        "Slope.tif": ("Slope.tif", 2),
        "b_map.TIF": ("x/bmap.tiff", 2),
        "none.tif": (None, 0),
    }


def test_run_sink_is_partitioned_by_hour(spark):
    hours = spark.range(50).select(F.col("id").alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("hr"))
    hours = hours.withColumn("fs", F.col("node_id") / 7.0)
    folder = new_table_path(spark, "run")
    tables.write_run(hours, hours.where("hr = 1").select("node_id"), folder)
    back = spark.read.parquet(f"{folder}/node_hour").where("hr = 2")
    assert back.count() == 50 and dict(back.dtypes)["fs"] == "float"
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hr" in plan


def write_batch(spark, folder, rows):
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), u, v) for i, (m, u, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, value double")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def stream(spark, folder, schema):
    return monitors.readings(monitors.read_stream(spark, folder, schema))


def test_release_is_reported_once_across_runs(spark):
    folder, out = new_table_path(spark, "in"), new_table_path(spark, "out")
    seen = []
    for rows in ([(1, 7, 10.0), (2, 7, 20.0), (3, 8, 99.0)], [(4, 7, 1.0), (5, 8, 2.0)]):
        schema = write_batch(spark, folder, rows)
        query = (
            monitors.released_once(stream(spark, folder, schema))
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{out}-progress")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        seen.append(sorted(r["node_id"] for r in spark.read.parquet(out).collect()))
    assert seen == [[7], [7, 8]]


def test_hours_are_final_after_the_watermark(spark):
    folder = new_table_path(spark, "in")
    schema = write_batch(spark, folder, [(5, 1, 10.0), (50, 2, 90.0), (70, 1, 10.0), (300, 1, 90.0)])
    out = monitors.run_to_table(monitors.failed_fraction_by_hour(stream(spark, folder, schema)), "hours")
    got = {r["hour_start"]: (r["failed_frac"], r["n_readings"]) for r in out.collect()}
    assert got == {"2024-01-01 00:00:00": (0.5, 2), "2024-01-01 01:00:00": (1.0, 1)}


def _same_on_file_and_folder(spark, tmp_path, query):
    from talusgrid.plans.registry import all_queries

    given = "/root/testdata/sf0.001"
    spark.read.parquet(f"{given}/events.parquet").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    one, many = (sorted(map(tuple, all_queries()[query](spark, folder).collect())) for folder in (given, str(tmp_path)))
    return one == many and len(one) > 0


def test_streams_read_folders_of_files(spark, tmp_path):
    assert _same_on_file_and_folder(spark, tmp_path, "stream_failed_fraction")


def test_release_stream_reads_folders_of_files(spark, tmp_path):
    assert _same_on_file_and_folder(spark, tmp_path, "stream_release_once")


def test_a_missing_stream_fails(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        monitors.read_stream(spark, f"{tmp_path}/events.parquet", spark.range(1).schema)


def test_late_readings_count(spark, tmp_path):
    """Parts of an hour that come in files of their own, in any order, add up; an unknown value counts as a reading, not as a failure."""
    rows = [("2024-01-01 05:10:00", 0.5), ("2024-01-01 00:10:00", 0.5), ("2024-01-01 05:50:00", 1.5), ("2024-01-01 00:20:00", None)]
    for i, row in enumerate(rows):
        spark.createDataFrame([(i, *row)], "node_id long, t string, fs double").selectExpr("node_id", "cast(t as timestamp) as ts", "fs").coalesce(1).write.mode(
            "append"
        ).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("node_id long, ts timestamp, fs double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = monitors.shares_so_far(monitors.run_to_table(monitors.hour_parts(stream), "parts")).orderBy("hour_start").collect()
    assert [tuple(r) for r in got] == [("2024-01-01 00:00:00", 0.5, 2), ("2024-01-01 05:00:00", 0.5, 2)]


@pytest.fixture
def few_tasks(spark):
    """Stateful streams start a Python worker per partition and batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def timed_stream(spark, tmp_path, batches):
    """A file per batch of (node_id, time, fs), read one a trigger."""
    for rows in batches:
        spark.createDataFrame(rows, "node_id long, t string, fs double").selectExpr("node_id", "cast(t as timestamp) as ts", "fs").coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in"
        )
        time.sleep(0.05)
    return spark.readStream.schema("node_id long, ts timestamp, fs double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_answers_while_the_stream_runs(spark, tmp_path, few_tasks):
    """A first answer, a later one, the final one when the watermark has passed the hour, and late readings on their own."""
    day = "2024-01-01"
    batches = [
        [(1, f"{day} 00:10:00", 0.5), (2, f"{day} 00:20:00", 1.5), (3, f"{day} 01:05:00", 0.5)],
        [(4, f"{day} 00:50:00", 0.5), (5, f"{day} 04:30:00", 1.5)],
        [(6, f"{day} 00:55:00", 0.5), (7, f"{day} 04:40:00", 0.5), (8, f"{day} 00:56:00", None)],
    ]
    answers = monitors.run_to_table(monitors.hour_answers(timed_stream(spark, tmp_path, batches)), "answers")
    got = sorted((r["hour"].hour, r["kind"], r["n_readings"], r["n_failed"]) for r in answers.collect())
    assert got == [(0, "final", 3, 2), (0, "first", 2, 1), (0, "late", 2, 1), (0, "more", 3, 2), (1, "final", 1, 1), (1, "first", 1, 1), (4, "first", 1, 0), (4, "more", 2, 1)]
    shares = monitors.shares_told(answers).orderBy("hour_start").collect()
    assert [tuple(r) for r in shares] == [(f"{day} 00:00:00", 0.6, 5), (f"{day} 01:00:00", 1.0, 1), (f"{day} 04:00:00", 0.5, 2)]


def test_answers_of_many_hours(spark, tmp_path, few_tasks):
    rows = spark.range(720 * 5).selectExpr("id AS node_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 12 * id) AS ts", "(id % 3) / 2e0 AS fs")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("node_id long, ts timestamp, fs double").parquet(f"{tmp_path}/in")
    answers = monitors.run_to_table(monitors.hour_answers(stream), "answers")
    kinds = {r["kind"]: r["count"] for r in answers.groupBy("kind").count().collect()}
    assert kinds == {"first": 720, "final": 717}  # three hours are open at the end
    told = monitors.shares_told(answers)
    assert told.count() == 720 and told.agg({"n_readings": "sum"}).first()[0] == 3600


def test_a_resumed_run_tells_no_node_again(spark, tmp_path, few_tasks):
    """The second run starts with the nodes of the first as its state, and says how large the state is."""
    day = "2024-01-01"
    first = timed_stream(spark, f"{tmp_path}/a", [[(1, f"{day} 00:10:00", 0.5), (2, f"{day} 00:20:00", 1.5)], [(1, f"{day} 02:10:00", 0.5), (3, f"{day} 02:20:00", 0.5)]])
    told = monitors.run_to_table(monitors.released_since(first), "released")
    assert sorted(r["node_id"] for r in told.collect()) == [1, 3]
    second = timed_stream(spark, f"{tmp_path}/b", [[(1, f"{day} 05:10:00", 0.5), (2, f"{day} 05:20:00", 0.5), (2, f"{day} 05:30:00", 0.5)]])
    path = new_table_path(spark, "released")
    query = monitors.started(monitors.released_since(second, earlier=told), path)
    assert [r["node_id"] for r in spark.read.parquet(path).collect()] == [2]
    assert monitors.state_size(query)["rows"] == 3


def test_flags_of_released_nodes_expire(spark, tmp_path, few_tasks):
    """With a lifetime a node may be told again after it; within it not."""
    day = "2024-01-01"
    batches = [[(1, f"{day} 00:10:00", 0.5)], [(1, f"{day} 00:20:00", 0.5)], [(1, f"{day} 00:30:00", 0.5)]]
    told = []
    for ttl_ms in (3_600_000, 1):
        path = new_table_path(spark, "released")
        monitors.started(monitors.released_since(timed_stream(spark, f"{tmp_path}/{ttl_ms}", batches), ttl_ms=ttl_ms), path, idle_batches=False)
        told.append(spark.read.parquet(path).count())
    assert told == [1, 3]
