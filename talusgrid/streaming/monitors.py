"""Monitors over arriving factor-of-safety readings (node_id, ts, fs)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from talusgrid.functions.physics import failing
from talusgrid.sources.workspace import new_table_path


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stream of a table that is one file or a folder of files; a missing path fails at once.

    A file source watches folders, so a single file is picked out of its folder by name.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place)
    source = spark.readStream.schema(schema)
    if status.isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def readings(events: DataFrame, scale: float = 50.0) -> DataFrame:
    """Event rows as readings; the watermark needs a zoned timestamp."""
    return events.select(
        F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / scale).alias("fs")
    )


def failed_fraction_by_hour(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Share of failing readings per clock hour, told once, when the watermark has passed it.

    State is one running average per open hour, and rows are combined before the shuffle. Hours that are still open
    when the stream stops are not told; `hour_parts` and `shares_so_far` also have those.
    """
    hours = stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"))
    return hours.agg(
        F.avg(failing(F.col("fs")).cast("double")).alias("failed_frac"), F.count(F.lit(1)).alias("n_readings")
    ).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "failed_frac", "n_readings")


def _hour_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("hour").aggregate([("n", "sum"), ("failed", "sum")])
        yield from found.select(["hour", "n_sum", "failed_sum"]).rename_columns(["hour", "n_readings", "n_failed"]).to_batches()


def hour_parts(stream: DataFrame) -> DataFrame:
    """Counts per hour of each batch of readings: (hour, n_readings, n_failed), to be added up.

    Nothing is held back and nothing is too late: there is no state, and parts of one hour may come at any time.
    """
    rows = stream.select(
        F.date_trunc("hour", "ts").alias("hour"), F.lit(1).cast("long").alias("n"), failing(F.col("fs")).cast("long").alias("failed")
    )
    return rows.mapInArrow(_hour_parts, "hour timestamp, n_readings long, n_failed long")


def shares_so_far(parts: DataFrame) -> DataFrame:
    """Table of hour parts -> failing share of every hour seen."""
    total = parts.groupBy("hour").agg(F.sum("n_readings").alias("n_readings"), F.sum("n_failed").alias("n_failed"))
    start = F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour_start")
    return total.select(start, (F.col("n_failed") / F.col("n_readings")).alias("failed_frac"), "n_readings")


HOUR_MS = 3_600_000
ANSWER = "hour timestamp, kind string, n_readings long, n_failed long"


class HourAnswers(StatefulProcessor):
    """Readings of one clock hour: a first answer when they start to come, later ones as they grow, and a final one.

    State is the hour's two counts, and a timer at its end. When the watermark passes the end, the timer tells the final
    answer and the state goes. What comes after that is told on its own, as late, and keeps no state. Readings without
    a time have no end; their answer grows as long as the stream runs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n_readings long, n_failed long")

    def handleInputRows(self, key, rows, timerValues):
        hour = key[0]
        n, failed = (sum(x) for x in zip(*((r["n_readings"], r["n_failed"]) for r in rows), strict=True))
        end = None if hour is None else int(hour.timestamp() * 1000) + HOUR_MS
        if end is not None and end <= timerValues.getCurrentWatermarkInMs():
            yield Row(hour=hour, kind="late", n_readings=n, n_failed=failed)
            return
        known = self.counts.get() if self.counts.exists() else None
        if known is None and end is not None:
            self.handle.registerTimer(end)
        total = (n, failed) if known is None else (known[0] + n, known[1] + failed)
        self.counts.update(total)
        yield Row(hour=hour, kind="first" if known is None else "more", n_readings=total[0], n_failed=total[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, failed = self.counts.get()
        self.counts.clear()
        yield Row(hour=key[0], kind="final", n_readings=n, n_failed=failed)

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers, expiry or initial rows needs the store that keeps it on disk; it also bounds executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def hour_answers(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Answers per hour while the stream runs: (hour, kind, n_readings, n_failed), kind first, more, final or late.

    Counts of first, more and final are of the whole hour so far; those of late are additions. Tasks add up their readings
    by hour first, so an hour's state gets one row per task and batch however hot the hour is.
    """
    keep_state_on_disk(stream.sparkSession)
    parts = hour_parts(stream.withWatermark("ts", lateness))
    return parts.groupBy("hour").transformWithState(HourAnswers(), ANSWER, outputMode="Append", timeMode="EventTime")


def shares_told(answers: DataFrame) -> DataFrame:
    """Table of answers -> failing share of every hour by its latest answer, late readings included."""
    late = F.col("kind") == "late"
    last = F.max(F.when(~late, F.struct("n_readings", "n_failed")))
    found = answers.groupBy("hour").agg(
        last.alias("last"), F.coalesce(F.sum(F.when(late, F.col("n_readings"))), F.lit(0)).alias("n_late"), F.coalesce(F.sum(F.when(late, F.col("n_failed"))), F.lit(0)).alias("f_late")
    )
    n, failed = (F.coalesce(F.col(f"last.{x}"), F.lit(0)) + F.col(y) for x, y in (("n_readings", "n_late"), ("n_failed", "f_late")))
    start = F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour_start")
    return found.select(start, (failed / n).alias("failed_frac"), n.alias("n_readings"))


class FirstFailure(StatefulProcessor):
    """A node's first failure, and none after it for as long as its flag lives."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.released = handle.getValueState("released", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        if not self.released.exists():
            yield Row(node_id=key[0])
        self.released.update((True,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.released.update((True,))

    def close(self) -> None:
        pass


def released_since(stream: DataFrame, earlier: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Each node when it fails, unless it did before in this run or in an earlier one.

    earlier(node_id) is what an earlier run told; its rows become the state that this run starts with. With ttl_ms the flag
    of a node expires so long after its last failure, which bounds the state by the nodes that failed within that time;
    without it the state is one flag per failed node for ever. State that expires asks for a batch whenever time goes by, so
    a run that is to end with its data must be started with idle_batches=False.
    """
    keep_state_on_disk(stream.sparkSession)
    failed = stream.where(failing(F.col("fs"))).select("node_id").mapInArrow(_once_per_batch, "node_id long")
    start = None if earlier is None else earlier.select("node_id").distinct().groupBy("node_id")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return failed.groupBy("node_id").transformWithState(FirstFailure(ttl_ms), "node_id long", outputMode="Append", timeMode=mode, initialState=start)


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Rows and bytes of state of a query after its last batch that reported any."""
    told = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    last = told[-1] if told else []
    return {"rows": sum(s["numRowsTotal"] for s in last), "bytes": sum(s["memoryUsedBytes"] for s in last)}


def _once_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node_id").unique()], names=["node_id"])


def released_once(stream: DataFrame) -> DataFrame:
    """Each node the first time it fails, never again. State is one flag per failed node.

    A node with very many readings is thinned inside each task first, so that the shuffle to its
    state does not carry one row per reading.
    """
    failed = stream.where(failing(F.col("fs"))).select("node_id")
    return failed.mapInArrow(_once_per_batch, "node_id long").dropDuplicates(["node_id"])


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def started(stream: DataFrame, path: str, idle_batches: bool = True) -> StreamingQuery:
    """Runs everything available into a Parquet table at path, and comes back when that is done.

    idle_batches: whether batches without data follow, as timers need them that the last data have set off.
    """
    conf = stream.sparkSession.conf
    before = conf.get(IDLE_BATCHES)
    conf.set(IDLE_BATCHES, str(idle_batches).lower())
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{path}-progress")
            .trigger(availableNow=True)
            .start(path)
        )
    finally:
        conf.set(IDLE_BATCHES, before)
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, write it as a table in the work folder, and return that table."""
    spark = stream.sparkSession
    path = new_table_path(spark, name)
    started(stream, path)
    return spark.read.schema(stream.schema).parquet(path)
