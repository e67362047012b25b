"""The roll-up as two streaming queries: deduplicate and mark late rows, then count the others by window.

The first query keeps an id's first delivery for `ttl_ms` (state with time to live, in the RocksDB store) and gives each row the watermark it met; its
batches are written under their number, so a batch that runs again after a failure replaces its own files. A row is late if that
watermark had reached its window's end. The second query counts rows that were not late; its watermark comes from rows that the first has passed on
already, so it never drops one of them: windows and late rows together are exactly the deduplicated stream.

Any streaming DataFrame with event_id, campaign_id, event_time and the columns of realtime.kinds() is a source, from Kafka or from files."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.realtime import kinds
from tidemark.operators.serving import latest
from tidemark.schema import EVENT
from tidemark.shipping import shipped

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = "event_id string, kind string, campaign_id string, is_twin int, event_time timestamp, watermark_ms long"


def kafka(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest", group: str | None = None) -> DataFrame:
    """The topics' records as (topic, partition, offset, key, value): one source for all, so that sinks share one read. Needs Spark's Kafka package.

    starting: `latest`, or `earliest` to replay all that the topics hold (with a new checkpoint; an old one goes on where it was)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    rows = (reader.option("kafka.group.id", group) if group else reader).load()
    return rows.select("topic", "partition", "offset", F.col("key").cast("string"), F.col("value").cast("string"))


def topic_events(records: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """The events of records (topic, value, ...) as rows of the schema, with their topic as source_topic; what is no JSON object is skipped, an unreadable field is null."""
    event = F.when(F.ltrim("value").startswith("{"), F.from_json("value", schema.add("_corrupt", "string") if "_corrupt" not in schema.fieldNames() else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rows = records.select(F.col("topic").alias("source_topic"), event.alias("e"), F.json_object_keys("value").isNotNull().alias("whole"))
    return rows.filter("e is not null and whole").select("source_topic", *[F.col(f"e.{f}").alias(f) for f in schema.fieldNames() if f != "_corrupt"])


def configure(spark: SparkSession, retain: int = 3) -> None:
    """State in RocksDB, written as changes, and so many old snapshots kept to recover from."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", str(retain))


def json_files(spark: SparkSession, path: str, schema, per_batch: int = 1000) -> DataFrame:
    """Rows of JSON files as they appear; unreadable lines are skipped, unreadable fields are null."""
    rows = spark.readStream.schema(schema.add("_corrupt", "string") if "_corrupt" not in schema.fieldNames() else schema)
    return rows.option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", per_batch).json(path)


class KeepFirst(StatefulProcessor):
    """Passes on the first row of an id and forgets the id after the state's time to live; later copies do not prolong it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r.event_time is None, r.event_time, r.campaign_id or ""))
        self.seen.update((1,))
        yield Row(
            event_id=key[0], kind=first.kind, campaign_id=first.campaign_id, is_twin=first.is_twin, event_time=first.event_time,
            watermark_ms=int(timerValues.getCurrentWatermarkInMs()),
        )

    def close(self) -> None:
        pass


def deduplicated(events: DataFrame, delay: str = "10 seconds", ttl_ms: int = 3_600_000, window_s: int = 60) -> DataFrame:
    """First deliveries with window_end and late. Set spark.sql.streaming.stateStore.providerClass to ROCKSDB before.

    A row is late when a watermark exists and is at its window's end less a millisecond, or after."""
    shipped(events.sparkSession)
    rows = kinds(events).filter("event_id is not null").withWatermark("event_time", delay).select("event_id", "kind", "campaign_id", "is_twin", "event_time").filter("kind is not null")
    rows = rows.observe("dedup_in", F.count(F.lit(1)).alias("rows"))
    out = rows.groupBy("event_id").transformWithState(
        statefulProcessor=KeepFirst(ttl_ms), outputStructType=FIELDS, outputMode="append", timeMode="ProcessingTime"
    )
    end = F.timestamp_seconds((F.floor(F.unix_seconds("event_time") / window_s) + 1) * window_s)
    late = (F.col("watermark_ms") > 0) & (F.col("watermark_ms") >= F.unix_millis(end) - 1)
    out = out.withColumn("window_end", end).withColumn("late", late)
    return out.observe("dedup_out", F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"))


def write_batches(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch under path/batch=<number>, replaced if it runs again.

    Batches without data are off: with state that ages by the clock there would always be another one, and a run over what is available would not end."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _started(rows, sink, checkpoint, trigger)


def fan_out(rows: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """One query for several sinks: each batch is computed once, and is done when all sinks have it. A batch whose sink failed runs again for all of
    them, so sinks should replace by batch number, as write_batches() and upsert() do."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return _started(rows, each, checkpoint, trigger)


def _started(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(name, before)


def flush(spark: SparkSession, path: str, past: datetime.datetime, delay_s: int = 10, window_s: int = 60, campaign: str = "flush") -> None:
    """Adds one impression of a sentinel campaign to a folder of JSON events, late enough to close the window that holds `past`: when traffic stops, nothing else moves the watermark on."""
    at = past + datetime.timedelta(seconds=window_s + delay_s + 1)
    row = [(f"flush-{uuid.uuid4().hex}", "impression", campaign, at)]
    spark.createDataFrame(row, "event_id string, event_type string, campaign_id string, event_time timestamp").coalesce(1).write.mode("append").json(path)


def window_counts(rows: DataFrame, delay: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """Counts by window and campaign of rows that were not late; a window comes out once, when it closes."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return (
        rows.filter("not late").withWatermark("event_time", delay).groupBy(F.window("event_time", window).alias("w"), "campaign_id")
        .agg(is_("impression").alias("impressions"), is_("click").alias("clicks"), is_("complete").alias("completes"), is_("request").alias("requests"), F.sum("is_twin").alias("ssai_dupes"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "campaign_id", "impressions", "clicks", "completes", "requests", "ssai_dupes")
    )


def upsert(path: str, keys: list[str], version: str, keep: Callable[[], Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the table at path holds the newest row of each key, and of these the rows for which keep() holds at the time (a time to live). A new generation is written beside the old one and named in
    a pointer file last, so readers see a whole one, and a batch that runs again changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path)
        rows = batch if old is None else old.unionByName(batch)
        generation = f"generation-{number}-{uuid.uuid4().hex}"
        rows = rows if keep is None else rows.filter(keep())
        latest(rows, keys, version).write.parquet(f"{path}/{generation}")
        _write_text(spark, f"{path}/CURRENT", generation)

    return sink


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table kept by upsert(), None before its first batch."""
    name = _read_text(spark, f"{path}/CURRENT")
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path).first()[0]


def fail_open(sink: Callable[[DataFrame, int], None], fallback: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes a batch of (topic, key, value) as JSON lines where `sink` fails, and goes on.

    A batch's folder is named by its query and number: it replaces itself if it runs again, and no batch of another query."""
    own = uuid.uuid4().hex

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception:  # noqa: BLE001
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or own
            rows = batch.select("topic", "key", F.col("value").alias("payload"), F.current_timestamp().cast("string").alias("fallback_ts"))
            rows.write.mode("overwrite").json(f"{fallback}/batch={query}-{number}")

    return guarded


def replay_fallback(spark: SparkSession, fallback: str, sink: Callable[[DataFrame, int], None]) -> dict[str, int]:
    """Sends every fallen-back batch again; a folder is renamed to .done once its batch went through. Returns folders, replayed, failed.

    A folder that could not be renamed raises an error, as its batch would be sent again."""
    from tidemark.schema import FALLBACK

    fs, p = _file_system(spark, fallback)
    counts = {"folders": 0, "replayed": 0, "failed": 0}
    if not fs.exists(p):
        return counts
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if not name.startswith("batch=") or name.endswith(".done"):
            continue
        counts["folders"] += 1
        rows = spark.read.schema(FALLBACK).json(str(status.getPath())).select("topic", "key", F.col("payload").alias("value"))
        n = rows.count()
        try:
            sink(rows, int(name.rpartition("-")[2].removeprefix("batch=")))
        except Exception:  # noqa: BLE001
            counts["failed"] += n
            continue
        counts["replayed"] += n
        done = status.getPath().suffix(".done")
        if fs.exists(done):  # of a batch that was sent before and fell back again
            fs.delete(done, True)
        if not fs.rename(status.getPath(), done):
            raise OSError(f"{status.getPath()} was sent and can't be renamed")
    return counts


def counters(query: StreamingQuery) -> dict[str, int]:
    """Sums over the query's recent batches: rows into and out of the deduplication, removed and late rows, and rows read; state rows and bytes, checkpoint milliseconds of the last."""
    out = {"rows_in": 0, "dedup_in": 0, "dedup_out": 0, "late": 0}
    last: dict = {}
    for p in query.recentProgress:
        last = p = json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p)
        seen = p.get("observedMetrics") or {}
        out["rows_in"] += p.get("numInputRows") or 0
        out["dedup_in"] += (seen.get("dedup_in") or {}).get("rows") or 0
        out["dedup_out"] += (seen.get("dedup_out") or {}).get("rows") or 0
        out["late"] += (seen.get("dedup_out") or {}).get("late") or 0
    out["removed"] = out["dedup_in"] - out["dedup_out"]
    states = last.get("stateOperators") or []
    out |= {"state_rows": sum(s.get("numRowsTotal") or 0 for s in states), "state_bytes": sum(s.get("memoryUsedBytes") or 0 for s in states)}
    return out | {"checkpoint_ms": (last.get("durationMs") or {}).get("walCommit", 0) + (last.get("durationMs") or {}).get("commitOffsets", 0)}


def progress(query: StreamingQuery) -> dict:
    """Rows in, state rows and watermark of a query's last batch."""
    last = query.lastProgress
    if last is None:
        return {}
    p = json.loads(last.json) if hasattr(last, "json") and isinstance(last.json, str) else dict(last)
    return {"batch": p.get("batchId"), "rows_in": p.get("numInputRows"), "watermark": p.get("eventTime", {}).get("watermark"), "state_rows": sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))}
