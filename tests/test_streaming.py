import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.streaming import rollup

BASE = dt.datetime(2024, 2, 5, 12, 0, 0)
SCHEMA = "event_id string, event_type string, campaign_id string, quartile string, fill boolean, ssai_twin_of string, event_time timestamp"


def _files(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(path))
        del i


def _row(n, s, kind="impression"):
    return (f"e{n}", kind, "c1", None, None, None, BASE + dt.timedelta(seconds=s))


def test_counted_and_late_rows_are_the_deduplicated_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [_row(i, i + rng.choice([0, 0, 0, -90])) for i in range(200)]
    rows += [rows[i] for i in range(0, 200, 7)]
    batches = [rows[i : i + 58] for i in range(0, len(rows), 58)]
    src, silver = tmp_path / "in", str(tmp_path / "silver")
    for k, b in enumerate(batches):
        _files(spark, src, [b])
        stream = rollup.json_files(spark, str(src), spark.createDataFrame([], SCHEMA).schema)
        q = rollup.write_batches(rollup.deduplicated(stream), silver, str(tmp_path / "c1"))  # stopped and restarted for every batch
        assert q.awaitTermination(120) and q.exception() is None, k
    out = spark.read.parquet(silver)
    assert out.count() == 200 == out.select("event_id").distinct().count()
    late = out.filter("late").count()
    assert 0 < late < 200
    counts = rollup.window_counts(spark.readStream.schema(out.drop("batch").schema).option("recursiveFileLookup", "true").parquet(silver))
    q = counts.writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {r[0]: r[1] for r in out.filter("not late").groupBy("window_end").count().collect()}
    got = {r[0]: r[1] for r in spark.sql("select window_end, impressions from w").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_upsert_is_idempotent(spark, tmp_path):
    sink = rollup.upsert(str(tmp_path / "t"), ["k"], "v")
    assert rollup.current(spark, str(tmp_path / "t")) is None
    batch = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, t string")
    for number in (0, 0):
        sink(batch, number)
    sink(spark.createDataFrame([("b", 0, "old"), ("c", 5, "z")], "k string, v int, t string"), 1)
    assert sorted(map(tuple, rollup.current(spark, str(tmp_path / "t")).select("k", "v", "t").collect())) == [("a", 2, "y"), ("b", 1, None), ("c", 5, "z")]


def test_fail_open_loses_nothing(spark, tmp_path):
    sent = []

    def broken(batch, number):
        raise OSError("down")

    def works(batch, number):
        sent.extend(r.value for r in batch.collect())

    rows = spark.createDataFrame([("t", "k", f"v{i}") for i in range(5)], "topic string, key string, value string")
    folder = str(tmp_path / "fallback")
    rollup.fail_open(broken, folder)(rows, 4)
    assert rollup.replay_fallback(spark, folder, broken) == {"folders": 1, "replayed": 0, "failed": 5}
    assert rollup.replay_fallback(spark, folder, works) == {"folders": 1, "replayed": 5, "failed": 0}
    assert rollup.replay_fallback(spark, folder, works) == {"folders": 0, "replayed": 0, "failed": 0}
    assert sorted(sent) == [f"v{i}" for i in range(5)]


def test_archive_stream(spark, tmp_path):
    from tidemark.operators import archive

    _files(spark, tmp_path / "in", [[_row(i, i * 1800) for i in range(6)]])
    stream = rollup.json_files(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    rows = archive.archived({"ad.impression": stream})
    q = rows.writeStream.format("parquet").partitionBy("dt", "hour").option("path", str(tmp_path / "a")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    back = archive.read(spark, str(tmp_path / "a"))
    assert back.count() == 6
    assert {r.hour for r in archive.lookup(back, "2024-02-05", ["12", "13"], {"campaign_id": ["c1"]}).collect()} == {"12", "13"}
    assert back.filter(F.col("late_flag").isNotNull()).count() == 0


def _events(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_one_read_for_several_sinks_and_a_failed_batch_runs_again(spark, tmp_path):
    """The second sink fails once in the middle of a run: after the restart no minute is missing and none is counted twice."""
    _files(spark, tmp_path / "in", [[_row(i, i * 20) for i in range(k, k + 10)] for k in range(0, 40, 10)])
    failed = []

    def broken(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("down")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"b/batch={number}"))

    def start():
        stream = rollup.deduplicated(rollup.json_files(spark, str(tmp_path / "in"), _events(spark), per_batch=1))
        first = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / f"a/batch={number}"))
        return rollup.fan_out(stream, [first, broken], str(tmp_path / "c"))

    q = start()
    try:
        q.awaitTermination(120)
    except Exception:  # noqa: BLE001
        pass
    assert failed and q.exception() is not None
    q = start()
    assert q.awaitTermination(120) and q.exception() is None
    for name in "ab":
        out = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.event_id for r in out.collect()) == sorted(f"e{i}" for i in range(40))
    counts = rollup.counters(q)
    assert counts["dedup_in"] == counts["dedup_out"] == counts["rows_in"] == 30 and counts["removed"] == 0 and counts["state_rows"] == 40


def test_flush_closes_the_last_window(spark, tmp_path):
    def run():
        rows = rollup.json_files(spark, str(tmp_path / "in"), _events(spark))
        q = rollup.write_batches(rollup.deduplicated(rows), str(tmp_path / "silver"), str(tmp_path / "c1"))
        assert q.awaitTermination(120)
        schema = spark.read.parquet(str(tmp_path / "silver")).drop("batch").schema
        counts = rollup.window_counts(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "silver")))
        q = counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return {r.campaign_id: r.impressions for r in spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect()}

    _files(spark, tmp_path / "in", [[_row(1, 0), _row(2, 5)]])
    assert run() == {}
    rollup.flush(spark, str(tmp_path / "in"), BASE)
    assert run() == {"c1": 2}


def test_events_of_topic_records(spark):
    rows = [("ad.click", '{"event_id":"a","ad_slot":3,"fill":true,"event_time":"2024-02-05T12:00:00Z"}'), ("ad.click", "{broken"), ("x", "[1]"), ("x", None), ("ad.request", '{"event_id":"b","ad_slot":"no"}')]
    got = rollup.topic_events(spark.createDataFrame(rows, "topic string, value string")).collect()
    assert [(r.source_topic, r.event_id, r.ad_slot, r.fill) for r in got] == [("ad.click", "a", 3, True), ("ad.request", "b", None, None)]


def test_fallback_keeps_batches_of_one_number_apart(spark, tmp_path):
    def broken(batch, number):
        raise OSError("down")

    folder, sent = str(tmp_path / "f"), []
    rows = lambda v: spark.createDataFrame([("t", "k", v)], "topic string, key string, value string")
    rollup.fail_open(broken, folder)(rows("one"), 0)
    rollup.fail_open(broken, folder)(rows("two"), 0)  # as after a restart with a new checkpoint
    assert rollup.replay_fallback(spark, folder, lambda batch, number: sent.extend((number, r.value) for r in batch.collect())) == {"folders": 2, "replayed": 2, "failed": 0}
    assert sorted(sent) == [(0, "one"), (0, "two")]


def test_upsert_forgets_after_the_time_to_live(spark, tmp_path):
    sink = rollup.upsert(str(tmp_path / "t"), ["k"], "v", keep=lambda: F.col("at") >= F.lit("2024-02-05 12:00:00").cast("timestamp_ntz"))
    at = lambda h: dt.datetime(2024, 2, 5, h)
    sink(spark.createDataFrame([("old", 1, at(11)), ("new", 1, at(12))], "k string, v int, at timestamp_ntz"), 0)
    assert [r.k for r in rollup.current(spark, str(tmp_path / "t")).collect()] == ["new"]
