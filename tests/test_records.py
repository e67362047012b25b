"""Records of the sinks, watermarks, traces, ordered publishing and reports, against plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from event_rows import AD
from test_golden import T, row
from tidemark.functions.keys import click_url, minute_key
from tidemark.operators import metrics, outbox, ranks, realtime, reconcile, serving, trace
from tidemark.sources import ingest


@pytest.mark.parametrize("part_rows", [1_000_000, 7])
def test_maxima_of_what_came_before(spark, part_rows):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice([None, rng.randint(0, 50)])) for i in range(60)]
    rng.shuffle(rows)
    got = {r.at: r.before_v for r in ranks.before_max(spark.createDataFrame(rows, "at long, v long"), "at", ["v"], part_rows).collect()}
    want, best = {}, None
    for at, v in sorted(rows):
        want[at] = best
        best = v if best is None else best if v is None else max(best, v)
    assert got == want
    assert ranks.before_max(spark.createDataFrame([], "at long, v long"), "at", ["v"]).count() == 0


@pytest.mark.parametrize("part_rows", [1_000_000, 9])
def test_running_sums(spark, part_rows):
    rng = random.Random(2)
    rows = [(k, v, rng.randint(1, 5)) for k in ("a", "b", None) for v in rng.sample(range(100), 40 if k == "a" else 5)]
    got = {(r.k, r.v): r.upto for r in ranks.running_sum(spark.createDataFrame(rows, "k string, v long, c long"), ["k"], "v", "c", part_rows).collect()}
    assert got == {(k, v): sum(c for k2, v2, c in rows if k2 == k and v2 <= v) for k, v, _ in rows}


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_nearest_rank_with_outliers_nulls_and_ties(spark, p):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, rng.gauss(0, 1), 1e300])) for k in ("a", None, "b") for _ in range(50)]
    got = {r.k: (r.n, r.value_at_p) for r in metrics.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", p).collect()}
    for k in ("a", None, "b"):
        values = sorted(v for k2, v in rows if k2 == k and v is not None)
        assert got[k] == (len(values), values[min(len(values) - 1, int(len(values) * p))])


def test_late_record_in_full(spark):
    rows = [row(1, "push", at=200.5, came=1), row(2, "late", at=-50.4, came=2, req="r"), row(3, "q", kind="quartile", q="complete", at=-50, came=3)]
    df = spark.createDataFrame(rows, AD)
    times = df.select(F.unix_micros(F.col("event_time").cast("timestamp")).alias("event_us"), F.unix_micros(F.col("arrival_time").cast("timestamp")).alias("arrival_us"))
    got = {r.event_id: r for r in realtime.late_records(realtime.replay(df), realtime.watermarks(times, 10_000_000)).collect()}
    mark = T + dt.timedelta(seconds=190.5)
    assert got["late"].watermark_at == mark and got["late"].lateness_ms == 240_000 and got["late"].topic_origin == "ad.impression" and got["late"].ad_request_id == "r"
    assert got["q"].event_type == "complete" and got["q"].topic_origin == "ad.quartile" and got["q"].lateness_ms == 240_000


def _marks_by_hand(rows, sources, delay, idle):
    begin, out, held = min(a for _, _, a in rows), {}, None
    for now in sorted({a for _, _, a in rows}):
        own, blocked = [], False
        for s in sources:
            seen = [(e, a) for x, e, a in rows if x == s and a < now]
            last = max((a for _, a in seen), default=begin)
            if last + idle > now:
                events = [e for e, _ in seen if e is not None]
                blocked |= not events
                own += [max(events)] if events else []
        value = None if blocked or not own else min(own) - delay
        held = value if held is None else held if value is None else max(held, value)
        out[now] = held
    return out


@pytest.mark.parametrize("part_rows", [1_000_000, 11])
def test_watermark_of_several_sources(spark, part_rows):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        s = rng.choices(["a", "b", "c"], [8, 3, 1 if i < 60 else 0])[0]
        rows.append((s, rng.choice([None, i * 10 + rng.randint(-40, 40)]), i * 10 + rng.choice([0, 0, 5])))
    df = spark.createDataFrame(rows + [("other", 10**9, 5)], "source string, event_us long, arrival_us long")
    got = {r.arrival_us: r.watermark_us for r in realtime.source_watermarks(df, ["a", "b", "c"], 20, 200, part_rows).collect()}
    assert got == _marks_by_hand(rows, ["a", "b", "c"], 20, 200)


def test_minute_and_alert_records(spark):
    rows = [row(i, f"i{i}", cid="C1", at=i) for i in range(3)] + [row(10 + i, f"r{i}", kind="ad_response", cid="C1", fill=True, at=i) for i in range(8)] + [row(30, "u", cid="unknown")]
    windows = realtime.window_counts(realtime.replay(spark.createDataFrame(rows, AD))).withColumn("campaign_id", F.lower("campaign_id"))
    campaigns = spark.createDataFrame([(" c1 ", "adv", "name"), ("other", "x", "y")], "campaign_id string, advertiser string, name string")
    full = {r.campaign_id: r for r in realtime.minute_records(windows, campaigns, F.lit(T)).collect()}
    r = full["c1"]
    assert (r.advertiser, r.campaign_name, r.impressions, r.requests, r.imp_req_ratio, r.window_end - r.window_start) == ("adv", "name", 3, 8, 0.375, dt.timedelta(minutes=1))
    assert full["unknown"].advertiser is None and full["unknown"].imp_req_ratio is None and len(r) == 12
    alerts = realtime.alert_records(windows, F.lit(T))
    assert len(alerts.columns) == 10 and [(a.campaign_id, a.threshold, a.alert_type) for a in alerts.collect()] == [("c1", 0.5, "low_impression_ratio")]
    message = realtime.as_messages(realtime.minute_records(windows, campaigns, F.lit(T)), "campaign_id").filter("key = 'unknown'").first()
    value = json.loads(message.value)
    assert value["advertiser"] is None and value["window_start"] == "2024-02-05T12:00:00.000" and list(value)[:3] == ["window_start", "window_end", "campaign_id"]


def test_trace_between_offsets(spark):
    event = lambda e, q: json.dumps({"event_id": e, "ad_request_id": q})
    rows = [("t", 0, i, event(f"e{i}", f"q{i % 3}")) for i in range(10)] + [("dlq", 1, 0, json.dumps({"reason": "x", "raw": {"eid": "e2"}})), ("dlq", 1, 1, "{broken"), ("t", 5, 0, event("e2", "q9")), ("dlq", 1, 2, None)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    bounds = spark.createDataFrame([("t", 0, 2, 6), ("dlq", 1, None, None)], "topic string, partition int, start_offset long, end_offset long")
    inside = trace.bounded(df, bounds)
    assert {(r.topic, r.offset) for r in inside.collect()} == {("t", 2), ("t", 3), ("t", 4), ("t", 5), ("dlq", 0), ("dlq", 1), ("dlq", 2)}
    twice = trace.seen_once(inside.unionByName(inside.limit(3)))
    assert twice.count() == 7
    got = {(r.id, r.topic, r.offset, r.reason) for r in trace.matched(twice, spark.createDataFrame([("e2",), ("q0",), ("e2",), (None,)], "id string")).collect()}
    assert got == {("e2", "t", 2, None), ("e2", "dlq", 0, "x"), ("q0", "t", 3, None)}
    assert {(r.topic, r.start_offset) for r in trace.next_bounds(inside).collect()} == {("t", 6), ("dlq", 3)}


@pytest.mark.parametrize("part_rows", [1_000_000, 8])
def test_publishing_in_order(spark, part_rows):
    ids = sorted(random.Random(5).sample(range(1000), 60))
    fails = {i for i in ids if i % 7 == 0}
    sent, at, failed, skipped = [], 0, set(), set()
    while at < len(ids):  # a worker, poll by poll
        poll, took = at, []
        for i in ids[at : at + 5]:
            if i in fails and i not in failed and i != ids[at]:
                break
            took.append(i)
        failed |= {ids[at + len(took)]} if at + len(took) < len(ids) and ids[at + len(took)] in fails else set()
        sent += [(i, poll) for i in took]
        if poll % 3 == 0 and poll not in skipped:
            skipped.add(poll)
            sent += [(i, poll) for i in took]
        at += len(took)
    df = spark.createDataFrame([(i, f"e{i}") for i in ids] + [(None, "x")], "id long, event_id string")
    got = outbox.published_in_order(df, 5, F.col("id") % 7 == 0, F.col("poll") % 3 == 0, part_rows)
    assert sorted((r.id, r.poll) for r in got.collect()) == sorted(sent)
    assert outbox.published_in_order(df.limit(0), 5, F.lit(None).cast("boolean"), F.lit(False)).count() == 0


def test_messages_of_decisions(spark):
    rows = [("r1", "cmp-1", None, 2), ("r2", None, "s", None)]
    out = outbox.messages(spark.createDataFrame(rows, "ad_request_id string, campaign_id string, session_id string, ad_slot int"), F.lit(T)).collect()
    a, b = (json.loads(r.payload) for r in sorted(out, key=lambda r: r.aggregate_id))
    assert list(a) == list(outbox.PAYLOAD) and a["fill"] is True and a["ad_slot"] == 2 and a["session_id"] is None and a["event_time"] == "2024-02-05T12:00:10.000Z"
    assert b["fill"] is False and b["campaign_id"] == "nofill" and len({r.event_id for r in out}) == 2 and not any(r.published for r in out)


def test_kept_minutes_and_summary(spark):
    t = lambda h, m=0: dt.datetime(2024, 2, 5, h, m)
    rows = [(t(1), "a", t(2), 1, "old"), (t(13), "a", t(14), 2, None), (t(13), "a", t(15), 3, None), (t(13, 5), "a", t(15), 4, "adv"), (t(13, 6), "a", t(15), 4, "later"), (None, "a", t(15), 9, "z")]
    df = spark.createDataFrame(rows, "minute_ts timestamp_ntz, campaign_id string, computed_at timestamp_ntz, impressions long, advertiser string")
    kept = serving.kept_minutes(df, F.lit(t(20)), 12)
    assert sorted((r.minute_ts, r.impressions) for r in kept.collect()) == [(t(13), 3), (t(13, 5), 4), (t(13, 6), 4)]
    r = serving.summary(kept, first_seen=["advertiser"]).first()
    assert (r.impressions, r.n_minutes, r.advertiser) == (11, 3, "adv")
    report = serving.report(kept, [F.col("minute_ts").desc()], 2).collect()
    assert [(x.minute_ts, x.place) for x in report] == [(t(13, 6), 1), (t(13, 5), 2)]
    assert [x.total for x in serving.newest_of_all(kept, ["minute_ts"], 1).collect()] == [3]


def test_range_bounds_reach_the_files(spark, tmp_path):
    spark.createDataFrame([(T, "a", 1)], "minute_ts timestamp_ntz, campaign_id string, impressions long").write.parquet(str(tmp_path / "m"))
    plan = serving.summary(spark.read.parquet(str(tmp_path / "m")), 1_707_112_830, 1_707_156_030)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(minute_ts,2024" in pushed and "LessThan(minute_ts,2024" in pushed


def test_reports_of_runs(spark):
    assert reconcile.minute_parameter("2024-02-05T12:34:56") == dt.datetime(2024, 2, 5, 12, 34) == reconcile.minute_parameter("2024-02-05T21:34:56+09:00")
    rec = reconcile.with_terms(spark.createDataFrame([("c", 1, 2, 2, 1)], "campaign_id string, rt long, bt long, raw long, late long"))
    runs = [reconcile.reported(rec, F.lit(T + dt.timedelta(hours=h)), F.lit("2024-02-05").cast("date"), s) for h, s in ((0, "range"), (1, "daily"))]
    latest = reconcile.latest_run(runs[0].unionByName(runs[1])).collect()
    assert [r.scope for r in latest] == ["daily"] and tuple(latest[0].asDict()) == reconcile.REPORT
    days = spark.createDataFrame([(dt.datetime(2024, 2, 5),), (dt.datetime(2024, 2, 5, 23, 59, 59),), (dt.datetime(2024, 2, 6),), (None,)], "t timestamp_ntz")
    assert days.filter(reconcile.of_day(F.col("t"), "2024-02-05")).count() == 2


def test_label_sums_and_replicas(spark):
    lines = ['n{a="1",b="x"} 2', 'n{b="x",a="1"} 3', 'n{a="11",b="x"} 5', 'n{xa="1",b="x"} 7', "n 11", 'm{a="1",b="x"} 13', "# n"]
    read = metrics.exposition(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert metrics.label_sum(read, "n", {"a": "1", "b": "x"}).first()[:] == (5.0, 2) and metrics.label_sum(read, "z", {}).first()[:] == (0.0, 0)
    seen = spark.createDataFrame([("r1",), ("r1",), ("r9",)], "replica string")
    assert metrics.replicas(seen, spark.createDataFrame([("r1",), ("r2",)], "replica string")).first()[:] == (1, 2)


def test_no_fill(spark):
    rows = [row(1, "a", kind="ad_response", fill=True), row(1, "a", kind="ad_response", fill=True), row(2, "b", kind="ad_response", cid="nofill", fill=False), row(3, "c", kind="ad_response"), row(4, "d")]
    assert realtime.no_fill_ratio(spark.createDataFrame(rows, AD), F.lit(1).alias("one")).first()[1:] == (3, 2, 2 / 3)


def test_ingested_values_keep_their_types(spark):
    base = {"event_id": "e", "event_type": "impression", "campaign_id": "c", "event_time": 1_707_134_400_000}
    cases = [{**base, "fill": True, "ad_slot": 3, "playhead_s": 1.5, "meta": {"a": 1, "l": [1, None, "x"]}, "n": None}, {**base, "source": None}, {**base, "server_ts": "mine", "source": "server"}]
    raws = [json.dumps(c) for c in cases] + ['{"event_id":"e","event_type":"impression","campaign_id":"c","event_time":1707134400000,"x":1,"x":2}']
    out = [json.loads(r.value) for r in ingest.routed(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"), F.lit(1_707_134_400_000)).orderBy("i").collect()]
    for case, value in zip(cases, out, strict=False):
        assert {k: value[k] for k in case if k not in ("event_time", "server_ts")} == {k: v for k, v in case.items() if k not in ("event_time", "server_ts")}
        assert value["event_time"] == value["server_ts"] == "2024-02-05T12:00:00.000Z" and value["ingest_endpoint"] == "v1_events"
    assert out[0]["source"] == "client" and out[1]["source"] is None and out[3]["event_id"] == "e" and out[3]["x"] == "2"


def test_keys_of_minutes_and_clicks(spark):
    r = spark.createDataFrame([(T, "cmp 1", None)], "t timestamp_ntz, c string, q string").select(minute_key("t").alias("k"), click_url("https://ads.example/click", F.col("c"), F.col("q")).alias("u"), click_url("x", F.col("q"), F.col("c")).alias("n")).first()
    assert r.k == "202402051200" and r.u == "https://ads.example/click/cmp+1?arid=" and r.n is None
