"""Scenarios with exact results: deduplication, twins, late rows, reconciliation, alerts, ingestion."""

import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from event_rows import AD
from tidemark.functions.signing import canonical, hmac_sha256
from tidemark.operators import metrics, outbox, realtime, reconcile, serving, settlement
from tidemark.sources import ingest

T = dt.datetime(2024, 2, 5, 12, 0, 10)

def row(n, eid, kind="impression", cid="c1", req=None, q=None, fill=None, source="client", twin=None, at=0.0, came=None, dup=None):
    t = T + dt.timedelta(seconds=at)
    return (n, eid, kind, cid, req, q, fill, source, twin, t, T + dt.timedelta(seconds=at if came is None else came), None, dup)


def golden():
    rows = [row(i, f"n{i}", req=f"r{i}", at=i) for i in range(5)]
    rows += [row(10, "d", req="rd", at=6), row(10, "d", req="rd", at=6, came=8, dup=True)]
    rows += [row(20, "s-client", req="rs", at=7), row(21, "s-server", req="rs", source="server", twin="s-client", at=7, came=7.5)]
    rows += [row(30, "late", req="rl", at=-90, came=100), row(40, "push", cid="other", at=99, came=99)]
    return rows


def test_golden_run(spark):
    df = spark.createDataFrame(golden(), AD)
    replayed = realtime.replay(df)
    win = realtime.window_counts(replayed).filter("campaign_id = 'c1'")
    assert win.agg(F.sum("impressions"), F.sum("ssai_dupes")).first()[:] == (8, 1)
    assert [r.event_id for r in realtime.late_events(replayed).collect()] == ["late"]
    day = settlement.daily(df).filter("campaign_id = 'c1'").first()
    assert (day.impressions, day.raw_impressions, day.dupes_removed) == (8, 9, 1)
    late = realtime.late_events(replayed).select("campaign_id", F.lit(1).alias("n"))
    batch = settlement.by_minute(df).select("campaign_id", F.col("impressions").alias("n"), F.col("raw_impressions").alias("raw"))
    rt = realtime.window_counts(replayed).select("campaign_id", F.col("impressions").alias("n"))
    rec = {r.campaign_id: r for r in reconcile.reconcile(rt, batch, late).collect()}
    r = rec["c1"]
    assert (r.realtime_impressions, r.batch_impressions, r.late, r.ssai, r.diff, r.residual, r.likely_cause) == (8, 8, 1, 1, 0, 0, "late +1 , ssai -1")
    assert rec["other"].likely_cause == "no difference"


@pytest.mark.parametrize(("edge", "late"), [(9.998, False), (9.999, True)])
def test_late_boundary(spark, edge, late):
    end = dt.datetime(2024, 2, 5, 12, 1)
    rows = [row(1, "push", at=(end - T).total_seconds() + edge, came=100), row(2, "x", at=0, came=101)]
    got = {r.event_id: r.late for r in realtime.replay(spark.createDataFrame(rows, AD)).collect()}
    assert got == {"push": False, "x": late}


@pytest.mark.parametrize(("gap", "kept"), [(3599, 1), (3600, 2)])
def test_a_forgotten_id_is_kept_again(spark, gap, kept):
    rows = [row(1, "a", at=0, came=0), row(1, "a", at=0, came=1800), row(1, "a", at=0, came=gap)]
    assert realtime.replay(spark.createDataFrame(rows, AD)).count() == kept


def test_quirks(spark):
    rows = [
        row(1, "alias", kind="ad_impression"), row(2, "c", kind="complete"), row(3, "click", kind="click", cid="clicks"), row(4, "ns1", source=None, req="q"), row(5, "ns2", req="q", source="client"),
        row(6, "nr1", cid="z"), row(7, "nr2", cid="z"), row(8, "p", cid="pending"), row(9, "f", kind="ad_response", cid="nofill", fill=True), row(10, "np", kind="quartile", cid="quart", q="start"),
    ]
    df = spark.createDataFrame(rows, AD)
    assert {(r.campaign_id, r.impressions, r.raw_impressions) for r in settlement.daily(df).collect()} == {("c1", 1, 2), ("z", 2, 2)}
    assert {r.campaign_id for r in settlement.by_minute(df).collect()} == {"c1", "z", "clicks"}
    assert {r.campaign_id: r.impressions for r in realtime.window_counts(realtime.replay(df)).collect()} == {"c1": 3, "z": 2, "clicks": 0, "pending": 1, "quart": 0}
    assert {r.source: r.n for r in settlement.source_mix(df.filter("ad_request_id = 'q'")).collect()} == {"client": 1}


@pytest.mark.parametrize(
    ("rt", "bt", "late", "ssai", "diff", "residual"),
    [(302, 290, 4, 16, -12, 0), (179, 180, 5, 4, 1, 0), (473, 477, 13, 9, 4, 0), (119, 119, 2, 2, 0, 0), (80, 81, 3, 2, 1, 0), (184, 188, 17, 6, 4, -7), (134, 133, 14, 6, -1, -9), (376, 377, 28, 14, 1, -13), (96, 96, 4, 2, 0, -2)],
)
def test_reconciliation_terms(spark, rt, bt, late, ssai, diff, residual):
    r = reconcile.with_terms(spark.createDataFrame([("c", rt, bt, bt + ssai, late)], "campaign_id string, rt long, bt long, raw long, late long")).first()
    assert (r.diff, r.residual, r.ssai) == (diff, residual, ssai)


def test_one_side_missing(spark):
    rows = spark.createDataFrame([("a", 0, 5, 5, 0), ("b", 5, 0, 0, 0), ("c", 0, 0, 0, 0)], "campaign_id string, rt long, bt long, raw long, late long")
    assert {r.campaign_id: r.likely_cause for r in reconcile.with_terms(rows).collect()} == {"a": "realtime missing", "b": "batch missing", "c": "no difference"}


def test_alerts(spark):
    rows = [(T, "c1", 43, 146), (T, "c2", 13, 76), (T, "edge", 5, 10), (T, "few", 1, 4), (T, "five", 2, 5), (T, "none", 3, 0)]
    got = realtime.alerts(spark.createDataFrame(rows, "window_start timestamp_ntz, campaign_id string, impressions long, requests long"))
    assert {r.campaign_id: round(r.imp_req_ratio, 3) for r in got.collect()} == {"c1": 0.295, "c2": 0.171, "five": 0.4}


NOW = 1_707_134_400_000


def test_ingest_reasons(spark):
    good = {"event_id": "e", "event_type": "Impression", "campaign_id": "c", "event_time": NOW}
    cases = [
        (good, None), ({**good, "event_id": None}, "missing_field:event_id"), ({**good, "campaign_id": " "}, "blank_field:campaign_id"), ({**good, "event_type": 7}, "unknown_event_type:7"),
        ({**good, "event_time": True}, "bad_event_time"), ({**good, "event_time": {"a": 1}}, "bad_event_time"), ({**good, "event_time": str(NOW + 300_000)}, None),
        ({**good, "event_time": NOW + 300_001}, "event_time_in_future"), ({**good, "event_time": "2024-02-05T21:00:00.5+09:00"}, None), ([1], "not_an_object"), ("text", "not_an_object"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, raw string")
    out = {r.i: r for r in ingest.routed(df, F.lit(NOW)).collect()}
    assert [out[i].reason for i in range(len(cases))] == [want for _, want in cases]
    value = json.loads(out[8].value)
    assert value["event_time"] == "2024-02-05T12:00:00.500Z" and value["source"] == "client" and out[8].topic == "ad.impression" and out[8].key == "e"
    assert {r.reason_class: r.n for r in ingest.reason_counts(ingest.split(df, F.lit(NOW)).rejected).collect()}["not_an_object"] == 2


def test_every_event_type_has_its_topic(spark):
    names = [(n.upper(), t) for t, ns in ingest.TOPICS.items() for n in ns]
    assert [r[0] for r in spark.createDataFrame(names, "n string, t string").select(ingest.topic(F.col("n")) == F.col("t")).collect()] == [True] * len(names)


def test_pixels(spark):
    secret = b"tidemark-test-key"
    sign = lambda q: hmac.new(secret, q.encode(), hashlib.sha256).hexdigest()
    plain = "cid=c 1&eid=e&exp=2000000000"
    good = "eid=e&cid=c+1&exp=2000000000&sig=" + sign(plain).upper()
    cases = [(good, None), ("eid=e&exp=1", "track_missing_sig"), ("eid=e&sig=aa", "track_missing_exp"), ("exp=x&sig=aa", "track_bad_exp"), ("exp=1&sig=aa", "track_expired"), (good.replace("eid=e", "eid=f"), "track_bad_signature")]
    df = spark.createDataFrame([(q,) for q, _ in cases], "q string").select(ingest.params(F.col("q")).alias("p"))
    assert [r[0] for r in df.select(ingest.pixel_reason(F.col("p"), secret, F.lit(1_700_000_000))).collect()] == [w for _, w in cases]
    event = json.loads(df.limit(1).select(ingest.pixel_event(F.col("p"), F.lit(NOW))).first()[0])
    assert event == {"event_id": "e", "event_type": "impression", "campaign_id": "c 1", "event_time": str(NOW), "source": "client", "transport": "pixel"}
    long = spark.createDataFrame([("k",)], "s string").select(hmac_sha256(b"x" * 100, F.lit("mé")), canonical(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("sig"), F.lit("z")))).first()
    assert long[0] == hmac.new(b"x" * 100, "mé".encode(), hashlib.sha256).hexdigest() and long[1] == "a=1&b=2"


def test_bodies(spark):
    cases = {'{"event_id":"1"}': 1, '[{"a":1},{"b":2}]': 2, '{"events":[{"a":1}]}': 1, "17": 0, "": 0, "[1,2,3,4]": 0, None: 0, "{broken": 0}
    df = spark.createDataFrame([(k,) for k in cases], "body string").withColumn("b", F.col("body"))
    got = {r.b: r["count"] for r in ingest.bodies(df, limit=3).groupBy("b").count().collect()}
    assert got == {k: n for k, n in cases.items() if n}


def test_measures(spark):
    s = spark.createDataFrame([("a", T + dt.timedelta(seconds=x), v) for x, v in ((0, 0), (2, 10), (4, 30), (30, 20), (30.5, 90))], "s string, t timestamp_ntz, v long")
    assert [r.rate for r in metrics.windowed_rate(s, ["s"], "t", "v", 8).orderBy("t").collect()] == [0.0, 5.0, 7.5, 0.0, 0.0]
    v = spark.createDataFrame([("a", x) for x in [*range(1, 101), None]], "k string, v long")
    assert metrics.nearest_rank(v, ["k"], "v", 0.95).first().value_at_p == 96
    lag = spark.createDataFrame([("t", 0, 10, 4), ("t", 1, 5, 9), ("t", 2, 7, None)], "topic string, partition int, end_offset long, committed long")
    assert metrics.consumer_lag(lag).first()[:] == ("t", 6, 22, 3)
    text = spark.createDataFrame([("# HELP x",), ('x{a="1"} 2',), ("x 3.5",), ("bad line",)], "value string")
    assert sorted((r.name, r.labels, r.value) for r in metrics.exposition(text).collect()) == [("x", "", 3.5), ("x", 'a="1"', 2.0)]


def test_outbox_counts(spark):
    rows = [(i, f"e{i}", i % 2 == 0, T) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id long, event_id string, published boolean, occurred_at timestamp_ntz")
    b = outbox.backlog(df, F.lit(T + dt.timedelta(seconds=90))).first()
    assert (b.total, b.unpublished, b.oldest_age_s, b.all_published) == (10, 5, 90, False)
    assert [r.id for r in outbox.head(df, 3).collect()] == [1, 3, 5]
    assert outbox.duplicate_stats(outbox.published(df, 3, 5)).first()[:] == (12, 10, 2)
    assert outbox.duplicate_stats(outbox.published(df, 3, 5, locked=False)).first()[:] == (36, 10, 26)


def test_gaps_and_overlay(spark):
    m = spark.createDataFrame([(dt.datetime(2024, 2, 5, 23, 58, 7), "A"), (dt.datetime(2024, 2, 6, 0, 1), "a "), (dt.datetime(2024, 2, 6, 0, 2), "a")], "minute_ts timestamp_ntz, campaign_id string")
    assert sorted(r.minute for r in serving.missing_minutes(m).collect()) == [dt.datetime(2024, 2, 5, 23, 59), dt.datetime(2024, 2, 6, 0, 0)]
    side = lambda *x: spark.createDataFrame([(T + dt.timedelta(minutes=i), n) for i, n in x], "minute timestamp_ntz, n long")
    got = [tuple(r)[1:] for r in serving.overlay(side((0, 5), (2, 7), (3, 1)), side((1, 4), (2, 6))).orderBy("minute").collect()]
    assert got == [(5, 0), (0, 4), (7, 6), (1, None)]
