"""The generator's rates and order of faults, and each experiment through ingestion, real time and settlement."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.signing import canonical, hmac_sha256
from tidemark.operators import realtime, settlement
from tidemark.sources import generator, ingest
from tidemark.sources.generator import Traffic

T = dt.datetime(2024, 2, 5, 12, 0, 10)


@pytest.fixture(scope="module")
def sent(spark):
    rows = generator.deliveries(generator.life(spark, 1500)).persist()
    yield rows
    rows.unpersist()


def _share(rows, test, of="true"):
    r = rows.agg(F.count_if(F.expr(test) & F.expr(of)).alias("a"), F.count_if(F.expr(of)).alias("b")).first()
    return r.a / r.b


def test_rates(sent):
    own = "copy = 'own'"
    near = lambda a, b, by=0.15: abs(a - b) <= max(by * b, 0.003)
    assert near(_share(sent, "_late", own), generator.LATE) and near(_share(sent, "forged", own), generator.FORGE) and near(_share(sent, "removed is not null", own), generator.BAD)
    n = lambda test: sent.filter(test).count()
    assert near(n("copy = 'twin'") / n("copy = 'own' and event_type = 'impression'"), generator.SSAI) and near(n("copy = 'dup'") / n(own), generator.DUP)
    assert near(_share(sent, "transport = 'pixel'", "copy = 'own' and event_type in ('impression', 'quartile', 'click') and not forged"), generator.PIXEL)


def test_order_of_faults(sent):
    assert sent.filter("copy = 'twin' and (_late or transport = 'pixel' or removed is not null)").count() == 0
    assert sent.filter("forged and transport <> 'pixel'").count() == 0
    assert sent.filter("event_type in ('progress', 'session_start', 'ad_request') and transport = 'pixel' and not forged").count() == 0
    late = sent.filter("_late").select(((F.col("at_ms") - F.unix_millis(F.col("event_time").cast("timestamp"))) / 1000).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert 30 <= late[0] and late[1] < 60
    shifted = sent.filter("copy = 'twin'").alias("t").join(sent.filter("copy = 'own' and _late").alias("o"), F.col("t.ssai_twin_of") == F.col("o.event_id"))
    assert shifted.count() > 0 and shifted.filter("t.event_time <= o.event_time").count() == 0
    again = sent.filter("copy = 'dup'").alias("d").join(sent.filter("copy = 'own'").alias("o"), F.col("d.event_id") == F.col("o.event_id")).select((F.col("d.sent_ms") - F.col("o.sent_ms")).alias("ms"))
    assert again.filter("ms < 500 or ms >= 3000").count() == 0 and again.count() > 0


def test_life_cycle(spark):
    rows = generator.life(spark, 600).persist()
    ads = rows.filter("ad_request_id is not null").groupBy("ad_request_id").agg(F.collect_set("event_type").alias("k"), F.count_if(F.expr("event_type = 'quartile'")).alias("q"), F.min("ad_slot").alias("slot"))
    assert ads.filter("not array_contains(k, 'ad_request') or not array_contains(k, 'ad_response')").count() == 0
    assert ads.filter("array_contains(k, 'click') and q < 3").count() == 0 and ads.filter("array_contains(k, 'impression') and (q < 1 or q > 5)").count() == 0
    assert rows.filter("event_type = 'ad_response' and not fill").select("ad_request_id").join(rows.filter("event_type = 'impression'"), "ad_request_id").count() == 0
    sizes = [r["count"] for r in rows.filter("event_type = 'ad_request'").groupBy("ad_pod_id").count().collect()]
    assert all(abs(sizes.count(n) / len(sizes) - p) < 0.05 for n, p in generator.PODS)
    assert {r[0] for r in rows.select("ad_duration_s").distinct().collect()} == {None, 15, 30}
    assert rows.count() == rows.select("event_id").distinct().count()
    assert sorted(map(str, generator.life(spark, 600).repartition(7).collect())) == sorted(map(str, rows.collect()))
    assert generator.life(spark, 600, Traffic(drop_impression=1.0)).filter("event_type = 'impression'").count() == 0
    rows.unpersist()


@pytest.mark.parametrize("mode", list(generator.MODES))
def test_pace(spark, sent, mode):
    rows = generator.paced(sent, mode)
    r = rows.agg(F.count("*").alias("n"), ((F.max("sent_ms") - F.min("sent_ms")) / 1000).alias("s"), F.min("sent_ms").alias("low")).first()
    assert abs(r.n / r.s / generator.MODES[mode] - 1) < 0.2
    if mode == "burst":
        assert rows.filter(F.pmod(F.col("sent_ms") - r.low, F.lit(60_000)) >= 50_000).count() == 0
    assert generator.paced(sent.limit(0), mode).count() == 0


def test_bodies_are_ingested(spark, sent):
    bodies = generator.as_bodies(sent)
    out = ingest.routed(ingest.bodies(bodies), F.lit(1_800_000_000_000))
    bad = out.filter("reason is not null")
    assert bad.filter("not reason like 'missing_field:%'").count() == 0 and bad.count() == sent.filter("transport = 'batch' and removed is not null").count()
    assert json.loads(out.filter("topic = 'ad.request' and value like '%ad_response%'").first().value)["fill"] in (True, False)


# pipeline's view of an experiment: accepted sendings, real-time impressions, raw rows, settled impressions, late, rejected, requests
EXPECT = {"normal": (1, 1, 1, 1, 0, 0, 0), "duplicate": (2, 1, 2, 1, 0, 0, 0), "ssai": (2, 2, 2, 1, 0, 0, 0), "late": (1, 0, 1, 1, 1, 0, 0), "bad_schema": (0, 0, 0, 0, 0, 1, 0), "forged": (0, 0, 0, 0, 0, 1, 0), "ad_request": (1, 0, 1, 0, 0, 0, 1)}


@pytest.mark.parametrize("kind", list(generator.EXPERIMENTS))
def test_experiment(spark, kind):
    now = F.lit(int((T - dt.datetime(1970, 1, 1)).total_seconds() * 1000) + 10_000)
    sent = generator.experiment(spark, kind, T)
    routed = ingest.routed(generator.as_bodies(sent).select(F.col("body").alias("raw"), "sent_ms"), now)
    params = F.create_map(F.lit("eid"), F.lit("probe"), F.lit("exp"), F.lit("2000000000"), F.lit("cid"), F.lit("cmp-probe"))
    sig = F.when(F.col("forged"), "00").otherwise(hmac_sha256(b"k", canonical(params)))
    pixels = sent.filter("transport = 'pixel'").select(ingest.pixel_reason(F.map_concat(params, F.create_map(F.lit("sig"), sig)), b"k", now / 1000).alias("reason"))
    rejected = routed.filter("reason is not null").count() + pixels.filter("reason is not null").count()
    fields = "event_id string, event_type string, campaign_id string, ad_request_id string, quartile string, fill boolean, source string, ssai_twin_of string, event_time timestamp"
    read = routed.filter("reason is null").select(F.from_json("value", fields).alias("e"), F.timestamp_millis("sent_ms").cast("timestamp_ntz").alias("arrival_time"))
    rows = read.select("e.*", "arrival_time", F.lit(1).alias("n"), F.lit(None).cast("boolean").alias("late_flag"), F.lit(None).cast("boolean").alias("dup_flag")).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    # traffic before, which has closed the window of 90 seconds ago, and after
    other = spark.createDataFrame([(f"o{i}", "impression", "other", f"r{i}", T + dt.timedelta(seconds=s)) for i, s in enumerate((-5, 200))], "event_id string, event_type string, campaign_id string, ad_request_id string, event_time timestamp_ntz")
    rows = rows.unionByName(other.withColumn("arrival_time", F.col("event_time")), allowMissingColumns=True)
    replayed = realtime.replay(rows)
    mine = "campaign_id = 'cmp-probe'"
    windows = realtime.window_counts(replayed).filter(mine).agg(F.coalesce(F.sum("impressions"), F.lit(0)).alias("i"), F.coalesce(F.sum("requests"), F.lit(0)).alias("r")).first()
    settled = settlement.daily(rows).filter(mine).agg(F.coalesce(F.sum("impressions"), F.lit(0))).first()[0]
    late = realtime.late_events(replayed).filter(mine).count()
    assert (routed.filter("reason is null").count(), windows.i, rows.filter(mine).count(), settled, late, rejected, windows.r) == EXPECT[kind]
