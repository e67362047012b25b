"""Queries that join, range over and report on what the ledger's operators left, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import campaign_key, click_url, minute_key, plain_key, request_key
from tidemark.operators import archive, metrics, outbox, realtime, reconcile, serving, settlement, trace
from tidemark.plans.ledger import _CAUSE, _DAY, _DEDUP, _RECON, _WITH, HOURLY, NOW, _ad, _archive, _raw_log, _replay, _written_replay
from tidemark.plans.ledger import SQL as _LEDGER_SQL
from tidemark.plans.problems import sql_campaign, sql_plain, sql_request
from tidemark.sources import ingest
from tidemark.sources.tables import table
from tidemark.storage import folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- serving --------------------------------------------------------------------------------------------------------------------


@query(f"""with r as (select minute_ts, campaign_id, computed_at, impressions from minute_settlement union all select minute_ts, campaign_id, computed_at, impressions from minute_settlement_copy),
f as (select * from r where minute_ts >= timestamp '2024-02-06 12:00:00' - interval 24 hour)
select minute_ts, campaign_id, max(computed_at) as computed_at, strftime(minute_ts, '%Y%m%d%H%M') as minute_key from f group by minute_ts, campaign_id""")
def serve_kept_minutes(spark, d):
    """Both copies of the minutes as upserts into a store that keeps a day leave them; the key of each by its minute."""
    columns = ("minute_ts", "campaign_id", "computed_at", "impressions")
    rows = table(spark, d, "minute_settlement", *columns).unionByName(table(spark, d, "minute_settlement_copy", *columns))
    kept = serving.kept_minutes(rows, F.lit("2024-02-06T12:00:00").cast("timestamp_ntz"), 24)
    return kept.select("minute_ts", "campaign_id", "computed_at", minute_key("minute_ts").alias("minute_key"))


@query(f"""with w as ({_LEDGER_SQL["rt_minute_records"]}), f as (select campaign_id, arg_min(advertiser, window_start) as advertiser, arg_min(campaign_name, window_start) as campaign_name from w
 where window_start >= timestamp '2024-02-05 06:00:00' and window_start < timestamp '2024-02-05 18:00:00' group by 1)
select w.campaign_id, cast(sum(impressions) as bigint) as impressions, cast(count(*) as bigint) as n_minutes, f.advertiser, f.campaign_name from w join f on f.campaign_id = w.campaign_id
where window_start >= timestamp '2024-02-05 06:00:00' and window_start < timestamp '2024-02-05 18:00:00' group by w.campaign_id, f.advertiser, f.campaign_name""")
def serve_named_summary(spark, d):
    """Half a day of the real-time job's minutes by campaign, with the advertiser and name of the first minute that has them."""
    windows = realtime.window_counts(realtime.replay(_raw_log(spark, d)))
    minutes = realtime.minute_records(windows, table(spark, d, "campaigns"), now()).withColumnRenamed("window_start", "minute_ts")
    rows = serving.summary(minutes.filter("campaign_id is not null"), 1_707_112_830, 1_707_156_030, ["advertiser", "campaign_name"])
    return rows.select("campaign_id", "impressions", "n_minutes", "advertiser", "campaign_name")


@query(f"""with a as ({_LEDGER_SQL["rt_alert_records"]}) select window_start, campaign_id, cast((select count(*) from a) as bigint) as total from a order by window_start desc, campaign_id desc limit 20""")
def serve_alert_ring(spark, d):
    """The newest alerts and the number of all."""
    windows = realtime.window_counts(_replay(spark, d), HOURLY)
    alerts = realtime.alerts(windows, 0.9, 2).select("window_start", "campaign_id")
    return serving.newest_of_all(alerts, ["window_start", "campaign_id"], 20)


@query(f"""with p as ({_LEDGER_SQL["archive_partitions"]}) select *, row_number() over (order by source_topic nulls first, dt nulls first, hour nulls first) as place from p order by source_topic nulls first, dt nulls first, hour nulls first limit 12""")
def report_first_partitions(spark, d):
    """A preview of the archive: the first twelve partitions."""
    return serving.report(archive.partitions(_archive(spark, d)), [F.col("source_topic"), F.col("dt"), F.col("hour")], 12)


@query(f"""with s as ({_LEDGER_SQL["settle_daily"]}) select dt, campaign_id, impressions, row_number() over (order by dt desc, campaign_id) as place from s order by dt desc, campaign_id limit 30""")
def report_newest_days(spark, d):
    """Settled days from the newest on, by campaign within a day: the first thirty rows."""
    rows = settlement.daily(_ad(spark, d)).select("dt", "campaign_id", "impressions")
    return serving.report(rows, [F.col("dt").desc(), F.col("campaign_id")], 30)


@query(f"""with r as ({_LEDGER_SQL["recon_all"]}) select campaign_id, residual, row_number() over (order by campaign_id) as place from r order by campaign_id limit 100""")
def report_campaigns(spark, d):
    """The campaigns of real time or settlement in order, the first hundred."""
    rows = _reconciled_days(spark, d).select("campaign_id", "residual")
    return serving.report(rows, [F.col("campaign_id")], 100)


@query(f"""with s as ({_LEDGER_SQL["settle_daily"]}) select dt, campaign_id, impressions, timestamp '{NOW}' as computed_at, row_number() over (order by dt, campaign_id) as place from s order by dt, campaign_id limit 50""")
def report_settled_days(spark, d):
    """Settled days by day and campaign, as stored: the first fifty rows."""
    rows = settlement.records(settlement.daily(settlement.found(_ad(spark, d))), now()).select("dt", "campaign_id", "impressions", "computed_at")
    return serving.report(rows, [F.col("dt"), F.col("campaign_id")], 50)


@query(f"""select *, timestamp '{NOW}' as computed_at from ({_LEDGER_SQL["settle_minute"]})""")
def settle_minute_records(spark, d):
    """The settled minutes as they are stored."""
    return settlement.records(settlement.by_minute(settlement.found(_ad(spark, d))), now())


@query("""select event_id, recorded_at, kind, campaign_id, window_end from (select *, row_number() over (partition by event_id order by recorded_at desc nulls last, kind desc nulls last, campaign_id desc nulls last,
 window_end desc nulls last) as rn from late_dropped) where rn = 1""")
def serve_upserted_late_rows(spark, d):
    """late_dropped as upserts by event_id leave it, with the newest row's values."""
    return serving.latest(table(spark, d, "late_dropped", "event_id", "recorded_at", "kind", "campaign_id", "window_end"), ["event_id"], "recorded_at")


@query(f"""{_DEDUP}, i as (select cast(event_time as date) as dt, campaign_id, count(*) as impressions from bill group by all),
m as (select cast(event_time as date) as dt, campaign_id, cast(sum(copies - 1) as bigint) as dupes_removed, cast(count(*) as bigint) as raw_impressions from kept where event_type = 'impression' group by all)
select dt, cast(sum(raw_impressions) as bigint) as raw_impressions, cast(sum(coalesce(impressions, 0)) as bigint) as impressions, cast(sum(raw_impressions - coalesce(impressions, 0)) as bigint) as twins_removed,
 cast(sum(dupes_removed) as bigint) as dupes_removed from m left join i using (dt, campaign_id) group by dt""")
def settle_days(spark, d):
    """Settled days over all campaigns: what deduplication and collapse removed."""
    rows = settlement.daily(_ad(spark, d)).groupBy("dt").agg(*[F.sum(c).alias(c) for c in ("raw_impressions", "impressions", "dupes_removed")])
    return rows.select("dt", "raw_impressions", "impressions", (F.col("raw_impressions") - F.col("impressions")).alias("twins_removed"), "dupes_removed")


# --- reconciliation --------------------------------------------------------------------------------------------------------------

_DT = "2024-01-15"


def _reconciled_days(spark, d, dt: str | None = None) -> DataFrame:
    """All days, or one, from the daily settlement."""
    replayed = _written_replay(spark, d)
    inside = (lambda c: reconcile.of_day(F.col(c), dt)) if dt else (lambda c: F.lit(True))
    rt = realtime.window_counts(replayed, HOURLY).filter(inside("window_start")).select("campaign_id", F.col("impressions").alias("n"))
    late = realtime.late_events(replayed).filter("kind = 'impression'").filter(inside("event_time")).select("campaign_id", F.lit(1).alias("n"))
    daily = settlement.daily(_ad(spark, d))
    daily = daily.filter(F.col("dt") == F.lit(dt).cast("date")) if dt else daily
    return reconcile.reconcile(rt, daily.select("campaign_id", F.col("impressions").alias("n"), F.col("raw_impressions").alias("raw")), late)


_OF_DAY = f"moment >= timestamp '{_DT} 00:00:00' and moment < timestamp '{_DT} 00:00:00' + interval 1 day"
_DAILY = f"{_RECON.format(where=_OF_DAY).replace('having sum(rt) + sum(bt) > 0', 'having bool_or(late = 0)')}, rep as (select *, {_CAUSE} from recon)"


@query(f"""{_DAILY} select timestamp '{NOW}' as run_at, date '{_DT}' as dt, campaign_id, realtime_impressions, batch_impressions, diff, diff_rate, likely_cause, 'daily' as scope from rep""")
def recon_daily(spark, d):
    """The reconciliation of one day, as its history keeps it."""
    return reconcile.reported(_reconciled_days(spark, d, _DT), now(), F.lit(_DT).cast("date"), "daily")


@query(_LEDGER_SQL["recon_range"])
def recon_served_range(spark, d):
    """The reconciliation of a range whose real-time side is the serving store's range summary."""
    start, end = (int((datetime.datetime.fromisoformat(x) - datetime.datetime(1970, 1, 1)).total_seconds()) for x in _DAY)
    replayed = _written_replay(spark, d)
    served = serving.summary(realtime.window_counts(replayed, HOURLY).withColumnRenamed("window_start", "minute_ts"), start, end)
    batch = settlement.by_minute(_ad(spark, d)).filter(reconcile.in_range(F.col("minute_ts"), *_DAY))
    late = realtime.late_events(replayed).filter("kind = 'impression'").filter(reconcile.in_range(F.col("event_time"), *_DAY)).select("campaign_id", F.lit(1).alias("n"))
    return reconcile.reconcile(served.select("campaign_id", F.col("impressions").alias("n")), batch.select("campaign_id", F.col("impressions").alias("n"), F.col("raw_impressions").alias("raw")), late)


@query(f"""{_DAILY} select timestamp '{NOW}' as run_at, date '{_DT}' as dt, campaign_id, realtime_impressions, batch_impressions, diff, diff_rate, likely_cause, 'daily' as scope from rep""")
def recon_latest_run(spark, d):
    """The newest of two runs in the history: an earlier one over all days, and that of one day."""
    before = reconcile.reported(_reconciled_days(spark, d), F.timestamp_add("HOUR", F.lit(-1), now()), F.lit(None).cast("date"), "range")
    return reconcile.latest_run(before.unionByName(recon_daily(spark, d)))


# --- archive and traces ------------------------------------------------------------------------------------------------------------


def _topics(spark, d) -> dict[str, DataFrame]:
    """The ad events by the topic they come by, all five."""
    rows = _ad(spark, d).withColumn("server_ts", F.date_format("arrival_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumnsRenamed({"late_flag": "_late", "dup_flag": "_dup"})
    where = F.coalesce(ingest.topic(F.col("event_type")), F.lit("ad.request"))
    return {t: rows.filter(where == t) for t in ingest.TOPICS}


_TOPIC = """case event_type when 'impression' then 'ad.impression' when 'click' then 'ad.click' when 'quartile' then 'ad.quartile' when 'ad_response' then 'ad.request' else 'user.behavior' end"""


@query(f"""{_WITH} select {_TOPIC} as source_topic, strftime(event_time, '%Y-%m-%d') as dt, strftime(event_time, '%H') as hour, cast(count(*) as bigint) as n,
 cast(count(*) filter (where late_flag) as bigint) as late from ad group by all""")
def archive_topics(spark, d):
    """All five topics in one archive."""
    return archive.partitions(archive.archived(_topics(spark, d)))


@query(f"""{_WITH} select event_id, campaign_id, source_topic from (select *, {_TOPIC} as source_topic from ad) where event_time >= timestamp '{_DT} 00:00:00' and event_time < timestamp '{_DT} 06:00:00'
 and ad_request_id in (select ad_request_id from ad where event_type = 'click')""")
def archive_stored_lookup(spark, d):
    """Rows of six hours of the stored archive whose request was clicked at any time: only those hours' folders are read, the ids come as a table."""
    path = folder(spark, "archive")
    archive.write(archive.archived(_topics(spark, d)), path)
    stored = archive.read(spark, path)
    clicked = stored.filter("source_topic = 'ad.click' and ad_request_id is not null").select("ad_request_id").distinct()
    hours = archive.lookup(stored, _DT, [f"{h:02}" for h in range(6)], {})
    return hours.join(clicked, "ad_request_id", "left_semi").select("event_id", "campaign_id", "source_topic")


def _records(spark, d) -> DataFrame:
    """`events` as records of topics: a topic for each type, six partitions, every tenth record a reject that holds its event."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    own = F.struct(F.concat(F.lit("evt-"), "event_id").alias("event_id"), F.concat(F.lit("req-"), F.col("event_id") % 500).alias("ad_request_id"))
    value = F.when(F.col("event_id") % 10 == 0, F.to_json(F.struct(F.lit("track_expired").alias("reason"), own.alias("raw")))).otherwise(F.to_json(own))
    return e.select(F.concat(F.lit("t."), "event_type").alias("topic"), (F.col("user_id") % 6).cast("int").alias("partition"), F.col("event_id").cast("bigint").alias("offset"), value.alias("value"))


@query("""with r as (select 't.' || event_type as topic, cast(user_id % 6 as integer) as part, event_id, 'req-' || event_id % 500 as request from events where event_id >= 100 and event_id < 700),
ids as (select 'req-' || range as id from range(0, 50) union all select 'evt-' || range from range(0, 10000, 7)), k as (select 'evt-' || event_id as id, * from r union all select request, * from r)
select id, topic, part as "partition", event_id as "offset", case when event_id % 10 = 0 then 'track_expired' end as reason from k where id in (select id from ids)""")
def trace_scan(spark, d):
    """Records between remembered and present offsets that carry one of a set of ids, rejects too; the scan is made twice with an overlap."""
    rows = _records(spark, d)
    parts = rows.select("topic", "partition").distinct()
    bounds = lambda lo, hi: parts.select("topic", "partition", F.lit(lo).cast("bigint").alias("start_offset"), F.lit(hi).cast("bigint").alias("end_offset"))
    seen = trace.seen_once(trace.bounded(rows, bounds(100, 450)).unionByName(trace.bounded(rows, bounds(400, 700))))
    ids = spark.range(50).select(F.concat(F.lit("req-"), "id").alias("id")).unionByName(spark.range(0, 10_000, 7).select(F.concat(F.lit("evt-"), "id").alias("id")))
    return trace.matched(seen, ids)


# --- outbox ---------------------------------------------------------------------------------------------------------------------


@query(f"""select 'evt-outbox-' || substring(sha256(request), 1, 16) as event_id, request as aggregate_id, 17 as n_fields, coalesce(campaign, 'nofill') as campaign, campaign is not null as fill, 'server' as source,
 'outbox' as transport, session_id is null as session_null, 'https://ads.example/click/' || campaign || '?arid=' || request as url
from (select distinct {sql_request("ad_request_id")} as request, {sql_campaign("campaign_id")} as campaign, session_id from src_impression) where request is not null and (campaign is null or regexp_matches(campaign, '^[a-z0-9-]*$'))
 and regexp_matches(request, '^[a-z0-9-]*$')""")
def outbox_messages(spark, d):
    """The responses that impressions would have had, written as payloads and read back."""
    rows = table(spark, d, "src_impression").select(request_key("ad_request_id").alias("ad_request_id"), campaign_key("campaign_id").alias("campaign_id"), "session_id").distinct()
    plain = F.col("ad_request_id").rlike("^[a-z0-9-]*$") & (F.col("campaign_id").isNull() | F.col("campaign_id").rlike("^[a-z0-9-]*$"))
    out = outbox.messages(rows.filter(F.col("ad_request_id").isNotNull() & plain), now())
    get = lambda f: F.get_json_object("payload", f"$.{f}")
    campaign = F.when(get("campaign_id") != "nofill", get("campaign_id"))
    return out.select(
        "event_id", "aggregate_id", F.size(F.json_object_keys("payload")).alias("n_fields"), get("campaign_id").alias("campaign"), get("fill").cast("boolean").alias("fill"), get("source").alias("source"),
        get("transport").alias("transport"), get("session_id").isNull().alias("session_null"), click_url("https://ads.example/click/", campaign, F.col("aggregate_id")).alias("url"),
    )


@query("""with r as (select id, event_id, id % 97 = 0 as fails, row_number() over (order by id) - 1 as rank from event_outbox),
b as (select *, coalesce(max(case when fails then rank end) over (order by id), 0) as begun from r), p as (select *, rank - (rank - begun) % 100 as poll from b)
select poll, cast(count(*) as bigint) as messages, cast(count(*) * case when poll % 7 = 0 then 2 else 1 end as bigint) as sent from p group by poll""")
def outbox_polls(spark, d):
    """Messages and sendings by poll of a worker that publishes a hundred at a time in order, where every message of an id divisible by 97 fails once and every poll from a place divisible by 7 is not marked."""
    rows = outbox.published_in_order(table(spark, d, "event_outbox", "id", "event_id"), 100, F.col("id") % 97 == 0, F.col("poll") % 7 == 0)
    return rows.groupBy("poll").agg(F.count_if(F.col("attempt") == 1).alias("messages"), F.count("*").alias("sent"))


# --- measures -------------------------------------------------------------------------------------------------------------------


@query("""select cast(coalesce(sum(value), 0) as double) as value, cast(count(*) as bigint) as lines from (select cast(cast(value as varchar) as double) as value, user_id % 3 as kind, event_type from events) where kind = 1 and event_type = 'click'""")
def metric_label_sum(spark, d):
    """A counter's sum over the lines with two given labels."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    line = F.concat(F.lit('sent_total{kind="'), F.col("user_id") % 3, F.lit('",type="'), "event_type", F.lit('"} '), F.col("value").cast("string"))
    return metrics.label_sum(metrics.exposition(e.select(line.alias("line")), "line"), "sent_total", {"kind": "1", "type": "click"})


@query("""select cast(count(distinct user_id % 4) as bigint) as alive, cast(6 as bigint) as total from events""")
def metric_replicas(spark, d):
    """Four of six replicas report."""
    scrapes = table(spark, d, "events", "user_id").select((F.col("user_id") % 4).cast("bigint").alias("replica"))
    return metrics.replicas(scrapes, spark.range(6).withColumnRenamed("id", "replica"))


@query("""with s as (select event_type as topic, date_trunc('hour', ts) as hour_ts, cast(sum(event_id) as bigint) as total from events group by all),
w as (select *, first_value(epoch_us(hour_ts)) over w as t0, first_value(total) over w as v0 from s window w as (partition by topic order by epoch_us(hour_ts) range between 86400000000 preceding and current row))
select topic, hour_ts, total, round(case when (epoch_us(hour_ts) - t0) / 1000000 >= 1 then greatest((total - v0) / ((epoch_us(hour_ts) - t0) / 1000000), 0) else 0 end, 9) as rate from w""")
def metric_topic_totals(spark, d):
    """Sums of the partitions' ends by topic and hour, and their rate over a day."""
    e = table(spark, d, "events", "event_type", "ts", "user_id", "event_id")
    ends = e.select(F.col("event_type").alias("topic"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"), (F.col("user_id") % 6).alias("partition"), F.col("event_id").alias("end_offset"))
    return metrics.topic_totals(ends, 86_400).withColumn("rate", F.round("rate", 9)).withColumnRenamed("at", "hour_ts")


@query(f"""select {sql_plain("device")} as device, cast(count(*) filter (where quartile = 'complete') as bigint) as completes, cast(count(*) filter (where quartile = 'start') as bigint) as starts,
 count(*) filter (where quartile = 'complete') / nullif(count(*) filter (where quartile = 'start'), 0) as rate from src_impression group by 1""")
def metric_device_completion(spark, d):
    return metrics.completion_rate(table(spark, d, "src_impression", "device", "quartile"), plain_key("device"), "device")
