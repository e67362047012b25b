"""Queries of the ad-event ledger over whole tables, each with its SQL where SQL can say the same.

The plain `events` table gives ad events of all kinds (see sources.adapter); it is sparse, so its roll-ups use windows of an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import MINUTE, arrival_us, campaign_key, floor_to, plain_key, request_key, wall_time, wall_us
from tidemark.functions.signing import canonical, hmac_sha256
from tidemark.operators import archive, metrics, outbox, realtime, reconcile, serving, settlement
from tidemark.operators.realtime import Roll
from tidemark.plans.problems import sql_arrival, sql_campaign, sql_plain, sql_request
from tidemark.sources import adapter, ingest
from tidemark.sources.tables import table
from tidemark.storage import written

HOURLY = Roll(60 * MINUTE, 10 * MINUTE, None)
WITH_TTL = Roll(60 * MINUTE, 10 * MINUTE, 30 * MINUTE)
NOW = "2024-02-12T00:00:00"
NOW_MS = 1_707_696_000_000
SECRET = b"tidemark-test-key"


def _ad(spark: SparkSession, d: str) -> DataFrame:
    return adapter.ad_events(table(spark, d, "events"))


def _replay(spark: SparkSession, d: str, roll: Roll = HOURLY) -> DataFrame:
    return realtime.replay(_ad(spark, d), roll)


def _written_replay(spark: SparkSession, d: str) -> DataFrame:
    """The replay for several readers."""
    return written(_replay(spark, d).select("event_id", "kind", "campaign_id", "is_twin", "event_us", "arrival_us", "window_end_us", "late"), "replayed")


_WITH = f"with {adapter.SQL}"
_DEDUP = f"""{_WITH},
once as (select * from (select *, row_number() over (partition by event_id order by event_time nulls last, arrival_time nulls last, dup_flag nulls last) as rn,
 count(*) over (partition by event_id) as copies from ad) where rn = 1),
kept as (select * from once where campaign_id not in ('none', 'nofill', 'pending')),
bill as (select * from (select *, row_number() over (partition by coalesce(ad_request_id, event_id) order by case source when 'server' then 0 when 'client' then 1 else 3 end, event_time nulls last, event_id) as sr
 from kept where event_type = 'impression') where sr = 1)"""
_COUNTS = """cast(count(*) filter (where event_type = 'ad_response' and fill) as bigint) as requests, cast(count(*) filter (where event_type = 'click') as bigint) as clicks,
 cast(count(*) filter (where event_type = 'quartile' and quartile = 'complete') as bigint) as completes, cast(count(*) filter (where event_type = 'impression') as bigint) as raw_impressions,
 cast(coalesce(sum(copies - 1) filter (where event_type = 'impression'), 0) as bigint) as dupes_removed"""
_RT = f"""{_WITH},
src_rows as (select *, case when event_type = 'impression' and campaign_id is not null then 'impression' when event_type = 'click' and campaign_id is not null then 'click'
 when event_type = 'quartile' and campaign_id is not null then case when quartile = 'complete' then 'complete' else 'quartile' end
 when event_type = 'ad_response' and fill and campaign_id <> 'nofill' then 'request' end as kind from ad where event_type <> 'progress'),
instants as (select arrival_time, max(event_time) as m from src_rows group by arrival_time),
marks as (select arrival_time, max(m) over (order by arrival_time rows between unbounded preceding and 1 preceding) - interval 10 minute as wm from instants),
firsts as (select * from (select s.*, row_number() over (partition by event_id order by arrival_time, n) as rn from src_rows s where kind is not null) where rn = 1),
rt as (select f.*, date_trunc('hour', event_time) + interval 1 hour as window_end, coalesce(wm >= date_trunc('hour', event_time) + interval 1 hour - interval 1 millisecond, false) as late
 from firsts f join marks using (arrival_time)),
win as (select window_end - interval 1 hour as window_start, campaign_id, cast(count(*) filter (where kind = 'impression') as bigint) as impressions, cast(count(*) filter (where kind = 'click') as bigint) as clicks,
 cast(count(*) filter (where kind = 'complete') as bigint) as completes, cast(count(*) filter (where kind = 'request') as bigint) as requests,
 cast(sum(case when ssai_twin_of is not null then 1 else 0 end) as bigint) as ssai_dupes from rt where not late group by all)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- settlement -----------------------------------------------------------------------------------------------------------------


@query(f"""{_DEDUP} select cast(sum(copies) as bigint) as rows_before, cast(count(*) as bigint) as rows_after, cast(sum(copies - 1) as bigint) as removed,
 round(sum(copies - 1) * 100.0 / sum(copies), 2) as removed_pct from once""")
def settle_dedup_stats(spark, d):
    return settlement.dedup_stats(_ad(spark, d))


@query(f"""{_DEDUP}, c as (select cast(event_time as date) as dt, campaign_id, {_COUNTS} from kept group by all),
i as (select cast(event_time as date) as dt, campaign_id, count(*) as impressions, count(*) filter (where late_flag) as late_impressions from bill group by all)
select dt, campaign_id, requests, cast(coalesce(impressions, 0) as bigint) as impressions, clicks, completes, raw_impressions, dupes_removed, cast(coalesce(late_impressions, 0) as bigint) as late_impressions
from c left join i using (dt, campaign_id) where raw_impressions > 0""")
def settle_daily(spark, d):
    return settlement.daily(_ad(spark, d))


@query(f"""{_DEDUP}, c as (select date_trunc('minute', event_time) as minute_ts, campaign_id, {_COUNTS} from kept group by all),
i as (select date_trunc('minute', event_time) as minute_ts, campaign_id, count(*) as impressions from bill group by all)
select minute_ts, campaign_id, cast(coalesce(impressions, 0) as bigint) as impressions, raw_impressions, clicks, completes, requests
from c left join i using (minute_ts, campaign_id) where coalesce(impressions, 0) + raw_impressions + clicks + completes + requests > 0""")
def settle_minute(spark, d):
    return settlement.by_minute(_ad(spark, d))


@query(f"{_DEDUP} select source, cast(count(*) as bigint) as n from bill group by source")
def settle_source_mix(spark, d):
    return settlement.source_mix(_ad(spark, d))


@query(f"""{_WITH} select distinct t.event_id as twin_id, o.event_id as original_id, t.ad_request_id = o.ad_request_id as same_request
from ad t left join ad o on t.ssai_twin_of = o.event_id and o.event_type = 'impression' where t.ssai_twin_of is not null""")
def settle_twin_pairs(spark, d):
    return settlement.twin_pairs(_ad(spark, d))


@query(f"""with r as (select event_id, event_type, {sql_campaign("campaign_id")} as campaign_id, {sql_request("ad_request_id")} as ad_request_id, {sql_plain("source")} as source, event_time,
 {sql_arrival("server_ts")} as arr, _late, _dup from src_impression where event_id is not null),
once as (select * from (select *, row_number() over (partition by event_id order by event_time nulls last, arr nulls last, _dup nulls last, event_type nulls first, campaign_id nulls first,
 ad_request_id nulls first, source nulls first) as rn, count(*) over (partition by event_id) as copies from r) where rn = 1),
bill as (select * from (select *, row_number() over (partition by coalesce(ad_request_id, event_id) order by case source when 'server' then 0 when 'client' then 1 else 3 end, event_time nulls last, event_id) as sr
 from once where campaign_id is not null and event_type = 'impression') where sr = 1),
c as (select cast(event_time as date) as dt, campaign_id, count(*) as raw_impressions, sum(copies - 1) as dupes_removed from once where campaign_id is not null and event_type = 'impression' group by all),
i as (select cast(event_time as date) as dt, campaign_id, count(*) as impressions from bill group by all)
select c.dt, c.campaign_id, cast(coalesce(impressions, 0) as bigint) as impressions, cast(raw_impressions as bigint) as raw_impressions, cast(dupes_removed as bigint) as dupes_removed
from c left join i on c.dt is not distinct from i.dt and c.campaign_id = i.campaign_id""")
def settle_impressions(spark, d):
    """The archive's impressions, settled by day and campaign with ids read as the tables' rules say."""
    rows = table(spark, d, "src_impression").select(
        "event_id", "event_type", campaign_key("campaign_id").alias("campaign_id"), request_key("ad_request_id").alias("ad_request_id"), "quartile", F.lit(None).cast("boolean").alias("fill"),
        plain_key("source").alias("source"), "event_time", arrival_us("server_ts").alias("arrival_time"), F.col("_late").alias("late_flag"), F.col("_dup").alias("dup_flag"),
    )
    return settlement.daily(rows).select("dt", "campaign_id", "impressions", "raw_impressions", "dupes_removed")


# --- real time ------------------------------------------------------------------------------------------------------------------


@query(f"{_RT} select kind, cast(count(*) as bigint) as n, cast(sum(case when ssai_twin_of is not null then 1 else 0 end) as bigint) as twins from src_rows where kind is not null group by kind")
def rt_kinds(spark, d):
    rows = realtime.kinds(_ad(spark, d).filter("event_type != 'progress'")).filter("kind is not null")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("is_twin").alias("twins"))


@query(f"{_RT} select * from win")
def rt_window_counts(spark, d):
    return realtime.window_counts(_replay(spark, d), HOURLY)


@query(f"""{_RT} select w.*, cast(null as varchar) as advertiser, cast(null as varchar) as campaign_name, case when requests > 0 then cast(impressions as double) / requests end as imp_req_ratio
from win w where not exists (select 1 from campaigns c where lower(trim(c.campaign_id)) = w.campaign_id)""")
def rt_enriched(spark, d):
    """Windows of campaigns without metadata keep their counts (the adapter's campaigns are not in the table)."""
    return realtime.enriched(realtime.window_counts(_replay(spark, d), HOURLY), table(spark, d, "campaigns"))


@query(f"""{_RT} select window_start, campaign_id, impressions, requests, cast(impressions as double) / requests as imp_req_ratio from win
where requests >= 2 and cast(impressions as double) / requests < 0.9""")
def rt_alerts(spark, d):
    return realtime.alerts(realtime.window_counts(_replay(spark, d), HOURLY), 0.9, 2)


@query(f"""{_RT} select event_id, kind, campaign_id, event_time, window_end, cast(datesub('second', event_time, arrival_time) * 1000 as bigint) as lateness_ms from rt where late""")
def rt_late_events(spark, d):
    return realtime.late_events(_replay(spark, d))


@query(f"""{_RT} select cast(l // 600000 * 600000 as bigint) as from_ms, cast(count(*) as bigint) as n from (select datesub('second', event_time, arrival_time) * 1000 as l from rt where late) group by 1""")
def rt_lateness_hist(spark, d):
    late = realtime.late_events(_replay(spark, d))
    return realtime.lateness_histogram(F.col("lateness_ms"), late, 600_000)


@query(f"""{_WITH} select cast(count(*) as bigint) as kept, cast(count(distinct event_id) as bigint) as ids from
 (select event_id, came, lag(came) over (partition by event_id order by came) as before from (
   select event_id, arrival_time as came from ad where event_type = 'impression' union all select event_id, arrival_time + interval 2 hour from ad where event_type = 'impression' and n % 5 = 0))
where before is null or came - before >= interval 30 minute""")
def rt_dedup_ttl(spark, d):
    """Impressions with resends two hours later of every fifth: kept again, since the deduplication forgets an id after half an hour."""
    ad = _ad(spark, d).filter("event_type = 'impression'")
    again = ad.filter("n % 5 = 0").withColumn("arrival_time", F.timestamp_add("HOUR", F.lit(2), F.col("arrival_time")))
    rows = realtime.kinds(ad.unionByName(again)).withColumn("event_us", wall_us("event_time")).withColumn("arrival_us", wall_us("arrival_time"))
    kept = realtime.deliveries(rows, WITH_TTL.ttl_us)
    return kept.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("kept"), F.count("*").alias("ids"))


def _raw_log(spark, d) -> DataFrame:
    """impression_raw as the roll-up reads it; rows without event time are in no window."""
    null = lambda t: F.lit(None).cast(t)
    return table(spark, d, "impression_raw").filter("event_time is not null").select(
        null("bigint").alias("n"), "event_id", "event_type", plain_key("campaign_id").alias("campaign_id"), request_key("ad_request_id").alias("ad_request_id"), null("string").alias("quartile"),
        null("boolean").alias("fill"), "ssai_twin_of", "event_time", wall_time(arrival_us("server_ts")).alias("arrival_time"),
    )


_RAW = f"""with recursive log as materialized (select event_id, lower(event_type) as kind, {sql_plain("campaign_id")} as campaign_id, {sql_request("ad_request_id")} as ad_request_id,
 case when ssai_twin_of is not null then 1 else 0 end as twin, epoch_us(event_time) as et, {sql_arrival("server_ts")} as arr from impression_raw where event_time is not null),
instants as (select arr, max(et) as m from log where arr is not null group by arr),
marks as (select arr, max(m) over (order by arr rows between unbounded preceding and 1 preceding) - 10000000 as wm from instants),
rows as materialized (select * from log where arr is not null and event_id is not null and campaign_id is not null and kind in ('impression', 'ad_impression')),
chain(event_id, arr) as (select event_id, min(arr) from rows group by event_id
 union all select c.event_id, min(r.arr) from chain c join rows r on r.event_id = c.event_id and r.arr >= c.arr + 3600000000 group by c.event_id),
kept as (select * from (select r.*, row_number() over (partition by r.event_id, r.arr order by campaign_id, twin, et, ad_request_id nulls first) as rn from rows r join chain c on r.event_id = c.event_id and r.arr = c.arr) where rn = 1),
rt as (select k.*, wm, et - et % 60000000 + 60000000 as we, coalesce(wm >= et - et % 60000000 + 59999000, false) as late from kept k join marks using (arr)),
win as (select make_timestamp(we - 60000000) as window_start, campaign_id, cast(count(*) as bigint) as impressions, cast(0 as bigint) as clicks, cast(0 as bigint) as completes, cast(0 as bigint) as requests,
 cast(sum(twin) as bigint) as ssai_dupes from rt where not late group by all)"""


@query(f"""{_RAW}, dim as (select {sql_plain("campaign_id")} as campaign_id, min(advertiser) as advertiser, min(name) as campaign_name from campaigns group by 1)
select window_start, window_start + interval 1 minute as window_end, campaign_id, advertiser, campaign_name, impressions, clicks, completes, requests, cast(null as double) as imp_req_ratio, ssai_dupes,
 timestamp '{NOW}' as emitted_at from win left join dim using (campaign_id)""")
def rt_minute_records(spark, d):
    """The real-time job's minutes of impression_raw with its default parameters, in full."""
    windows = realtime.window_counts(realtime.replay(_raw_log(spark, d)))
    return realtime.minute_records(windows, table(spark, d, "campaigns"), F.lit(NOW).cast("timestamp_ntz"))


@query(f"""{_RAW} select event_id, 'impression' as event_type, campaign_id, ad_request_id, make_timestamp(et) as event_time, make_timestamp(we) as window_end, make_timestamp(wm) as watermark_at,
 cast((wm - et) // 1000000 * 1000 as bigint) as lateness_ms, 'ad.impression' as topic_origin from rt where late""")
def rt_late_records(spark, d):
    """What the real-time job's windows dropped of impression_raw, in full."""
    log = _raw_log(spark, d)
    times = log.select(wall_us("event_time").alias("event_us"), wall_us("arrival_time").alias("arrival_us"))
    return realtime.late_records(realtime.replay(log), realtime.watermarks(times, Roll().delay_us))


@query(f"""{_RAW} select cast(l // 10000 * 10000 as bigint) as from_ms, cast(count(*) as bigint) as n from (select (wm - et) // 1000000 * 1000 as l from rt where late) group by 1""")
def rt_late_records_hist(spark, d):
    """Late records by how far the watermark was past them, in steps of ten seconds."""
    return realtime.lateness_histogram(F.col("lateness_ms"), rt_late_records(spark, d))


@query(f"""{_RT} select '{realtime.LOW_RATIO}' as alert_type, campaign_id, window_start, window_start + interval 1 hour as window_end, impressions, requests, cast(impressions as double) / requests as imp_req_ratio,
 cast(0.9 as double) as threshold, 'impressions per request below 0.9' as message, timestamp '{NOW}' as detected_at from win where requests >= 2 and cast(impressions as double) / requests < 0.9""")
def rt_alert_records(spark, d):
    return realtime.alert_records(realtime.window_counts(_replay(spark, d), HOURLY), F.lit(NOW).cast("timestamp_ntz"), 0.9, 2, HOURLY)


@query(f"""{_WITH}, l as (select case event_type when 'impression' then 'ad.impression' when 'click' then 'ad.click' when 'quartile' then 'ad.quartile' when 'ad_response' then 'ad.request' end as source,
 epoch_us(event_time) as et, epoch_us(arrival_time) as arr from ad where event_type <> 'progress'),
i as (select arr, {", ".join(f"max(et) filter (where source = '{t}') as e{k}, max(arr) filter (where source = '{t}') as s{k}" for k, t in enumerate(("ad.impression", "ad.click", "ad.quartile", "ad.request")))} from l group by arr),
b as (select arr, {", ".join(f"max(e{k}) over w as e{k}, coalesce(max(s{k}) over w, (select min(arr) from l)) + 3600000000 > arr as a{k}" for k in range(4))} from i window w as (order by arr rows between unbounded preceding and 1 preceding)),
o as (select arr, case when not ({" or ".join(f"(a{k} and e{k} is null)" for k in range(4))}) then least({", ".join(f"case when a{k} then e{k} end" for k in range(4))}) - 600000000 end as own from b)
select make_timestamp(arr) as arrival_time, make_timestamp(max(own) over (order by arr)) as watermark_at from o""")
def rt_source_watermarks(spark, d):
    """The watermark at each arrival as the smallest of the topics' own, a topic without arrivals for an hour left out."""
    log = _ad(spark, d).filter("event_type != 'progress'").select(ingest.topic(F.col("event_type")).alias("source"), wall_us("event_time").alias("event_us"), wall_us("arrival_time").alias("arrival_us"))
    log = log.withColumn("source", F.coalesce("source", F.lit("ad.request")))
    marks = realtime.source_watermarks(log, ["ad.impression", "ad.click", "ad.quartile", "ad.request"], HOURLY.delay_us, 60 * MINUTE)
    return marks.select(wall_time(F.col("arrival_us")).alias("arrival_time"), wall_time(F.col("watermark_us")).alias("watermark_at"))


@query(f"""{_WITH}, r as (select date_trunc('day', event_time) as day, event_id, bool_or(fill) as fill from ad where event_type = 'ad_response' group by all)
select day, cast(count(*) as bigint) as responses, cast(count(*) filter (where not coalesce(fill, false)) as bigint) as no_fill, cast(count(*) filter (where not coalesce(fill, false)) as double) / count(*) as no_fill_ratio from r group by day""")
def rt_no_fill(spark, d):
    return realtime.no_fill_ratio(_ad(spark, d), F.date_trunc("day", "event_time").cast("timestamp_ntz").alias("day"))


# --- reconciliation --------------------------------------------------------------------------------------------------------------

_RECON = f"""{_RT},
once as (select * from (select *, row_number() over (partition by event_id order by event_time nulls last, arrival_time nulls last, dup_flag nulls last) as rn from ad) where rn = 1),
bill as (select * from (select *, row_number() over (partition by coalesce(ad_request_id, event_id) order by case source when 'server' then 0 when 'client' then 1 else 3 end, event_time, event_id) as sr
 from once where event_type = 'impression' and campaign_id not in ('none', 'nofill', 'pending')) where sr = 1),
terms as (select campaign_id, sum(rt) as rt, sum(bt) as bt, sum(raw) as raw, sum(late) as late from (
 select campaign_id, impressions as rt, 0 as bt, 0 as raw, 0 as late, window_start as moment from win
 union all select campaign_id, 0, 1, 0, 0, event_time from bill
 union all select campaign_id, 0, 0, 1, 0, event_time from once where event_type = 'impression' and campaign_id not in ('none', 'nofill', 'pending')
 union all select campaign_id, 0, 0, 0, 1, event_time from rt where late and kind = 'impression') where {{where}} group by campaign_id having sum(rt) + sum(bt) > 0),
recon as (select campaign_id, cast(rt as bigint) as realtime_impressions, cast(bt as bigint) as batch_impressions, cast(late as bigint) as late, cast(raw - bt as bigint) as ssai, cast(bt - rt as bigint) as diff,
 cast(bt - rt - (late - (raw - bt)) as bigint) as residual, round_even((bt - rt) / greatest(rt, bt, 1), 4) as diff_rate from terms)"""
_CAUSE = """case when realtime_impressions = 0 and batch_impressions > 0 then 'realtime missing' when batch_impressions = 0 and realtime_impressions > 0 then 'batch missing'
 when late = 0 and ssai = 0 and residual = 0 then 'no difference' else concat_ws(' , ', case when late <> 0 then 'late ' || printf('%+d', late) end,
 case when ssai <> 0 then 'ssai ' || printf('%+d', -ssai) end, case when residual <> 0 then 'residual ' || printf('%+d', residual) end) end as likely_cause, abs(diff_rate) > 0.05 as warn"""
_DAY = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


def _reconciled(spark, d, start=None, end=None) -> DataFrame:
    ad, rp = _ad(spark, d), _written_replay(spark, d)
    rt = realtime.window_counts(rp, HOURLY).filter(reconcile.in_range(F.col("window_start"), start, end)).select("campaign_id", F.col("impressions").alias("n"))
    batch = settlement.by_minute(ad).filter(reconcile.in_range(F.col("minute_ts"), start, end)).select("campaign_id", F.col("impressions").alias("n"), F.col("raw_impressions").alias("raw"))
    late = realtime.late_events(rp).filter("kind = 'impression'").filter(reconcile.in_range(F.col("event_time"), start, end)).select("campaign_id", F.lit(1).alias("n"))
    return reconcile.reconcile(rt, batch, late)


@query(f"{_RECON.format(where='true')} select *, {_CAUSE} from recon")
def recon_all(spark, d):
    return _reconciled(spark, d)


@query(f"{_RECON.format(where=f'''moment >= timestamp '{_DAY[0]}' and moment < timestamp '{_DAY[1]}' ''')} select *, {_CAUSE} from recon")
def recon_range(spark, d):
    return _reconciled(spark, d, *_DAY)


@query(f"""{_RECON.format(where='true')}, s as (select {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("realtime_impressions", "batch_impressions", "late", "ssai", "diff", "residual"))} from recon)
select *, round_even(diff / greatest(realtime_impressions, batch_impressions, 1), 4) as diff_rate from s""")
def recon_totals(spark, d):
    return reconcile.totals(_reconciled(spark, d))


# --- serving --------------------------------------------------------------------------------------------------------------------

_MIN = f"select date_trunc('minute', minute_ts) as minute, {sql_plain('campaign_id')} as campaign_id, * exclude (campaign_id) from minute_settlement"


@query(f"""select campaign_id, {", ".join(f"cast(sum({m}) as bigint) as {m}" for m in serving.MEASURES)}, cast(count(*) as bigint) as n_minutes from ({_MIN})
where minute >= timestamp '2024-02-05 06:00:00' and minute < timestamp '2024-02-05 18:00:00' group by campaign_id""")
def serve_summary(spark, d):
    return serving.summary(table(spark, d, "minute_settlement"), 1_707_112_830, 1_707_156_030)


@query(f"""select campaign_id, minute, cast(sum(impressions) as bigint) as impressions from ({_MIN}) where minute_ts > (select max(minute_ts) from minute_settlement) - interval 240 minute group by all""")
def serve_series(spark, d):
    return serving.series(table(spark, d, "minute_settlement"), 240)


@query("""select date_trunc('minute', t) as minute, kind, cast(count(*) as bigint) as n from (select event_id, kind, min(event_time) as t from late_dropped where event_id is not null group by all) group by all""")
def serve_late_by_minute(spark, d):
    return serving.late_by_minute(table(spark, d, "late_dropped"))


@query(f"""{_RT}, a as (select window_start, campaign_id, impressions, requests, cast(impressions as double) / requests as imp_req_ratio from win where requests >= 1 and impressions < requests)
select * from a order by window_start desc, campaign_id desc limit 100""")
def serve_newest_alerts(spark, d):
    return serving.newest(realtime.alerts(realtime.window_counts(_replay(spark, d), HOURLY), 1.0, 1), ["window_start", "campaign_id"], 100)


@query("""select event_id, max(recorded_at) as recorded_at, count(*) > 0 as present from late_dropped group by event_id""")
def serve_upserted_late(spark, d):
    """late_dropped as upserts by event_id leave it."""
    rows = table(spark, d, "late_dropped", "event_id", "recorded_at", "kind", "window_end")
    return serving.latest(rows, ["event_id"], "recorded_at").select("event_id", "recorded_at", F.lit(True).alias("present"))


@query(f"""select {sql_plain('c.campaign_id')} as campaign_id, advertiser, vertical, cast(coalesce(max(cpm), 0) as double) as cpm, cast(coalesce(max(cpc), 0) as double) as cpc
from campaigns c left join campaign_rates r on {sql_plain('c.campaign_id')} = {sql_plain('r.campaign_id')} where active group by 1, 2, 3""")
def serve_active_campaigns(spark, d):
    return serving.active_campaigns(table(spark, d, "campaigns"), table(spark, d, "campaign_rates"))


@query(f"""with m as (select distinct campaign_id, minute from ({_MIN}) where minute is not null), g as (select *, lead(minute) over (partition by campaign_id order by minute) as nxt from m)
select campaign_id, unnest(generate_series(minute + interval 1 minute, nxt - interval 1 minute, interval 1 minute)) as minute from g where nxt > minute + interval 1 minute""")
def metric_missing_minutes(spark, d):
    return serving.missing_minutes(table(spark, d, "minute_settlement"))


@query("""with r as (select date_trunc('minute', event_time) as minute, count(*) as n from impression_raw where event_time is not null group by 1),
b as (select date_trunc('minute', minute_ts) as minute, coalesce(sum(impressions), 0) as n from minute_settlement group by 1)
select coalesce(r.minute, b.minute) as minute, cast(coalesce(r.n, 0) as bigint) as realtime, case when coalesce(r.minute, b.minute) <= (select max(minute) from b) then cast(coalesce(b.n, 0) as bigint) end as batch
from r full join b on r.minute = b.minute""")
def metric_overlay(spark, d):
    at = lambda c: wall_time(floor_to(wall_us(c), MINUTE)).alias("minute")
    raw = table(spark, d, "impression_raw", "event_time").filter("event_time is not null").select(at("event_time"), F.lit(1).alias("n"))
    return serving.overlay(raw, table(spark, d, "minute_settlement").select(at("minute_ts"), F.col("impressions").alias("n")))


# --- ingestion ------------------------------------------------------------------------------------------------------------------


def _raw_events(spark, d) -> DataFrame:
    """Every row of `events` as an event's JSON, every 50th with one of ten faults."""
    m = F.col("event_id") % 500
    fault = lambda k: m == 50 * k
    text = F.to_json(
        F.struct(
            F.when(fault(0), " ").otherwise(F.concat(F.lit("evt-"), "event_id")).alias("event_id"),
            F.when(fault(1), "hover").when(fault(8), "CLICKTHROUGH").otherwise("Impression").alias("event_type"),
            F.when(~fault(2), F.concat(F.lit("cmp-"), F.col("user_id") % 5)).alias("campaign_id"),
            F.when(fault(3), "yesterday").when(fault(4), "2024-02-12T00:05:01+00:00").when(fault(5), "1707696300000").otherwise("2024-02-11T23:00:00.123456789Z").alias("event_time"),
            F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("req-"), "event_id")).alias("ad_request_id"),
        )
    )
    return table(spark, d, "events", "event_id", "user_id").select("event_id", F.when(fault(6), "[1, 2]").when(fault(7), "{broken").otherwise(text).alias("raw"))


_FAULTS = """r as (select event_id, case event_id % 500 when 0 then 'blank_field:event_id' when 50 then 'unknown_event_type:hover' when 100 then 'missing_field:campaign_id' when 150 then 'bad_event_time'
 when 200 then 'event_time_in_future' when 300 then 'not_an_object' when 350 then 'not_an_object' end as reason from events)"""


@query(f"with {_FAULTS} select event_id, reason from r")
def ingest_validate(spark, d):
    rows = ingest.routed(_raw_events(spark, d), F.lit(NOW_MS))
    return rows.select("event_id", "reason")


@query(f"""with {_FAULTS} select topic, key, cast(count(*) as bigint) as n from (select case when event_id % 500 = 400 then 'ad.click' else 'ad.impression' end as topic,
 case when event_id % 2 = 0 then 'req-' || event_id else 'evt-' || event_id end as key from r where reason is null) group by all""")
def ingest_route(spark, d):
    return ingest.split(_raw_events(spark, d), F.lit(NOW_MS)).valid.groupBy("topic", "key").agg(F.count("*").alias("n"))


def _typed_events(spark, d) -> DataFrame:
    """Every row of `events` as an event's JSON with fields of all types: source absent, null or given, times as numbers and texts."""
    e, m = F.col("event_id"), F.col("event_id") % 3
    source = F.when(m == 0, "").when(m == 1, ',"source":null').otherwise(',"source":"server"')
    text = F.concat(
        F.lit('{"event_id":"evt-'), e, F.lit('","event_type":"impression","campaign_id":"cmp-1","event_time":'),
        F.when(e % 2 == 0, "1707690000123").otherwise('"2024-02-11T23:00:00.5+01:00"'), F.lit(',"fill":'), F.when(e % 4 == 0, "true").otherwise("false"),
        F.lit(',"ad_slot":'), e % 7, F.lit(',"playhead_s":'), e % 100, F.lit('.5,"meta":{"a":'), e, F.lit(',"b":[1,null,"x"]},"note":null,"ad_request_id":"r \\"q\\""'), source, F.lit("}"),
    )
    return table(spark, d, "events", "event_id").select("event_id", text.alias("raw"))


@query("""select event_id, event_id % 4 = 0 as fill, cast(event_id % 7 as integer) as ad_slot, cast(event_id % 100 as double) + 0.5 as playhead_s, event_id as meta_a, '[1,null,"x"]' as meta_b,
 'r "q"' as request, case event_id % 3 when 0 then 'client' when 2 then 'server' end as source, 'v1_events' as endpoint, '2024-02-12T00:00:00.000Z' as server_ts,
 case when event_id % 2 = 0 then '2024-02-11T22:20:00.123Z' else '2024-02-11T22:00:00.500Z' end as event_time,
 'ad_request_id,ad_slot,campaign_id,event_id,event_time,event_type,fill,ingest_endpoint,meta,note,playhead_s,server_ts,source' as fields from events""")
def ingest_value(spark, d):
    """What the enriched record holds, read by a typed reader."""
    rows = ingest.routed(_typed_events(spark, d), F.lit(NOW_MS)).select("event_id", "value")
    read = F.from_json("value", "fill boolean, ad_slot int, playhead_s double, meta struct<a:bigint,b:string>, ad_request_id string, source string, ingest_endpoint string, server_ts string, event_time string")
    rows = rows.select("event_id", F.explode(F.array(read)).alias("r"), F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("fields"))
    named = {"fill": "fill", "ad_slot": "ad_slot", "playhead_s": "playhead_s", "meta.a": "meta_a", "meta.b": "meta_b", "ad_request_id": "request", "source": "source", "ingest_endpoint": "endpoint", "server_ts": "server_ts", "event_time": "event_time"}
    return rows.select("event_id", *[F.col(f"r.{c}").alias(a) for c, a in named.items()], "fields")


@query(f"""with {_FAULTS} select event_id, split_part(reason, ':', 1) as reason_class, case event_id % 500 when 300 then 'array' when 350 then 'string' else 'object' end as raw_kind, 'v1_events' as endpoint,
 '2024-02-12T00:00:00.000Z' as server_ts, true as own_id from r where reason is not null""")
def ingest_dlq_records(spark, d):
    """The rejects' records: raw as an object where it was JSON, an id for each even where two rejects are equal."""
    rows = _raw_events(spark, d)
    bad = ingest.split(rows, F.lit(NOW_MS), position=F.col("event_id")).rejected
    records = ingest.reject_records(bad, F.lit(NOW_MS)).select(F.explode(F.array(F.parse_json("value"))).alias("v"))
    get = lambda f, t="string": F.variant_get("v", f"$.{f}", t)
    seen = records.select(get("dlq_id").alias("dlq_id"), get("reason").alias("reason"), get("endpoint").alias("endpoint"), get("server_ts").alias("server_ts"), F.schema_of_variant(F.variant_get("v", "$.raw", "variant")).alias("kind"))
    origin = ingest.routed(rows, F.lit(NOW_MS)).filter("reason is not null").select("event_id", F.sha2(F.concat_ws("|", "reason", "raw", F.col("event_id").cast("string")), 256).alias("dlq_id"))
    kind = F.lower(F.regexp_extract("kind", "^[A-Z]+", 0))
    return seen.join(origin, "dlq_id").select("event_id", F.substring_index("reason", ":", 1).alias("reason_class"), kind.alias("raw_kind"), "endpoint", "server_ts", F.lit(True).alias("own_id"))


@query(f"with {_FAULTS} select split_part(reason, ':', 1) as reason_class, cast(count(*) as bigint) as n from r where reason is not null group by 1")
def ingest_dlq_reasons(spark, d):
    return ingest.reason_counts(ingest.split(_raw_events(spark, d), F.lit(NOW_MS)).rejected)


@query("""select shape, cast(sum(case shape when 0 then 1 when 1 then 2 when 2 then 3 else 0 end) as bigint) as n_events from (select event_id % 5 as shape from events) where shape < 3 group by shape""")
def ingest_bodies(spark, d):
    """Bodies of one object, an array of two, an object with three events, a number, and a batch over the limit."""
    one = F.to_json(F.struct(F.col("event_id").alias("event_id")))
    many = lambda k: F.concat(F.lit("["), F.array_join(F.array_repeat(one, k), ","), F.lit("]"))
    shape = F.col("event_id") % 5
    body = F.when(shape == 0, one).when(shape == 1, many(2)).when(shape == 2, F.concat(F.lit('{"events":'), many(3), F.lit("}"))).when(shape == 3, "17").otherwise(many(9))
    rows = table(spark, d, "events", "event_id").select(shape.alias("shape"), body.alias("body"))
    return ingest.bodies(rows, limit=8).groupBy("shape").agg(F.count("*").alias("n_events"))


@query("""select event_id, 'cid=cmp ' || (user_id % 5) || '&eid=evt-' || event_id || '&et=' || event_type || '&exp=' || case when event_id % 7 = 0 then '1707690000' else '1707697000' end as canonical,
 sha256('cid=cmp ' || (user_id % 5) || '&eid=evt-' || event_id || '&et=' || event_type || '&exp=' || case when event_id % 7 = 0 then '1707690000' else '1707697000' end) as digest from events""")
def pixel_canonical(spark, d):
    rows = _pixels(spark, d)
    return rows.select("event_id", canonical(F.col("p")).alias("canonical"), F.sha2(canonical(F.col("p")), 256).alias("digest"))


def _pixels(spark, d) -> DataFrame:
    exp = F.when(F.col("event_id") % 7 == 0, "1707690000").otherwise("1707697000")
    text = F.concat(F.lit("et="), F.col("event_type"), F.lit("&eid=evt-"), F.col("event_id"), F.lit("&cid=cmp+"), F.col("user_id") % 5, F.lit("&exp="), exp)
    rows = table(spark, d, "events", "event_id", "user_id", "event_type").select("event_id", F.explode(F.array(ingest.params(text))).alias("p"))
    sig = F.when(F.col("event_id") % 5 == 0, "00ff").when(F.col("event_id") % 5 != 1, F.upper(hmac_sha256(SECRET, canonical(F.col("p")))))
    signed = F.when(sig.isNull(), F.col("p")).otherwise(F.map_concat("p", F.create_map(F.lit("sig"), sig)))
    return rows.select("event_id", F.explode(F.array(signed)).alias("p"))


@query("""select event_id, case when event_id % 5 = 1 then 'track_missing_sig' when event_id % 7 = 0 then 'track_expired' when event_id % 5 = 0 then 'track_bad_signature' end as reason from events""")
def pixel_verify(spark, d):
    return _pixels(spark, d).select("event_id", ingest.pixel_reason(F.col("p"), SECRET, F.lit(NOW_MS // 1000)).alias("reason"))


@query("""select event_id, 'evt-' || event_id as id, event_type as kind, 'cmp ' || (user_id % 5) as campaign, 'client' as source, '1707696000000' as event_time from events""")
def pixel_event(spark, d):
    e = ingest.pixel_event(F.col("p"), F.lit(NOW_MS))
    get = lambda f: F.get_json_object(e, f"$.{f}")
    return _pixels(spark, d).select("event_id", get("event_id").alias("id"), get("event_type").alias("kind"), get("campaign_id").alias("campaign"), get("source").alias("source"), get("event_time").alias("event_time"))


# --- archive --------------------------------------------------------------------------------------------------------------------


@query("""select source_topic, dt, hour, cast(count(*) as bigint) as n, cast(count(*) filter (where late_flag) as bigint) as late from (
 select 'ad.impression' as source_topic, strftime(event_time, '%Y-%m-%d') as dt, strftime(event_time, '%H') as hour, _late as late_flag from src_impression
 union all select 'ad.request', strftime(occurred_at, '%Y-%m-%d'), strftime(occurred_at, '%H'), null from event_outbox) group by all""")
def archive_partitions(spark, d):
    return archive.partitions(_archive(spark, d))


def _archive(spark, d) -> DataFrame:
    sent = table(spark, d, "event_outbox").select("event_id", "event_type", F.col("aggregate_id").alias("ad_request_id"), F.col("occurred_at").alias("event_time"))
    return archive.archived({"ad.impression": table(spark, d, "src_impression"), "ad.request": sent})


@query("""select event_id, ad_request_id, server_ts, 'ad.impression' as source_topic from src_impression where event_time >= timestamp '2024-02-05 03:00:00' and event_time < timestamp '2024-02-05 05:00:00'
 and campaign_id in ('cmp-4993', 'cmp-8500')""")
def archive_lookup(spark, d):
    return _looked_up(spark, d, plain=False)


@query(f"""select event_id, ad_request_id, server_ts, 'ad.impression' as source_topic from src_impression where event_time >= timestamp '2024-02-05 03:00:00' and event_time < timestamp '2024-02-05 05:00:00'
 and {sql_plain("campaign_id")} in ('cmp-4993', 'cmp-8500')""")
def archive_lookup_all(spark, d):
    """archive_lookup with the rows whose campaign is written carelessly."""
    return _looked_up(spark, d, plain=True)


def _looked_up(spark, d, plain: bool) -> DataFrame:
    rows = archive.lookup(_archive(spark, d), "2024-02-05", ["03", "04"], {"campaign_id": ["cmp-4993", "cmp-8500"]}, plain)
    return rows.filter("source_topic = 'ad.impression'").select("event_id", "ad_request_id", "server_ts", "source_topic")


# --- outbox ---------------------------------------------------------------------------------------------------------------------


@query(f"""select cast(count(*) as bigint) as total, cast(count(*) filter (where not coalesce(published, false)) as bigint) as unpublished,
 coalesce(cast(floor((epoch_us(timestamp '{NOW}') - min(epoch_us(occurred_at)) filter (where not coalesce(published, false))) / 1000000) as bigint), 0) as oldest_age_s,
 coalesce(bool_and(published), true) as all_published from event_outbox""")
def outbox_backlog(spark, d):
    return outbox.backlog(table(spark, d, "event_outbox"), F.lit(NOW).cast("timestamp_ntz"))


@query("select id, event_id from event_outbox where not coalesce(published, false) order by id limit 100")
def outbox_head(spark, d):
    return outbox.head(table(spark, d, "event_outbox"), 100).select("id", "event_id")


@query("""select id, case when json_valid(payload) then json_extract_string(payload, '$.campaign_id') end as campaign, case when json_valid(payload) then json_extract_string(payload, '$.ad_request_id') end as request from event_outbox""")
def outbox_payload(spark, d):
    return outbox.payload_fields(table(spark, d, "event_outbox", "id", "payload"), {"campaign": "$.campaign_id", "request": "$.ad_request_id"})


@query("""with m as (select o.event_id, unnest(range(case when id % 50 = 0 then 6 else 3 end)) from event_outbox o)
select cast(count(*) as bigint) as messages, cast(count(distinct event_id) as bigint) as distinct_ids, cast(count(*) - count(distinct event_id) as bigint) as duplicates from m where event_id is not null""")
def outbox_publish(spark, d):
    return outbox.duplicate_stats(outbox.published(table(spark, d, "event_outbox", "id", "event_id"), workers=3, skip_every=50, locked=False))


# --- measures -------------------------------------------------------------------------------------------------------------------


@query("""with w as (select event_type, ts, event_id, first_value(epoch_us(ts)) over w as t0, first_value(event_id) over w as v0, last_value(event_id) over w as v1 from events
 window w as (partition by event_type order by epoch_us(ts) range between 86400000000 preceding and current row))
select event_type, ts, event_id as total, round(case when (epoch_us(ts) - t0) / 1000000 >= 1 then greatest((v1 - v0) / ((epoch_us(ts) - t0) / 1000000), 0) else 0 end, 9) as rate from w""")
def metric_windowed_rate(spark, d):
    """The rate over the trailing day of a counter (all events so far) that each type samples."""
    samples = table(spark, d, "events", "event_type", "ts", "event_id").withColumnRenamed("event_id", "total")
    return metrics.windowed_rate(samples, ["event_type"], "ts", "total", 86_400).withColumn("rate", F.round("rate", 9))


@query("""select event_type, cast(count(*) as bigint) as n, list_sort(list(user_id))[least(count(*) - 1, cast(floor(count(*) * 0.95) as bigint)) + 1] as value_at_p from events group by event_type""")
def metric_percentile(spark, d):
    return metrics.nearest_rank(table(spark, d, "events"), ["event_type"], "user_id", 0.95)


@query("""with o as (select event_type as topic, user_id % 6 as part, count(*) as e, count(*) - cast(max(user_id) % 7 as bigint) + 3 as c from events group by all)
select topic, cast(sum(greatest(e - c, 0)) as bigint) as lag, cast(sum(e) as bigint) as end_offset, cast(count(*) as bigint) as partitions from o group by topic""")
def metric_consumer_lag(spark, d):
    o = table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 6).alias("partition")).agg(F.count("*").alias("end_offset"), (F.count("*") - F.max("user_id") % 7 + 3).alias("committed"))
    return metrics.consumer_lag(o)


@query("""select 'events_total' as name, cast(sum(value) as double) as value, cast(count(distinct user_id % 4) as bigint) as alive from events where event_id % 10 <> 0""")
def metric_exposition(spark, d):
    """Counters written as text lines by four replicas, read back and merged."""
    e = table(spark, d, "events", "event_id", "user_id", "value")
    line = F.when(F.col("event_id") % 10 == 0, "# HELP events_total all").otherwise(F.concat(F.lit('events_total{type="x"} '), F.col("value").cast("string")))
    return metrics.merged_counters(metrics.exposition(e.select((F.col("user_id") % 4).alias("replica"), line.alias("line")), "line"))


@query(f"""{_WITH} select campaign_id, cast(count(*) filter (where quartile = 'complete') as bigint) as completes, cast(count(*) filter (where quartile = 'start') as bigint) as starts,
 count(*) filter (where quartile = 'complete') / nullif(count(*) filter (where quartile = 'start'), 0) as rate from ad group by campaign_id""")
def metric_completion_rate(spark, d):
    return metrics.completion_rate(_ad(spark, d), F.col("campaign_id"), "campaign_id")


@query(f"""select i.event_id, {sql_plain('i.ad_request_id')} as request, i.server_ts, o.id as outbox_id, l.watermark_at from src_impression i
left join (select {sql_plain('aggregate_id')} as k, min(id) as id from event_outbox group by 1) o on o.k = {sql_plain('i.ad_request_id')}
left join (select event_id, min(watermark_at) as watermark_at from late_dropped group by 1) l on l.event_id = i.event_id
where i.campaign_id = 'cmp-2193' and i.event_id is not null""")
def trace_impressions(spark, d):
    """Impressions of a campaign through the stores: their response in the outbox and, if the window dropped them, at which watermark."""
    return _traced(spark, d, F.col("campaign_id"), plain_key)


@query(f"""select i.event_id, {sql_request('i.ad_request_id')} as request, i.server_ts, o.id as outbox_id, l.watermark_at from src_impression i
left join (select {sql_request('aggregate_id')} as k, min(id) as id from event_outbox group by 1) o on o.k = {sql_request('i.ad_request_id')}
left join (select event_id, min(watermark_at) as watermark_at from late_dropped group by 1) l on l.event_id = i.event_id
where {sql_plain('i.campaign_id')} = 'cmp-2193' and i.event_id is not null""")
def trace_impressions_all(spark, d):
    """trace_impressions with the rows whose campaign is written carelessly; placeholders are no request and are not looked up."""
    return _traced(spark, d, plain_key("campaign_id"), request_key)


def _traced(spark, d, campaign, request) -> DataFrame:
    rows = table(spark, d, "src_impression", "event_id", "campaign_id", "ad_request_id", "server_ts").filter((campaign == "cmp-2193") & F.col("event_id").isNotNull())
    sent = table(spark, d, "event_outbox", "aggregate_id", "id").groupBy(request("aggregate_id").alias("request")).agg(F.min("id").alias("outbox_id"))
    late = table(spark, d, "late_dropped", "event_id", "watermark_at").groupBy("event_id").agg(F.min("watermark_at").alias("watermark_at"))
    return (
        rows.withColumn("request", request("ad_request_id")).join(sent, "request", "left").join(late, "event_id", "left").select("event_id", "request", "server_ts", "outbox_id", "watermark_at")
    )
