"""Queries over whole tables for late events, missing references, differing copies and repeated messages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import MINUTE, arrival_us, floor_to, plain_key, wall_time, wall_us
from tidemark.operators import compare, late, redelivery, references
from tidemark.sources.tables import table
from tidemark.storage import written

SETTLED_FIELDS = ["minute_ts", "campaign_id", "impressions", "raw_impressions", "clicks", "completes", "requests"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    raw = late.late_firsts(table(spark, d, "impression_raw")).select(F.lit("impression_raw").alias("table_name"), "event_id")
    return raw.unionByName(late.late_recorded(table(spark, d, "late_dropped")).select(F.lit("late_dropped").alias("table_name"), "event_id"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """Impressions of ids with an arrival time, as its SQL has them."""
    return _periods(late.corrected_periods(table(spark, d, "impression_raw")))


def p1_periods_all(spark: SparkSession, d: str) -> DataFrame:
    """p1_periods with the ids that have an event time but no readable arrival."""
    return _periods(late.corrected_periods(table(spark, d, "impression_raw"), undated=True))


def _periods(rows: DataFrame) -> DataFrame:
    start = wall_time(F.col("period_end") - MINUTE)
    return rows.select(start.alias("minute_start"), F.col("group").alias("campaign_id"), F.col("n").alias("impressions"), "provisional", "frozen")


def _references(spark: SparkSession, d: str) -> DataFrame:
    return references.impression_references(*(table(spark, d, t) for t in ("src_impression", "campaigns", "campaign_rates", "event_outbox")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_records(_references(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_references(spark, d))


def p2_maintained(spark: SparkSession, d: str) -> DataFrame:
    """p2_found from a stored ledger: half of the impressions and a rate for every campaign come first, then the other half, and those rates are taken back."""
    impressions, campaigns, rates, outbox = (table(spark, d, t) for t in ("src_impression", "campaigns", "campaign_rates", "event_outbox"))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    state = written(references.ledger(*references.changes(impressions.filter(half == 0), campaigns, rates, outbox), *references.changes(rates=campaigns)), "ledger")
    state = written(references.ledger(state, *references.changes(impressions.filter(half == 1)), *references.changes(rates=campaigns, sign=-1)), "ledger")
    return references.orphan_records(references.offending(state, impressions, campaigns, rates))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    keys = {"minute_epoch": F.floor(floor_to(wall_us("minute_ts"), MINUTE) / 1_000_000), "campaign_id": plain_key("campaign_id")}
    return compare.differences(table(spark, d, "minute_settlement"), table(spark, d, "minute_settlement_copy"), keys, SETTLED_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    seen = redelivery.kept_once(table(spark, d, "src_impression"), "event_id", [arrival_us("server_ts")], ["event_id", "server_ts"], repeated_only=True)
    sent = redelivery.kept_once(table(spark, d, "event_outbox"), "event_id", [F.col("id")], ["event_id", "id"], repeated_only=True)
    return seen.select(F.lit("src_impression").alias("table_name"), "event_id", F.col("server_ts").alias("kept")).unionByName(
        sent.select(F.lit("event_outbox").alias("table_name"), "event_id", F.col("id").cast("string").alias("kept"))
    )


def p5_outbox(spark: SparkSession, d: str) -> DataFrame:
    """The outbox with one message per event_id, payloads included."""
    return redelivery.kept_once(table(spark, d, "event_outbox"), "event_id", [F.col("id")])


def p5_impressions(spark: SparkSession, d: str) -> DataFrame:
    """The impressions with one delivery per event_id, all columns."""
    return redelivery.kept_once(table(spark, d, "src_impression"), "event_id", [arrival_us("server_ts")])


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p1_periods_all, p2_found, p2_report, p2_maintained, p3_found, p5_found, p5_outbox, p5_impressions)}


# --- the same in DuckDB's SQL -------------------------------------------------------------------------------------------------------

_BLANK = r"' ' || chr(9) || chr(10) || chr(13)"


def sql_plain(c: str) -> str:
    return f"lower(trim({c}, {_BLANK}))"


def sql_request(c: str) -> str:
    return f"case when not regexp_matches({sql_plain(c)}, '^([a-z]*-)?0*$') then {sql_plain(c)} end"


def sql_campaign(c: str) -> str:
    return f"case when {sql_plain(c)} not in ('', '-', 'none', 'pending', 'nofill') then {sql_plain(c)} end"


def sql_arrival(c: str) -> str:
    zone = r"(Z|[+-]\d{2}(:?\d{2})?)$"
    return (
        rf"case when regexp_matches({c}, '^\d+$') then try_cast({c} as bigint) * 1000"
        rf" when regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}(:?\d{{2}})?)?$')"
        rf" then epoch_us(try_cast(case when length({c}) > 19 and regexp_matches({c}, '{zone}') then {c} else {c} || '+00' end as timestamptz)) end"
    )


_LOG = f"""log as (select event_id, {sql_plain("campaign_id")} as campaign_id, epoch_us(event_time) as et, {sql_arrival("server_ts")} as arr from impression_raw),
timed as (select * from log where arr is not null),
instants as (select arr, max(et) as m from timed group by arr),
marks as (select arr, max(m) over (order by arr rows between unbounded preceding and 1 preceding) - 10000000 as wm from instants),
ranked as (select t.*, wm, et - et % 60000000 + 60000000 as pe, min(t.arr) over (partition by event_id) as first_arr
           from timed t join marks using (arr) where event_id is not null),
firsts as (select event_id, min(arr) as arr, min(campaign_id) as campaign_id, min(pe) as pe, coalesce(bool_or(wm >= pe + 600000000), false) as rejected
           from ranked where arr = first_arr group by event_id)"""

_REFS = f"""imp as (select event_id, {sql_campaign("campaign_id")} as campaign, {sql_request("ad_request_id")} as request, event_time from src_impression),
out as (select {sql_request("aggregate_id")} as request, min(occurred_at) as said from event_outbox group by 1),
rated as (select distinct {sql_campaign("campaign_id")} as campaign from campaign_rates),
known as (select distinct {sql_campaign("campaign_id")} as campaign from campaigns),
refs as (
 select 'src_impression' as table_name, event_id as record_id, 'ad_request_id' as ref_field, case when said is null then 'missing' else 'later' end as status, event_time
 from imp left join out using (request) where request is not null and (said is null or said > event_time)
 union all
 select 'src_impression', event_id, 'campaign_id', case when exists (select 1 from known k where k.campaign = imp.campaign) then 'deleted' else 'missing' end, event_time
 from imp where campaign is not null and not exists (select 1 from rated r where r.campaign = imp.campaign)
 union all
 select 'campaign_rates', campaign, 'campaign_id', 'missing', null from rated where campaign is not null and not exists (select 1 from known k where k.campaign = rated.campaign))"""


def _side(t: str) -> str:
    return f"select distinct epoch_us(minute_ts) // 60000000 * 60 as minute_epoch, {sql_plain('campaign_id')} as key_campaign, {', '.join(SETTLED_FIELDS)} from {t}"


_P3 = " union all ".join(
    [
        f"select a.minute_epoch, a.key_campaign as campaign_id, '{f}' as difference from a join b on a.minute_epoch is not distinct from b.minute_epoch"
        f" and a.key_campaign is not distinct from b.key_campaign where a.{f} is distinct from b.{f}"
        for f in SETTLED_FIELDS
    ]
    + [
        f"select x.minute_epoch, x.key_campaign, '{word}' from {x} x where not exists (select 1 from {y} y where x.minute_epoch is not distinct from y.minute_epoch"
        " and x.key_campaign is not distinct from y.key_campaign)"
        for x, y, word in (("a", "b", compare.MISSING_IN_COPY), ("b", "a", compare.MISSING_IN_ORIGINAL))
    ]
)

_KEPT = f"""select event_id, server_ts, count(*) over (partition by event_id) as n,
 row_number() over (partition by event_id order by {sql_arrival("server_ts")} nulls last) as rn from src_impression where event_id is not null"""

SQL = {
    "p1_found": f"""with {_LOG} select 'impression_raw' as table_name, event_id from firsts where rejected
union all select 'late_dropped', event_id from (select event_id, min(epoch_us(event_time) - epoch_us(event_time) % 60000000 + 60000000) as pe, min(epoch_us(watermark_at)) as wm
 from late_dropped where event_id is not null and event_time is not null group by event_id) where wm >= pe + 600000000""",
    "p1_periods": f"""with {_LOG}, fin as (select max(arr) - 21600000000 as cut from firsts),
closing as (select pe, min(arr) as closes from (select distinct pe from firsts where pe is not null) p join (select arr, et from timed) t on et >= pe + 610000000 group by pe)
select make_timestamp(pe - 60000000) as minute_start, campaign_id, cast(count(*) filter (where not rejected) as bigint) as impressions,
 cast(count(*) filter (where not rejected and arr > cut) as bigint) as provisional, coalesce(bool_or(not rejected and arr <= cut and coalesce(closes <= cut, false)), false) as frozen
from firsts left join closing using (pe), fin where pe is not null group by pe, campaign_id having count(*) filter (where not rejected) > 0""",
    "p1_periods_all": f"""with {_LOG}, fin as (select max(arr) - 21600000000 as cut from firsts),
undated as (select event_id, min(arr) as arr, min(et - et % 60000000 + 60000000) as pe, arg_min(campaign_id, (et - et % 60000000, coalesce(campaign_id, ''))) as campaign_id, false as rejected from log
 where event_id is not null and event_id not in (select event_id from firsts) group by event_id),
ids as (select event_id, arr, pe, campaign_id, rejected from firsts union all select event_id, arr, pe, campaign_id, rejected from undated),
closing as (select pe, min(arr) as closes from (select distinct pe from ids where pe is not null) p join (select arr, et from timed) t on et >= pe + 610000000 group by pe)
select make_timestamp(pe - 60000000) as minute_start, campaign_id, cast(count(*) filter (where not rejected) as bigint) as impressions,
 cast(count(*) filter (where not rejected and coalesce(arr > cut, false)) as bigint) as provisional, coalesce(bool_or(not rejected and coalesce(arr <= cut, true) and coalesce(closes <= cut, false)), false) as frozen
from ids left join closing using (pe), fin where pe is not null group by pe, campaign_id having count(*) filter (where not rejected) > 0""",
    "p2_found": f"with {_REFS} select distinct table_name, record_id, ref_field, status from refs where record_id is not null",
    "p2_report": f"with {_REFS} select table_name, ref_field, status, cast(event_time as date) as event_day, cast(count(*) as bigint) as n_references from refs group by all",
    "p2_maintained": f"with {_REFS} select distinct table_name, record_id, ref_field, status from refs where record_id is not null",
    "p3_found": f"with a as ({_side('minute_settlement')}), b as ({_side('minute_settlement_copy')}) {_P3}",
    "p5_found": f"""select 'src_impression' as table_name, event_id, server_ts as kept from ({_KEPT}) where n > 1 and rn = 1
union all select 'event_outbox', event_id, cast(min(id) as varchar) from event_outbox where event_id is not null group by event_id having count(*) > 1""",
    "p5_outbox": "select * from event_outbox o where event_id is null or id = (select min(id) from event_outbox i where i.event_id = o.event_id)",
    "p5_impressions": f"""select * exclude (rn) from (select *, row_number() over (partition by event_id order by {sql_arrival("server_ts")} nulls last) as rn from src_impression)
where rn = 1 or event_id is null""",
}
