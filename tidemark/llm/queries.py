"""Queries of the training-data problems over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import plain_key
from tidemark.llm import bpe, distinct, mixing, skeleton, survivor
from tidemark.plans.problems import sql_arrival, sql_plain, sql_request
from tidemark.sources.tables import table
from tidemark.storage import written


def _user_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "src_impression", "user_id", "campaign_id", "event_time")
    dims = {"day": F.to_date("event_time"), "campaign_id": plain_key("campaign_id")}
    seen = written(distinct.facts(rows, plain_key("user_id"), dims), "facts")
    codes = written(distinct.dictionary(seen), "dictionary")
    return written(distinct.buckets(seen, codes, list(dims)), "buckets")


def _levels(stored: DataFrame) -> DataFrame:
    """Counts per day and campaign, per day, per campaign and overall: the last three merged from the first's bitmaps."""
    out = None
    for level, dims in (("day_campaign", ["day", "campaign_id"]), ("day", ["day"]), ("campaign", ["campaign_id"]), ("all", [])):
        n = distinct.count(distinct.union(stored, dims), dims)
        for c, kind in (("day", "date"), ("campaign_id", "string")):
            if c not in dims:
                n = n.withColumn(c, F.lit(None).cast(kind))
        n = n.select(F.lit(level).alias("level"), "day", "campaign_id", "n_distinct", F.lit(0.0).alias("error_bound"))
        out = n if out is None else out.unionByName(n)
    return out


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users per day and campaign, per day, per campaign and overall."""
    return _levels(_user_buckets(spark, d))


def p4_returning(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users by campaign that were seen on both 2024-02-05 and 2024-02-06: an AND of merged bitmaps."""
    import datetime

    days = [datetime.date(2024, 2, 5), datetime.date(2024, 2, 6)]
    return distinct.count(distinct.intersection(_user_buckets(spark, d), "day", days, ["campaign_id"]), ["campaign_id"]).filter("n_distinct > 0")


def p4_returning_all(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users by campaign that were seen on a day and on the next, for every day of the data."""
    dims = ["day", "campaign_id"]
    return distinct.count(distinct.returning(_user_buckets(spark, d), "day", ["campaign_id"]), dims).filter("n_distinct > 0")


def p4_maintained(spark: SparkSession, d: str) -> DataFrame:
    """p4_distinct from stored bitmaps: those of the days up to the middle one, to which the later days' bitmaps are added.

    The later days bring their new users into the dictionary; stored buckets and numbers stay as they are."""
    rows = table(spark, d, "src_impression", "user_id", "campaign_id", "event_time")
    dims = ["day", "campaign_id"]
    seen = written(distinct.facts(rows, plain_key("user_id"), {"day": F.to_date("event_time"), "campaign_id": plain_key("campaign_id")}), "facts")
    middle = seen.agg(F.percentile_approx(F.unix_date("day"), 0.5).alias("middle")).first()["middle"]
    early = F.coalesce(F.unix_date("day") <= F.lit(middle), F.lit(True))
    old = written(distinct.dictionary(seen.filter(early)), "dictionary")
    stored = written(distinct.buckets(seen.filter(early), old, dims), "buckets")
    codes = written(distinct.dictionary(seen.filter(~early), old), "dictionary")
    return _levels(stored.unionByName(written(distinct.buckets(seen.filter(~early), codes, dims), "buckets")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found(table(spark, d, "src_impression"))


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    return survivor.merged(table(spark, d, "src_impression"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents", "doc_id", "text"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from their ids, as digests and bytes: the round trip loses nothing."""
    rows = bpe.texts_of(p7_ids(spark, d))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").alias("n_bytes"))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    """Every mix at the largest size at which its sources reach their shares."""
    return mixing.mixture(table(spark, d, "documents", "doc_id", "text", "source", "lang"), table(spark, d, "mix_targets"), size_tokens=mixing.REACHABLE)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each is taken."""
    return _mixture(spark, d).copies.select("mix_name", "source", "doc_id", "n_tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares by mix and source, met within a hundredth of the target."""
    m = _mixture(spark, d)
    return mixing.shares(m.copies, m.docs, m.goals, mixing.REACHABLE, tolerance=0.01)


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    """The languages' and topics' own and reached shares by mix."""
    m = _mixture(spark, d)
    return mixing.marginals(m.copies, m.docs, m.goals)


def _looks(spark: SparkSession, d: str) -> DataFrame:
    return written(skeleton.digests(table(spark, d, "documents", "doc_id", "text")), "digests")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.alike_pairs(_looks(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document that looks like a different text, with its class."""
    return skeleton.alike_members(_looks(spark, d)).withColumnRenamed("key", "doc_id")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one form."""
    return skeleton.skeletons(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p4_distinct, p4_returning, p4_returning_all, p4_maintained, p6_found, p6_merged, p7_ids, p7_texts, p8_mix, p8_shares, p8_marginals, p9_found, p9_classes, p9_forms)}

_PLAIN = "lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13)))"
_USERS = f"""users as (select cast(event_time as date) as day, {_PLAIN.format(c="campaign_id")} as campaign_id, {_PLAIN.format(c="user_id")} as u from src_impression
 where user_id is not null and {_PLAIN.format(c="user_id")} != '')"""

_TEXTS = {"creative_id", "session_id", "user_id", "device", "content_id", "ad_pod_id"}


def _sql_filled(f: str) -> str:
    return f"({f} is not null and {f} <> '')" if f in _TEXTS else f"({f} is not null)"


_ORDER = "trust, missing, arr desc nulls last, event_id"
_GROUPS = f"""with recursive recs as materialized (select event_id, {sql_request("ad_request_id")} as request, {sql_plain("ssai_twin_of")} as twin,
 case {sql_plain("source")} when 'server' then 0 when 'client' then 1 else 2 end as trust, {" + ".join(f"cast(not {_sql_filled(f)} as integer)" for f in survivor.FIELDS)} as missing, arr,
 {", ".join(survivor.FIELDS)} from (select *, row_number() over (partition by event_id order by arr nulls last) as rn from (select *, {sql_arrival("server_ts")} as arr from src_impression)
 where event_id is not null) where rn = 1),
node as materialized (select event_id, coalesce('r:' || request, 'e:' || event_id) as v from recs),
edge as materialized (select a.v as a, b.v as b from recs r join node a using (event_id) join node b on b.event_id = r.twin where a.v <> b.v),
step as materialized (select a, b from edge union select b, a from edge),
reach(v, w) as (select distinct a, a from step union select r.v, s.b from reach r join step s on s.a = r.w),
root as materialized (select v, min(w) as root from reach group by v),
placed as materialized (select r.*, coalesce(root, v) as g from recs r join node using (event_id) left join root using (v)),
many as materialized (select * from (select *, count(*) over (partition by g) as n, min(event_id) over (partition by g) as group_id from placed) where n > 1)"""
_LAYERS = """, beats as materialized (select x.event_id as low, y.event_id as high from many x join many y on x.g = y.g and y.trust <= x.trust and y.missing <= x.missing
 and coalesce(y.arr, -9e18) >= coalesce(x.arr, -9e18) and (y.trust < x.trust or y.missing < x.missing or coalesce(y.arr, -9e18) > coalesce(x.arr, -9e18))),
depth(event_id, k) as (select event_id, 1 from many union select low, k + 1 from depth join beats on high = event_id),
layer as (select event_id, max(k) as layer from depth group by event_id),
deep as (select * from many join layer using (event_id))"""
_FILLED = ", ".join(f"first({c} order by layer, {_ORDER}) filter (where {_sql_filled(f)}) as {name}" for f in survivor.FIELDS for c, name in ((f, f), ("event_id", f"from_{f}")))

SQL: dict[str, str] = {
    "p6_found": f"{_GROUPS} select group_id, event_id as survivor_id from (select *, row_number() over (partition by g order by {_ORDER}) as place from many) where place = 1",
    "p6_merged": f"""{_GROUPS}{_LAYERS}, whole as (select min(group_id) as group_id, count(*) as n_records, first(event_id order by {_ORDER}) as survivor_id, {_FILLED} from deep group by g)
select group_id, survivor_id, cast(n_records as bigint) as n_records, {" + ".join(f"cast(coalesce(from_{f} <> survivor_id, false) as integer)" for f in survivor.FIELDS)} as n_filled,
 {", ".join(survivor.FIELDS)} from whole""",
    "p4_distinct": f"""with {_USERS}
select 'day_campaign' as level, day, campaign_id, cast(count(distinct u) as bigint) as n_distinct, cast(0 as double) as error_bound from users group by day, campaign_id
union all select 'day', day, null, count(distinct u), 0 from users group by day
union all select 'campaign', null, campaign_id, count(distinct u), 0 from users group by campaign_id
union all select 'all', null, null, count(distinct u), 0 from users""",
    "p4_returning_all": f"""with {_USERS}, d as (select distinct day, campaign_id, u from users where day is not null)
select x.day, x.campaign_id, cast(count(*) as bigint) as n_distinct from d x join d y on y.day = x.day + 1 and y.u = x.u and y.campaign_id is not distinct from x.campaign_id group by all""",
    "p4_returning": f"""with {_USERS} select campaign_id, cast(count(*) as bigint) as n_distinct from (select campaign_id, u from users where day in (date '2024-02-05', date '2024-02-06')
 group by campaign_id, u having count(distinct day) = 2) group by campaign_id""",
}
SQL["p4_maintained"] = SQL["p4_distinct"]
SQL["p7_texts"] = "select doc_id, md5(coalesce(text, '')) as digest, cast(strlen(coalesce(text, '')) as integer) as n_bytes from documents"
