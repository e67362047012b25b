"""Orphan references, from signed counts per key.

Every change of a referring table is a delta of references to a key (+1 added, -1 removed), every change of a referred table
a delta of existence. A ledger holds, per key, the sums of both. Keys with positive references and no existence are the
orphan report; a key whose first existence is younger than its earliest reference has references that were early.
New deltas are added to a stored ledger by one more aggregation, so the report is kept without reading old tables again. One ledger holds all references:
its keys carry a prefix for the field that refers.

Counting is by long sums and minima: combined before the shuffle, so a key that holds a third of the rows is one row from each
map task. The referring table is read once for the counts, whatever the number of its fields, and once to go back from keys to records. That is a join with
the reported keys only, which are written before: both its sides are plain shuffles, so Spark splits the big side where a key is hot.

Cases. A null or invalid key is no reference and no existence. Repeated rows count as often as they come, in both signs. A null time
is no time: such a reference is never early. Empty tables give empty ledgers. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import campaign_key, request_key, wall_us
from tidemark.storage import written


def reference_deltas(rows: DataFrame, key: Column, at_us: Column | None = None, sign: int = 1) -> DataFrame:
    return _deltas(rows, key, refs=sign, exists=0, ref_us=at_us if sign > 0 else None)


def existence_deltas(rows: DataFrame, key: Column, at_us: Column | None = None, sign: int = 1) -> DataFrame:
    return _deltas(rows, key, refs=0, exists=sign, exists_us=at_us if sign > 0 else None)


def _deltas(rows: DataFrame, key: Column, refs: int, exists: int, ref_us: Column | None = None, exists_us: Column | None = None) -> DataFrame:
    no = F.lit(None).cast("bigint")
    return rows.select(
        key.alias("key"), F.lit(refs).cast("bigint").alias("refs"), F.lit(exists).cast("bigint").alias("exists"),
        (no if ref_us is None else ref_us).alias("first_ref_us"), (no if exists_us is None else exists_us).alias("first_exists_us"),
    ).filter("key is not null")


def ledger(*changes: DataFrame) -> DataFrame:
    """The sums of deltas and earlier ledgers: key, refs, exists, first_ref_us, first_exists_us. Keys that sum to nothing are dropped.

    first_exists_us of a key is the earliest ever seen, also of an existence taken back since."""
    rows = changes[0]
    for more in changes[1:]:
        rows = rows.unionByName(more)
    sums = rows.groupBy("key").agg(
        F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), F.min("first_ref_us").alias("first_ref_us"), F.min("first_exists_us").alias("first_exists_us")
    )
    return sums.filter("refs != 0 or exists != 0")


def orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.filter("refs > 0 and exists <= 0")


def early_or_orphan(state: DataFrame) -> DataFrame:
    """Keys with at least one reference to nothing, or older than the key's first existence."""
    return state.filter("refs > 0 and (exists <= 0 or first_ref_us < first_exists_us)")


#: Prefixes of the keys that impressions and rates refer by.
BY_CAMPAIGN, BY_REQUEST, BY_RATE = "campaign:", "request:", "rate:"
_NAMES = {BY_CAMPAIGN: ("src_impression", "campaign_id"), BY_REQUEST: ("src_impression", "ad_request_id"), BY_RATE: ("campaign_rates", "campaign_id")}


def _prefixed(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key)


def _impression_refs(impressions: DataFrame) -> DataFrame:
    """(record_id, key, event_us), a row for each reference of an impression."""
    keys = F.array_compact(F.array(_prefixed(BY_CAMPAIGN, campaign_key("campaign_id")), _prefixed(BY_REQUEST, request_key("ad_request_id"))))
    return impressions.select(F.col("event_id").alias("record_id"), F.explode(keys).alias("key"), wall_us("event_time").alias("event_us"))


def changes(impressions: DataFrame | None = None, campaigns: DataFrame | None = None, rates: DataFrame | None = None, outbox: DataFrame | None = None, sign: int = 1) -> list[DataFrame]:
    """The deltas of rows that were added to tables (sign 1) or removed (sign -1), for ledger().

    Impressions refer to rates and to outbox messages, rates to campaigns."""
    out = []
    if impressions is not None:
        refs = _impression_refs(impressions)
        out.append(reference_deltas(refs, F.col("key"), F.when(F.col("key").startswith(BY_REQUEST), F.col("event_us")), sign))
    if outbox is not None:
        out.append(existence_deltas(outbox, _prefixed(BY_REQUEST, request_key("aggregate_id")), wall_us("occurred_at"), sign))
    if rates is not None:
        out.append(existence_deltas(rates, _prefixed(BY_CAMPAIGN, campaign_key("campaign_id")), sign=sign))
        out.append(reference_deltas(rates, _prefixed(BY_RATE, campaign_key("campaign_id")), sign=sign))
    if campaigns is not None:
        out.append(existence_deltas(campaigns, _prefixed(BY_RATE, campaign_key("campaign_id")), sign=sign))
    return out


def offending(state: DataFrame, impressions: DataFrame, campaigns: DataFrame, rates: DataFrame) -> DataFrame:
    """Every reference of a ledger's keys to what does not exist or came later: table_name, record_id, ref_field, status, event_us.

    One row for each offending reference; a record that was delivered twice comes twice, a rate's campaign once. record_id may be null here."""
    known = existence_deltas(campaigns, _prefixed(BY_CAMPAIGN, campaign_key("campaign_id"))).select("key", F.lit(True).alias("known")).distinct()
    reported = written(early_or_orphan(state).join(known, "key", "left").select("key", "exists", "first_exists_us", "known"), "reported")
    rated = rates.select(campaign_key("campaign_id").alias("record_id")).filter("record_id is not null").distinct()
    rated = rated.select("record_id", _prefixed(BY_RATE, F.col("record_id")).alias("key"), F.lit(None).cast("bigint").alias("event_us"))
    refs = _impression_refs(impressions).unionByName(rated).join(reported, "key")
    status = F.when(F.col("exists") > 0, F.when(F.col("first_exists_us") > F.col("event_us"), "later")).when(F.col("known"), "deleted").otherwise("missing")
    named = lambda i: F.coalesce(*[F.when(F.col("key").startswith(prefix), names[i]) for prefix, names in _NAMES.items()])
    refs = refs.select(named(0).alias("table_name"), "record_id", named(1).alias("ref_field"), status.alias("status"), "event_us")
    return refs.filter("status is not null")


def impression_references(impressions: DataFrame, campaigns: DataFrame, rates: DataFrame, outbox: DataFrame) -> DataFrame:
    """offending() of whole tables."""
    return offending(ledger(*changes(impressions, campaigns, rates, outbox)), impressions, campaigns, rates)


def orphan_records(references: DataFrame) -> DataFrame:
    """Distinct (table_name, record_id, ref_field, status) of references by records with an id."""
    return references.filter("record_id is not null").select("table_name", "record_id", "ref_field", "status").distinct()


def orphan_report(references: DataFrame) -> DataFrame:
    """References and records per table, field, status and event day (null where a reference has no time)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("event_us") / 86_400_000_000).cast("int"))
    return references.groupBy("table_name", "ref_field", "status", day.alias("event_day")).agg(F.count("*").alias("n_references"))
