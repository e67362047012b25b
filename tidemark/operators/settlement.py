"""Batch settlement: full deduplication, server-over-client twin collapse, counts per day or minute and campaign.

Both selections (one delivery per id, one impression per request) are made by `min` over an ordering struct, which combines before the shuffle;
a hot id or request is one row from each map task. All measures of a grain come from one conditional aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import NO_CAMPAIGN
from tidemark.storage import written


def one_per_id(events: DataFrame, keep: list[str], order: list[Column]) -> DataFrame:
    """(event_id, copies, *keep) of the first delivery by order (nulls last), and how many deliveries there were. Rows without id are dropped."""
    first = F.struct(*[x for i, o in enumerate(order) for x in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))], *[c for c in keep])
    best = events.filter("event_id is not null").groupBy("event_id").agg(F.min(first).alias("f"), F.count("*").alias("copies"))
    return best.select("event_id", "copies", *[F.col(f"f.{c}").alias(c) for c in keep])


def priority(source: Column, ranked: tuple[str, ...] = ("server", "client")) -> Column:
    """0 for the best source; unknown and null sources come after all named ones."""
    return F.coalesce(*[F.when(source == s, i) for i, s in enumerate(ranked)], F.lit(len(ranked) + 1))


def billable(impressions: DataFrame, keep: list[str], ranked: tuple[str, ...] = ("server", "client")) -> DataFrame:
    """One impression per request (per event where there is no request): by source, then the earliest, then the smallest id."""
    first = F.struct(priority(F.col("source"), ranked).alias("p"), F.col("event_time").isNull().alias("late"), "event_time", "event_id", *[c for c in keep if c not in ("event_time", "event_id")])
    best = impressions.groupBy(F.coalesce("ad_request_id", "event_id").alias("request")).agg(F.min(first).alias("f"), F.count("*").alias("twins"))
    return best.select("twins", *[F.col(f"f.{c}").alias(c) for c in dict.fromkeys(["event_id", "event_time", *keep])])


def _in_campaign() -> Column:
    return ~F.col("campaign_id").isin(*NO_CAMPAIGN)


def _deduped(events: DataFrame) -> DataFrame:
    order = [F.col("event_time"), F.col("arrival_time"), F.col("dup_flag")]
    return one_per_id(events, ["event_type", "campaign_id", "ad_request_id", "quartile", "fill", "source", "event_time", "late_flag"], order)


def _measures(events: DataFrame, grain: Column, name: str) -> DataFrame:
    """Counts of the kept rows by grain and campaign; collapsed impressions count where the survivor lies.

    The deduplicated rows are written once, as counts and collapse both read them."""
    deduped = written(_deduped(events), "deduped")
    flag = lambda c: F.count_if(c).alias
    rows = deduped.filter(_in_campaign())
    kind = F.col("event_type")
    counts = rows.groupBy(grain.alias(name), "campaign_id").agg(
        flag((kind == "ad_response") & F.col("fill"))("requests"), flag(kind == "click")("clicks"), flag((kind == "quartile") & (F.col("quartile") == "complete"))("completes"),
        flag(kind == "impression")("raw_impressions"), F.coalesce(F.sum(F.when(kind == "impression", F.col("copies") - 1)), F.lit(0)).alias("dupes_removed"),
    )
    kept = billable(rows.filter(kind == "impression"), ["campaign_id", "late_flag"])
    kept = kept.groupBy(grain.alias(name), "campaign_id").agg(F.count("*").alias("impressions"), F.count_if("late_flag").alias("late_impressions"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("impressions", "late_impressions")]
    none = [F.lit(0).cast("bigint").alias(c) for c in ("requests", "clicks", "completes", "raw_impressions", "dupes_removed")]
    both = counts.select("*", *zero).unionByName(kept.select("*", *none))
    return both.groupBy(name, "campaign_id").agg(*[F.sum(c).alias(c) for c in ("requests", "impressions", "clicks", "completes", "raw_impressions", "dupes_removed", "late_impressions")])


def daily(events: DataFrame) -> DataFrame:
    """Settled measures per day and campaign; only days with a raw impression of the campaign appear.

    Repeated deliveries of an id have its event time, so a removed one belongs to the day of the kept one."""
    return _measures(events, F.to_date("event_time"), "dt").filter("raw_impressions > 0")


def by_minute(events: DataFrame) -> DataFrame:
    """Settled measures per minute and campaign; groups without any measure do not appear."""
    rows = _measures(events, F.date_trunc("minute", "event_time").cast("timestamp_ntz"), "minute_ts")
    rows = rows.select("minute_ts", "campaign_id", "impressions", "raw_impressions", "clicks", "completes", "requests")
    return rows.filter("impressions + raw_impressions + clicks + completes + requests > 0")


def found(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The rows with a key; an input without any is an error, so that a run over the wrong folder doesn't replace a table by nothing."""
    rows = events.filter(F.col(key).isNotNull())
    if rows.isEmpty():
        raise LookupError(f"no row with {key} to settle")
    return rows


def records(settled: DataFrame, computed_at: Column) -> DataFrame:
    """Settled rows as they are stored."""
    return settled.withColumn("computed_at", computed_at)


def dedup_stats(events: DataFrame) -> DataFrame:
    """One row: deliveries before and after deduplication, removed, and percent removed."""
    counts = events.filter("event_id is not null").groupBy("event_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    return total.select("rows_before", "rows_after", removed.alias("removed"), F.round(F.try_divide(removed * 100.0, "rows_before"), 2).alias("removed_pct"))


def source_mix(events: DataFrame) -> DataFrame:
    """Kept impressions by source."""
    rows = _deduped(events).filter((F.col("event_type") == "impression") & _in_campaign())
    return billable(rows, ["source"]).groupBy("source").agg(F.count("*").alias("n"))


def twin_pairs(events: DataFrame) -> DataFrame:
    """Server twins with the client original they name."""
    twins = one_per_id(events.filter("ssai_twin_of is not null"), ["ssai_twin_of", "ad_request_id", "event_time"], [F.col("arrival_time")])
    ids = one_per_id(events.filter(F.col("event_type") == "impression"), ["ad_request_id"], [F.col("arrival_time")])
    return twins.alias("t").join(ids.alias("o"), F.col("t.ssai_twin_of") == F.col("o.event_id"), "left").select(
        F.col("t.event_id").alias("twin_id"), F.col("o.event_id").alias("original_id"), (F.col("t.ad_request_id") == F.col("o.ad_request_id")).alias("same_request")
    )
