"""Range queries over the minute roll-up, and the small tables beside it."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import MINUTE, floor_to, plain_key, wall_time, wall_us

MEASURES = ("impressions", "raw_impressions", "clicks", "completes", "requests")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key, as an upsert leaves it: the same however often and in whatever order rows come."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("v"), *[c for c in rest if c != version])).alias("m"))
    return newest.select(*keys, *[F.col("m.v").alias(version) if c == version else F.col(f"m.{c}") for c in rest])


def minute_range(c: str, start_s: int | None, end_s: int | None) -> Column:
    """Both bounds are floored to their minute; the end is exclusive."""
    at = lambda s: F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s // 60 * 60)).cast("timestamp_ntz")
    test = F.lit(True)  # the column itself is compared, so the bounds reach the files
    if start_s is not None:
        test = test & (F.col(c) >= at(start_s))
    if end_s is not None:
        test = test & (F.col(c) < at(end_s))
    return test


def kept_minutes(rows: DataFrame, now: Column, keep_hours: int = 48, minute: str = "minute_ts", version: str = "computed_at") -> DataFrame:
    """The store of minutes as upserts by campaign and minute leave it: the newest row of each, without the minutes older than keep_hours at `now`."""
    fresh = F.col(minute) >= F.timestamp_add("HOUR", F.lit(-keep_hours), now)
    return latest(rows.filter(fresh), [minute, "campaign_id"], version)


def summary(minutes: DataFrame, start_s: int | None = None, end_s: int | None = None, first_seen: Sequence[str] = ()) -> DataFrame:
    """Sums of all measures and the number of minutes by campaign, over a range of epoch seconds; of the columns of first_seen the value of the earliest
    minute that has one (the smallest of several)."""
    rows = minutes.filter(minute_range("minute_ts", start_s, end_s)).withColumn("campaign_id", plain_key("campaign_id"))
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("minute_ts", F.col(c).alias("v"))))["v"].alias(c) for c in first_seen]
    return rows.groupBy("campaign_id").agg(*[F.sum(m).alias(m) for m in MEASURES if m in rows.columns], F.count("*").alias("n_minutes"), *first)


def series(minutes: DataFrame, last: int, measure: str = "impressions") -> DataFrame:
    """The measure by campaign and minute over the last `last` minutes of the table."""
    end = minutes.agg(F.max("minute_ts")).scalar()
    rows = minutes.filter(F.col("minute_ts") > F.timestamp_add("MINUTE", F.lit(-last), end))
    at = wall_time(floor_to(wall_us("minute_ts"), MINUTE))
    return rows.groupBy(plain_key("campaign_id").alias("campaign_id"), at.alias("minute")).agg(F.sum(measure).alias(measure))


def late_by_minute(dropped: DataFrame) -> DataFrame:
    """Dropped records by minute of event time and kind, each id once: a replay does not count again."""
    once = dropped.filter("event_id is not null").groupBy("event_id", "kind").agg(F.min("event_time").alias("event_time"))
    return once.groupBy(F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("minute"), "kind").agg(F.count("*").alias("n"))


def newest(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows by descending order columns: a bounded report."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def newest_of_all(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """newest() with the number of all rows (total)."""
    return newest(rows, order, limit).withColumn("total", rows.agg(F.count("*")).scalar())


def report(rows: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """rows in order, the first `limit` of them if given, with their place from 1 on if limited: a bounded report."""
    if limit is None:
        return rows.orderBy(*order)
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def active_campaigns(campaigns: DataFrame, rates: DataFrame) -> DataFrame:
    """Active campaigns with their rates; a missing rate is 0."""
    rate = rates.groupBy(plain_key("campaign_id").alias("key")).agg(F.max("cpm").alias("cpm"), F.max("cpc").alias("cpc"))
    rows = campaigns.filter("active").withColumn("key", plain_key("campaign_id")).join(rate, "key", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return rows.select(F.col("key").alias("campaign_id"), "advertiser", "vertical", zero("cpm"), zero("cpc"))


def missing_minutes(minutes: DataFrame) -> DataFrame:
    """Minutes without any row between the first and the last of each campaign: an anti-join of the dense range, found from gaps between neighbours.

    The gaps come from a window per campaign and day with the next day's first minute, so no window holds more than 1,440 rows."""
    at = floor_to(wall_us("minute_ts"), MINUTE)
    seen = minutes.filter("minute_ts is not null").select(plain_key("campaign_id").alias("campaign_id"), at.alias("at")).distinct()
    seen = seen.withColumn("day", F.floor(F.col("at") / (1440 * MINUTE)))
    days = seen.groupBy("campaign_id", "day").agg(F.min("at").alias("first"))
    after = days.select("campaign_id", "day", F.lead("first").over(Window.partitionBy("campaign_id").orderBy("day")).alias("next_day"))
    nxt = F.coalesce(F.lead("at").over(Window.partitionBy("campaign_id", "day").orderBy("at")), F.col("next_day"))
    gaps = seen.join(after, ["campaign_id", "day"]).withColumn("next", nxt).filter(F.col("next") > F.col("at") + MINUTE)
    return gaps.select("campaign_id", F.explode(F.sequence(F.col("at") + MINUTE, F.col("next") - MINUTE, F.lit(MINUTE))).alias("m")).select("campaign_id", wall_time(F.col("m")).alias("minute"))


def overlay(realtime: DataFrame, batch: DataFrame) -> DataFrame:
    """Two minute series on one axis: a missing real-time minute is 0, a batch minute is null after the last settled one.

    realtime, batch: minute, n."""
    r = realtime.groupBy("minute").agg(F.sum("n").alias("realtime"))
    b = batch.groupBy("minute").agg(F.sum("n").alias("batch"))
    cut = batch.agg(F.max("minute")).scalar()
    rows = r.join(b, "minute", "full_outer")
    value = F.when(F.col("minute") <= cut, F.coalesce("batch", F.lit(0)))
    return rows.select("minute", F.coalesce("realtime", F.lit(0)).alias("realtime"), value.alias("batch"))
