"""The outbox: a queue kept in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import wall_us
from tidemark.operators.ranks import before_max, ranked


def backlog(outbox: DataFrame, now: Column) -> DataFrame:
    """One row: messages, unpublished ones, the age in seconds of the oldest unpublished (0 if none), and whether all are published."""
    open_ = ~F.coalesce(F.col("published"), F.lit(False))
    oldest = F.min(F.when(open_, wall_us("occurred_at")))
    return outbox.agg(
        F.count("*").alias("total"), F.count_if(open_).alias("unpublished"), F.coalesce(F.floor((wall_us(now) - oldest) / 1_000_000), F.lit(0)).alias("oldest_age_s"),
        F.coalesce(F.bool_and("published"), F.lit(True)).alias("all_published"),
    )


def head(outbox: DataFrame, n: int) -> DataFrame:
    """The next n messages to publish, in order of id."""
    return outbox.filter("not coalesce(published, false)").orderBy("id").limit(n)


def payload_fields(outbox: DataFrame, fields: dict[str, str]) -> DataFrame:
    """id and the named JSON paths of the payload; a payload that is no JSON has nulls."""
    return outbox.select("id", *[F.get_json_object("payload", path).alias(name) for name, path in fields.items()])


def published(outbox: DataFrame, workers: int, skip_every: int, locked: bool = True) -> DataFrame:
    """What an at-least-once publisher sends: with locks each message once, and every skip_every-th again, as its flag was not
    written; without locks each of the workers sends it. Columns: id, event_id, attempt."""
    again = F.when(F.col("id") % skip_every == 0, 2).otherwise(1)
    times = again if locked else again * workers
    return outbox.select("id", "event_id", F.explode(F.sequence(F.lit(1), times)).alias("attempt"))


# The fields of a response's payload, in order.
PAYLOAD = (
    "event_id", "event_type", "campaign_id", "event_time", "ad_request_id", "creative_id", "ad_duration_s", "fill", "session_id", "user_id", "content_id", "device", "ad_pod_id", "ad_slot",
    "playhead_s", "source", "transport",
)


def messages(decisions: DataFrame, decided_at: Column) -> DataFrame:
    """The outbox rows of decisions: event_id, event_type, aggregate_id, payload, occurred_at, published.

    decisions: the fields of PAYLOAD that they have; others are null. A decision without campaign is not filled. Nulls are written. The event id
    comes from the request, so a decision that is made again has the same."""
    have = set(decisions.columns)
    request = F.col("ad_request_id")
    given = {
        "event_id": F.concat(F.lit("evt-outbox-"), F.substring(F.sha2(request, 256), 1, 16)), "event_type": F.lit("ad_response"), "campaign_id": F.coalesce("campaign_id", F.lit("nofill")),
        "event_time": F.date_format(decided_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "fill": F.col("campaign_id").isNotNull(), "source": F.lit("server"), "transport": F.lit("outbox"),
    }
    fields = [given.get(c, F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in PAYLOAD]
    return decisions.select(
        given["event_id"].alias("event_id"), F.lit("ad_response").alias("event_type"), request.alias("aggregate_id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"),
        decided_at.alias("occurred_at"), F.lit(False).alias("published"),
    )


def published_in_order(outbox: DataFrame, batch: int, fails: Column, unmarked: Column, part_rows: int = 1_000_000) -> DataFrame:
    """What one worker sends: (id, event_id, poll, attempt), poll being the place of the poll's first message.

    A poll takes the next `batch` messages in order of id and stops at the first one whose sending fails; that one begins the next poll, and goes through.
    Where a poll's messages could not be marked as published they are all sent again. fails: of the first sending of a message; unmarked: of a poll, over its
    column poll. Places and poll starts are found by ranges, so no task sorts the whole queue."""
    rows = outbox.filter("id is not null").select("id", "event_id", F.coalesce(fails, F.lit(False)).alias("fails"), F.lit(0).alias("all"))
    rows = ranked(rows, ["all"], ["id"], part_rows).withColumn("start", F.when(F.col("fails"), F.col("rank")))
    rows = before_max(rows, "rank", ["start"], part_rows)
    begun = F.coalesce("start", "before_start", F.lit(0))
    rows = rows.withColumn("poll", F.col("rank") - F.pmod(F.col("rank") - begun, F.lit(batch)))
    times = F.when(F.coalesce(unmarked, F.lit(False)), 2).otherwise(1)
    return rows.select("id", "event_id", "poll", F.explode(F.sequence(F.lit(1), times)).alias("attempt"))


def duplicate_stats(messages: DataFrame) -> DataFrame:
    """One row: messages, distinct ids and messages beyond the first of their id."""
    counts = messages.filter("event_id is not null").groupBy("event_id").agg(F.count("*").alias("n"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("*").alias("distinct_ids"))
    return sums.withColumn("duplicates", F.col("messages") - F.col("distinct_ids"))
