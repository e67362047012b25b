"""The real-time roll-up over a bounded log: keep-first deduplication, tumbling windows by event time, and a side output of what they dropped.

Given the arrival times, the answer of an unbounded run is a function of the log: a record is late if a record that arrived strictly
before it had moved the watermark to its window's end. The watermark counts all rows of the log, repeated ones included.
Windows and late records together are exactly the deduplicated log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import MINUTE, SECOND, wall_time, wall_us
from tidemark.operators.late import CutOff, LambdaView
from tidemark.operators.ranks import before_max, ranked
from tidemark.sources.ingest import topic
from tidemark.storage import written

KINDS = ("impression", "click", "complete", "quartile", "request")


@dataclass(frozen=True)
class Roll:
    window_us: int = MINUTE
    delay_us: int = 10 * SECOND
    ttl_us: int | None = 60 * MINUTE


def kinds(events: DataFrame) -> DataFrame:
    """events with kind and is_twin; rows that no window counts (null campaign, unserved requests, other types) have a null kind.

    A kind goes by the topic that takes the event type, so other names of a type count here though settlement knows one only; a quartile
    is complete by its quartile field, not by its type."""
    where, quartile = topic(F.col("event_type")), F.col("quartile")
    named = F.col("campaign_id").isNotNull()
    return events.withColumn(
        "kind",
        F.when((where == "ad.impression") & named, "impression")
        .when((where == "ad.click") & named, "click")
        .when((where == "ad.quartile") & named, F.when(quartile == "complete", "complete").otherwise("quartile"))
        .when((F.col("event_type") == "ad_response") & F.col("fill") & (F.col("campaign_id") != "nofill"), "request"),
    ).withColumn("is_twin", F.when((F.col("kind") == "impression") & F.col("ssai_twin_of").isNotNull(), 1).otherwise(0))


def deliveries(events: DataFrame, ttl_us: int | None = None, list_rows: int = 1_000_000) -> DataFrame:
    """The rows that keep-first passes on, one per id, or one more whenever the last one kept is ttl_us old or older.

    With ttl_us, every distinct arrival of an id counts. They are folded as lists in order of time, of at most list_rows each; an id with more has
    several, and each goes on from the last arrival that the one before kept."""
    tie = F.struct("arrival_us", "n", "kind", "campaign_id", "is_twin", "event_us", "ad_request_id")
    rows = events.filter("event_id is not null and arrival_us is not null")
    if ttl_us is None:
        return rows.groupBy("event_id").agg(F.min(tie).alias("f")).select("event_id", "f.*")
    each = written(rows.groupBy("event_id", "arrival_us").agg(F.min(tie).alias("f")), "arrivals")
    lists = ranked(each.select("event_id", "arrival_us"), ["event_id"], ["arrival_us"], list_rows)
    lists = lists.groupBy("event_id", F.floor(F.col("rank") / list_rows).alias("block")).agg(F.array_sort(F.collect_list("arrival_us")).alias("us"))
    lists = written(lists, "lists")
    last = lists.agg(F.max("block")).first()[0] or 0
    never = F.lit(-(1 << 62)).cast("bigint")
    kept, folded = None, None
    for block in range(last + 1):
        own = lists.filter(F.col("block") == block)
        own = own.withColumn("before", never) if folded is None else own.join(folded.select("event_id", F.element_at("kept", -1).alias("before")), "event_id")
        fold = F.aggregate("us", F.array("before"), lambda acc, us: F.when(us >= F.element_at(acc, -1) + ttl_us, F.concat(acc, F.array(us))).otherwise(acc))
        folded = own.select("event_id", fold.alias("kept"))
        if last:
            folded = written(folded, "kept")
        new = folded.select("event_id", F.explode(F.slice("kept", 2, F.size("kept"))).alias("arrival_us"))
        kept = new if kept is None else kept.unionByName(new)
    return each.join(kept, ["event_id", "arrival_us"], "left_semi").select("event_id", "f.*")


def replay(events: DataFrame, roll: Roll = Roll()) -> DataFrame:  # noqa: B008
    """Deduplicated counted kinds with window_end_us and late. events: event_id, event_type, ..., event_time, arrival_time.

    Progress reports come by a topic that the roll-up does not read: they do not move the watermark."""
    rows = kinds(events.filter("event_type != 'progress'")).withColumn("event_us", wall_us("event_time")).withColumn("arrival_us", wall_us("arrival_time"))
    view = LambdaView(CutOff(roll.window_us, roll.delay_us, 0, SECOND // 1000))
    closings = written(view.closings(rows.select("event_us", "arrival_us").filter("arrival_us is not null")), "closings")
    kept = deliveries(rows.filter("kind is not null"), roll.ttl_us)
    kept = view.stamped(kept, closings)
    return kept.withColumn("late", F.coalesce(F.col("arrival_us") > F.col("closes_us"), F.lit(False))).withColumnRenamed("period_end", "window_end_us")


def window_counts(replayed: DataFrame, roll: Roll = Roll()) -> DataFrame:  # noqa: B008
    """Counts by window and campaign of the rows that came in time."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return (
        replayed.filter("not late")
        .groupBy(wall_time(F.col("window_end_us") - roll.window_us).alias("window_start"), "campaign_id")
        .agg(
            is_("impression").alias("impressions"), is_("click").alias("clicks"), is_("complete").alias("completes"), is_("request").alias("requests"),
            F.sum("is_twin").alias("ssai_dupes"),
        )
    )


def ratio() -> Column:
    return F.when(F.col("requests") > 0, F.col("impressions").cast("double") / F.col("requests"))


def enriched(windows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Window rows with the campaign's advertiser and name; joined after aggregating, kept without metadata."""
    dim = campaigns.groupBy(F.lower(F.trim("campaign_id")).alias("campaign_id")).agg(F.min("advertiser").alias("advertiser"), F.min("name").alias("campaign_name"))
    return windows.join(dim, "campaign_id", "left").withColumn("imp_req_ratio", ratio())


def alerts(windows: DataFrame, threshold: float = 0.5, min_requests: int = 5) -> DataFrame:
    """Windows with enough requests and a ratio below the threshold. Read before any enrichment, so unknown campaigns alert too."""
    rows = windows.withColumn("imp_req_ratio", ratio())
    return rows.filter((F.col("requests") >= min_requests) & (F.col("imp_req_ratio") < threshold)).select("window_start", "campaign_id", "impressions", "requests", "imp_req_ratio")


def late_events(replayed: DataFrame) -> DataFrame:
    """What the windows dropped: id, kind, campaign, times."""
    return replayed.filter("late").select(
        "event_id", "kind", "campaign_id", wall_time(F.col("event_us")).alias("event_time"), wall_time(F.col("window_end_us")).alias("window_end"),
        (F.floor((F.col("arrival_us") - F.col("event_us")) / SECOND) * 1000).alias("lateness_ms"),
    )


def lateness_histogram(lateness_ms: Column, rows: DataFrame, step_ms: int = 10_000) -> DataFrame:
    """Records by lateness in steps."""
    return rows.groupBy((F.floor(lateness_ms / step_ms) * step_ms).alias("from_ms")).agg(F.count("*").alias("n"))


# --- the records of the sinks -------------------------------------------------------------------------------------------------------

# The topic that a late record of a kind came by.
ORIGIN = {"impression": "ad.impression", "click": "ad.click", "request": "ad.request"}
LOW_RATIO = "low_impression_ratio"


def watermarks(log: DataFrame, delay_us: int, part_rows: int = 1_000_000) -> DataFrame:
    """(arrival_us, watermark_us) for every instant of arrival: the greatest event time of all that arrived strictly before, less the delay. log: event_us, arrival_us."""
    instants = log.filter("arrival_us is not null").groupBy("arrival_us").agg(F.max("event_us").alias("event_us"))
    return before_max(instants, "arrival_us", ["event_us"], part_rows).select("arrival_us", (F.col("before_event_us") - delay_us).alias("watermark_us"))


def source_watermarks(log: DataFrame, sources: Sequence[str], delay_us: int, idle_us: int, part_rows: int = 1_000_000) -> DataFrame:
    """(arrival_us, watermark_us) where each of a few sources (topics, or partitions of topics) has a watermark of its own. log: source, event_us, arrival_us.

    The watermark is the smallest of the sources' own, without those that are idle: nothing of theirs arrived for idle_us (counted from the log's first
    arrival where none ever did). It never recedes when an idle source comes back, and is null before there is one. Other sources are not read."""
    log = log.filter(F.col("source").isin(*sources) & F.col("arrival_us").isNotNull())
    of = lambda i, c: F.max(F.when(F.col("source") == sources[i], F.col(c)))
    columns = [x for i in range(len(sources)) for x in (of(i, "event_us").alias(f"event_{i}"), of(i, "arrival_us").alias(f"seen_{i}"))]
    instants = log.groupBy("arrival_us").agg(*columns)
    rows = before_max(instants, "arrival_us", [f"{c}_{i}" for i in range(len(sources)) for c in ("event", "seen")], part_rows)
    begin = log.agg(F.min("arrival_us")).scalar()
    awake = [F.coalesce(F.col(f"before_seen_{i}"), begin) + idle_us > F.col("arrival_us") for i in range(len(sources))]
    held = F.lit(False)
    for i, a in enumerate(awake):  # a source that is awake and has no event time yet holds the watermark back
        held = held | (a & F.col(f"before_event_{i}").isNull())
    lowest = F.array_min(F.array_compact(F.array(*[F.when(a, F.col(f"before_event_{i}")) for i, a in enumerate(awake)])))
    rows = rows.select("arrival_us", F.when(~held, lowest - delay_us).alias("own_us"))
    rows = before_max(rows, "arrival_us", ["own_us"], part_rows)
    return rows.select("arrival_us", F.greatest("own_us", "before_own_us").alias("watermark_us"))


def late_records(replayed: DataFrame, marks: DataFrame) -> DataFrame:
    """The late records in full. marks: as by watermarks() of the same log. lateness_ms is how far the watermark was past the event, in whole seconds."""
    late = replayed.filter("late").select("event_id", "kind", "campaign_id", "ad_request_id", "event_us", "window_end_us", "arrival_us")
    lateness = F.expr("(watermark_us - event_us) div 1000000") * 1000
    origin = F.coalesce(*[F.when(F.col("kind") == k, t) for k, t in ORIGIN.items()], F.lit("ad.quartile"))
    return late.join(marks, "arrival_us").select(
        "event_id", F.col("kind").alias("event_type"), "campaign_id", "ad_request_id", wall_time(F.col("event_us")).alias("event_time"), wall_time(F.col("window_end_us")).alias("window_end"),
        wall_time(F.col("watermark_us")).alias("watermark_at"), lateness.alias("lateness_ms"), origin.alias("topic_origin"),
    )


def minute_records(windows: DataFrame, campaigns: DataFrame, emitted_at: Column, roll: Roll = Roll()) -> DataFrame:  # noqa: B008
    """The windows in full, with their campaign's advertiser and name."""
    end = F.timestamp_add("MICROSECOND", F.lit(roll.window_us), F.col("window_start"))
    return enriched(windows, campaigns).select(
        "window_start", end.alias("window_end"), "campaign_id", "advertiser", "campaign_name", "impressions", "clicks", "completes", "requests", "imp_req_ratio", "ssai_dupes", emitted_at.alias("emitted_at")
    )


def alert_records(windows: DataFrame, detected_at: Column, threshold: float = 0.5, min_requests: int = 5, roll: Roll = Roll()) -> DataFrame:  # noqa: B008
    """The alerts in full."""
    end = F.timestamp_add("MICROSECOND", F.lit(roll.window_us), F.col("window_start"))
    return alerts(windows, threshold, min_requests).select(
        F.lit(LOW_RATIO).alias("alert_type"), "campaign_id", "window_start", end.alias("window_end"), "impressions", "requests", "imp_req_ratio", F.lit(threshold).alias("threshold"),
        F.concat(F.lit("impressions per request below "), F.lit(str(threshold))).alias("message"), detected_at.alias("detected_at"),
    )


def as_messages(records: DataFrame, key: str) -> DataFrame:
    """Records as (key, value) for a topic: value is their JSON, nulls written, times in ISO notation with milliseconds."""
    return records.select(F.col(key).alias("key"), F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}).alias("value"))


def no_fill_ratio(events: DataFrame, *by: Column) -> DataFrame:
    """Responses without an ad among all responses, once for each id; null without responses."""
    once = events.filter("event_type = 'ad_response' and event_id is not null").groupBy(*by, "event_id").agg(F.bool_or("fill").alias("fill"))
    names = [c for c in once.columns if c not in ("event_id", "fill")]
    empty = F.count_if(~F.coalesce(F.col("fill"), F.lit(False)))
    return once.groupBy(*names).agg(F.count("*").alias("responses"), empty.alias("no_fill"), F.try_divide(empty, F.count("*")).alias("no_fill_ratio"))
