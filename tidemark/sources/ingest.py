"""From request bodies and pixel queries to valid events and rejects, without losing a record: every input row ends as exactly one of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signing import canonical, hmac_sha256

# Required fields in the order of their test, seconds that an event may be ahead, and events of one body.
REQUIRED = ("event_id", "event_type", "campaign_id", "event_time")
FUTURE_S = 300
MAX_BATCH = 5_000

# The event types that each topic takes.
TOPICS = {
    "ad.impression": ("impression", "ad_impression"),
    "ad.quartile": ("quartile", "start", "first_quartile", "firstquartile", "midpoint", "third_quartile", "thirdquartile", "complete"),
    "ad.click": ("click", "ad_click", "clickthrough"),
    "ad.request": ("ad_request", "request", "ad_response", "response"),
    "user.behavior": ("progress", "play", "pause", "resume", "seek", "session_start", "session_end", "content_start", "content_end"),
}
# Pixel parameters and the fields they carry.
PIXEL = {"eid": "event_id", "et": "event_type", "cid": "campaign_id", "ts": "event_time", "arid": "ad_request_id", "crid": "creative_id", "q": "quartile", "sid": "session_id", "src": "source"}


def bodies(requests: DataFrame, body: str = "body", limit: int = MAX_BATCH) -> DataFrame:
    """One row (raw) per event of each body: a JSON array, an object with `events`, or one object. Anything else has no event; a
    body of more than limit events is refused whole."""
    b = F.ltrim(body)
    many = F.from_json(F.when(b.startswith("["), b).otherwise(F.get_json_object(b, "$.events")), "array<string>")
    one = F.when(b.startswith("{") & F.json_object_keys(b).isNotNull() & ~F.array_contains(F.json_object_keys(b), "events"), F.array(b))
    events = F.coalesce(one, many, F.array().cast("array<string>"))
    return requests.withColumn("raw", F.explode(F.when(F.size(events) <= limit, events))).drop(body)


def params(query: Column) -> Column:
    """The decoded parameters of a query string; of a repeated name the first value holds."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")))
    named = F.filter(named, lambda e: e["k"].isNotNull())
    first = F.aggregate(
        named,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))),
    )
    return first


def pixel_reason(p: Column, secret: bytes, now_s: Column) -> Column:
    """Why a pixel is refused, null if it is signed and in time."""
    sig, exp = p["sig"], p["exp"].try_cast("bigint")
    good = F.lower(sig) == hmac_sha256(secret, canonical(p))
    return (
        F.when(F.coalesce(F.trim(sig), F.lit("")) == "", "track_missing_sig")
        .when(F.coalesce(F.trim(p["exp"]), F.lit("")) == "", "track_missing_exp")
        .when(exp.isNull(), "track_bad_exp")
        .when(now_s > exp, "track_expired")
        .when(~good, "track_bad_signature")
    )


def pixel_event(p: Column, now_ms: Column) -> Column:
    """The event of a pixel as JSON: an unreadable time is now, the type is impression and the source client if not named."""
    fields = {f: p[k] for k, f in PIXEL.items()}
    fields["event_time"] = F.when(instant(fields["event_time"]).isNotNull(), fields["event_time"]).otherwise(now_ms.cast("string"))
    fields["event_type"] = F.coalesce(fields["event_type"], F.lit("impression"))
    fields["source"] = F.coalesce(fields["source"], F.lit("client"))
    return F.to_json(F.struct(*[v.alias(f) for f, v in fields.items()], F.lit("pixel").alias("transport")))


def instant(text: Column) -> Column:
    """Epoch milliseconds of a number, a digit string or an ISO time with offset, else null."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), F.unix_millis(text.try_cast("timestamp")))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).otherwise(iso)


def parsed(raw: Column) -> Column:
    """An event's top fields as text, null where raw is no JSON object. Nested values keep their JSON text; of a field that is named twice the last value holds."""
    fields = F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, "map<string,string>"))
    names = F.map_keys(fields)
    entries = F.map_entries(fields)
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.when(F.size(names) == F.size(F.array_distinct(names)), fields).otherwise(F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i))))


def invalid_reason(event: Column, now_ms: Column) -> Column:
    """The first reason to refuse a parsed() event, null if it is valid."""
    tests = [F.when(event.isNull(), "not_an_object")]
    for f in REQUIRED:
        tests.append(F.when(event[f].isNull(), f"missing_field:{f}").when(F.trim(event[f]) == "", f"blank_field:{f}"))
    at = instant(event["event_time"])
    tests += [F.when(at.isNull(), "bad_event_time"), F.when(at > now_ms + FUTURE_S * 1000, "event_time_in_future")]
    return F.coalesce(*tests)


def topic(event_type: Column) -> Column:
    kind = F.lower(event_type)
    return F.coalesce(*[F.when(kind.isin(*names), t) for t, names in TOPICS.items()])


@dataclass(frozen=True)
class Ingested:
    valid: DataFrame
    rejected: DataFrame


def routed(events: DataFrame, now_ms: Column, endpoint: str = "v1_events") -> DataFrame:
    """events (raw) with reason, topic, key and the enriched value; topic, key and value are null where there is a reason.

    The value keeps the event's fields with their JSON types. server_ts, event_time and ingest_endpoint are set; source is client where there is no such field.
    An object that names a field twice has its fields as text, the last value of each."""
    # a generated column is computed once: a plain one would be copied into every later expression, and into filters that are pushed below it
    typed = F.try_parse_json("raw").try_cast("map<string,variant>")
    rows = events.withColumn("tidemark_event", F.explode(F.array(F.struct(parsed(F.col("raw")).alias("text"), typed.alias("typed")))))
    event = F.col("tidemark_event.text")
    where = topic(event["event_type"])
    reason = F.coalesce(invalid_reason(event, now_ms), F.when(where.isNull(), F.concat(F.lit("unknown_event_type:"), event["event_type"])))
    ok = F.col("reason").isNull()
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def enriched(fields: Column, kind: str) -> Column:
        word = lambda c: c.cast(kind)
        return F.to_json(F.map_concat(
            F.map_filter(fields, lambda k, v: ~k.isin("server_ts", "event_time", "ingest_endpoint")),
            F.create_map(F.lit("server_ts"), word(stamp(now_ms)), F.lit("event_time"), word(stamp(instant(event["event_time"]))), F.lit("ingest_endpoint"), word(F.lit(endpoint))),
            F.when(F.map_contains_key(fields, "source"), F.create_map().cast(f"map<string,{kind}>")).otherwise(F.create_map(F.lit("source"), word(F.lit("client")))),
        ))

    value = F.coalesce(enriched(F.col("tidemark_event.typed"), "variant"), enriched(event, "string"))
    return rows.withColumn("reason", reason).select(
        *events.columns, "reason", F.when(ok, where).alias("topic"), F.when(ok, F.coalesce(event["ad_request_id"], event["event_id"])).alias("key"), F.when(ok, value).alias("value")
    )


def split(events: DataFrame, now_ms: Column, endpoint: str = "v1_events", position: Column | None = None) -> Ingested:
    """Valid events (topic, key, value) and rejects (key, dlq_id, reason, endpoint, raw).

    The id of a reject is a digest of what it holds and of its position in the input, if given: equal rejects then have ids of their own, and the same ones
    when a batch runs again."""
    rows = routed(events if position is None else events.withColumn("tidemark_position", position.cast("string")), now_ms, endpoint)
    dlq_id = F.sha2(F.concat_ws("|", "reason", "raw", *([] if position is None else ["tidemark_position"])), 256)
    bad = rows.filter("reason is not null").select(
        F.coalesce(F.get_json_object("raw", "$.event_id"), dlq_id).alias("key"), dlq_id.alias("dlq_id"), "reason", F.lit(endpoint).alias("endpoint"), "raw"
    )
    return Ingested(rows.filter("reason is null").select("topic", "key", "value"), bad)


def reject_records(rejected: DataFrame, now_ms: Column) -> DataFrame:
    """Rejects as (key, value) for their topic: value is the JSON of dlq_id, reason, endpoint, server_ts and raw; raw is an object where it was one."""
    server_ts = F.date_format(F.timestamp_millis(now_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = F.coalesce(F.try_parse_json("raw"), F.col("raw").cast("variant"))
    fields = {"dlq_id": F.col("dlq_id").cast("variant"), "reason": F.col("reason").cast("variant"), "endpoint": F.col("endpoint").cast("variant"), "server_ts": server_ts.cast("variant"), "raw": raw}
    return rejected.select("key", F.to_json(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])).alias("value"))


def reason_counts(rejected: DataFrame) -> DataFrame:
    """Rejects by class: the reason up to its colon."""
    return rejected.groupBy(F.substring_index("reason", ":", 1).alias("reason_class")).agg(F.count("*").alias("n"))
