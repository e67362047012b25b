"""Schemas of the ad-event tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _N = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: What a topic's JSON may hold, besides fields that pass through in the raw text.
EVENT = _struct(
    event_id=_S, event_type=_S, campaign_id=_S, ad_request_id=_S, creative_id=_S, session_id=_S, user_id=_S, device=_S, content_id=_S, quartile=_S,
    ad_pod_id=_S, ad_slot=T.IntegerType(), ad_duration_s=T.IntegerType(), playhead_s=T.DoubleType(), source=_S, transport=_S, ssai_twin_of=_S,
    ingest_endpoint=_S, server_ts=_S, fill=_B, _late=_B, _dup=_B, event_time=T.TimestampType(),
)

#: The archive: all fields, flags under their table names, and where a row came from and lies.
ARCHIVE = _struct(
    event_id=_S, event_type=_S, campaign_id=_S, ad_request_id=_S, creative_id=_S, session_id=_S, user_id=_S, device=_S, content_id=_S, quartile=_S,
    ad_pod_id=_S, ad_slot=T.IntegerType(), ad_duration_s=T.IntegerType(), playhead_s=T.DoubleType(), source=_S, transport=_S, ssai_twin_of=_S,
    ingest_endpoint=_S, server_ts=_S, fill=_B, late_flag=_B, dup_flag=_B, event_time=_N, source_topic=_S, dt=_S, hour=_S,
)

MINUTE = _struct(minute_ts=_N, campaign_id=_S, impressions=_L, raw_impressions=_L, clicks=_L, completes=_L, requests=_L, computed_at=_N)
LATE = _struct(event_id=_S, kind=_S, campaign_id=_S, ad_request_id=_S, event_time=_N, window_end=_N, watermark_at=_N, recorded_at=_N)
OUTBOX = _struct(id=_L, event_id=_S, event_type=_S, aggregate_id=_S, payload=_S, occurred_at=_N, published=_B, published_at=_N)
FALLBACK = _struct(topic=_S, key=_S, payload=_S, fallback_ts=_S)
