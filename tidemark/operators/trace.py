"""Following records through the topics: a scan between remembered offsets and the present ends, for the ids of a set.

A topic's rows are (topic, partition, offset, value) with value as JSON. Bounds and ids are tables, so neither is written into the plan; both joins are by key, and
Spark sends the smaller side around where its size allows it.

Cases. A partition without bounds is not read, a null bound does not bound. An offset that was read before is read once. A value that is no JSON matches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a record's ids are: its own, and those of the event inside a reject.
PATHS = ("$.event_id", "$.ad_request_id", "$.raw.event_id", "$.raw.eid", "$.raw.ad_request_id")


def bounded(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows with start_offset <= offset < end_offset of their partition. bounds: topic, partition, start_offset, end_offset."""
    inside = (F.col("offset") >= F.coalesce("start_offset", F.lit(0))) & (F.coalesce(F.col("offset") < F.col("end_offset"), F.lit(True)))
    return rows.join(bounds, ["topic", "partition"]).filter(inside).select(*rows.columns)


def next_bounds(rows: DataFrame) -> DataFrame:
    """(topic, partition, start_offset): where the next scan goes on."""
    return rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("start_offset"))


def seen_once(rows: DataFrame) -> DataFrame:
    """Each (topic, partition, offset) once, however often scans have met it; of differing rows the smallest."""
    rest = [c for c in rows.columns if c not in ("topic", "partition", "offset")]
    once = rows.groupBy("topic", "partition", "offset").agg(F.min(F.struct(*rest)).alias("r"))
    return once.select("topic", "partition", "offset", *[F.col(f"r.{c}").alias(c) for c in rest])


def candidates(value: Column) -> Column:
    """The ids a record may be known by."""
    return F.array_distinct(F.array_compact(F.array(*[F.get_json_object(value, p) for p in PATHS])))


def matched(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, topic, partition, offset, reason) of the rows that carry one of the ids, in any of its places. ids: id."""
    known = rows.select("topic", "partition", "offset", F.get_json_object("value", "$.reason").alias("reason"), F.explode(candidates(F.col("value"))).alias("id"))
    return known.join(ids.select("id").distinct(), "id", "left_semi").select("id", "topic", "partition", "offset", "reason")
