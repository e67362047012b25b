"""Ad events of all kinds made from the plain `events` table, with late, repeated and twin deliveries.

view is an impression, click a click, purchase a quartile, signup a served request, error a progress report of no campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TWIN_OFFSET = 1_000_000_000


def ad_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    late = F.col("event_id") % 10 == 3
    base = events.select(
        F.col("event_id").alias("n"),
        F.concat(F.lit("evt-"), "event_id").alias("event_id"),
        F.when(kind == "view", "impression").when(kind == "click", "click").when(kind == "purchase", "quartile").when(kind == "signup", "ad_response").otherwise("progress").alias("event_type"),
        F.when(kind == "error", "none").when((kind == "signup") & (k < 8), "nofill").otherwise(F.concat(F.lit("cmp-"), 1001 + F.col("user_id") % 5)).alias("campaign_id"),
        F.concat(F.lit("req-"), "event_id").alias("ad_request_id"),
        F.when(kind == "purchase", F.element_at(F.array(*map(F.lit, ("start", "first_quartile", "midpoint", "third_quartile", "complete"))), k % 5 + 1)).alias("quartile"),
        F.when(kind == "signup", k >= 8).alias("fill"),
        F.when(kind == "signup", "server").otherwise("client").alias("source"),
        F.lit(None).cast("string").alias("ssai_twin_of"),
        F.col("ts").alias("event_time"),
        F.when(late, F.timestamp_add("SECOND", 1800 + 60 * k, F.col("ts"))).otherwise(F.col("ts")).alias("arrival_time"),
        late.alias("late_flag"),
        F.lit(None).cast("boolean").alias("dup_flag"),
    )
    # one scan: each row is exploded to its deliveries
    copies = base.withColumn(
        "copy", F.explode(F.filter(F.array(F.lit(0), F.when(F.col("n") % 20 == 7, 1), F.when((F.col("event_type") == "impression") & (F.col("n") % 11 == 0), 2)), lambda c: c.isNotNull()))
    )
    dup, twin = F.col("copy") == 1, F.col("copy") == 2
    changed = {
        "n": F.when(twin, F.col("n") + TWIN_OFFSET).otherwise(F.col("n")),
        "event_id": F.when(twin, F.concat("event_id", F.lit("-s"))).otherwise(F.col("event_id")),
        "source": F.when(twin, "server").otherwise(F.col("source")),
        "ssai_twin_of": F.when(twin, F.col("event_id")),
        "arrival_time": F.when(twin, F.col("event_time")).when(dup, F.timestamp_add("SECOND", F.lit(2), F.col("arrival_time"))).otherwise(F.col("arrival_time")),
        "late_flag": F.when(~twin, F.col("late_flag")),
        "dup_flag": F.when(dup, True),
    }
    return copies.select(*[changed.get(c, F.col(c)).alias(c) for c in base.columns])


SQL = """src as (select event_id as n, 'evt-' || event_id as event_id,
 case event_type when 'view' then 'impression' when 'click' then 'click' when 'purchase' then 'quartile' when 'signup' then 'ad_response' else 'progress' end as event_type,
 case when event_type = 'error' then 'none' when event_type = 'signup' and k < 8 then 'nofill' else 'cmp-' || (1001 + user_id % 5) end as campaign_id,
 'req-' || event_id as ad_request_id,
 case when event_type = 'purchase' then ['start', 'first_quartile', 'midpoint', 'third_quartile', 'complete'][k % 5 + 1] end as quartile,
 case when event_type = 'signup' then k >= 8 end as fill, case when event_type = 'signup' then 'server' else 'client' end as source,
 ts as event_time, case when event_id % 10 = 3 then ts + to_seconds(1800 + 60 * k) else ts end as arrival_time, event_id % 10 = 3 as late_flag
 from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)),
ad as (select n, event_id, event_type, campaign_id, ad_request_id, quartile, fill, source, cast(null as varchar) as ssai_twin_of, event_time, arrival_time, late_flag, cast(null as boolean) as dup_flag from src
 union all select n, event_id, event_type, campaign_id, ad_request_id, quartile, fill, source, null, event_time, arrival_time + interval 2 second, late_flag, true from src where n % 20 = 7
 union all select n + 1000000000, event_id || '-s', event_type, campaign_id, ad_request_id, quartile, fill, 'server', event_id, event_time, event_time, null, null
 from src where event_type = 'impression' and n % 11 = 0)"""
