"""One surviving record for each group of records that report the same thing.

Links. Records are linked by an equal request id, or where one names the other as its twin. Request ids are contracted to one vertex each, so
only twin links between different vertices need connected components.

Choice. Records of a group are compared by trust (of their source), completeness (filled fields) and recency (arrival). All
records of the group form its dominance layers: layer 1 is the skyline, the records that none beats in one respect without losing in another; layer 2
is the skyline of the rest, and so on. The survivor is the skyline's first by trust, then completeness, then recency, then the smallest id. Its empty
fields are filled from the first layer that has a value, within a layer in the same order.

Of the records with equal trust and equally filled fields only the latest, their representative, can survive or give a value, so at most 3 * 2^fields
a group need a layer, but every record counts in the depth of those that it dominates.

All steps before the layers are minima and counts, combined before the shuffle. Layers are found in a fold over a group's records from the latest on,
inside the JVM; it keeps the depth reached in each cell of trust and completeness. A group of more than `list_rows` different records is folded list by
list, each going on from the one before. Values are fetched last, for donors only.

Cases. Records without id are left out. Repeated deliveries count once, by the first arrival (see redelivery). Placeholder request ids link
nothing. No arrival is the oldest. A record that names itself as twin, or one that is absent, has no twin. A null or empty text and
a null number are not filled. A field that nobody filled stays null. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import arrival_us, plain_key, request_key
from tidemark.llm.components import components
from tidemark.operators.ranks import ranked
from tidemark.operators.redelivery import Once
from tidemark.storage import written

FIELDS = ("creative_id", "session_id", "user_id", "device", "content_id", "ad_pod_id", "ad_slot", "ad_duration_s", "playhead_s")
TRUST = ("server", "client")


def delivered(impressions: DataFrame) -> Once:
    """The first delivery of each event id, for any number of reads."""
    return Once(impressions, "event_id", [arrival_us("server_ts")])


def records(deliveries: Once) -> DataFrame:
    """One narrow row per event id: event_id, request, twin, trust (0 best), filled (bit mask), missing (fields), age_us (smaller is later)."""
    once = deliveries.read(["event_id", "ad_request_id", "ssai_twin_of", "source", "server_ts", *FIELDS]).filter("event_id is not null")
    source = plain_key("source")
    trust = F.coalesce(*[F.when(source == t, i) for i, t in enumerate(TRUST)], F.lit(len(TRUST)))
    mask = F.lit(0)
    for i, f in enumerate(FIELDS):
        mask = mask + F.when(_filled(once, f), 1 << i).otherwise(0)
    return once.select(
        "event_id", request_key("ad_request_id").alias("request"), plain_key("ssai_twin_of").alias("twin"), trust.cast("int").alias("trust"),
        mask.alias("filled"), (-F.coalesce(arrival_us("server_ts"), F.lit(-(1 << 62)))).alias("age_us"),
    ).withColumn("missing", F.lit(len(FIELDS)) - F.bit_count("filled"))


def _filled(df: DataFrame, f: str) -> Column:
    c = F.col(f)
    return c.isNotNull() & (c != "") if dict(df.dtypes)[f] == "string" else c.isNotNull()


def grouped(rows: DataFrame) -> DataFrame:
    """The records() that may share a group with another, with their vertex: what all records of a group have in common.

    Most records are alone. Those that are not have a request of several records or an end of a twin link; the hashes of these vertices pick them out,
    so only they are joined and grouped. rows: a written table."""
    rows = rows.withColumn("vertex", F.coalesce(F.concat(F.lit("r:"), "request"), F.concat(F.lit("e:"), "event_id")))
    twins = rows.filter("twin is not null and twin != '' and twin != event_id").select("twin", F.col("vertex").alias("a"))
    links = written(twins.join(rows.select(F.col("event_id").alias("twin"), F.col("vertex").alias("b")), "twin").select("a", "b"), "links")
    mark = F.xxhash64("vertex").alias("mark")
    shared = rows.filter("request is not null").groupBy(mark).agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    ends = links.select(F.explode(F.array("a", "b")).alias("vertex")).select(mark)
    rows = rows.withColumn("mark", mark).join(written(shared.unionAll(ends).distinct(), "marks"), "mark", "left_semi").drop("mark")
    roots = components(links)
    return rows.join(roots.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("vertex", F.coalesce("root", "vertex")).drop("root")


def representatives(rows: DataFrame) -> DataFrame:
    """One row per group of two or more: group_id, n_records, reps (in order of trust, completeness, recency, id)."""
    best = rows.groupBy("vertex", "trust", "missing", "filled").agg(
        F.min(F.struct("age_us", "event_id")).alias("best"), F.count("*").alias("n"), F.min("event_id").alias("first_id")
    )
    whole = best.groupBy("vertex").agg(
        F.min("first_id").alias("group_id"), F.sum("n").alias("n_records"),
        F.collect_list(F.struct("trust", "missing", "best.age_us", "best.event_id", "filled")).alias("reps"),
    )
    return whole.filter("n_records > 1").select("group_id", "n_records", F.array_sort("reps").alias("reps"))


_LAYERED = """
aggregate(reps, cast(array() as array<struct<layer:int,trust:int,missing:int,age_us:bigint,event_id:string,filled:int>>), (done, r) ->
  concat(done, array(named_struct(
    'layer', 1 + coalesce(array_max(transform(filter(done, d -> d.trust <= r.trust and d.missing <= r.missing and d.age_us <= r.age_us
        and (d.trust < r.trust or d.missing < r.missing or d.age_us < r.age_us)), d -> d.layer)), 0),
    'trust', r.trust, 'missing', r.missing, 'age_us', r.age_us, 'event_id', r.event_id, 'filled', r.filled))))
"""


def layered(groups: DataFrame) -> DataFrame:
    """representatives() with the layers that they form among themselves, which is enough for the survivor: (layer, trust, missing, age_us, event_id, filled) in order of layer, then of the policy.

    The reps come in an order in which no record follows one that it dominates, so one pass finds each layer from the layers before it."""
    return groups.select("group_id", "n_records", F.array_sort(F.expr(_LAYERED)).alias("layers"))


_CELLS = (len(TRUST) + 1) * (len(FIELDS) + 1)  # a cell for each trust and number of missing fields
_FRESH = f"""named_struct('best', array_repeat(0, {_CELLS}), 'age_us', cast(null as bigint), 'cell', -1,
  'layers', cast(array() as array<struct<layer:int,trust:int,missing:int,age_us:bigint,event_id:string,filled:int>>))"""
#: s: best (the depth reached in each cell), age_us and cell of the last record, and the layers of representatives so far. Records of one cell and
#: age are one point. An own cell has its depth from later records only, so each point is one deeper than the deepest cell that is as good.
_STEP = f"""
get(transform(array(if(s.age_us = r.age_us and s.cell = r.trust * {len(FIELDS) + 1} + r.missing, get(s.best, s.cell),
    1 + array_max(transform(s.best, (d, i) -> if(i div {len(FIELDS) + 1} <= r.trust and i % {len(FIELDS) + 1} <= r.missing, d, 0))))), depth -> named_struct(
  'best', transform(s.best, (d, i) -> if(i = r.trust * {len(FIELDS) + 1} + r.missing, depth, d)), 'age_us', r.age_us, 'cell', r.trust * {len(FIELDS) + 1} + r.missing,
  'layers', if(exists(s.layers, x -> x.trust = r.trust and x.filled = r.filled), s.layers, concat(s.layers, array(named_struct(
    'layer', depth, 'trust', r.trust, 'missing', r.missing, 'age_us', r.age_us, 'event_id', r.event_id, 'filled', r.filled)))))), 0)
"""


def layered_whole(rows: DataFrame, list_rows: int = 200_000) -> DataFrame:
    """The groups of grouped() with their representatives in layers, as layered(), the layers being those of all records."""
    each = rows.groupBy("vertex", "trust", "missing", "filled", "age_us").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    each = written(each, "points")
    lists = ranked(each, ["vertex"], ["age_us", "trust", "missing", "filled"], list_rows)
    lists = lists.groupBy("vertex", F.floor(F.col("rank") / list_rows).alias("block")).agg(
        F.min("event_id").alias("group_id"), F.sum("n").alias("n_records"), F.array_sort(F.collect_list(F.struct("age_us", "trust", "missing", "filled", "event_id"))).alias("points")
    )
    lists = written(lists.filter("n_records > 1 or block > 0"), "lists")
    last = lists.agg(F.max("block")).first()[0] or 0
    out, folded = None, None
    for block in range(last + 1):
        own = lists.filter(F.col("block") == block)
        if folded is None:
            own = own.withColumn("start", F.expr(_FRESH))
        else:
            before = folded.select("vertex", F.col("group_id").alias("g"), F.col("n_records").alias("n"), F.col("state").alias("start"))
            own = own.join(before, "vertex").withColumn("group_id", F.least("group_id", "g")).withColumn("n_records", F.col("n_records") + F.col("n"))
        folded = own.select("vertex", "group_id", "n_records", F.expr(f"aggregate(points, start, (s, r) -> {_STEP})").alias("state"))
        ended = folded
        if last:
            folded = written(folded, "folded")
            ended = folded.join(lists.filter(F.col("block") == block + 1).select("vertex"), "vertex", "left_anti")
        ended = ended.select("group_id", "n_records", F.array_sort("state.layers").alias("layers"))
        out = ended if out is None else out.unionByName(ended)
    return out.filter("n_records > 1")


def survivors(groups: DataFrame) -> DataFrame:
    """(group_id, survivor_id, n_records, donors): the first of the skyline; donors: for each field the id of the record that fills it."""
    donors = [F.expr(f"get(filter(layers, r -> r.filled & {1 << i} != 0), 0).event_id").alias(f) for i, f in enumerate(FIELDS)]
    return groups.select("group_id", F.expr("get(layers, 0).event_id").alias("survivor_id"), "n_records", F.struct(*donors).alias("donors"))


def found(impressions: DataFrame) -> DataFrame:
    """(group_id, survivor_id)."""
    return survivors(layered(representatives(grouped(written(records(delivered(impressions)), "records"))))).select("group_id", "survivor_id")


def merged(impressions: DataFrame, list_rows: int = 200_000) -> DataFrame:
    """The surviving records: group_id, survivor_id, n_records, n_filled (fields taken from others), and the fields."""
    deliveries = delivered(impressions)
    chosen = written(survivors(layered_whole(grouped(written(records(deliveries), "records")), list_rows)), "survivors")
    wanted = chosen.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"donors.{f}").alias("event_id")) for f in FIELDS])).alias("w"))
    wanted = wanted.select("group_id", "w.field", "w.event_id").filter("event_id is not null")
    given = wanted.join(deliveries.read(["event_id", *FIELDS]), "event_id").groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col(f))).alias(f) for f in FIELDS])
    taken = [F.when(F.col(f"donors.{f}") != F.col("survivor_id"), 1).otherwise(0) for f in FIELDS]
    n_filled = taken[0]
    for t in taken[1:]:
        n_filled = n_filled + t
    return chosen.join(given, "group_id", "left").select("group_id", "survivor_id", "n_records", n_filled.alias("n_filled"), *FIELDS)
