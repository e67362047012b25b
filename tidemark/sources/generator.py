"""Seeded traffic of viewers: sessions, ad pods, each ad's life cycle, and the faults of delivery. Every draw is a hash of the seed, its purpose and what it is for, so
the traffic is the same in every run, whatever the partitions, and a session's rows need no other session's.

Life cycle of an ad: its request (campaign `pending`), the response, the impression, five quartiles, and a click of those who saw at least the midpoint. Pods of
one to three ads follow at the session's breaks. Some viewers leave a session, or an ad after its start; some responses show nothing.

Faults, in this order for every event: a server twin of an impression, made before the event is shifted, so the twin is on time; a shift of the event time into
the past; a forged signature, which only pixels can have; a required field removed; then the event is sent, and perhaps once more some time later. A repeat draws
its way of sending anew. Twins and behaviour never go by pixel, forged ones always do."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import wall_time
from tidemark.sources.ingest import REQUIRED

# Rates of faults, of behaviour, and the shares of pod sizes; ad lengths; quartiles with their part of the ad.
LATE, DUP, BAD, FORGE, SSAI, PIXEL = 0.10, 0.05, 0.01, 0.01, 0.03, 0.15
LEAVE_SESSION, LEAVE_AD, CLICK, NO_FILL = 0.20, 0.08, 0.10, 0.08
PODS = ((1, 0.45), (2, 0.40), (3, 0.15))
LENGTHS = (15, 15, 15, 30)
QUARTILES = (("start", 0.0), ("first_quartile", 0.25), ("midpoint", 0.5), ("third_quartile", 0.75), ("complete", 1.0))
# Events a second of the modes.
MODES = {"normal": 200, "live": 2000, "burst": 200}

_MS = 1000
_BEHAVIOUR = ("session_start", "progress", "session_end", "content_end")


@dataclass(frozen=True)
class Traffic:
    seed: int = 1
    start: datetime.datetime = datetime.datetime(2024, 1, 1)
    campaigns: int = 8
    breaks: int = 3
    break_every_s: int = 600
    late: float = LATE
    dup: float = DUP
    bad: float = BAD
    forge: float = FORGE
    ssai: float = SSAI
    pixel: float = PIXEL
    leave_session: float = LEAVE_SESSION
    leave_ad: float = LEAVE_AD
    drop_impression: float = 0.0
    click: float = CLICK
    no_fill: float = NO_FILL

    def draw(self, purpose: str, *of: Column | str) -> Column:
        """A number from 0 up to 1."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(purpose), *of), F.lit(1 << 53)) / float(1 << 53)

    def chance(self, purpose: str, rate: float, *of: Column | str) -> Column:
        return self.draw(purpose, *of) < rate


def life(spark: SparkSession, users: int, t: Traffic = Traffic()) -> DataFrame:  # noqa: B008
    """The events as they happen, without faults: event_id, event_type, campaign_id, ad_request_id, ..., at_ms (when it happened). A row for each."""
    start_ms = int((t.start - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    session = spark.range(users).select(
        F.col("id").alias("user"), F.concat(F.lit("usr-"), "id").alias("user_id"), F.concat(F.lit("ses-"), "id").alias("session_id"), F.concat(F.lit("cnt-"), F.pmod(F.xxhash64(F.lit(t.seed), "id"), F.lit(40))).alias("content_id"),
        F.element_at(F.array(*map(F.lit, ("smart_tv", "mobile", "pc", "tablet"))), (t.draw("device", "id") * 4).cast("int") + 1).alias("device"),
        (start_ms + t.draw("begin", "id") * t.break_every_s * _MS).cast("bigint").alias("begin_ms"), t.chance("leave", t.leave_session, "id").alias("leaves"),
        (t.draw("leave at", "id") * (t.breaks + 1) * t.break_every_s).alias("leave_s"),
    )
    length = (t.breaks + 1) * t.break_every_s
    inside = lambda s: ~F.col("leaves") | (s <= F.col("leave_s"))
    step = lambda kind, s, name: F.struct(F.lit(kind).alias("event_type"), s.cast("double").alias("playhead_s"), name.alias("name"))
    end_s = F.when(F.col("leaves"), F.col("leave_s")).otherwise(F.lit(length))
    pings = F.transform(F.sequence(F.lit(60), F.lit(length - 60), F.lit(60)), lambda s: step("progress", s, F.concat(F.lit("p"), s)))
    steps = F.concat(
        F.array(step("session_start", F.lit(0), F.lit("s"))), pings,
        F.when(~F.col("leaves"), F.array(step("content_end", end_s, F.lit("c")))).otherwise(F.array().cast("array<struct<event_type:string,playhead_s:double,name:string>>")),
        F.array(step("session_end", end_s, F.lit("e"))),
    )
    who = ["user_id", "session_id", "content_id", "device"]
    behaviour = session.withColumn("b", F.explode(steps)).filter(inside(F.col("b.playhead_s"))).select(
        F.concat(F.lit("evt-"), "user", F.lit("-"), "b.name").alias("event_id"), "b.event_type", F.lit("none").alias("campaign_id"), F.lit(None).cast("string").alias("ad_request_id"), *who,
        F.round("b.playhead_s", 1).alias("playhead_s"), (F.col("begin_ms") + F.col("b.playhead_s") * _MS).cast("bigint").alias("at_ms"),
    )
    pods = session.withColumn("pod", F.explode(F.sequence(F.lit(1), F.lit(t.breaks)))).filter(inside(F.col("pod") * t.break_every_s))
    size, below, share = F.lit(PODS[-1][0]), 0.0, t.draw("pod", "user", "pod")
    picked = []
    for n, p in PODS[:-1]:
        below += p
        picked.append(F.when(share < below, n))
    size = F.coalesce(*picked, size)
    ads = pods.withColumn("ad_slot", F.explode(F.sequence(F.lit(0), size - 1)))
    ad = ["user", "pod", "ad_slot"]
    seconds = F.element_at(F.array(*map(F.lit, LENGTHS)), (t.draw("length", *ad) * len(LENGTHS)).cast("int") + 1)
    ads = ads.withColumn("name", F.concat_ws("-", *ad)).withColumn("ad_duration_s", seconds).withColumn("fill", ~t.chance("no fill", t.no_fill, *ad))
    ads = ads.withColumn("campaign", F.when(F.col("fill"), F.concat(F.lit("cmp-"), 1 + (t.draw("campaign", *ad) * t.campaigns).cast("int"))).otherwise("nofill"))
    # quartiles up to where the viewer leaves the ad (after its start at least)
    left = F.when(t.chance("leave ad", t.leave_ad, *ad), 1 + (t.draw("leave ad at", *ad) * 4).cast("int")).otherwise(len(QUARTILES))
    shown = F.col("fill") & ~t.chance("drop", t.drop_impression, *ad)
    of = lambda kind, quartile, campaign, s: F.struct(F.lit(kind).alias("event_type"), F.lit(quartile).cast("string").alias("quartile"), campaign.alias("campaign_id"), s.cast("double").alias("after_s"))
    mine, seen = F.col("campaign"), 0.3 + F.col("ad_duration_s") * 0.0
    made = [of("ad_request", None, F.lit("pending"), F.lit(0.0)), of("ad_response", None, mine, F.lit(0.1)), F.when(shown, of("impression", None, mine, seen))]
    made += [F.when(shown & (left > i), of("quartile", q, mine, seen + F.col("ad_duration_s") * part)) for i, (q, part) in enumerate(QUARTILES)]
    made.append(F.when(shown & (left > 2) & t.chance("click", t.click, *ad), of("click", None, mine, seen + F.col("ad_duration_s") + 0.1)))
    ads = ads.withColumn("e", F.explode(F.array_compact(F.array(*made))))
    gap = (F.col("ad_slot") * 31).cast("double")  # ads of a pod follow one another
    shows = ads.select(
        F.concat_ws("-", F.lit("evt"), "name", F.col("e.event_type"), F.col("e.quartile")).alias("event_id"), "e.event_type", "e.campaign_id", F.concat(F.lit("req-"), "name").alias("ad_request_id"), *who,
        (F.col("pod") * F.lit(float(t.break_every_s))).alias("playhead_s"), F.concat_ws("-", F.lit("pod"), "user", "pod").alias("ad_pod_id"), "ad_slot", "ad_duration_s", F.concat(F.replace("campaign", F.lit("cmp"), F.lit("crt")), F.lit("-a")).alias("creative_id"),
        "e.quartile", F.when(F.col("e.event_type") == "ad_response", F.col("fill")).alias("fill"), (F.col("begin_ms") + (F.col("pod") * t.break_every_s + gap + F.col("e.after_s")) * _MS).cast("bigint").alias("at_ms"),
    )
    return behaviour.unionByName(shows, allowMissingColumns=True).withColumn("source", F.when(F.col("event_type") == "ad_response", "server").otherwise("client"))


def deliveries(events: DataFrame, t: Traffic = Traffic()) -> DataFrame:  # noqa: B008
    """life() with its faults, a row for each sending: the fields, event_time, sent_ms, transport (`batch` or `pixel`), forged, removed (the missing field), _late, _dup and copy (`own`, `twin` or `dup`)."""
    e = F.col("event_id")
    ad = ~F.col("event_type").isin(*_BEHAVIOUR, "ad_request", "ad_response")  # what the player may send by pixel
    base = events.withColumn("ssai_twin_of", F.lit(None).cast("string")).withColumn("may_pixel", ad)
    kinds = F.array_compact(F.array(F.lit("own"), F.when((F.col("event_type") == "impression") & t.chance("ssai", t.ssai, e), "twin"), F.when(t.chance("dup", t.dup, e), "dup")))
    rows = base.withColumn("copy", F.explode(kinds))
    twin, dup = F.col("copy") == "twin", F.col("copy") == "dup"
    late = t.chance("late", t.late, e) & ~twin
    shift = F.when(late, ((30 + 30 * t.draw("shift", e)) * _MS).cast("bigint")).otherwise(0)
    removed = F.when(t.chance("bad", t.bad, e) & ~twin, F.element_at(F.array(*map(F.lit, REQUIRED)), (t.draw("victim", e) * len(REQUIRED)).cast("int") + 1))
    forged = t.chance("forge", t.forge, e) & (F.col("copy") == "own")
    pixel = forged | (F.col("may_pixel") & ~twin & t.chance("pixel", t.pixel, e, "copy"))
    again = F.when(dup, ((0.5 + 2.5 * t.draw("again", e)) * _MS).cast("bigint")).otherwise(0)
    rows = rows.select(
        *[c for c in base.columns if c not in ("event_id", "source", "ssai_twin_of", "may_pixel")],
        F.when(twin, F.concat(e, F.lit("-twin"))).otherwise(e).alias("event_id"), F.when(twin, "server").otherwise(F.col("source")).alias("source"), F.when(twin, e).alias("ssai_twin_of"),
        (F.col("at_ms") - shift).alias("event_ms"), (F.col("at_ms") + 50 + again).alias("sent_ms"), F.when(pixel, "pixel").otherwise("batch").alias("transport"), forged.alias("forged"), removed.alias("removed"),
        F.when(late, True).alias("_late"), F.when(dup, True).alias("_dup"), "copy",
    )
    return rows.withColumn("event_time", wall_time(F.col("event_ms") * _MS)).drop("event_ms")


def as_bodies(sent: DataFrame) -> DataFrame:
    """The batch sendings as request bodies (sent_ms, body), each one event's JSON without its removed field; pixels are left out."""
    rows = sent.filter("transport = 'batch'")
    fields = [c for c in sent.columns if c not in ("transport", "forged", "removed", "sent_ms", "at_ms", "event_time", "copy")]
    value = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if c == "event_time" else F.col(c)
    present = [F.when(F.coalesce(F.col("removed") != c, F.lit(True)), value(c)).alias(c) for c in [*fields, "event_time"]]
    return rows.select("sent_ms", F.to_json(F.struct(*present)).alias("body"))


def paced(sent: DataFrame, mode: str = "normal", period_s: int = 60, pause_s: int = 10) -> DataFrame:
    """sent with sent_ms at the mode's average rate: time between sendings is stretched by one factor, what the controller of a live run would settle at.
    In `burst`, what falls into the last pause_s of a period goes out at once when the period ends."""
    spread = sent.agg(F.min("sent_ms").alias("low"), F.greatest(F.max("sent_ms") - F.min("sent_ms"), F.lit(1)).alias("span"), F.count("*").alias("n")).first()
    if not spread["n"]:
        return sent
    factor = spread["n"] * _MS / MODES[mode] / spread["span"]
    at = ((F.col("sent_ms") - spread["low"]) * factor).cast("bigint")
    if mode == "burst":
        inside = F.pmod(at, F.lit(period_s * _MS))
        at = F.when(inside >= (period_s - pause_s) * _MS, at - inside + period_s * _MS).otherwise(at)
    return sent.withColumn("sent_ms", spread["low"] + at)


# What one event does to the stores, by experiment: the sendings, as (event id, changes).
EXPERIMENTS = {
    "normal": [{}],
    "duplicate": [{}, {"_dup": True, "sent_ms": 1500}],
    "ssai": [{}, {"event_id": "probe-twin", "source": "server", "ssai_twin_of": "probe"}],
    "late": [{"event_ms": -90_000, "_late": True}],
    "bad_schema": [{"removed": "campaign_id"}],
    "forged": [{"transport": "pixel", "forged": True}],
    "ad_request": [{"event_type": "ad_response", "fill": True, "source": "server"}],
}


def experiment(spark: SparkSession, kind: str, at: datetime.datetime, campaign: str = "cmp-probe") -> DataFrame:
    """The sendings of one experiment, in the columns of deliveries()."""
    at_ms = int((at - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    base = {"event_id": "probe", "event_type": "impression", "campaign_id": campaign, "ad_request_id": "req-probe", "fill": None, "source": "client", "ssai_twin_of": None, "sent_ms": 0, "event_ms": 0,
            "transport": "batch", "forged": False, "removed": None, "_late": None, "_dup": None}
    rows = [base | change for change in EXPERIMENTS[kind]]
    schema = "event_id string, event_type string, campaign_id string, ad_request_id string, fill boolean, source string, ssai_twin_of string, sent_ms long, event_ms long, transport string, forged boolean, removed string, _late boolean, _dup boolean"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return df.withColumn("event_time", wall_time((F.col("event_ms") + at_ms) * _MS)).withColumn("sent_ms", F.col("sent_ms") + at_ms).drop("event_ms")
