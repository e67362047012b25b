"""Whatever goes wrong on the way, the difference of settled and real-time counts is explained to the row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from event_rows import AD
from tidemark.operators import realtime, reconcile, settlement

T = dt.datetime(2024, 2, 5, 12)


def events(seed, resend_after=None):
    rng, rows = random.Random(seed), []
    for i in range(600):
        at = i * 0.7
        came = at + rng.random() * 2 + (rng.choice([35, 60, 95]) if rng.random() < 0.1 else 0)
        req = rng.choice([None, f"r{i}"])
        base = [i, f"e{i}", "impression", f"c{rng.randint(1, 4)}", req, None, None, rng.choice(["client", None, "lab"]), None, at, came, None, None]
        rows.append(base)
        if rng.random() < 0.08:
            rows.append([*base[:10], came + rng.random() * 3, None, True])
        if req and rng.random() < 0.05:
            rows.append([i + 10_000, f"e{i}-s", *base[2:7], "server", f"e{i}", at, at, None, None])
        if resend_after and rng.random() < 0.03:
            rows.append([*base[:10], came + resend_after, None, True])
    stamp = lambda s: T + dt.timedelta(seconds=s)
    return [(*r[:9], stamp(r[9]), stamp(r[10]), *r[11:]) for r in rows]


def residuals(spark, rows, roll):
    df = spark.createDataFrame(rows, AD)
    replayed = realtime.replay(df, roll)
    rt = realtime.window_counts(replayed, roll).select("campaign_id", F.col("impressions").alias("n"))
    batch = settlement.by_minute(df).select("campaign_id", F.col("impressions").alias("n"), F.col("raw_impressions").alias("raw"))
    late = realtime.late_events(replayed).filter("kind = 'impression'").select("campaign_id", F.lit(1).alias("n"))
    return reconcile.reconcile(rt, batch, late).collect()


@pytest.mark.parametrize("seed", range(3))
def test_residual_is_zero(spark, seed):
    out = residuals(spark, events(seed), realtime.Roll())
    assert len(out) == 4 and {r.residual for r in out} == {0}
    assert sum(r.late for r in out) > 0 and sum(r.ssai for r in out) > 0


def test_forgotten_ids_are_the_negative_residual(spark):
    roll = realtime.Roll(ttl_us=100_000_000)
    rows = events(7, resend_after=150)
    extra = realtime.replay(spark.createDataFrame(rows, AD), roll).count() - len({r[1] for r in rows})
    late_again = sum(r.residual for r in residuals(spark, rows, roll))
    assert extra > 0 and late_again == -extra
