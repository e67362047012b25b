"""Real-time counts against settled ones, by campaign: batch - realtime = late - twins + residual."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(c: Column, start: str | None, end: str | None) -> Column:
    """start <= c < end; a missing bound does not bound."""
    test = F.lit(True)
    if start:
        test = test & (c >= F.lit(start).cast("timestamp_ntz"))
    if end:
        test = test & (c < F.lit(end).cast("timestamp_ntz"))
    return test


def reconcile(realtime: DataFrame, batch: DataFrame, late: DataFrame, warn_rate: float = 0.05) -> DataFrame:
    """realtime: campaign_id, n. batch: campaign_id, n, raw. late: campaign_id, n. One row per campaign of realtime or batch."""
    rows = (
        realtime.groupBy("campaign_id").agg(F.sum("n").alias("rt"))
        .join(batch.groupBy("campaign_id").agg(F.sum("n").alias("bt"), F.sum("raw").alias("raw")), "campaign_id", "full_outer")
        .join(late.groupBy("campaign_id").agg(F.sum("n").alias("late")), "campaign_id", "left")
        .na.fill(0, ["rt", "bt", "raw", "late"])
    )
    return with_terms(rows, warn_rate)


def with_terms(rows: DataFrame, warn_rate: float = 0.05) -> DataFrame:
    """Adds diff, ssai, residual, diff_rate, likely_cause and warn to rows of rt, bt, raw, late."""
    rows = rows.withColumn("ssai", F.col("raw") - F.col("bt")).withColumn("diff", F.col("bt") - F.col("rt"))
    rows = rows.withColumn("residual", F.col("diff") - (F.col("late") - F.col("ssai")))
    rows = rows.withColumn("diff_rate", F.bround(F.col("diff") / F.greatest("rt", "bt", F.lit(1)), 4))
    signed = lambda c: F.format_string("%+d", c)
    parts = F.concat_ws(
        " , ",
        F.when(F.col("late") != 0, F.concat(F.lit("late "), signed(F.col("late")))),
        F.when(F.col("ssai") != 0, F.concat(F.lit("ssai "), signed(-F.col("ssai")))),
        F.when(F.col("residual") != 0, F.concat(F.lit("residual "), signed(F.col("residual")))),
    )
    cause = (
        F.when((F.col("rt") == 0) & (F.col("bt") > 0), "realtime missing")
        .when((F.col("bt") == 0) & (F.col("rt") > 0), "batch missing")
        .when(parts == "", "no difference")
        .otherwise(parts)
    )
    return rows.select(
        "campaign_id", F.col("rt").alias("realtime_impressions"), F.col("bt").alias("batch_impressions"), "late", "ssai", "diff", "residual", "diff_rate",
        cause.alias("likely_cause"), (F.abs("diff_rate") > warn_rate).alias("warn"),
    )


def totals(reconciled: DataFrame) -> DataFrame:
    """The grand totals, one row."""
    sums = reconciled.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("realtime_impressions", "batch_impressions", "late", "ssai", "diff", "residual")])
    rate = F.bround(F.col("diff") / F.greatest("realtime_impressions", "batch_impressions", F.lit(1)), 4)
    return sums.withColumn("diff_rate", rate)


REPORT = ("run_at", "dt", "campaign_id", "realtime_impressions", "batch_impressions", "diff", "diff_rate", "likely_cause", "scope")


def minute_parameter(text: str) -> datetime.datetime:
    """An instant given as a parameter, without zone: without an offset it is UTC; seconds are dropped."""
    at = datetime.datetime.fromisoformat(text)
    at = at.astimezone(datetime.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    return at.replace(second=0, microsecond=0)


def of_day(c: Column, dt: str) -> Column:
    """c lies on the day dt; the bounds are compared with the column itself, so they reach the files."""
    day = F.lit(dt).cast("date")
    return (c >= day.cast("timestamp_ntz")) & (c < F.date_add(day, 1).cast("timestamp_ntz"))


def reported(reconciled: DataFrame, run_at: Column, dt: Column, scope: str) -> DataFrame:
    """The rows of a run as its history keeps them. scope: `daily` or `range`."""
    return reconciled.select(run_at.alias("run_at"), dt.alias("dt"), *[c for c in REPORT if c not in ("run_at", "dt", "scope")], F.lit(scope).alias("scope")).select(*REPORT)


def latest_run(history: DataFrame) -> DataFrame:
    """The rows of the newest run."""
    return history.filter(F.col("run_at") == history.agg(F.max("run_at")).scalar())
