"""Operational measures over samples, counters and offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import SECOND, wall_us
from tidemark.operators.ranks import running_sum
from tidemark.storage import written


def windowed_rate(samples: DataFrame, series: list[str], at: str, value: str, window_s: int) -> DataFrame:
    """Per sample, the rate between the first and the last sample of its trailing window; 0 with fewer than two samples or less than a
    second between them, never negative. Time is cut into chunks of 16 windows, each with the window before it, so a series is many tasks."""
    chunk = 16 * window_s * SECOND
    place, lead = F.floor(F.col("us") / chunk), F.pmod(F.col("us"), F.lit(chunk)) >= chunk - window_s * SECOND
    rows = samples.withColumn("us", wall_us(at))
    rows = rows.withColumn("own", F.explode(F.when(lead, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    rows = rows.withColumn("chunk", F.when(F.col("own"), place).otherwise(place + 1))
    w = Window.partitionBy(*series, "chunk").orderBy("us").rangeBetween(-window_s * SECOND, 0)
    rows = rows.withColumn("f", F.first(F.struct("us", value)).over(w)).withColumn("l", F.last(F.struct("us", value)).over(w)).filter("own")
    span = (F.col("l.us") - F.col("f.us")) / SECOND
    rate = F.when(span >= 1, F.greatest((F.col(f"l.{value}") - F.col(f"f.{value}")) / span, F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("rate", rate).drop("us", "own", "chunk", "f", "l")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at place min(n - 1, floor(n * p)) of each group's sorted values, from counts of equal values. Columns: keys, n, value_at_p.

    Equal values become one row first; their running counts are taken by ranges (see ranks), whatever the values' distribution. Null values count nowhere."""
    rows = rows.filter(F.col(value).isNotNull())
    counts = written(rows.groupBy(*keys, value).agg(F.count("*").alias("c")), "counts")
    whole = counts.groupBy(*keys).agg(F.sum("c").alias("n")).withColumn("rank", F.least(F.col("n") - 1, F.floor(F.col("n") * p)))
    whole = whole.select(*[F.col(k).alias(f"w_{k}") for k in keys], "n", "rank")
    upto = running_sum(counts, keys, value, "c")
    joined = upto.join(whole, [upto[k].eqNullSafe(whole[f"w_{k}"]) for k in keys])
    return joined.filter("upto > rank").groupBy(*keys, "n").agg(F.min(value).alias("value_at_p"))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """offsets: topic, partition, end_offset, committed. Lag by topic; partitions without commit or behind it count 0."""
    lag = F.greatest(F.col("end_offset") - F.coalesce("committed", "end_offset"), F.lit(0))
    return offsets.groupBy("topic").agg(F.sum(F.coalesce(lag, F.lit(0))).alias("lag"), F.sum("end_offset").alias("end_offset"), F.count("*").alias("partitions"))


def exposition(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, labels and value (and the other columns) of text lines `name{labels} value`; comments and other lines are skipped."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{(.*)\})?\s+([-+0-9.eE]+|NaN)\s*$"
    rows = lines.filter(F.col(line).rlike(pattern))
    part = lambda i: F.regexp_extract(line, pattern, i)
    return rows.select(*[c for c in lines.columns if c != line], part(1).alias("name"), part(3).alias("labels"), part(4).try_cast("double").alias("value"))


def merged_counters(scrapes: DataFrame) -> DataFrame:
    """scrapes: replica, name, value. Sums over replicas and how many reported."""
    return scrapes.groupBy("name").agg(F.sum("value").alias("value"), F.count_distinct("replica").alias("alive"))


def label_sum(scrapes: DataFrame, name: str, labels: dict[str, str]) -> DataFrame:
    """One row: the sum of the values of `name` whose labels (as by exposition()) have all the given values, and how many lines have them."""
    test = F.col("name") == name
    for k, v in labels.items():
        test = test & F.col("labels").rlike(f'(^|,){re.escape(k)}="{re.escape(v)}"(,|$)')
    rows = scrapes.filter(test)
    return rows.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.count("*").alias("lines"))


def replicas(scrapes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: how many of the expected replicas reported, and how many there are. expected: replica."""
    seen = scrapes.select("replica").distinct().withColumn("alive", F.lit(1))
    return expected.select("replica").distinct().join(seen, "replica", "left").agg(F.count("alive").alias("alive"), F.count("*").alias("total"))


def topic_totals(offsets: DataFrame, window_s: int) -> DataFrame:
    """offsets: at, topic, partition, end_offset. For each topic and instant the sum of its partitions' ends, and the rate over the trailing window."""
    sums = offsets.groupBy("topic", "at").agg(F.sum("end_offset").alias("total"))
    return windowed_rate(sums, ["topic"], "at", "total", window_s)


def completion_rate(events: DataFrame, by: Column, name: str) -> DataFrame:
    """Completed among started quartiles by `by`; null without starts."""
    done, begun = F.count_if(F.col("quartile") == "complete"), F.count_if(F.col("quartile") == "start")
    return events.groupBy(by.alias(name)).agg(done.alias("completes"), begun.alias("starts"), F.try_divide(done.cast("double"), begun).alias("rate"))
