"""The archive: every delivery of every topic, untouched, in one schema, partitioned by event day and hour."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import plain_key
from tidemark.schema import ARCHIVE

RENAMED = {"late_flag": "_late", "dup_flag": "_dup"}


def archived(topics: dict[str, DataFrame]) -> DataFrame:
    """The union of the topics' rows in the archive's columns; fields that a topic lacks are null, others are left out."""
    out = None
    for name, df in topics.items():
        have, at = set(df.columns), F.col("event_time")
        given = {"source_topic": F.lit(name), "dt": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")}
        cols = []
        for f in ARCHIVE.fields:
            source = RENAMED.get(f.name, f.name)
            col = given.get(f.name, F.col(source) if source in have else F.lit(None))
            cols.append(col.cast(f.dataType).alias(f.name))
        out = df.select(*cols) if out is None else out.unionByName(df.select(*cols))
    return out


def write(rows: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Parquet under dt=/hour=. Rows are brought together by partition first, so that a run leaves few files in each; a large hour is spread over
    several by a salt that follows its rows."""
    salt = F.pmod(F.xxhash64("event_id"), F.lit(8))
    rows.repartition("dt", "hour", salt).write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("dt", "hour").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The archive with its declared schema: dt and hour stay text."""
    return spark.read.schema(ARCHIVE).parquet(path)


def partitions(rows: DataFrame) -> DataFrame:
    """Rows and late rows per topic and partition."""
    return rows.groupBy("source_topic", "dt", "hour").agg(F.count("*").alias("n"), F.count_if("late_flag").alias("late"))


def lookup(rows: DataFrame, dt: str, hours: list[str], having: dict[str, list], plain: bool = False) -> DataFrame:
    """Rows of some hours of a day whose columns are among the given values, as written or, if plain, as keys are compared; on a written archive only
    those folders are read, elsewhere the bounds of event_time reach the files."""
    at = lambda hour: F.lit(datetime.datetime.fromisoformat(dt) + datetime.timedelta(hours=hour)).cast("timestamp_ntz")
    test = (F.col("dt") == dt) & F.col("hour").isin(*hours) & (F.col("event_time") >= at(min(map(int, hours)))) & (F.col("event_time") < at(max(map(int, hours)) + 1))
    for name, values in having.items():
        test = test & (plain_key(name).isin(*[v.strip(" \t\r\n").lower() for v in values]) if plain else F.col(name).isin(*values))
    return rows.filter(test)
