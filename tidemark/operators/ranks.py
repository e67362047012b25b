"""Places of rows within their key, and maxima of all that came before, also where one key or all rows are one order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int) -> DataFrame:
    """df with rank: the place of each row, from 0, within its keys in the order of the columns of order. df is read several times.

    Keys of up to hot_rows rows go through a window. The rows of the others are put into ranges of keys and order of about hot_rows rows each;
    a row's place is its place over all ranges less that of its key's first row, so no task sorts a whole key. The ranks are the same either way
    if order tells all rows of a key apart. A null is a key of its own."""
    window = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1
    hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows)
    n = hot.agg(F.sum("count")).first()[0]
    if n is None:
        return df.withColumn("rank", window)
    named = [F.col(k).alias(f"h_{k}") for k in keys]
    same = lambda x, y: [x[k].eqNullSafe(y[f"h_{k}"]) for k in keys]
    hot = written(hot.select(*named), "hot")
    calm = df.join(hot, same(df, hot), "left_anti").withColumn("rank", window)
    by = [*keys, *order]
    rows = df.join(hot, same(df, hot), "left_semi").repartitionByRange(-(-n // hot_rows), *by).sortWithinPartitions(*by)
    rows = written(rows.withColumn("r_id", F.monotonically_increasing_id()), "ordered")  # the range above 33 bits, the place within it below
    rows = rows.withColumn("r_range", F.shiftright("r_id", 33))
    before = F.coalesce(F.sum("count").over(Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("r_range").count().select("r_range", before.alias("r_before"))
    rows = rows.join(sizes, "r_range").withColumn("r_place", F.col("r_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("r_before"))
    starts = rows.groupBy(*keys).agg(F.min("r_place").alias("r_start")).select(*named, "r_start")
    rows = rows.join(starts, same(rows, starts)).withColumn("rank", F.col("r_place") - F.col("r_start"))
    return calm.unionByName(rows.select(*calm.columns))


def before_max(df: DataFrame, order: str, values: Sequence[str], part_rows: int = 1_000_000) -> DataFrame:
    """df with before_<value>: for each value its greatest in the rows before, in ascending order; null where there is none. order tells all rows apart.

    Rows are put into ranges of about part_rows; the maxima within a range and those of the ranges before it are found apart, so no task sorts everything."""
    n = max(1, -(-df.count() // part_rows))
    rows = written(df.repartitionByRange(n, order).withColumn("r_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("r_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("r_range").agg(*[F.max(v).alias(f"top_{v}") for v in values])
    over = Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("r_range", *[F.max(f"top_{v}").over(over).alias(f"top_{v}") for v in values])
    rows = rows.join(tops, "r_range").withColumns({f"before_{v}": F.greatest(F.max(v).over(inside), F.col(f"top_{v}")) for v in values})
    return rows.drop("r_range", *[f"top_{v}" for v in values])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, part_rows: int = 1_000_000) -> DataFrame:
    """df with upto: the sum of value over the rows of its keys up to and with its own, in ascending order. keys (one at least) and order tell all rows apart; value is null nowhere.

    Sums within ranges of about part_rows, of the ranges before, and less what came before the key's first row: no task sorts a whole key."""
    n = max(1, -(-df.count() // part_rows))
    rows = written(df.repartitionByRange(n, *keys, order).withColumn("r_range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("r_range").agg(F.sum(value).alias("r_own"))
    sums = sums.select("r_range", F.coalesce(F.sum("r_own").over(Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("r_before"))
    inside = Window.partitionBy("r_range").orderBy(*keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "r_range").withColumn("r_all", F.col("r_before") + F.sum(value).over(inside))
    named = [F.col(k).alias(f"h_{k}") for k in keys]
    starts = rows.groupBy(*keys).agg(F.min(F.col("r_all") - F.col(value)).alias("r_start")).select(*named, "r_start")
    rows = rows.join(starts, [rows[k].eqNullSafe(starts[f"h_{k}"]) for k in keys])
    return rows.withColumn("upto", F.col("r_all") - F.col("r_start")).select(*df.columns, "upto")
