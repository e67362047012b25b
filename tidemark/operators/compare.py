"""Differences between two copies of a table, field by field.

Rows that are equal on both sides cancel out first. The rest get their rank within key and side in the order of their values, are put into
hash buckets of key and rank, and cogrouped as Arrow tables. In a bucket, keys become integers, the sides are aligned by sorted search, all fields
are compared at once through null-aware masks, and the masked cells come out as rows. Buckets are sized from row counts, so none outgrows a task.

Cases. Null equals null and differs from every value; NaN equals NaN. Fully equal rows of one side count once. A null key part is a key
value of its own. Where a key has several rows that are not on the other side, they match first to first, second to second in the order of their
values; what one side has more of is missing on the other. The rule holds for every key at every size. Keys with more than `hot_rows` such rows on a
side are ranked by ranges. Empty sides give only missing rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import ranked
from tidemark.shipping import shipped
from tidemark.storage import written

MISSING_IN_COPY, MISSING_IN_ORIGINAL = "missing_in_copy", "missing_in_original"


def differences(
    original: DataFrame, copy: DataFrame, keys: dict[str, Column], fields: Sequence[str], bucket_rows: int = 100_000, hot_rows: int = 20_000
) -> DataFrame:
    """keys: name -> expression over either side. One row (*keys, difference) for each row missing on a side and each field that differs."""
    names = [f"k{i}" for i in range(len(keys))]
    cells = [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame, bit: int) -> DataFrame:
        columns = [*(e.alias(n) for n, e in zip(names, keys.values(), strict=True)), *(F.col(f).alias(c) for f, c in zip(fields, cells, strict=True))]
        return df.select(*columns, F.lit(bit).alias("side"))

    shipped(original.sparkSession)
    rows = side(original, 1).unionAll(side(copy, 2)).groupBy(*names, *cells).agg(F.bit_or("side").alias("side")).filter("side < 3")
    rows = written(rows, "unequal")
    n = max(1, -(-rows.count() // bucket_rows))
    rows = ranked(rows, [*names, "side"], cells, hot_rows).withColumn("bucket", F.pmod(F.xxhash64(*names, "rank"), F.lit(n)))
    own = [*names, *cells, "rank", "bucket"]
    a, b = (rows.filter(F.col("side") == bit).select(*[F.col(c).alias(c) for c in own]) for bit in (1, 2))  # columns of their own, else cogroup mixes them up
    types = dict(a.dtypes)
    schema = ", ".join([*(f"`{k}` {types[n]}" for k, n in zip(keys, names, strict=True)), "difference string"])
    out_names = list(keys)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compare(left, right, names, cells, list(fields), out_names)

    return a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(compare, schema)


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integers that are equal where the values are; nulls get -1."""
    both = pa.chunked_array([*left.chunks, *right.chunks], type=left.type)
    codes = pd.factorize(both.to_pandas(integer_object_nulls=True, timestamp_as_object=False), use_na_sentinel=True)[0].astype(np.int64)
    return codes[: len(left)], codes[len(left) :]


def _compare(left: pa.Table, right: pa.Table, names: list[str], cells: list[str], fields: list[str], out_names: list[str]) -> pa.Table:
    ka, kb = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for n in [*names, "rank"]:
        x, y = _codes(left[n], right[n])
        ka, kb = _dense(np.concatenate([ka, kb]), np.concatenate([x, y]), len(left))
    values = [_codes(left[c], right[c]) for c in cells]
    order_a, order_b = np.argsort(ka), np.argsort(kb)
    sa, sb = ka[order_a], kb[order_b]
    at = np.searchsorted(sb, sa)
    hit = (at < len(sb)) & (sb[np.minimum(at, max(len(sb) - 1, 0))] == sa) if len(sb) else np.zeros(len(sa), bool)
    found = np.zeros(len(sb), bool)
    found[at[hit]] = True
    rows_a, rows_b = order_a[hit], order_b[at[hit]]
    picks, labels = [(left, order_a[~hit]), (right, order_b[~found])], [MISSING_IN_COPY, MISSING_IN_ORIGINAL]
    for (va, vb), f in zip(values, fields, strict=True):
        picks.append((left, rows_a[va[rows_a] != vb[rows_b]]))
        labels.append(f)
    parts = [
        pa.table([*(t[n].take(pa.array(rows)) for n in names), pa.array([label] * len(rows), pa.string())], names=[*out_names, "difference"])
        for (t, rows), label in zip(picks, labels, strict=True)
    ]
    return pa.concat_tables(parts)


def _dense(high: np.ndarray, low: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """One integer for each pair (high, low); low is -1 or more."""
    codes = pd.factorize(high * (int(low.max(initial=0)) + 2) + low + 1)[0].astype(np.int64)
    return codes[:split], codes[split:]
