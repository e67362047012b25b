"""Exact distinct counts over huge identifier sets, by compressed bitmaps that can be stored, merged and intersected.

Identifiers are dictionary-encoded to dense integers: each gets its rank within one of `parts` hash parts, behind the identifiers of the
parts before. The dictionary only grows, so bitmaps of earlier days stay valid. Per day and group, the integers become
buckets of 32,768; a bucket with few of them is kept as its sorted positions (two bytes each), a fuller one as a bit map of 4 KB.
Any combination of days and groups is the OR (or AND) of its buckets, and a count is the number of bits. The error is zero.

Facts are reduced to distinct (day, group, identifier) before anything else, combined before the shuffle, so an identifier or group with a
third of all rows is a few rows from each map task. A bucket is at most 4 KB, and no aggregate holds more than one
per key: no task's memory depends on the number of identifiers.

Cases. Null and empty identifiers are none. A null day or group is a value like others. Repeated rows count once. Empty tables have no
buckets. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 32_768
#: A bucket with at most so many positions is stored as a list of them.
SPARSE = 2_047


def facts(rows: DataFrame, identifier: Column, dims: dict[str, Column]) -> DataFrame:
    """Distinct (*dims, id) with an identifier."""
    picked = rows.select(*[c.alias(n) for n, c in dims.items()], identifier.alias("id"))
    return picked.filter("id is not null and id != ''").distinct()


def dictionary(ids: DataFrame, old: DataFrame | None = None, parts: int = 4096) -> DataFrame:
    """(id, n): integers from 0 on without gaps for every distinct id; ids of an old dictionary keep theirs and new ones follow.

    Ranks are taken within hash parts, which a sort can spill; the offsets of the parts are sums over `parts` rows."""
    new = ids.select("id").distinct()
    base: Column = F.lit(0).cast("bigint")
    if old is not None:
        new = new.join(old.select("id"), "id", "left_anti")
        base = F.coalesce(F.lit(old.agg(F.max("n") + 1).first()[0]), base)
    new = new.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    sizes = new.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    fresh = ranked.join(F.broadcast(offsets), "part").select("id", (base + F.col("offset") + F.col("rank")).alias("n"))
    return fresh if old is None else old.select("id", "n").unionByName(fresh)


def buckets(seen: DataFrame, codes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(*dims, bucket, positions, bits) of distinct facts: positions (smallint, less 32,768) of a sparse bucket, or the bit map of a full one."""
    n = F.col("n")
    placed = seen.join(codes, "id").select(*dims, F.floor(n / BITS).cast("int").alias("bucket"), F.pmod(n, F.lit(BITS)).cast("int").alias("bit"))
    # whole positions are brought together: a bit map built before the shuffle would be nearly empty
    full = placed.repartition(*dims, "bucket").groupBy(*dims, "bucket").agg(
        F.expr("bitmap_construct_agg(bit)").alias("bits"), F.collect_list((F.col("bit") - BITS).cast("smallint")).alias("positions")
    )
    few = F.size("positions") <= SPARSE
    return full.select(*dims, "bucket", F.when(few, F.array_sort("positions")).alias("positions"), F.when(~few, F.col("bits")).alias("bits"))


def union(stored: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(*dims, bucket, bits): the OR of all buckets that agree in dims; leave a dimension out to merge over it."""
    dense = stored.filter("bits is not null").select(*dims, "bucket", "bits")
    sparse = stored.filter("positions is not null").select(*dims, "bucket", F.explode("positions").alias("p"))
    sparse = sparse.groupBy(*dims, "bucket").agg(F.expr(f"bitmap_construct_agg(int(p) + {BITS})").alias("bits"))
    return dense.unionByName(sparse).groupBy(*dims, "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def count(bitmaps: DataFrame, dims: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """The number of bits by dims."""
    return bitmaps.groupBy(*dims).agg(F.sum(F.expr("bitmap_count(bits)")).alias(name))


def intersection(stored: DataFrame, over: str, values: Sequence, dims: Sequence[str] = ()) -> DataFrame:
    """(*dims, bucket, bits) of the identifiers seen in every one of `values` of the dimension `over`."""
    each = union(stored.filter(F.col(over).isin(*values)), [*dims, over])
    both = each.groupBy(*dims, "bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("have"))
    return both.filter(F.col("have") == len(set(values))).drop("have")


def returning(stored: DataFrame, day: str, dims: Sequence[str] = ()) -> DataFrame:
    """(*dims, day, bucket, bits) of the identifiers seen on a day and on the next, for every day."""
    each = union(stored.filter(F.col(day).isNotNull()), [*dims, day])
    pairs = each.select(*dims, F.explode(F.array(F.col(day), F.date_sub(day, 1))).alias(day), "bucket", "bits")
    both = pairs.groupBy(*dims, day, "bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("have"))
    return both.filter("have = 2").drop("have")
