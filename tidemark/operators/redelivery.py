"""Exactly one copy of each message that was delivered at least once.

Only identifier, delivery order and position (file, row) are shuffled. One winner per identifier is selected by an aggregate
that combines before the shuffle, so an identifier with a third of all deliveries is one row from each map task. The winners'
positions become bit vectors of 32,768 rows of a file: which rows stay (deletion is their complement among rows with an identifier),
and which of them had repeats. The vectors are written once. The wide table is then read in place, and each row tests its bit; payloads are never
shuffled.

Vectors take 8 KB for 32,768 rows of a file. Up to `vectors_per_group` of them go to every executor for the scan. Of a larger table, the files are put
into groups by a hash of their path and the vectors into a folder for each group; a job for each group scans its files, with its own vectors only, and
adds what stays to a table in the shared folder. So every vector is read once, no broadcast exceeds `vectors_per_group` times 8 KB by more than the
files' uneven hashes make it (one file's vectors at least), and no plan grows with the groups.

Cases. Rows without identifier are all kept and have no repeats. Null order comes last; ties are decided by file and row, so the
result is the same in every run over the same files. An empty table stays empty. Any other columns pass through unchanged;
columns named like the helpers do not clash, since helpers live in one struct of a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import folder, written

#: Rows of one bit vector, and bits of one of its numbers.
BITS, WORD = 32_768, 64


def _file() -> Column:
    """Key of the file."""
    return F.xxhash64(F.col("_metadata.file_path"))


def _position() -> tuple[Column, Column, Column]:
    """Key of the file, number of the vector in it, bit in the vector."""
    row = F.col("_metadata.row_index")
    return _file(), F.floor(row / BITS).cast("int"), F.pmod(row, F.lit(BITS)).cast("int")


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def winners(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key the first delivery by order: (file, vector, bit, repeated). rows must be a scan of parquet files."""
    file, vector, bit = _position()
    ranked = rows.select(
        F.col(key).alias("k"),
        F.struct(*[x for i, o in enumerate(order) for x in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))], file.alias("file"), vector.alias("vector"), bit.alias("bit")).alias("p"),
    ).filter("k is not null")
    best = ranked.groupBy("k").agg(F.min("p").alias("p"), (F.count("*") > 1).alias("repeated"))
    return best.select("p.file", "p.vector", "p.bit", "repeated")


def vectors(best: DataFrame) -> DataFrame:
    """(file, vector, stays, repeats) as lists of 512 numbers of 64 bits. Positions are brought together first: maps built before that would be nearly empty."""
    maps = (
        best.repartition("file", "vector")
        .groupBy("file", "vector")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("stays"), F.expr("bitmap_construct_agg(if(repeated, bit, null))").alias("repeats"))
    )
    numbers = f"transform(sequence(0, {BITS // WORD - 1}), i -> bigint(conv(hex(substring({{0}}, 8 * i + 1, 8)), 16, -10)))"
    return maps.select("file", "vector", *[F.expr(numbers.format(c)).alias(c) for c in ("stays", "repeats")])


def _bit_is_set(numbers: Column, bit: Column) -> Column:
    """A map's bytes run up, its bits within a byte from the lowest on; the first byte is the highest of its number."""
    within = F.pmod(bit, F.lit(WORD))
    at = 56 - F.shiftright(within, 3) * 8 + within.bitwiseAND(F.lit(7))
    return F.coalesce(F.call_function("getbit", F.get(numbers, F.shiftright(bit, 6)), at) == 1, F.lit(False))


class Once:
    """One delivery per key of a scan: its vectors, found and written once, for any number of reads."""

    def __init__(self, rows: DataFrame, key: str, order: list[Column], vectors_per_group: int = 8192):
        self.rows, self.key = rows, key
        n_files = len(rows.inputFiles())
        # at most so many vectors; rows are counted from the files' footers
        most = n_files + (rows.count() // BITS if n_files > 1 else 0)
        self.groups = -(-most // vectors_per_group) if n_files > 1 else min(n_files, 1)
        if self.groups:
            marks = vectors(winners(rows, key, order))
            if self.groups > 1:
                marks = marks.withColumn("part", F.pmod("file", F.lit(self.groups)).cast("int"))
            self.marks = written(marks, "vectors", *(["part"] if self.groups > 1 else []))

    def read(self, columns: list[str] | None = None, repeated_only: bool = False) -> DataFrame:
        """The deliveries that stay. columns: what to read of them, all if None. repeated_only: just those of keys with more than one delivery."""
        wide = columns or self.rows.columns
        if not self.groups:
            return self.rows.select(*wide)
        if self.groups == 1:
            return self._tested(self.rows, self.marks, wide, repeated_only)
        path = folder(self.rows.sparkSession, "once")
        for part in range(self.groups):
            own = self.rows.filter(F.pmod(_file(), F.lit(self.groups)) == part)  # files of other groups aren't opened
            self._tested(own, self.marks.filter(F.col("part") == part), wide, repeated_only).write.mode("append").parquet(path)
        return self.rows.sparkSession.read.schema(self.rows.select(*wide).schema).parquet(path)

    def _tested(self, scan: DataFrame, marks: DataFrame, wide: list[str], repeated_only: bool) -> DataFrame:
        at, test = _free(self.rows, "at"), _free(self.rows, "marks")
        file, vector, bit = _position()
        rows = scan.select(*dict.fromkeys([*wide, self.key]), F.struct(file.alias("file"), vector.alias("vector"), bit.alias("bit")).alias(at))
        which = "repeats" if repeated_only else "stays"
        own = F.broadcast(marks.select(F.struct("file", "vector", F.col(which).alias("bits")).alias(test)))
        m = F.col(test)
        rows = rows.join(own, (F.col(f"{at}.file") == m["file"]) & (F.col(f"{at}.vector") == m["vector"]), "inner" if repeated_only else "left")
        keep = _bit_is_set(m["bits"], F.col(f"{at}.bit"))
        return rows.filter(keep if repeated_only else keep | F.col(self.key).isNull()).select(*wide)


def kept_once(rows: DataFrame, key: str, order: list[Column], columns: list[str] | None = None, repeated_only: bool = False, vectors_per_group: int = 8192) -> DataFrame:
    """The scan `rows` (as read from parquet files) with one delivery per key: the first by order, nulls last.

    columns: what to read of the winners; all if None. repeated_only: just the winners of keys with more than one delivery."""
    return Once(rows, key, order, vectors_per_group).read(columns, repeated_only)
