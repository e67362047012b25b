"""Parquet tables of one data folder, and tables of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of `folder`, with the given columns only, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in parts. Needs the database's driver on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Appends, or replaces the rows of an existing table and keeps its definition (`overwrite`)."""
    rows.write.format("jdbc").option("url", url).option("dbtable", name).option("truncate", "true").options(**options).mode(mode).save()


def execute(spark: SparkSession, url: str, *statements: str, **properties: str) -> None:
    """Runs statements (definitions of tables, say) in a database, one after the other."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        for text in statements:
            statement = connection.createStatement()
            statement.execute(text)
            statement.close()
    finally:
        connection.close()
