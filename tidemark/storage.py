"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df written once as parquet under shared_dir() and read back: cuts the lineage, survives lost executors, and gives
    the planner true sizes. Fields keep their types; the rows' order is not kept. parts: columns with a folder for each value."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under shared_dir()."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    """The application's folder; the driver's JVM deletes it when it ends."""
    name = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if name not in _MARKED:
        fs, path = _path(spark, name)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(name)
    return name


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def clear(spark: SparkSession) -> None:
    """Deletes what written() left in this application so far. Results that were not stored elsewhere can't be read afterwards."""
    name = _folder(spark)
    fs, path = _path(spark, name)
    fs.delete(path, True)
    _MARKED.discard(name)


def table_bytes(df: DataFrame) -> int:
    """The planner's size estimate of df; of a written table, what its files hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
