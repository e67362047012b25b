"""The package on the executors, for functions that run in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Gives the executors this package once per application, so that they need no copy of it on their path."""
    app = spark.sparkContext.applicationId
    package = os.path.dirname(os.path.abspath(__file__))
    if app in _SHIPPED or not os.path.isdir(package):  # inside a zip it was given to Spark already
        return
    folder = tempfile.mkdtemp(prefix="tidemark-package-")  # the driver serves it as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    staged = os.path.join(folder, "staged")
    shutil.copytree(package, os.path.join(staged, "tidemark"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tidemark"), "zip", staged))
    _SHIPPED.add(app)
