"""Intermediate tables lie in the shared folder and go with the application."""

import os
import subprocess
import sys

from tidemark import storage

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tidemark import storage
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}").getOrCreate()
df = storage.written(s.range(5), "numbers")
assert df.count() == 5 and len(__import__("os").listdir({folder!r} + "/tidemark")) == 1
s.stop()
"""


def test_tables_are_gone_when_the_application_ends(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", CODE.format(repo=repo, folder=str(tmp_path))], check=True, timeout=120)
    assert os.listdir(tmp_path / "tidemark") == []


def test_parts_have_folders_and_clear_deletes(spark):
    df = storage.written(spark.range(10).selectExpr("id", "id % 2 as part"), "numbers", "part")
    assert df.columns == ["id", "part"] and df.filter("part = 1").count() == 5 and storage.table_bytes(df) > 0
    storage.clear(spark)
    assert storage.written(spark.range(3), "numbers").count() == 3
