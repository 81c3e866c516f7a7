"""The folder for tables that a job writes between its steps."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a session of one machine may do without, in a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _of_this_process()
    return found.rstrip("/")


@functools.cache
def _of_this_process() -> str:
    folder = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table in the shared folder: a cut point that survives lost executors."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
