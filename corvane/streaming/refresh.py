"""Refreshes as streams: rows that arrive are looked up in the store of results, what it lacks is analysed in small batches and
written through, with counts of the progress (R7, R8, R10, R11, K3).

A trigger's results are the folder `batch=<number>` of the store, written as a whole. A replay of the trigger reads the store
without its own folder and writes that folder anew, so that each row is there once however often a trigger is started.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.snapshots import read_text, replace_text

PROGRESS = "batch long, rows long, hits long, misses long, analyzed long, failed long"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, store: str, before: int | None = None, schema: str | None = None) -> DataFrame | None:
    """The results of all triggers, or of those before a number; None where the store has none yet."""
    if not _exists(spark, store):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(store)
    return rows if before is None else rows.where(F.col("batch") < before)


def refresh_batch(rows: DataFrame, batch: int, store: str, progress: str, key: str, analyze: Callable[[DataFrame], DataFrame], schema: str) -> None:
    """One trigger. rows carry `key`, equal for rows of equal results; of equal keys one row is analysed. analyze gives each
    row it is given a row of `schema` (with `key` and `error`). Rows whose result failed are counted, and asked again when they come again."""
    spark = rows.sparkSession
    known = stored(spark, store, batch, f"{schema}, batch long")
    once = rows.dropDuplicates([key])
    misses = once if known is None else once.join(known.where("error IS NULL").select(key).distinct(), key, "left_anti")
    analyze(misses).write.mode("overwrite").parquet(f"{store}/batch={batch}")
    done = spark.read.schema(schema).parquet(f"{store}/batch={batch}")
    n, unique = rows.count(), once.count()
    found = done.agg(F.count(F.lit(1)).alias("misses"), F.count_if(F.col("error").isNull()).alias("analyzed"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    counts = [(batch, n, unique - found["misses"], found["misses"], found["analyzed"], found["failed"])]
    spark.createDataFrame(counts, PROGRESS).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={batch}")


def refresh(stream: DataFrame, store: str, progress: str, checkpoint: str, key: str, analyze: Callable[[DataFrame], DataFrame], schema: str, every: str | None = None):
    """The running query of a stream of rows: over what is there now, or, with `every` (such as `1 hour`), again and again.
    Spark starts no trigger while one runs, and a stopped query goes on where its checkpoint says."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: refresh_batch(rows, batch, store, progress, key, analyze, schema)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def progress_of(spark: SparkSession, progress: str) -> DataFrame:
    """(batch, rows, hits, misses, analyzed, failed), a row for each trigger; hits and misses count distinct keys."""
    return spark.read.schema(PROGRESS).parquet(progress) if _exists(spark, progress) else spark.createDataFrame([], PROGRESS)


class LeaseTaken(RuntimeError):
    """Another run refreshes."""


class Lease:
    """The right of one run to refresh what lies in a folder, for ttl seconds after each renewal. A file that only one run can
    make holds it; one that has expired, or that can't be read, is removed. Only its owner renews or gives it back."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str, ttl: float = 7200.0, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.run_id, self.ttl, self.clock = spark, f"{folder}/refresh.lease", run_id, ttl, clock

    def _text(self) -> str:
        return json.dumps({"run_id": self.run_id, "expires": self.clock() + self.ttl}, sort_keys=True)

    def holder(self) -> str | None:
        """The run that holds it, None if it is free or expired."""
        try:
            found = json.loads(read_text(self.spark, self.path) or "null")
            return str(found["run_id"]) if float(found["expires"]) > self.clock() else None
        except (ValueError, TypeError, KeyError):
            return None

    def acquire(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for _ in range(3):
            try:
                out = fs.create(where, False)
            except Exception as e:
                if not fs.exists(where):
                    raise
                if (by := self.holder()) is not None:
                    raise LeaseTaken(f"run {by} refreshes already") from e
                fs.delete(where, False)
                continue
            out.write(self._text().encode())
            out.close()
            return
        raise LeaseTaken("another run took the lease")

    def renew(self) -> bool:
        """Whether it is still this run's; if so, for ttl seconds more."""
        if self.holder() != self.run_id:
            return False
        replace_text(self.spark, self.path, self._text(), self.run_id)
        return True

    def release(self) -> bool:
        """Whether it was this run's to give back."""
        if self.holder() != self.run_id:
            return False
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, False))
