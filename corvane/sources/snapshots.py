"""Versioned snapshots: a folder for each run and a pointer that is swapped when a run is whole.

The run's tables are ordinary Parquet, written by Spark to any file system. The pointer is one small file, renamed into
place through Hadoop's file system, so readers see the old run or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1
POINTER = "latest.json"


class SnapshotError(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_text(spark: SparkSession, path: str, text: str, mark: str = "new") -> None:
    """A small file written beside its place and renamed into it, so that readers see the old text or the new one."""
    folder, _, name = path.rpartition("/")
    fresh, fs = _fs(spark, f"{folder}/.{name}.{mark}")
    out = fs.create(fresh, True)
    out.write(text.encode())
    out.close()
    place, _ = _fs(spark, path)
    files = spark._jvm.org.apache.hadoop.fs.FileContext
    context = files.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()) if place.toUri().getScheme() else files.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    many = spark.sparkContext._gateway.new_array(options, 1)
    many[0] = options.OVERWRITE
    context.rename(fresh, place, many)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        return None
    opened = fs.open(place)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """K2: a value as indented JSON, UTF-8 as it is, with a line feed at its end; a reader sees it whole or not at all."""
    replace_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The JSON object of a small file; None where there is none, an error where it is anything else."""
    text = read_text(spark, path)
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError as e:
        raise SnapshotError(f"no JSON in {path}") from e
    if not isinstance(value, dict):
        raise SnapshotError(f"no JSON object in {path}")
    return value


def require_writable(spark: SparkSession, folder: str) -> str:
    """K9: the folder, which must exist and take a file."""
    where, fs = _fs(spark, folder)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise SnapshotError(f"{folder} is no folder")
    probe, _ = _fs(spark, f"{folder}/.probe-{uuid.uuid4().hex}")
    try:
        fs.create(probe, False).close()
        fs.delete(probe, False)
    except Exception as e:
        raise SnapshotError(f"{folder} can't be written to") from e
    return folder


def initial(spark: SparkSession, root: str | None, bundled: dict[str, DataFrame], needed: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The latest run of a root that has one, else the tables that come with the program. A broken run is an error, not a reason for the latter."""
    return read_snapshot(spark, root, needed) if root and read_text(spark, f"{root}/{POINTER}") is not None else bundled


def write_snapshot(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame]) -> str:
    """Write a run, which must not exist yet, and make it the latest. A failure leaves the old pointer."""
    if not run_id or "/" in run_id or run_id.startswith("."):
        raise SnapshotError(f"not a run id: {run_id!r}")
    run, fs = _fs(spark, f"{root}/{run_id}")
    if fs.exists(run):
        raise SnapshotError(f"run {run_id} exists")
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{run_id}/{name}")
    text = json.dumps({"schema_version": SCHEMA_VERSION, "run_id": run_id, "tables": sorted(tables)}, indent=2, sort_keys=True) + "\n"
    replace_text(spark, f"{root}/{POINTER}", text, run_id)
    return f"{root}/{run_id}"


def read_snapshot(spark: SparkSession, root: str, needed: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of the latest run. A missing pointer, another schema version or a missing table is an error."""
    pointer, fs = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        raise SnapshotError(f"no snapshot in {root}")
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/{POINTER}").collect())
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SnapshotError(f"broken pointer in {root}") from e
    if not isinstance(found, dict) or found.get("schema_version") != SCHEMA_VERSION:
        raise SnapshotError(f"pointer of another schema in {root}")
    lacking = sorted(set(needed) - set(found["tables"]))
    if lacking:
        raise SnapshotError(f"the run lacks {lacking}")
    return {name: spark.read.parquet(f"{root}/{found['run_id']}/{name}") for name in found["tables"]}


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K4-K6: one compact JSON object to a line, keys in alphabetic order, nulls kept."""
    from pyspark.sql import functions as F

    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
