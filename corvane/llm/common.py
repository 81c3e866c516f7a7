"""What the operators of this subpackage share: reading tables, the shared work folder, and plain byte-level words."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; every other byte stays, so byte offsets stay too.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A session of one machine may do without: it then
    gets a folder of its own; on a cluster the setting is needed, as a local folder there would be lost on other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
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


#: Whether a query's shuffle files go as it ends. Else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and a lost executor costs nothing. What was
    shuffled for it is deleted once it is written, as nothing reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # These tables hold hashes, which no dictionary shortens.
        df.write.option("compression", codec).option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *frames_or_paths) -> None:
    """Delete written tables that nothing will read again."""
    for x in frames_or_paths:
        path = x if isinstance(x, str) else x.inputFiles()[0].rpartition("/")[0] if x.inputFiles() else None
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released() -> None:
    """Give back what Arrow's pool of this Python worker holds for reuse: the worker stays for the tasks of other operators."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def fresh(name: str, taken) -> str:
    """A column name of one's own: `name` behind as many underscores as it takes."""
    name = f"__{name}"
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))
