"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets that fit in memory. Pass two gathers each bucket into an array,
puts it in a fixed order, shuffles it by Fisher-Yates and writes it. The draws are hashes of seed, bucket and step, so
that the order depends on the rows and the seed alone, not on partitions (the SQL function `shuffle` draws by partition);
a drawn row is struck out of what remains, as in the method's first form. A row's place
in the whole order is the number of rows in all earlier buckets plus its place in its own; shards are equal ranges of
places, so the law is `rows`: counts differ by one at most. Copies of a text have ids of their own and scatter like any
other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import new_path, table

#: A bucket holds about so many bytes, and so many rows, as a shuffle takes time with the square of its rows.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 2048
SEED = 7


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A random order of 0 to n - 1 that seed and bucket fix."""
    none = F.array().cast("array<int>")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)

    def strike(held: Column, step: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), bucket, step), n - step).cast("int")
        rest = held["rest"]
        return F.struct(F.concat(F.slice(rest, F.lit(1), at), F.slice(rest, at + 2, n)).alias("rest"), F.concat(held["out"], F.array(F.get(rest, at))).alias("out"))

    return F.aggregate(every, F.struct(every.alias("rest"), none.alias("out")), strike, lambda held: held["out"])


def shuffled(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with size, shard and slot added (columns of these names are replaced), in a random order that `seed` fixes.

    Null texts have size 1 like empty ones; null ids scatter like any other; rows equal in all columns are interchangeable
    and keep their number; a text of any length is one row of its bucket; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n, buckets = total["n"], max(1, math.ceil(total["b"] / bucket_bytes), math.ceil(total["n"] / bucket_rows))
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(F.col(text), F.lit("")))), F.lit(buckets))
    rows = docs.select(bucket.alias("__bucket"), *names)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # A running count over buckets, not over rows: within runs of 4096 buckets, then over the few runs.
    counts = counts.withColumn("__run", F.floor(F.col("__bucket") / 4096))
    upto = W.orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    runs = counts.groupBy("__run").agg(F.sum("__n").alias("__sum")).select("__run", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__base"))
    inside = W.partitionBy("__run").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(runs, "__run").select("__bucket", (F.col("__base") + F.col("__in")).alias("__first"))
    row = F.struct(F.col(id_col).alias("__k1"), F.xxhash64(*names).alias("__k2"), F.struct(*names).alias("__row"))
    grouped = rows.groupBy("__bucket").agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    order = fisher_yates(F.size("__rows"), seed, F.col("__bucket"))
    placed = grouped.join(bases, "__bucket").select("__first", F.posexplode(F.transform(order, lambda i: F.get("__rows", i))).alias("__i", "__r"))
    place = F.col("__first") + F.col("__i")
    shard = F.expr(f"cast((__first + __i) * {shards} div {max(1, n)} as int)")
    return placed.select(*[F.col(f"__r.__row.`{c}`").alias(c) for c in names], place.alias("__place"), shard.alias("shard")).select(
        *names, size.alias("size"), "shard", F.expr(f"__place - (cast(shard as bigint) * {max(1, n)} + {shards - 1}) div {shards}").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> str:
    """Write shuffled(docs) as Parquet, a folder for each shard, rows of a file in their order. Nulls and
    repeated rows are rows like others; an empty table writes no shard."""
    out = shuffled(docs, shards, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """What write_shards wrote, every row of it; a folder without shards needs the schema."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into shards 0 to 7, written, and read back.
    Nulls, empty and long texts, repeated rows and empty tables as in shuffled: a row for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = write_shards(docs, new_path(spark, "shards"), 8)
    return read_shards(spark, path, "doc_id long, text string, size long, slot long, shard int").select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
