"""Content-addressed reuse and change tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    """X2."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def table_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One SHA-256 for a table, whatever the order of its rows.

    Row digests are added up by prefix of the key's digest first, so no task holds all rows: the 256 buckets' digests are
    what the last step joins.
    """
    row = rows.select(digest(F.col(key).cast("string")).alias("k"), digest(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})).alias("d"))
    parts = row.groupBy(F.substring("k", 1, 2).alias("b")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("d", i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 9, 17, 25)])
    line = F.concat_ws(":", "b", "n", *[f"s{i}" for i in (1, 9, 17, 25)])
    return parts.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"))


def split_reusable(rows: DataFrame, stored: DataFrame, key: str, content: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the stored value of the same key and content, rows to work out anew)."""
    known = stored.select(key, content, value).dropDuplicates([key, content])
    return rows.join(known, [key, content]), rows.join(known, [key, content], "left_anti")


def lookup(rows: DataFrame, cache: DataFrame, cache_key: str, schema_version: int) -> DataFrame:
    """Rows with `payload` and `reason`: hit, absent, invalid_schema:<found> or invalid_payload."""
    reason = (
        F.when(F.col("__stored").isNull(), F.lit("absent"))
        .when(F.col("schema_version") != schema_version, F.concat(F.lit("invalid_schema:"), F.col("schema_version").cast("string")))
        .when(F.col("payload").isNull(), F.lit("invalid_payload"))
        .otherwise(F.lit("hit"))
    )
    found = rows.join(cache.withColumn("__stored", F.lit(1)), cache_key, "left").withColumn("reason", reason)
    return found.withColumn("payload", F.when(F.col("reason") == "hit", F.col("payload"))).drop("__stored", "schema_version")


def summary(looked_up: DataFrame) -> DataFrame:
    """A14."""
    return looked_up.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def latest(entries: DataFrame, cache_key: str, written: str) -> DataFrame:
    """K3: the entry of each key that was written last."""
    return entries.withColumn("__k", F.row_number().over(W.partitionBy(cache_key).orderBy(F.desc(written)))).where("__k = 1").drop("__k")
