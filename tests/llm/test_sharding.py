"""Shards hold every row once, near equal, gapless, and depend on the seed only."""

from corvane.llm import sharding as S
from corvane.llm.common import new_path


def test_shards(spark, docs, empty):
    rows = S.shuffled(docs, 3, bucket_bytes=200).collect()
    assert len(rows) == 11 and S.shuffled(docs, 3).columns == [c for c in docs.columns if c != "shard"] + ["size", "shard", "slot"]
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(3)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert S.shuffled(empty, 3).count() == 0


def test_files_and_order(spark):
    many = spark.range(2000).selectExpr("id as doc_id", "concat('t', id) as text")
    path = S.write_shards(many, new_path(spark, "s"), 8, bucket_bytes=500)
    back = S.read_shards(spark, path).orderBy("shard", "slot").collect()
    ids = [r["doc_id"] for r in back]
    assert sorted(ids) == list(range(2000)) and sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:], strict=False)) < 20
    assert S.shuffled(many, 8, seed=1).where("slot = 0").count() == 8


def test_order_by_seed_alone(spark):
    """The same rows in other partitions keep every place; another seed gives another order; one bucket is a permutation."""
    from pyspark.sql import functions as F

    many = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text")
    places = lambda df, **o: {r["doc_id"]: (r["shard"], r["slot"]) for r in S.shuffled(df, 8, bucket_bytes=2000, **o).collect()}
    first = places(many.repartition(7))
    assert first == places(many.coalesce(1).orderBy(F.desc("doc_id"))) != places(many, seed=1)
    one = spark.range(1).select(S.fisher_yates(F.lit(50), 3, F.lit(0)).alias("a"), S.fisher_yates(F.lit(50), 4, F.lit(0)).alias("b"), S.fisher_yates(F.lit(0), 3, F.lit(0)).alias("c")).first()
    assert sorted(one["a"]) == list(range(50)) == sorted(one["b"]) and one["a"] != one["b"] and one["a"] != list(range(50)) and one["c"] == []


def test_draws_by_hand(spark):
    """The order against the plain algorithm: each draw strikes one of what remains."""
    from pyspark.sql import functions as F

    draws = [r[0] for r in spark.range(20).orderBy("id").select(F.pmod(F.xxhash64(F.lit(9), F.lit(5), F.col("id").cast("int")), F.lit(20) - F.col("id"))).collect()]
    rest, want = list(range(20)), []
    for k in draws:
        want.append(rest.pop(k))
    assert spark.range(1).select(S.fisher_yates(F.lit(20), 9, F.lit(5)).alias("a")).first()["a"] == want
