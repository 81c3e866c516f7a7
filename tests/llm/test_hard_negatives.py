"""Hard negatives against a plain loop in Python's integers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label long, id long, block string, anchor int, bucket double"


def brute(rows, anchors, positives=5, negatives=5, share=(4, 5)):
    one = {}
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            one[i] = min(one.get(i, (y, v)), (y, v))
    ints = {i: [math.floor(256 * x) for x in v] for i, (_, v) in one.items()}
    out = []
    for a in [i for i in one if anchors(i)]:
        score = {i: sum(x * y for x, y in zip(ints[a], v, strict=False)) for i, v in ints.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == one[a][0]][:positives]:
            found = [i for i in order if one[i][0] != one[a][0] and share[0] * score[p] <= share[1] * score[i] and score[i] <= score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(found[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, -1, "x", 7, 0.5) for i, v, y in rows], SCHEMA)


def random_rows(n, dims, labels, seed, coarse):
    r = np.random.default_rng(seed)
    at = r.normal(size=(n, dims)) if not coarse else r.integers(-2, 3, (n, dims)) / 8
    return [(int(i), [float(x) for x in v], int(min(y, labels - 1))) for i, v, y in zip(r.permutation(n), at, r.integers(0, labels * 3 // 2, n), strict=True)]


@pytest.mark.parametrize(("dims", "coarse", "block", "chunk"), [(7, False, 16, 3), (20, True, 5, 6), (3, True, 1024, 32)])
def test_same_as_a_plain_loop(spark, monkeypatch, dims, coarse, block, chunk):
    """Many small blocks, several levels of merging, ties by the score, one label with a third of all rows."""
    monkeypatch.setattr(h, "FAN", 3)
    rows = random_rows(150, dims, 4, dims, coarse)
    got = h.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_nulls_repeats_lengths_and_size(spark):
    good = random_rows(40, 4, 2, 3, False)
    odd = [(None, [1.0] * 4, 0), (100, None, 0), (101, [1.0, None, 1.0, 1.0], 0), (102, [math.nan] * 4, 0), (103, [math.inf, 0.0, 0.0, 0.0], 1), (104, [1.0] * 4, None), (105, [1e300] * 4, 1)]
    fine = [(110, [1.0, 2.0], 0), (120, [], 1), (130, [0.0] * 4, 0), good[0], good[0], (good[1][0], [9.0] * 4, 1), (140, [1e6, -1e6, 1e6, 5e5], 1), (141, [1e6, -1e6, 1e6, 4e5], 0), (142, [1e6, -1e6, 1e6, 3e5], 1)]
    rows = good + fine
    got = sorted(map(tuple, h.hard_negatives(frame(spark, rows + odd), F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0) and {140} == {x[0] for x in got if x[0] == 140}


def test_empty_tables_and_lonely_anchors(spark):
    none = frame(spark, [])
    assert h.hard_negatives(none, F.lit(True)).collect() == []
    assert h.hard_negatives(frame(spark, [(1, [1.0], 0)]), F.col("vec_id") > 5).collect() == []
    assert h.hard_negatives(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)]), F.lit(True)).collect() == []
    assert h.hard_negatives(frame(spark, [(1, [], 0), (2, [], 1), (3, [], 0)]), F.col("vec_id") == 1).collect() == [(1, 3, 1, 2, 0, 0)]


def test_top_keeps_ties_by_id():
    scores = np.array([[5, 7, 7, 7, 1], [0, 0, 0, 0, 0]])
    ids, best = h.top(scores, np.array([[True] * 5, [True, False, True, True, True]]), np.array([1, 3, 5, 7, 9]), 2)
    assert ids.tolist() == [[3, 5], [1, 5]] and best.tolist() == [[7, 7], [0, 0]]
    assert h.product(np.array([[2**31 - 1] * 2]), np.array([[2**31 - 1] * 2])).tolist() == [[2 * (2**31 - 1) ** 2]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    assert sorted(map(tuple, h.op11_hard_negatives(spark, f"/root/testdata/{sf}").collect())) == sorted(con.sql(h.OP11_SQL).fetchall())
