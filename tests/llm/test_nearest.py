"""Neighbours against brute force, with ties, bad vectors, repeats and few candidates."""

import numpy as np

from corvane.llm import nearest as N


def test_hadamard():
    x = np.random.default_rng(1).standard_normal((3, 8))
    assert np.allclose(np.linalg.norm(N.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 32)).astype(np.float32)
    x[600:640] = x[600]  # a group of copies, one of them a query
    bad = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [None] * 32), (None, [1.0] * 32), (7, x[7].tolist())]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in N.nearest(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1200, 20):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(1200), -np.round(s, 12)))[:5]
        found = [got[q][k] for k in range(1, 6)]
        hit += len(set(best.tolist()) & {v for v, _ in found})
        assert all(abs(s[v] - c) < 1e-9 for v, c in found)
        if 600 <= q < 640:
            assert [v for v, _ in found] == [v for v in range(600, 640) if v != q][:5]
    assert hit / (60 * 5) >= 0.9 and 5000 not in got


def test_few_candidates(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, -1.0]), (2, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    got = N.nearest(rows, rows.where("vec_id = 0"), tables=1, probes=1).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    assert N.nearest(rows.limit(0), rows.limit(0)).count() == 0
    assert N.nearest(rows, rows, functions=2).count() == 6


def test_repeats_take_no_places(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(1, [1.0, 0.1, 0.0, 0.0])] * 8 + [(2, [1.0, 0.2, 0.0, 0.0]), (3, [1.0, 0.3, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = N.nearest(frame, frame.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3]
