"""Held-out accuracy on made texts, thresholds, and texts without words."""

import random

from corvane.llm import toxicity as X


def test_classifier(spark):
    r = random.Random(1)
    rows = []
    for i in range(1500):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 400))]
        bad = i % 5 == 0
        if bad:
            words.insert(r.randint(0, len(words)), r.choice(["Rotten", "vile", "nasty"]))
        rows.append((i, " ".join(words), int(bad), "en" if i % 2 else "fr"))
    rows += [(2000, None, None, "en"), (2001, "", 0, "xx"), (2002, "vile", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    model = X.train(docs.where("doc_id % 3 > 0"))
    out = X.flag(X.score(docs.selectExpr("*", "toxic as score"), model), model).collect()
    held = [r for r in out if r["doc_id"] % 3 == 0 and r["doc_id"] < 1500]
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in held) / len(held) > 0.97
    assert sum(r["rejected"] == bool(r["toxic"]) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and set(model.thresholds) == {"en", "fr"}
    by = {r["doc_id"]: r for r in out}
    assert by[2000]["score"] == by[2001]["score"] < 0.5 < by[2002]["score"]


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", 0, "en"), (2, "c", 0, "en")], "doc_id long, text string, toxic int, lang string")
    assert X.score(docs, X.train(docs)).where("score >= 0.5").count() == 0
    nobody = docs.limit(0)
    assert X.score(docs, X.train(nobody)).count() == 2 and X.score(nobody, X.train(docs)).count() == 0


def test_threshold():
    import numpy as np

    assert X.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == 0.5
    assert 0.4 < X.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1]), 1) < 0.6
    assert X.best_threshold(np.array([0.1]), np.array([0])) == 0.5


def test_thresholds_of_all_rows(spark):
    """Rows beyond the fitted sample calibrate, and a language without toxic rows uses the common threshold."""
    import numpy as np

    r = random.Random(2)
    words = lambda: " ".join(f"w{r.randint(0, 40)}" for _ in range(20))
    rows = [(i, words() + (" vile" if i % 10 == 0 else ""), int(i % 10 == 0), "fr" if i % 10 == 3 else "en") for i in range(800)]
    model = X.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string"), max_positive=20, max_negative=20)
    assert set(model.thresholds) == {"en"}
    assert X.best_threshold(np.array([0.4, 0.6]), np.array([0, 1]), weights=np.array([9, 20])) == 0.5


def small_network(seed=3):
    import numpy as np

    r = np.random.default_rng(seed)
    net = X.Network(seed)
    net.keys = np.arange(1, 21)
    net.E = r.standard_normal((21, X.DIMS)).astype(np.float64)
    net.E[0] = 0
    net.W = [W.astype(np.float64) for W in net.W]
    net.b = [0.1 * r.standard_normal(X.FILTERS) for _ in X.WIDTHS]
    net.v = r.standard_normal(len(net.v))
    return net, [r.integers(0, 21, k) for k in (1, 2, 3, 7, 40)]


def test_pool_against_loops():
    import numpy as np

    net, texts = small_network()
    got, _, _ = net.pool(np.concatenate(texts), np.array([len(t) for t in texts]))
    for i, text in enumerate(texts):
        padded = np.concatenate([text, np.zeros(max(X.WIDTHS) - 1, np.int64)])
        want = []
        for w, W, b in zip(X.WIDTHS, net.W, net.b, strict=True):
            places = range(len(padded) - w + 1)
            best = [max(sum(net.E[padded[p + k]] @ W[k][:, f] for k in range(w)) + b[f] for p in places) for f in range(X.FILTERS)]
            want += [max(0.0, x) for x in best]
        assert np.allclose(got[i], want, atol=1e-5)


def test_gradients_against_differences():
    import numpy as np

    net, texts = small_network()
    labels = np.array([0, 1, 1, 0, 1], float)

    def loss():
        h, _, _ = net.pool(np.concatenate(texts), np.array([len(t) for t in texts]))
        z = h @ net.v + net.c
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    grads, dc, rows, ge = net.gradients(texts, labels)
    def slope(array, at, eps=1e-5):
        array[at] += eps
        up = loss()
        array[at] -= 2 * eps
        down = loss()
        array[at] += eps
        return (up - down) / (2 * eps)

    r = np.random.default_rng(0)
    for param, grad in zip([*net.W, *net.b, net.v], grads, strict=True):
        for _ in range(4):
            at = tuple(int(r.integers(0, n)) for n in param.shape)
            assert abs(slope(param, at) - grad[at]) < 1e-4
    for i in range(0, len(rows), 3):
        if rows[i]:
            assert abs(slope(net.E, (int(rows[i]), 2)) - ge[i, 2]) < 1e-4


def test_stays_outside_names_and_languages(spark):
    """Own columns stay as they are, a missing lang is no error, repeated rows and long texts are scored."""
    import numpy as np

    net, _ = small_network()
    model = X.Classifier(net, {"en": 0.0}, 2.0)
    rows = [(1, "a " * 30_000, "keep", "mine"), (1, "a " * 30_000, "keep", "mine"), (2, None, "keep", "mine"), (None, "", "keep", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, rejected string")
    kept = X.clean(docs, model).collect()
    assert len(kept) == 4 and all(k["score"] == "keep" and k["rejected"] == "mine" for k in kept)
    from pyspark.sql import functions as F

    assert X.clean(docs.withColumn("lang", F.lit("en")), model).count() == 0
    assert np.all([k["score"] is not None for k in X.score(docs, model).collect()])


def test_text_goes_to_python_once(spark, docs):
    """Scoring adds no second copy of the text to what a task sends, and a text under another case of its name is found."""
    model = X.Classifier(X.Network(), {}, 0.5)
    scored = X.score(docs, model)
    assert scored._jdf.queryExecution().analyzed().child().output().size() == len(docs.columns) - 1
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"]
    assert {q["score"] for q in X.score(docs, model, "TEXT").collect()} == {q["score"] for q in scored.collect()}
