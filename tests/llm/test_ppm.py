"""The model is a distribution, escapes and exclusions follow a plain trie, and word counts follow a plain count."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ppm
from corvane.llm.common import LOWER, fold_of


def model_of(texts, order, least):
    codes, n = np.unique(ppm.codes_of(texts, order)[0], return_counts=True)
    kept, totals = [], []
    for o in range(order + 1):
        u, inverse = np.unique(codes & np.uint64((1 << ppm.BITS * (o + 1)) - 1), return_inverse=True)
        m = np.bincount(inverse, n)
        c, at = np.unique(u >> np.uint64(ppm.BITS), return_inverse=True)
        top = np.zeros(len(c))
        np.maximum.at(top, at, m)
        kept.append((u[m >= least], m[m >= least]))
        totals.append((c[top >= least], np.bincount(at, m)[top >= least]))
    return ppm.Model(order, kept, totals)


def plain(texts, order, least, context, symbol):
    """Method C with full exclusion, from the definition."""
    count = [Counter() for _ in range(order + 1)]
    total = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [ppm.END] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            for o in range(order + 1):
                count[o][tuple(s[i - o : i + 1])] += 1
                total[o][tuple(s[i - o : i])] += 1
    out, excluded = 1.0, set()
    for o in range(order, -1, -1):
        c = tuple(context[len(context) - o :])
        own = {x: count[o][(*c, x)] for x in range(257) if count[o][(*c, x)] >= least}
        if not own:
            continue
        left = {x: n for x, n in own.items() if x not in excluded}
        n = total[o][c] - sum(own[x] for x in excluded if x in own)
        d = len(left)
        if symbol in left:
            return out * left[symbol] / (n + d)
        if n + d:
            escape = (n - sum(left.values()) + d) / (n + d)
            out *= escape if escape > 0 else 1
        excluded |= own.keys()
    return out / (257 - len(excluded))


@pytest.mark.parametrize("least", [1, 2, 4])
def test_model(least):
    texts = [b"abracadabra", b"abrakadabra abra", b"", b"banana \xc3\xa9"]
    model = model_of(texts, 3, least)
    codes = ppm.codes_of([b"abrac", b"zzab", b"\xc3\xa9a"], 3)[0]
    for code in codes.tolist():
        context = [code >> ppm.BITS * k & 511 for k in (3, 2, 1)]
        every = np.array([(code & ~511) | x for x in range(257)], np.uint64)
        p = 10 ** model.log10(every)
        assert p.sum() == pytest.approx(1, abs=1e-9)
        for x in (97, 98, 122, ppm.END):
            assert p[x] == pytest.approx(plain(texts, 3, least, context, x), rel=1e-9)


def test_scores(spark, docs, empty):
    held = fold_of(F.col("doc_id")) == 1
    out = ppm.score_texts(docs, held, order=2, nodes=1000, heavy=8).collect()
    rows = [(r["doc_id"], r["text"], r["h"]) for r in docs.withColumn("h", held).collect()]
    assert len(out) == len(rows)
    words = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    c = Counter(w for _, t, h in rows if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t, h in rows:
        own = words(t)
        want[i] = (h, len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    for r in out:
        h, tokens, known, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert ppm.score_texts(empty, held).count() == 0
    nothing = ppm.score_texts(docs, F.lit(True), order=1).where("doc_id = 3").first()
    assert nothing["base_score"] == pytest.approx(0) and nothing["score"] == pytest.approx(-math.log10(257))


@pytest.mark.parametrize(("order", "nodes"), [(5, 12), (5, 10**6), (2, 0)])
def test_scores_of_the_whole_trie(spark, docs, order, nodes, monkeypatch):
    """No node is cut: every score is that of one trie of all training texts, however few codes are shipped."""
    monkeypatch.setattr(ppm, "AT_ONCE", 20)
    r = np.random.default_rng(1)
    made = [("ab" * 9 + "".join(map(chr, r.integers(97, 103, 40)))) for _ in range(60)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    held = fold_of(F.col("doc_id")) == 1
    rows = [((q["text"] or "").encode().translate(LOWER), q["h"]) for q in frame.withColumn("h", held).collect()]
    model = model_of([t for t, h in rows if not h], order, 1)
    want = sorted(model.log10(ppm.codes_of([t], order)[0]).sum() for t, _ in rows)
    got = sorted(q["score"] for q in ppm.score_texts(frame, held, order=order, nodes=nodes, heavy=4).collect())
    assert len(got) == len(want) and got == pytest.approx(want, rel=1e-9)
