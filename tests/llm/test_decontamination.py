"""Window hits against a plain scan."""

import hashlib

from corvane.llm import decontamination as D

ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, "  "), (4, None), (10, "two-three four five six seven eight nine ten, eleven"), (None, "zz")]
TEXTS = [
    (1, "x one TWO three four five; six seven eight nine ten eleven twelve y", "a"),
    (2, "a Short item!", "b"), (3, "shorts item", "c"), (4, None, "d"), (5, "", "e"), (6, "short short item item short item", "f"), (6, "short short item item short item", "f"),
    (7, "é short\u00a0item short item é", "g"), (None, "short item", "h"), (8, "w " * 4000 + "short item", "i"),
]


def plain(text):
    words = D.words_of((text or "").encode())
    hit, items = set(), set()
    for i, t in ITEMS:
        own = D.words_of((t or "").encode())
        n = min(10, len(own))
        for a in range(len(own) - n + 1) if own and i is not None else ():
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[a : a + n]:
                    hit |= set(range(k, k + n))
                    items.add(i)
    return len(words), len(hit), sorted(items)


def test_scan(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for chars in (D.AUTOMATON_CHARS, 60):  # one automaton, and several
        found = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in D.scan_documents(docs, bench, automaton_chars=chars).collect())
        assert found == sorted((str(i), *plain(t)) for i, t, _ in TEXTS)
    digest = {r["doc_id"]: r for r in D.digest(D.scan_documents(docs, bench)).collect()}
    assert digest[1]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest() and digest[4]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    span = D.scan_documents(docs, bench).where("doc_id = 2").first()["spans"][0]
    assert "a Short item!"[span["begin"] : span["end"]] == "Short item"
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] + [7] * (plain(TEXTS[7][1])[1] == 0)
    assert D.scan_documents(docs.limit(0), bench).count() == 0 and D.scan_documents(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(3, "shorts item", "keep", 7, "t"), (2, "a short item", "keep", 8, "t")], "doc_id long, text string, items string, n_hit int, __text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(3, "shorts item", "keep", 7, "t")]
