"""Operators on small tables with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import etl, incremental, labels, publication, repository, scoring, search, training_rows, vectors
from corvane.sources import cards, snapshots


def test_bm25_worked_example(spark):
    docs = spark.createDataFrame([("d1", "cat cat dog"), ("d2", "dog bird"), ("d3", "fish")], "id string, text string")
    posted = search.postings(docs, "id", {"text": 1.0}, T.tokens)
    found = {r["id"]: r["score"] for r in search.scored(posted, 3, 2.0, ["cat", "dog"], "id").collect()}
    assert found == pytest.approx({"d1": 1.591206, "d2": 0.470004}, abs=1e-6)
    hits = search.scored(posted, 3, 2.0, ["cat", "dog"], "id")
    top = search.ranked(hits, docs.withColumn("likes", F.lit(1)), "id", "likes", "text", 2, search.phrase_boost("fish", F.col("text"), F.col("id"))).collect()
    assert [r["id"] for r in top] == ["d3", "d1"] and top[0]["total"] == 3 and top[0]["score"] == 1.0
    with pytest.raises(ValueError):
        search.search_limit(31)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:2]}
    assert {(r["id"], r["other"]) for r in vectors.top_pairs(rows, rows, 2, block=16).collect()} == want
    links = vectors.nearest_links(rows).collect()
    assert {(r["source"], r["target"]) for r in links} == {(min(p), max(p)) for p in want}
    assert [vectors.cluster_count(n) for n in (3, 10, 12, 64, 125, 500)] == [3, 6, 6, 8, 10, 10]
    with pytest.raises(Exception, match="length zero"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalized(F.col("v"))).collect()


def test_clusters_and_layouts(spark):
    centers = np.eye(6)[[0, 1, 2]] * 10
    rows = spark.createDataFrame([(i, (centers[i % 3] + 0.01 * i).tolist()) for i in range(24)], "id long, vec array<double>")
    found = {r["id"]: r["cluster_id"] for r in vectors.kmeans(rows, 3, starts=3).collect()}
    assert len({(i % 3, c) for i, c in found.items()}) == 3
    placed = vectors.pca_layout(rows).collect()
    assert len(placed) == 24 and all(10 <= r["x"] <= 90 and 10 <= r["y"] <= 90 for r in placed)
    first, again = (vectors.tsne_layout(rows, 100).orderBy("id").collect() for _ in range(2))
    assert first == again and all(3 <= r["x"] <= 97 for r in first)


def test_gap(spark):
    rows = spark.createDataFrame([("a", 0.30), ("b", 0.50), ("c", 0.65), ("d", 0.95)], "seed string, score double")
    assert {r["seed"]: round(r["gap"], 6) for r in vectors.gap_scores(rows, "seed").collect()} == {"a": 1, "b": 0.75, "c": 0.5, "d": 0}


def test_labels(spark):
    names = ["openbmb", "Best Use of Codex", "Custom frontend", "Modal (first)", "nonsense"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(labels.canonical(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["OpenBMB", "Codex", "Off-Brand", "Modal", None]
    tagged = spark.createDataFrame([(1, ["Sponsor:Modal", "x", "sponsor:modal", "track:wood"])], "id long, tags array<string>")
    assert {r["label"] for r in labels.declared(tagged, "id", "tags").collect()} == {"Modal", "Thousand Token Wood"}
    matches = spark.createDataFrame([(1, "Modal", 0.5, " e ", "readme"), (2, "?", 0.5, "e", "readme"), (3, "Codex", 1.5, "e", "readme"), (4, "Codex", 0.1, " ", "readme"), (5, "Codex", 0.1, "Signals: x", "readme"), (6, "Codex", 0.1, "x", "rules")], "id long, label string, confidence double, evidence string, source string")
    assert [r["error"] for r in labels.checked(matches, "id").orderBy("id").collect()] == [None, "unknown label", "confidence out of range", "no evidence", "evidence of the prompt", "unknown source"]
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    gaps = labels.coverage_gaps(ids, matches, "id")
    assert {(r["id"], r["problem"]) for r in gaps.collect()} == {(9, "missing"), *((i, "extra") for i in range(2, 7))}
    with pytest.raises(labels.LabelError):
        labels.require(gaps, "coverage")


def test_evaluation_without_labels_is_perfect(spark):
    rows = spark.createDataFrame([([], None)], "gold array<string>, predicted array<string>")
    r = labels.evaluation(rows).first()
    assert (r["precision"], r["recall"], r["exact"]) == (1.0, 1.0, 1)


def test_scores(spark):
    tops = [0.1, 0.125, 0.25, 0.5, 0.8]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tops)], "i int, t double")
    out = scoring.with_scores(rows, F.array(F.lit("localfirst"), F.lit("games")), F.col("t"), F.array("t"), F.lit(9)).orderBy("i").collect()
    assert [r["originality"] for r in out] == [8, 8, 6, 1, 1]
    assert out[0]["verdict"] == "UNWRITTEN" and out[4]["verdict"] == "ECHO x1"
    assert (out[0]["delight"], out[0]["ai_necessity"], out[0]["feasibility"], out[0]["goal_fit"]) == (6, 5, 8, 9)


def test_incremental(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, c string")
    kept, fresh = incremental.split_reusable(rows, spark.createDataFrame([(1, "a", 7), (2, "x", 8)], "id long, c string, v int"), "id", "c", "v")
    assert [r["id"] for r in kept.collect()] == [1] and [r["id"] for r in fresh.collect()] == [2]
    one = incremental.table_digest(rows, "id", ["id", "c"]).first()
    assert one == incremental.table_digest(rows.repartition(3).orderBy(F.desc("id")), "id", ["c", "id"]).first()


def test_echoes_of_answers(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 2, "user", "b"), (1, 3, "assistant", "x"), (1, 4, "assistant", "y")]
    out = etl.without_echoes(spark.createDataFrame(rows, "c long, turn long, role string, text string"), "c", "turn").orderBy("turn").collect()
    assert [r["turn"] for r in out] == [2, 3, 4]


def test_repository(spark):
    rows = spark.createDataFrame([("p-1", "Tide Clock"), ("p-2", "Clock")], "id string, name string")
    asked = spark.createDataFrame([("show the tide clock now",), ("nothing",)], "q string")
    found = {r["q"]: r["match"] for r in repository.resolve_contained(rows, asked, "name", "q").collect()}
    assert found == {"show the tide clock now": "Tide Clock", "nothing": None}
    assert repository.resolve_ladder(rows, "clock", "id", "name").first()["id"] == "p-2"


def test_snapshots(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(3)
    snapshots.write_snapshot(spark, root, "r1", {"a": rows})
    snapshots.write_snapshot(spark, root, "r2", {"a": rows.limit(1)})
    assert snapshots.read_snapshot(spark, root, ("a",))["a"].count() == 1
    with pytest.raises(snapshots.SnapshotError):
        snapshots.write_snapshot(spark, root, "r2", {"a": rows})
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_snapshot(spark, root, ("b",))
    with pytest.raises(ValueError):
        cards.resolved_under(root, "../x")


def test_cards(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"generated_at": "x", "source": "y", "projects": [{"id": "o/a-b", "likes": 3, "tags": ["t", "region:us"]}, {"id": "o/c", "title": "C"}]}')
    rows = cards.coerced(cards.read_cards(spark, str(tmp_path / "s.json")).drop("page")).orderBy("id").collect()
    assert (rows[0]["title"], rows[0]["likes"], rows[0]["summary"], rows[1]["tags"]) == ("a-b", 3, "", [])
    shown = cards.public(cards.coerced(cards.read_cards(spark, str(tmp_path / "s.json")).drop("page"))).orderBy("id").first()
    assert shown["tags"] == ["t"] and len(shown) == 14


def test_idf():
    assert math.log(1 + (10 - 1 + 0.5) / 1.5) == pytest.approx(1.992430, abs=1e-6)


def test_resolve_contained_punctuation(spark):
    names = spark.createDataFrame([("France",), ("Tide Clock",), ("Tide",), ("Jawbreaker",)], "name string")
    asked = {"tell me about Jawbreaker?": "Jawbreaker", "(France)": "France", 'see "Tide Clock", please': "Tide Clock", "France, please": "France", "preTIDEpost": "Tide", "no": None, "fran ce": None}
    out = repository.resolve_contained(names, spark.createDataFrame([(q,) for q in asked], "q string"), "name", "q", 3)
    assert {r["q"]: r["match"] for r in out.collect()} == asked


def test_registered_settings(monkeypatch, spark):
    """The registered layouts run the operators' own numbers of starts and steps."""
    from corvane.plans import queries

    seen = {}
    monkeypatch.setattr(vectors, "kmeans", lambda rows, **given: seen.update(kmeans=given))
    monkeypatch.setattr(vectors, "tsne_layout", lambda rows, **given: seen.update(tsne=given))
    queries.kmeans_clusters(spark, "/root/testdata/sf0.001")
    queries.tsne_layout(spark, "/root/testdata/sf0.001")
    assert seen == {"kmeans": {}, "tsne": {}}


def test_echoes(spark):
    """An answer that its conversation's next answer repeats goes, and the user turn that led to it; what is kept doesn't undo that."""
    def kept(*turns):
        rows = spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(turns)], "c int, turn int, role string, text string")
        return sorted(r["turn"] for r in etl.without_echoes(rows, "c", "turn").collect())

    u, a = "user", "assistant"
    assert kept((u, "q"), (a, "y"), (a, "x"), (u, "r"), (a, "x")) == [1, 3, 4]
    assert kept((u, "1"), (a, "same"), (u, "2"), (a, "same"), (u, "3"), (a, "same")) == [4, 5]
    assert kept((u, "1"), (a, "a"), (u, "2"), (a, "b"), (u, "3"), (a, "a")) == [0, 1, 2, 3, 4, 5]


def test_history(spark):
    rows = [(1, 0, "user", " hi  there "), (1, 1, "assistant", "same"), (1, 2, "system", "s"), (1, 3, "user", "again"), (1, 4, "assistant", " same "), (1, 5, "user", " "), (1, 6, "user", "x" * 900)]
    frame = spark.createDataFrame(rows, "c int, turn int, role string, text string")
    got = {r["turn"]: r["text"] for r in etl.history(frame, "c", "turn").collect()}
    assert got == {3: "again", 4: "same", 6: "x" * 600}


def test_session_stats_in_order_of_records(spark):
    rows = spark.createDataFrame([("s", 0, None), ("s", 1, "b"), ("s", 2, "a"), ("s", 3, None)], "k string, i int, at string")
    out = etl.session_stats(rows, "k", "i", "at", F.col("i") > 0).first()
    assert (out["records"], out["published"], out["dropped"], out["first_at"], out["last_at"]) == (4, 3, 1, "b", "a")


def test_label_names(spark):
    names = {"best use of OpenAI Codex": "Codex", "MiniCPM": "OpenBMB", "OpenBMB / MiniCPM": "OpenBMB", "Custom UI": "Off-Brand", "off the grid (x)": "Off the Grid", "Local first": "Off the Grid", "Small model <=4B": "Tiny Titan", "Modal / Codex / Modal": "Modal,Codex", "Modal / nothing": None, "nothing": None}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["l"] for r in rows.select("n", F.array_join(labels.canonical_all(F.col("n")), ",").alias("l")).collect()} == names


def test_declared_tracks_settle_both(spark):
    rows = spark.createDataFrame([(1, ["Track:Backyard", "track:backyard", "x"]), (2, ["sponsor:modal"])], "id int, tags array<string>")
    found = labels.declared(rows, "id", "tags")
    assert {tuple(r) for r in found.collect()} == {(1, "Backyard AI", 1.0, "official Space tag track:backyard", "metadata"), (2, "Modal", 1.0, "official Space tag sponsor:modal", "metadata")}
    left = labels.remaining(rows, found, "id", ["Backyard AI", "Thousand Token Wood", "Modal"], labels.suppressed(found, "id"))
    assert {r["id"]: r["labels"] for r in left.collect()} == {1: ["Modal"], 2: ["Backyard AI", "Thousand Token Wood"]}


def test_publication_rules(spark):
    lines = [
        ("session_meta", '{"id": "s", "cwd": "/home/me/p", "other": 1}'),
        ("turn_context", '{"model": "m", "collaboration_mode": {"mode": "plan", "x": 1}}'),
        ("event_msg", '{"type": "agent", "message": "see hf_aaaaaaaaaaaaaaaaaaaaaaaa", "text_elements": [{"text": "t"}]}'),
        ("response_item", '{"type": "message", "content": "private"}'),
        ("response_item", '{"type": "function_call_output", "output": "%s"}' % ("x" * 200)),
        ("compacted", '{"a": 1}'),
        ("event_msg", "no object"),
        ("event_msg", None),
    ]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i int, type string, payload string")
    out = publication.public_records(rows, "type", "payload", (("/home/me", "~"),)).orderBy("i").collect()
    assert out[0]["public"] == '{"cwd":"~/p","id":"s"}'
    assert out[1]["public"] == '{"collaboration_mode":{"mode":"plan"},"model":"m"}'
    assert out[2]["public"] == '{"message":"see [REDACTED_SECRET]","text_elements":[{"text":"t"}],"type":"agent"}' and out[2]["texts"] == 2
    assert [r["public"] is None for r in out] == [False, False, False, True, False, True, True, True]
    assert (out[4]["cut"], out[4]["omitted"]) == (1, 80) and "truncated 80 chars" in out[4]["public"]


def test_app_segments(spark):
    source = "import os\nfrom a.b import c\nx = 1\n  from a.b import c\nfrom d import e"
    rows = spark.createDataFrame([(source, "org/model x/y-z"), ("", " "), (None, "a/b")], "s string, g string")
    got = [r[0] for r in rows.select(training_rows.app_segment(F.col("s"), F.col("g"))).collect()]
    assert got[0] == f"from a.b import c\nfrom d import e\n\n{source}\n\nASSETS: org/model, x/y-z" and got[1:] == ["", "\n\nASSETS: a/b"]


def test_taxonomy_quotes(spark):
    rows = spark.createDataFrame([("It says  SIGNALS: x",), ("Runs  on this machine",), ("fine",)], "e string")
    assert [r[0] for r in rows.select(labels.repeats_taxonomy(F.col("e"), ["Runs on this machine only"])).collect()] == [True, False, False]
    assert rows.select(labels.repeats_taxonomy(F.col("e"), ["runs on"])).collect()[1][0] is True
