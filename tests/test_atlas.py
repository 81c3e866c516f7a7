"""The chat's tools over a small dashboard."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import atlas, dashboard


@pytest.fixture(scope="module")
def made(spark):
    rows = [(0, "Tide Clock", 5, "2024-03"), (1, "tide table", 5, "2024-01"), (2, "Moon Agent", 9, "2024-02"), (3, "Moon Base", 1, "2024-03"), (4, "", 0, "2024-04")]
    projects = spark.createDataFrame([(i, t, "About it", n, ["a"], at) for i, t, n, at in rows], "id long, title string, summary string, likes long, tags array<string>, last_modified string")
    layout = spark.createDataFrame([(i, 10.0 * i, 5.0, int(i >= 2)) for i in range(5)], "id long, x double, y double, raw int")
    links = spark.createDataFrame([(0, 1, 0.5)], "source long, target long, score double")
    matches = spark.createDataFrame([(1, "Modal", 0.5), (0, "Modal", 0.9), (0, "Codex", 0.4), (2, "Codex", 0.8)], "id long, label string, confidence double")
    dimension = spark.createDataFrame([(0, "Modal"), (1, "Codex"), (2, "Nemotron")], "pos int, label string")
    return projects, dashboard.payload(projects, layout, links, matches, dimension, "id", T.tokens(F.col("title")), "rules", "2024")


def test_overview(made):
    got = [tuple(r) for r in atlas.atlas_overview(made[1], "id").collect()]
    assert ("projects", 0, "analyzed", 5) in got and ("clusters", 0, "", 2) in got
    assert [x[2] for x in sorted(got) if x[0] == "liked"] == ["2", "1", "0"] and [x[2:] for x in sorted(got) if x[0] == "label"] == [("Codex", 2), ("Modal", 2)]
    assert [x[3] for x in sorted(got) if x[0] == "cluster"] == [3, 2]


def test_clusters(made):
    parts = made[1]
    shown = {r["cluster_id"]: r for r in atlas.list_clusters(parts).collect()}
    assert set(shown) == {"cluster-1", "cluster-2"} and "tide" in shown["cluster-2"]["keywords"]
    one = atlas.show_cluster(parts, "what about the tide ones?", "id").collect()
    assert [r["cluster_id"] for r in one] == ["cluster-2"] and [e["title"] for e in one[0]["examples"]] == ["Tide Clock", "tide table"]
    assert atlas.show_cluster(parts, "zzzz", "id").collect() == []


def test_labels(made):
    parts = made[1]
    assert [(r["label"], r["rows"]) for r in atlas.list_labels(parts).collect()] == [("Codex", 2), ("Modal", 2), ("Nemotron", 0)]
    one = atlas.show_label(parts, "who did Modal?", "id").first()
    assert one["rows"] == 2 and [e["id"] for e in one["examples"]] == [0, 1] and atlas.show_label(parts, "nothing", "id").collect() == []
    none = atlas.show_label(parts, "Nemotron", "id").first()
    assert none["rows"] == 0 and none["examples"] is None
    assert [(r["id"], r["labels"], r["total"]) for r in atlas.top_by_labels(parts, "id", 2).collect()] == [(0, 2, 3), (2, 1, 3)]
    assert len(atlas.top_by_labels(parts, "id", 0).collect()) == 1


def test_recent_and_projects(spark, made):
    projects, parts = made
    assert [r["id"] for r in atlas.recent_activity(parts, projects, "id", 3).collect()] == [4, 0, 3]
    whole = projects.select("id", F.col("id").alias("pos"), F.concat(F.lit("org/p"), "id").alias("name"), "title", "summary", F.array(F.lit("m")).alias("models"), F.lit("# Read " + "me " * 900).alias("readme_body"), F.lit("import os").alias("app_file_source"), F.lit("").alias("app_file_embedding_text"))
    named = whole.withColumnRenamed("id", "key").withColumnRenamed("name", "id")
    keyed = {**parts, "points": parts["points"].withColumnRenamed("id", "key")}
    asked = {"ORG/P1": 1, "p3": 3, "tell me about Moon Agent now": 2, "untitled project": 4, "nope": None}
    got = {r["q"]: r for r in atlas.show_project(keyed, named, spark.createDataFrame([(q,) for q in asked], "q string"), "key", "q").collect()}
    assert {q: r["match"] for q, r in got.items()} == asked
    assert got["p3"]["cluster_label"] and len(got["p3"]["readme_excerpt"]) == 1504 and got["p3"]["app_excerpt"] == "import os" and got["nope"]["title"] is None
