"""The tools of a chat over a dashboard's parts (§2.13: A8, A23, C12, J14-J16, T1-T6): each a small table that one question wants.

parts is what `dashboard.payload` makes: header, clusters (cluster_id, label, keywords, project_count, representatives), points,
links, quest_report (pos, label, rows, examples). Every tool is a filter, an aggregate or a top-k, so that no tool sorts or moves more than it shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import clean, clipped, public_summary, public_title
from corvane.operators.repository import resolve_clusters, resolve_label, resolve_projects, top
from corvane.operators.training_rows import app_segment, readme_segment

Parts = dict[str, DataFrame]
EXAMPLES, LEADERS, RECENT, TOP, KEYWORDS = 6, 8, 6, 3, 5
README_CHARS, APP_CHARS = 1500, 1900


def _by_likes(key: str) -> list[Column]:
    """Most liked first, then the folded title, falling; the key settles the rest."""
    return [F.desc("likes"), F.desc(F.lower(clean(F.col("title")))), F.asc(key)]


def atlas_overview(parts: Parts, key: str) -> DataFrame:
    """(what, pos, item, n): the counts of the whole, and its three largest clusters, most met labels and most liked projects."""
    head = parts["header"].select(F.lit("projects").alias("what"), F.lit(0).alias("pos"), F.col("status").alias("item"), F.col("project_count").cast("long").alias("n"))
    number = parts["clusters"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("clusters").alias("what"), F.lit(0).alias("pos"), F.lit("").alias("item"), "n")

    def ranked(rows: DataFrame, what: str, order: list[Column], item: Column, n: Column) -> DataFrame:
        best = top(rows.select("*", item.alias("__item"), n.cast("long").alias("__n")), order, TOP)
        # A window over the three rows that are left.
        return best.withColumn("pos", F.row_number().over(W.orderBy(*order))).select(F.lit(what).alias("what"), "pos", F.col("__item").alias("item"), F.col("__n").alias("n"))

    largest = ranked(parts["clusters"], "cluster", [F.desc("project_count"), F.asc(F.length("cluster_id")), F.asc("cluster_id")], clean(F.col("label")), F.col("project_count"))
    labels = ranked(parts["quest_report"].where("rows > 0"), "label", [F.desc("rows"), F.asc(F.lower("label")), F.asc("pos")], F.col("label"), F.col("rows"))
    liked = ranked(parts["points"], "liked", _by_likes(key), F.col(key).cast("string"), F.col("likes"))
    return head.unionByName(number).unionByName(largest).unionByName(labels).unionByName(liked)


def list_clusters(parts: Parts) -> DataFrame:
    """(cluster_id, label, project_count, keywords): every cluster with its first four keywords."""
    return parts["clusters"].select("cluster_id", clean(F.col("label")).alias("label"), "project_count", F.slice("keywords", 1, 4).alias("keywords"))


def show_cluster(parts: Parts, asked: str, key: str) -> DataFrame:
    """The cluster that a question means, if any: (cluster_id, label, project_count, keywords, examples of key, title, likes)."""
    known = [(r["cluster_id"], r["label"], r["keywords"]) for r in parts["clusters"].orderBy(F.length("cluster_id"), "cluster_id").select("cluster_id", "label", "keywords").collect()]
    spark = parts["clusters"].sparkSession
    match = resolve_clusters(known, spark.createDataFrame([(asked,)], "q string"), "q").first()["match"] if known else None
    one = parts["clusters"].where(F.col("cluster_id") == F.lit(match)).select("cluster_id", clean(F.col("label")).alias("label"), "project_count", F.slice("keywords", 1, KEYWORDS).alias("keywords"), "representatives")
    shown = one.select("cluster_id", F.posexplode(F.slice("representatives", 1, EXAMPLES)).alias("pos", key)).join(parts["points"].select(key, "title", "likes"), key)
    listed = shown.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", key, "title", "likes"))), lambda x: F.struct(x[key].alias(key), x["title"].alias("title"), x["likes"].alias("likes"))).alias("examples"))
    return one.drop("representatives").join(listed, "cluster_id", "left")


def list_labels(parts: Parts) -> DataFrame:
    """(pos, label, rows): every label, the most met first, then in the order of its name."""
    return parts["quest_report"].select("pos", "label", "rows").orderBy(F.desc("rows"), F.lower("label"))


def show_label(parts: Parts, asked: str, key: str, resolve=resolve_label) -> DataFrame:
    """The label that a question means, if any, with its best projects: (label, rows, examples of key, title, likes)."""
    spark = parts["points"].sparkSession
    label = spark.createDataFrame([(asked,)], "q string").select(resolve(F.col("q")).alias("label")).first()["label"]
    one = parts["quest_report"].where(F.col("label") == F.lit(label)).select("label", "rows", "examples")
    shown = one.select("label", F.posexplode(F.slice("examples", 1, EXAMPLES)).alias("pos", key)).join(parts["points"].select(key, "title", "likes"), key)
    listed = shown.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", key, "title", "likes"))), lambda x: F.struct(x[key].alias(key), x["title"].alias("title"), x["likes"].alias("likes"))).alias("examples"))
    return one.drop("examples").join(listed, "label", "left")


def top_by_labels(parts: Parts, key: str, limit: int = LEADERS) -> DataFrame:
    """T4: (key, title, likes, labels, quest_ids, total): the projects with most labels; total is how many have one at all."""
    rows = parts["points"].where(F.size("quest_ids") > 0)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    best = top(rows.select(key, "title", "likes", F.size("quest_ids").alias("labels"), "quest_ids"), [F.desc("labels"), *_by_likes(key)], limit)
    return best.join(F.broadcast(total))


def recent_activity(parts: Parts, changed: DataFrame, key: str, limit: int = RECENT) -> DataFrame:
    """T5: (key, title, likes, last_modified, cluster_label): the projects changed last, by the text of the time. changed: key, last_modified."""
    rows = parts["points"].join(changed.select(key, "last_modified"), key)
    best = top(rows.select(key, "title", "likes", "last_modified", "cluster_id"), [F.desc("last_modified"), F.asc(key)], limit)
    names = parts["clusters"].select("cluster_id", clean(F.col("label")).alias("cluster_label"))
    return best.join(names, "cluster_id", "left").select(key, "title", "likes", "last_modified", F.coalesce("cluster_label", F.lit("")).alias("cluster_label"))


def show_project(parts: Parts, projects: DataFrame, asked: DataFrame, key: str, question: str) -> DataFrame:
    """For each question the project it means (null without one), with its public card, cluster, labels and excerpts of README and app
    as the classifier sees them. projects: key, id, title, summary, models, readme_body, app_file_source, app_file_embedding_text, pos."""
    names = F.array("id", F.substring_index("id", "/", -1), public_title(F.col("title")))
    found = resolve_projects(projects.select("pos", key, names.alias("names")), asked, "pos", key, "names", question)
    clusters = parts["clusters"].select("cluster_id", clean(F.col("label")).alias("cluster_label"))
    shown = parts["points"].select(key, "likes", "cluster_id", "quest_ids").join(clusters, "cluster_id", "left").drop("cluster_id")
    cards = projects.select(
        F.col(key).alias("match"), public_title(F.col("title")).alias("title"), public_summary(F.col("summary")).alias("summary"), F.slice("models", 1, 4).alias("models"),
        clipped(readme_segment(F.col("readme_body")), README_CHARS).alias("readme_excerpt"), clipped(app_segment(F.col("app_file_source"), F.col("app_file_embedding_text")), APP_CHARS).alias("app_excerpt"),
    )
    return found.join(cards, "match", "left").join(shown.withColumnRenamed(key, "match"), "match", "left")
