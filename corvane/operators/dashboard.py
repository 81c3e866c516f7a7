"""The read path of a corpus atlas: clusters with names and centres, points with labels, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import normalized_tags, public_summary, public_title
from corvane.operators import search
from corvane.operators.labels import report, require
from corvane.sources.snapshots import read_snapshot, write_snapshot
from corvane.sources.work import written


def placed(projects: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """Each project with its (x, y, raw) of the layout; both must have the same keys, which `unplaced` tells."""
    return projects.join(layout, key)


def unplaced(projects: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the two has; `require` turns rows into an error."""
    a, b = projects.select(key).withColumn("__a", F.lit(1)), layout.select(key).withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key)


def cluster_ids(rows: DataFrame) -> DataFrame:
    """A5, M9: (raw, cluster_id, project_count, x, y) of placed rows: clusters numbered by falling size, then centre."""
    sums = rows.groupBy("raw").agg(F.count(F.lit(1)).alias("project_count"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    # One row for each cluster: the window's size is their number.
    number = F.row_number().over(W.orderBy(F.desc("project_count"), "cx", "cy"))
    return sums.select("raw", F.concat(F.lit("cluster-"), number.cast("string")).alias("cluster_id"), "project_count", F.round("cx", 4).alias("x"), F.round("cy", 4).alias("y"))


def representatives(rows: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(raw, rank, key, title): a cluster's rows by likes, last change and folded title, all falling."""
    by = W.partitionBy("raw").orderBy(F.desc("likes"), F.desc("last_modified"), F.desc(F.lower("title")), F.desc(key))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select("raw", "rank", key, public_title(F.col("title")).alias("title"))


def clusters(rows: DataFrame, key: str, words: Column, most: int = 5) -> DataFrame:
    """(cluster_id, label, keywords, project_count, x, y, representatives) of placed rows. words: the tokens of a row's names."""
    ids = cluster_ids(rows)
    terms = rows.select("raw", key, F.explode(words).alias("term")).groupBy("raw", key, "term").agg(F.count(F.lit(1)).alias("n"))
    found = search.distinctive_keywords(terms, "raw", key, rows.count(), ids.select("raw", F.col("project_count").alias("members")), most)
    best = representatives(rows, key)
    lists = found.groupBy("raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    shown = best.groupBy("raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("representatives"))
    names = search.cluster_labels(found, best, "raw", "title")
    joined = ids.join(names, "raw").join(lists, "raw", "left").join(shown, "raw")
    return joined.select("cluster_id", "label", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "project_count", "x", "y", "representatives")


def points(rows: DataFrame, ids: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """A placed row with its public fields, cluster and labels, those of falling confidence first; rows without a match have none."""
    own = matches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "label"))), lambda x: x["label"]).alias("quest_ids"))
    joined = rows.join(ids.select("raw", "cluster_id"), "raw", "left").join(own, key, "left")
    return joined.select(
        key,
        public_title(F.col("title")).alias("title"),
        public_summary(F.col("summary")).alias("summary"),
        "likes",
        normalized_tags(F.col("tags")).alias("tags"),
        "x",
        "y",
        F.coalesce("cluster_id", F.lit("")).alias("cluster_id"),
        F.coalesce("quest_ids", F.array().cast("array<string>")).alias("quest_ids"),
    )


def visible(shown: DataFrame, cluster: str | None = None, label: str | None = None, found: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """points of a cluster, with a label, and among search results, each if asked for."""
    if cluster is not None:
        shown = shown.where(F.col("cluster_id") == cluster)
    if label is not None:
        shown = shown.where(F.array_contains("quest_ids", label))
    return shown if found is None else shown.join(found.select(key), key, "left_semi")


def labelled_points(shown: DataFrame, key: str, found: DataFrame | None = None) -> DataFrame:
    """The points that carry their title: of search results the 16 best, else the 12 most liked."""
    if found is not None:
        return shown.join(found.select(key, "score"), key).orderBy(F.desc("score"), key).limit(16)
    return shown.orderBy(F.desc("likes"), key).limit(12)


def with_points(results: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """Search results with their public point; a result without one keeps nulls."""
    return results.join(shown.select(key, "title", "cluster_id", "tags", "quest_ids"), key, "left")


def check(shown: DataFrame, ids: DataFrame, links: DataFrame, key: str) -> None:
    """Points of unknown clusters and links to unknown points are errors."""
    require(shown.join(ids.select("cluster_id"), "cluster_id", "left_anti").select(key, "cluster_id"), "points of unknown clusters")
    ends = links.select(F.explode(F.array("source", "target")).alias(key))
    require(ends.join(shown.select(key), key, "left_anti"), "links to unknown points")


PAYLOAD_VERSION, LEAST_PROJECTS = 1, 3


def payload(projects: DataFrame, layout: DataFrame, links: DataFrame | None, matches: DataFrame, dimension: DataFrame, key: str, words: Column, source: str, generated_at: str) -> dict[str, DataFrame]:
    """All parts of one dashboard from one reading of its rows: header, clusters, points, links and quest_report.

    projects: title, summary, likes, tags, last_modified; layout: x, y, raw; links: source, target, score; dimension: pos, label.
    The placed rows are written once and every part is made of them, so that the parts agree; no parts are made of rows that only
    one of projects and layout has, which `payload_problems` tells. Without links there is no such part: the tools of a chat need none. Without a source the labels count as not analysed."""
    require(unplaced(projects, layout, key), "projects without a place, or places without a project")
    rows = written(placed(projects, layout, key), "placed")
    ids = written(cluster_ids(rows), "clusters")
    header = rows.agg(F.count(F.lit(1)).alias("project_count")).select(
        F.lit(PAYLOAD_VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "project_count", F.lit("analyzed" if source else "not_analyzed").alias("status"), F.lit(source).alias("source")
    )
    return {
        "header": header,
        "clusters": clusters(rows, key, words),
        "points": points(rows, ids, matches, key),
        **({} if links is None else {"links": links}),
        "quest_report": report(dimension, matches.join(rows.select(key), key, "left_semi"), key, rows.select(key, "likes")),
    }


def payload_problems(parts: dict[str, DataFrame], key: str, least: int = LEAST_PROJECTS) -> DataFrame:
    """J21 over a whole payload: (problem, what), a row for everything that doesn't fit: its version and number of projects, ids that
    are missing or come twice, places outside 0..100, points of no or of unknown clusters, links to unknown points, an unknown status."""
    shown, name = parts["points"], F.col(key).cast("string").alias("what")
    told = lambda rows, problem, what=name: rows.select(F.lit(problem).alias("problem"), what)
    head = parts["header"].join(shown.agg(F.count(F.lit(1)).alias("__points")))
    number = lambda c: F.col(c).cast("string").alias("what")
    outside = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 100)
    ends = parts["links"].select(F.explode(F.array("source", "target")).alias(key))
    found = [
        told(head.where(F.col("schema_version") != PAYLOAD_VERSION), "unsupported schema version", number("schema_version")),
        told(head.where(F.col("project_count") < least), "too few projects", number("project_count")),
        told(head.where("project_count <> __points"), "the number of points isn't that of projects", number("__points")),
        told(head.where(~F.col("status").isin("analyzed", "not_analyzed")), "unknown report status", number("status")),
        told(shown.where(F.col(key).isNull()), "a point without an id"),
        told(shown.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "a point comes twice"),
        told(shown.where(outside("x") | outside("y")), "a place outside 0 to 100"),
        told(shown.where("cluster_id = ''"), "a point without a cluster"),
        told(shown.where("cluster_id <> ''").join(parts["clusters"].select("cluster_id"), "cluster_id", "left_anti"), "a point of an unknown cluster"),
        told(ends.join(shown.select(key), key, "left_anti"), "a link to an unknown point"),
    ]
    whole = found[0]
    for rows in found[1:]:
        whole = whole.unionByName(rows)
    return whole


def publish(parts: dict[str, DataFrame], root: str, run_id: str, key: str) -> str:
    """The payload as one run of a snapshot, made the latest when it is whole; a payload with problems is an error and leaves the old one."""
    require(payload_problems(parts, key), "dashboard payload")
    return write_snapshot(parts["points"].sparkSession, root, run_id, parts)


def public_points(shown: DataFrame) -> DataFrame:
    """Points as they are read, their tags without hosting ones and repeats whatever was stored."""
    return shown.withColumn("tags", normalized_tags(F.col("tags")))


def latest(spark: SparkSession, root: str, key: str) -> dict[str, DataFrame]:
    """The latest payload below root, all of its parts there and without problems."""
    parts = read_snapshot(spark, root, ("clusters", "header", "links", "points", "quest_report"))
    require(payload_problems(parts, key), "the stored dashboard")
    return parts
