"""The vector index of a corpus, its checks, lookups in it, and small rules of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.operators.labels import require
from corvane.operators.vectors import norm, normalized

NORM_ROOM = 0.01


def built(rows: DataFrame, key: str, text: str, vec: str) -> DataFrame:
    """(key, text_digest, norm, vector, dimensions): unit vectors rounded to 8 places; a vector of length zero is an error."""
    unit = normalized(F.col(vec))
    return rows.select(
        key,
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_digest"),
        let(unit, lambda v: F.struct(F.round(norm(v), 8).alias("norm"), F.transform(v, lambda x: F.round(x, 8)).alias("vector"))).alias("__v"),
    ).select(key, "text_digest", "__v.norm", "__v.vector", F.size("__v.vector").alias("dimensions"))


def problems(index: DataFrame, rows: DataFrame, key: str, text: str, dimensions: int) -> DataFrame:
    """(key, problem) of an index against its corpus: rows that only one of them has, other texts, other dimensions, vectors that aren't of length one."""
    have = rows.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("__digest"), F.lit(True).alias("__row"))
    joined = index.withColumn("__index", F.lit(True)).join(have, key, "full_outer")
    found = (
        F.when(F.col("__index").isNull(), F.lit("not indexed"))
        .when(F.col("__row").isNull(), F.lit("not in the corpus"))
        .when(F.col("text_digest") != F.col("__digest"), F.lit("text digest differs"))
        .when(F.size("vector") != dimensions, F.lit("dimensions differ"))
        .when(F.abs(norm(F.col("vector")) - 1) > NORM_ROOM, F.lit("not normalized"))
    )
    return joined.select(key, found.alias("problem")).where("problem is not null")


#: What an index says of itself.
SCHEMA_VERSION, ALGORITHM, RUNTIME = 3, "dense-cosine", "external"


def header(index: DataFrame, snapshot: dict[str, str], metadata: dict[str, str] | None = None, generated_at: str = "") -> DataFrame:
    """The one row of an index's header. snapshot: generated_at, source and digest of what was indexed. An empty index, and one
    of vectors of several sizes, is an error."""
    sizes = index.agg(F.count(F.lit(1)).alias("document_count"), F.min("dimensions").alias("least"), F.max("dimensions").alias("most"))
    bad = F.when(F.coalesce("most", F.lit(0)) <= 0, F.lit("embedding vectors must not be empty")).when(F.col("least") != F.col("most"), F.lit("embedding vectors must have one shared dimension"))
    most = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("most")).cast("int")
    own = {"runtime": RUNTIME, "normalized": "true", **(metadata or {})}
    return sizes.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(ALGORITHM).alias("algorithm"), F.lit(generated_at).alias("generated_at"), *[F.lit(snapshot.get(k, "")).alias(f"snapshot_{k}") for k in ("generated_at", "source", "digest")],
        "document_count", F.struct(most.alias("dimensions"), *[F.lit(v).alias(k) for k, v in sorted(own.items())]).alias("embedding"),
    )


def header_problems(head: DataFrame, snapshot: dict[str, str], documents: int) -> DataFrame:
    """(problem) of an index's header, each that there is: its version and algorithm, the snapshot it was built of, its
    embedding, and the number of its documents."""
    differs = lambda column, value: ~F.coalesce(F.col(column) == value, F.lit(False))
    checks = {
        "unsupported schema version": differs("schema_version", SCHEMA_VERSION),
        "unsupported algorithm": differs("algorithm", ALGORITHM),
        "built from a snapshot of another time": differs("snapshot_generated_at", snapshot.get("generated_at", "")),
        "built from a snapshot of another source": differs("snapshot_source", snapshot.get("source", "")),
        "the snapshot's digest differs": differs("snapshot_digest", snapshot.get("digest", "")),
        "no embedding": F.col("embedding").isNull(),
        "no dimensions": F.coalesce(F.col("embedding.dimensions"), F.lit(0)) <= 0,
        "another runtime": F.col("embedding").isNotNull() & differs("embedding.runtime", RUNTIME),
        "another number of documents": differs("document_count", documents),
    }
    told = F.filter(F.array(*[F.struct(c.alias("holds"), F.lit(p).alias("problem")) for p, c in checks.items()]), lambda x: x["holds"])
    return head.select(F.explode(told).alias("x")).select("x.problem")


def order_problems(index: DataFrame, rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pos, other) where the document of a place (pos) isn't the one of the corpus; other: what the index has there."""
    there = index.select(F.col(pos), F.col(key).alias("other"))
    joined = rows.select(key, pos).join(there, pos, "full_outer")
    return joined.where(~F.col(key).eqNullSafe(F.col("other"))).select(key, pos, "other")


def validate(index: DataFrame, rows: DataFrame, key: str, text: str, dimensions: int) -> None:
    """Any problem is an error, as is an empty dimension."""
    if dimensions <= 0:
        raise ValueError("an index needs dimensions")
    require(problems(index, rows, key, text, dimensions), "the index doesn't match its corpus")


def found(rows: DataFrame, asked: DataFrame, key: str, slug: str, order: str) -> DataFrame:
    """(asked, key): for each row of asked (asked) the first row, by order, whose id or slug it is; two equi-joins rather than a disjunction."""
    by_id = asked.join(rows, F.col("asked") == F.col(key)).select("asked", key, order)
    by_slug = asked.join(rows, F.col("asked") == F.col(slug)).select("asked", key, order)
    return by_id.unionByName(by_slug).groupBy("asked").agg(F.min_by(key, order).alias(key))


def snapshot_order(rows: DataFrame, key: str) -> DataFrame:
    """Public rows by their folded id."""
    return rows.where(~F.coalesce(F.col("private"), F.lit(False))).orderBy(F.lower(key), key)


def starters(seeds: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first seeds of the dimension, with score 0."""
    return seeds.orderBy(order).limit(limit).withColumn("score", F.lit(0.0))


def unused_first(items: DataFrame, used: DataFrame, order: str) -> DataFrame:
    """items (label) with `place`: first the first one whose folded label isn't used, or the first of all, then the others in their order."""
    taken = used.select(F.lower(F.trim("label")).alias("__l")).distinct()
    free = items.join(taken, F.lower(F.trim("label")) == F.col("__l"), "left_anti").agg(F.min(order).alias("best"))
    first = items.agg(F.min(order).alias("first")).join(free).select(F.coalesce("best", "first").alias("__best"))
    chosen = items.join(first).withColumn("place", F.when(F.col(order) == F.col("__best"), F.lit(-1)).otherwise(F.col(order)))
    return chosen.drop("__best").orderBy("place")


def is_new_idea(title: Column, pitch: Column, current_title: Column, current_pitch: Column) -> Column:
    """another title but for case, or another pitch."""
    return (F.lower(F.trim(title)) != F.lower(F.trim(current_title))) | (F.trim(pitch) != F.trim(current_pitch))


def visible_ideas(ideas: DataFrame, current: str, order: str, newest: int = 3) -> DataFrame:
    """The current idea, then the newest others."""
    return ideas.orderBy(F.desc(current), F.desc(order)).limit(newest + 1)


def ready_badges(badges: DataFrame, ready: str) -> DataFrame:
    """A17."""
    return badges.agg(F.count_if(F.col(ready)).alias("ready"), F.count(F.lit(1)).alias("badges"))


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's distinct values in the order in which they came up."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("__at"))
    return seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value]).alias(value))


def host_url(host: Column, subdomain: Column) -> Column:
    """The host, else the address of the subdomain, else nothing."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(~empty(host), host).when(~empty(subdomain), F.concat(F.lit("https://"), subdomain, F.lit(".hf.space"))).otherwise(F.lit(""))


def display_path(path: Column, home: str) -> Column:
    """`~` for the home folder at the beginning."""
    return F.when(path == home, F.lit("~")).when(path.startswith(f"{home}/"), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def point_radius(likes: Column) -> Column:
    """P41."""
    return 0.62 + F.least(F.lit(0.72), F.sqrt(F.coalesce(likes, F.lit(0))) * 0.12)


def short_title(title: Column) -> Column:
    """A title of over 22 characters is cut to 20."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when(F.length(t) > 22, F.concat(F.trim(F.left(t, F.lit(20))), F.lit("..."))).otherwise(t)
