"""Field-weighted BM25 over token postings (A1-A3, M3-M6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import clean, let, public_summary, public_title, snippet, title_case
from corvane.sources.work import written

# Words that name no cluster.
CLUSTER_STOPWORDS = (
    "about agent app apps ai all an and are as at before assistant be been being build build-small build-small-hackathon built by demo face for from gradio "
    "hackathon hugging huggingface in is it its first local make makes made me model models my of on or our one project projects pro region run runs small "
    "space spaces submission the their them these they this those to tool tools try us use used uses using we with you your"
).split()

K1, B = 1.35, 0.72
TITLE_BOOST, SLUG_BOOST = 2.0, 1.4
DEFAULT_LIMIT, MAX_LIMIT = 12, 30
#: Weights of the fields of a search document (M5).
FIELDS = {"Title": 4.0, "Space": 3.2, "Summary": 2.4, "Tags": 2.0, "Quest evidence": 1.6, "Cluster": 1.4, "App": 1.0, "README": 0.9}


def search_limit(limit: int) -> int:
    """P12."""
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"the limit must be 1 to {MAX_LIMIT}")
    return limit


def postings(docs: DataFrame, key: str, fields: dict[str, float], tokens) -> DataFrame:
    """A2: (key, term, tf), tf being the sum of field weights over all occurrences. `tokens` maps a column to an array."""
    parts = F.array(*[F.struct(F.lit(w).alias("weight"), tokens(F.col(f)).alias("terms")) for f, w in fields.items()])
    exploded = docs.select(key, F.explode(parts).alias("f")).select(key, F.col("f.weight").alias("weight"), F.explode("f.terms").alias("term"))
    return exploded.groupBy(key, "term").agg(F.sum("weight").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """A1: (term, df)."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(posted: DataFrame, key: str) -> DataFrame:
    """A3: (key, length), the sum of weighted term frequencies."""
    return posted.groupBy(key).agg(F.sum("tf").alias("length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """M3, one term of one document. Lengths below 1 count as 1."""
    share = F.greatest(length, F.lit(1.0)) / F.greatest(average, F.lit(1.0))
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))


def scored(posted: DataFrame, total: int, average: float, terms: list[str], key: str) -> DataFrame:
    """(key, score, matched): BM25 of the query's terms; matched in the query's order, at most 8. Only postings of those
    terms are read past the filter; lengths are attached by a window-free aggregate over matching documents."""
    unique = list(dict.fromkeys(terms))
    hits = posted.where(F.col("term").isin(unique))
    df = document_frequency(hits)
    matching = posted.join(hits.select(key).distinct(), key, "left_semi")
    rows = hits.join(F.broadcast(df), "term").join(lengths(matching, key), key)
    order = F.array_position(F.array(*map(F.lit, unique)), F.col("term"))
    score = F.sum(term_score(F.col("tf"), F.col("df"), F.lit(float(total)), F.col("length"), F.lit(average)))
    return rows.groupBy(key).agg(score.alias("score"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("term").alias("t")))), lambda x: x["t"]), 1, 8).alias("matched"))


def one_pass(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], tokens, keep: tuple[str, ...] = (), alphabetic: bool = False) -> DataFrame:
    """M3, M5, A1-A3 for one query: (key, kept columns, score, matched) of every row. Each row counts the terms and its own
    length in all fields; one aggregate row has the corpus's counts; no token is shuffled. Documents without
    tokens count in the average length. `matched`: in the query's order, or sorted (J18), at most 8."""
    unique = list(dict.fromkeys(terms))
    # One array a row: its length, then how often each term occurs, weighted. A field's tokens are made once.
    def occurrences(words: Column, term: str) -> Column:
        return F.size(F.filter(words, lambda x: x == term))

    def weighted(field: Column) -> Column:
        own = lambda w: F.array(F.size(w), *[occurrences(w, term) for term in unique])
        return F.transform(let(tokens(field["text"]), own), lambda n: n * field["weight"])

    # One expression for all fields, not one a field.
    parts = F.array(*[F.struct(F.lit(float(x)).alias("weight"), F.col(f).alias("text")) for f, x in fields.items()])
    start = F.array(*[F.lit(0.0)] * (len(unique) + 1))
    sums = F.aggregate(F.transform(parts, weighted), start, lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    rows = written(docs.select(key, *keep, sums.alias("__w")), "counts")
    length, tf = F.col("__w")[0], [F.col("__w")[i + 1] for i in range(len(unique))]
    some = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("average"), *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)]).first()
    one = lambda i: F.when(tf[i] > 0, term_score(tf[i], F.lit(some[f"df{i}"]), F.lit(float(some["n"])), length, F.lit(some["average"] or 1.0))).otherwise(0.0)
    hit = F.array_compact(F.array(*[F.when(x > 0, F.lit(t)) for x, t in zip(tf, unique, strict=True)])) if unique else F.array().cast("array<string>")
    matched = F.slice(F.sort_array(hit) if alphabetic else hit, 1, 8)
    return rows.select(key, *keep, sum((one(i) for i in range(len(unique))), F.lit(0.0)).alias("score"), matched.alias("matched"))


def project_fields(projects: DataFrame, points: DataFrame, clusters: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """M5: a project's search fields as columns, named as in FIELDS, with key, title, slug and likes.

    projects: id, title, summary, tags, models, datasets, sdk, likes, app_file, app_file_embedding_text, app_file_source,
    readme_body; points: cluster_id; clusters: cluster_id, label, keywords; evidence: pos, label, evidence, in the order of pos.
    A project without a point, a cluster or evidence has those fields empty."""
    own = evidence.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.concat_ws(" ", "label", "evidence")).alias("t")))), lambda x: x["t"]), " ").alias("Quest evidence"))
    names = clusters.select("cluster_id", F.concat_ws(" ", "label", F.array_join("keywords", " ")).alias("Cluster"))
    rows = projects.join(points.select(key, "cluster_id"), key, "left").join(names, "cluster_id", "left").join(own, key, "left")
    slug = F.substring_index("id", "/", -1)
    return rows.select(
        key,
        "likes",
        "title",
        slug.alias("slug"),
        public_title(F.col("title")).alias("Title "),
        F.concat_ws(" ", "id", slug, F.translate(slug, "-_", "  ")).alias("Space"),
        public_summary(F.col("summary")).alias("Summary"),
        F.concat_ws(" ", F.array_join(F.concat("tags", "models", "datasets"), " "), "sdk").alias("Tags"),
        F.coalesce("Quest evidence", F.lit("")).alias("Quest evidence"),
        F.coalesce("Cluster", F.lit("")).alias("Cluster"),
        F.concat_ws(" ", "app_file", "app_file_embedding_text", "app_file_source").alias("App"),
        F.col("readme_body").alias("README"),
    )


def search_projects(fields: DataFrame, query: str, key: str, fold, tokens, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """M4 over project_fields: the best projects for a query, best first: (key, title, slug, likes, score, raw_score, total, matched, snippets).

    fold: normalises and folds the case of a column; tokens: the search tokens of a folded column. The query's words are
    made the same way and keep their order; a query without words finds nothing."""
    spark, text = fields.sparkSession, " ".join(query.split())
    terms = spark.createDataFrame([(text,)], "q string").select(tokens(fold("q")).alias("t")).first()["t"]
    own = {name: "Title " if name == "Title" else name for name in FIELDS}
    folded = fields.select(key, "likes", "title", "slug", *[fold(c).alias(c) for c in own.values()])
    hits = one_pass(folded, key, {own[n]: w for n, w in FIELDS.items()}, terms, tokens, keep=("likes", "title", "slug"))
    best = ranked(hits.where(F.lit(bool(terms))), None, key, "likes", "title", limit, phrase_boost(text, public_title(F.col("title")), F.col("slug")))
    shown = best.join(fields.select(key, *own.values()), key)
    # Terms are looked for in the folded text, and the excerpt is of the text itself.
    flat = {n: f"__{i}" for i, n in enumerate(FIELDS)}
    both = shown.select("*", *[fold(clean_column(c)).alias(flat[n]) for n, c in own.items()])
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    every = F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).alias("text"), F.col(flat[n]).alias("folded")) for n, c in own.items()])
    hit = F.filter(every, lambda x: F.arrays_overlap(tokens(x["folded"]), wanted))
    excerpts = F.transform(hit, lambda x: F.struct(x["source"].alias("source"), snippet(x["text"], wanted, folded=x["folded"]).alias("text")))
    found = F.slice(F.filter(excerpts, lambda x: x["text"] != ""), 1, 2)
    return both.select(key, "title", "slug", "likes", "score", "raw_score", "total", "matched", found.alias("snippets")).orderBy(F.desc("raw_score"), F.desc("likes"), F.desc(F.lower("title")), key)


def clean_column(name: str) -> Column:
    return clean(F.col(name))


def snippets(fields: dict[str, Column], terms: list[str], tokens, cut) -> Column:
    """(source, text) of the first two fields, in their order, that share a token with the query."""
    wanted = F.array(*map(F.lit, terms))
    found = [F.when(F.arrays_overlap(tokens(c), wanted), F.struct(F.lit(f).alias("source"), cut(c, wanted).alias("text"))) for f, c in fields.items()]
    return F.slice(F.filter(F.array(*found), lambda x: x.isNotNull() & (x["text"] != "")), 1, 2)


def ranked(hits: DataFrame, docs: DataFrame | None, key: str, likes: str, title: str, limit: int, boost: Column | None = None) -> DataFrame:
    """Boosts added for documents with or without matching terms, positive scores kept, ordered by score, likes and
    folded title, all falling, then the key; scores divided by the best; `total` counts hits before the limit. Without docs the
    hits carry likes and title themselves, and no text is moved."""
    joined = hits if docs is None else docs.join(hits, key, "left" if boost is not None else "inner")
    value = F.coalesce("score", F.lit(0.0)) + (boost if boost is not None else F.lit(0.0))
    found = joined.withColumn("raw_score", value).where("raw_score > 0")
    whole = found.agg(F.count(F.lit(1)).alias("total"), F.max("raw_score").alias("best"))
    top = found.orderBy(F.desc("raw_score"), F.desc(likes), F.desc(F.lower(title)), key).limit(search_limit(limit))
    return top.join(F.broadcast(whole)).withColumn("score", F.col("raw_score") / F.col("best")).drop("best")


def phrase_boost(query: str, title: Column, slug: Column) -> Column:
    """the whole query within the public title, or within the slug with spaces for - and _."""
    q = query.casefold()
    return F.when(F.lower(title).contains(q), F.lit(TITLE_BOOST)).otherwise(0.0) + F.when(F.lower(F.translate(slug, "-_", "  ")).contains(q), F.lit(SLUG_BOOST)).otherwise(0.0)


def names_clusters(term: Column) -> Column:
    """terms that may name a cluster: no stopword, no hosting region, no number."""
    return ~term.isin(CLUSTER_STOPWORDS) & ~term.startswith("region") & ~term.rlike(r"(?U)^\d+$")


def distinctive_keywords(terms: DataFrame, cluster: str, key: str, total: int, sizes: DataFrame, most: int = 5) -> DataFrame:
    """M6: (cluster, term, score, rank) for the terms that set a cluster apart. `terms`: (cluster, key, term, n), a key being in one cluster, so that the corpus's counts are sums over clusters."""
    own = terms.where(names_clusters(F.col("term"))).groupBy(cluster, "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("docs"))
    rows = own.withColumn("df", F.sum("docs").over(W.partitionBy("term"))).join(sizes.select(cluster, "members"), cluster)
    weight = F.log((1 + F.lit(total)) / (1 + F.col("df")))
    score = (1 + F.log("tf")) * weight * (0.35 + 0.65 * F.col("docs") / F.col("df")) * (0.35 + 0.65 * F.col("docs") / F.col("members"))
    kept = rows.where((F.col("docs") >= F.when(F.col("members") <= 3, 1).otherwise(2)) & (weight > 0)).withColumn("score", score)
    by = W.partitionBy(cluster).orderBy(F.desc("score"), F.desc("docs"), F.desc("tf"), "term")
    return kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select(cluster, "term", "tf", "docs", "df", "score", "rank")


def cluster_labels(keywords: DataFrame, representatives: DataFrame, cluster: str, title: str) -> DataFrame:
    """M7: (cluster, label): the two best keywords in title case, else the titles of the two first representatives (cluster, rank, title) that have one, else `Mixed projects`."""
    joined = lambda rows, value: rows.groupBy(cluster).agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]), 1, 2), " / ").alias("label"))
    by_word = joined(keywords.where("rank <= 2"), title_case(F.col("term")))
    named = representatives.where(F.col(title) != "Untitled project")
    by_title = joined(named, F.col(title)).withColumnRenamed("label", "titles")
    every = representatives.select(cluster).distinct().join(by_word, cluster, "left").join(by_title, cluster, "left")
    return every.select(cluster, F.coalesce("label", "titles", F.lit("Mixed projects")).alias("label"))
