"""Multi-label taxonomy: declared and merged labels, canonical names, validation, coverage report, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import clean, label_key

# The ordered label space as (id, label), names that mean a label, and tags that declare one.
LABELS = (
    ("Off the Grid", "Local-first"),
    ("Well-Tuned", "Fine-tuned"),
    ("Off-Brand", "Custom frontend"),
    ("Llama Champion", "llama.cpp path"),
    ("Sharing is Caring", "Shareable artifact"),
    ("Field Notes", "Build notes"),
    ("Backyard AI", "Real problem for one person"),
    ("Thousand Token Wood", "Delightful & creative"),
    ("OpenBMB", "OpenBMB model"),
    ("Codex", "OpenAI Codex"),
    ("Nemotron", "NVIDIA Nemotron"),
    ("Modal", "Modal-powered"),
    ("Tiny Titan", "Small model (<=4B)"),
    ("Best Agent", "Agentic"),
)
TAG_LABELS = {
    "track:backyard": "Backyard AI",
    "track:wood": "Thousand Token Wood",
    "sponsor:openbmb": "OpenBMB",
    "sponsor:openai": "Codex",
    "sponsor:nvidia": "Nemotron",
    "sponsor:modal": "Modal",
    "achievement:offgrid": "Off the Grid",
    "achievement:welltuned": "Well-Tuned",
    "achievement:offbrand": "Off-Brand",
    "achievement:llama": "Llama Champion",
    "achievement:sharing": "Sharing is Caring",
    "achievement:fieldnotes": "Field Notes",
    "tiny-titan": "Tiny Titan",
    "best-agent": "Best Agent",
}
ALIASES = {
    "Best MiniCPM Build": "OpenBMB",
    "MiniCPM Build": "OpenBMB",
    "MiniCPM": "OpenBMB",
    "OpenBMB / MiniCPM": "OpenBMB",
    "OpenAI": "Codex",
    "Offbrand": "Off-Brand",
    "Offgrid": "Off the Grid",
    "Llama Champion badge": "Llama Champion",
    "Modal first": "Modal",
    "Nemotron 3 Nano 4B": "Nemotron",
    "Nemotron Mini 4B": "Nemotron",
    "Small model <=4B": "Tiny Titan",
    "Small model under 4B": "Tiny Titan",
    "Shareable output": "Sharing is Caring",
    "Custom UI": "Off-Brand",
    "Custom interface": "Off-Brand",
    "Local first": "Off the Grid",
    "Fine tuned": "Well-Tuned",
    "Fine tune": "Well-Tuned",
}
#: Labels of tracks: a declared track settles both.
TRACKS = ("Backyard AI", "Thousand Token Wood")
SOURCES = ("readme", "app_file", "metadata")
EVIDENCE_CHARS = 360


class LabelError(ValueError):
    """Matches that break the contract; `rows` are the violations."""

    def __init__(self, what: str, rows: list):
        super().__init__(f"{what}: {rows[:5]}")
        self.rows = rows


def declared(tagged: DataFrame, key: str, tags: str, tag_labels: dict[str, str] = TAG_LABELS) -> DataFrame:
    """(key, label, confidence, evidence, source) for tags of the official map; the first tag of a label counts."""
    spark = tagged.sparkSession
    known = spark.createDataFrame(list(tag_labels.items()), "tag string, label string")
    rows = tagged.select(key, F.posexplode(tags).alias("pos", "raw")).withColumn("tag", F.lower(clean(F.col("raw"))))
    first = W.partitionBy(key, "label").orderBy("pos")
    own = rows.join(F.broadcast(known), "tag").withColumn("k", F.row_number().over(first)).where("k = 1")
    return own.select(key, "label", F.lit(1.0).alias("confidence"), F.concat(F.lit("official Space tag "), "tag").alias("evidence"), F.lit("metadata").alias("source"))


def suppressed(declared_matches: DataFrame, key: str, tracks: tuple[str, ...] = TRACKS) -> DataFrame:
    """(key, label): rows that declare a track are settled for all tracks."""
    own = declared_matches.where(F.col("label").isin(*tracks)).select(key).distinct()
    return own.select(key, F.explode(F.array(*map(F.lit, tracks))).alias("label"))


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union of two match tables; where both have a label of a row, the first wins."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    by = W.partitionBy(key, "label").orderBy("__p", F.desc("confidence"))
    return both.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k", "__p")


def remaining(rows: DataFrame, matches: DataFrame, key: str, labels: list[str], settled: DataFrame | None = None) -> DataFrame:
    """(key, labels), those of the label space that a row has no match for and that aren't settled (key, label), in its order."""
    matches = matches.select(key, "label") if settled is None else matches.select(key, "label").unionByName(settled.select(key, "label"))
    has = matches.groupBy(key).agg(F.collect_set("label").alias("__has"))
    every = F.array(*map(F.lit, labels))
    return rows.select(key).join(has, key, "left").select(key, F.array_except(every, F.coalesce("__has", F.array().cast("array<string>"))).alias("labels"))


def _names(labels: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """The key of every name of a label: its id and label, both behind `Best` and `Best Use of`, and the fixed aliases."""
    plain = lambda name: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower().replace("&", " and ")).split())
    names = {f"{before}{name}": i for i, label in labels for name in (i, label) for before in ("", "Best ", "Best Use of ")}
    return {plain(name): i for name, i in {**names, **ALIASES}.items()}


def canonical(name: Column, labels: tuple[tuple[str, str], ...] = LABELS) -> Column:
    """X11: the id of an exact id, else of a known name by its key, else of an id, in any case, before ` (` or ` - `; else null."""
    raw = clean(name)
    out = F.lit(None).cast("string")
    for i, _ in reversed(labels):
        low = F.lower(raw)
        out = F.when((low == i.lower()) | low.startswith(f"{i.lower()} (") | low.startswith(f"{i.lower()} - "), F.lit(i)).otherwise(out)
    known = F.create_map(*[F.lit(x) for pair in _names(labels).items() for x in pair])
    return F.when(raw.isin([i for i, _ in labels]), raw).otherwise(F.coalesce(F.try_element_at(known, label_key(raw)), out))


def canonical_all(name: Column, labels: tuple[tuple[str, str], ...] = LABELS) -> Column:
    """X11, composites: the ids of a name, or of the parts between its slashes if all are known; null if one isn't."""
    whole = canonical(name, labels)
    parts = F.filter(F.transform(F.split(clean(name), "/"), lambda p: F.trim(p)), lambda p: p != "")
    ids = F.transform(parts, lambda p: canonical(p, labels))
    every = (F.size(parts) > 1) & ~F.exists(ids, lambda i: i.isNull())
    return F.when(whole.isNotNull(), F.array(whole)).when(every, F.array_distinct(ids))


def repeats_taxonomy(evidence: Column, descriptions: list[str]) -> Column:
    """evidence that quotes the prompt: it has `signals:`, or begins with the first 80 characters of a description."""
    flat = F.lower(clean(evidence))
    begins = [flat.startswith(" ".join(x.lower().split())[:80]) for x in descriptions]
    out = F.contains(flat, F.lit("signals:"))
    for b in begins:
        out = out | b
    return out


def checked(matches: DataFrame, key: str, descriptions: list[str] = []) -> DataFrame:  # noqa: B006
    """Matches with canonical label, rounded confidence, clipped evidence, and `error`, null where the match is valid."""
    label = canonical(F.col("label"))
    evidence = F.left(clean(F.col("evidence")), F.lit(EVIDENCE_CHARS))
    error = (
        F.when(label.isNull(), F.lit("unknown label"))
        .when(F.col("confidence").isNull() | (F.col("confidence") <= 0) | (F.col("confidence") > 1), F.lit("confidence out of range"))
        .when(evidence == "", F.lit("no evidence"))
        .when(repeats_taxonomy(evidence, descriptions), F.lit("evidence of the prompt"))
        .when(~F.col("source").isin(*SOURCES), F.lit("unknown source"))
    )
    return matches.select(key, label.alias("label"), F.bround("confidence", 3).alias("confidence"), evidence.alias("evidence"), "source", error.alias("error"))


def coverage_gaps(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, problem), ids without any match row (`missing`) and match rows without an id (`extra`)."""
    a, b = rows.select(key).distinct().withColumn("__a", F.lit(1)), matches.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__b").isNull(), "missing").otherwise("extra").alias("problem"))


def duplicates(matches: DataFrame, key: str) -> DataFrame:
    """(key, label, n) where a row has a label more than once."""
    return matches.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require(violations: DataFrame, what: str) -> None:
    """Raise LabelError if the table has rows."""
    found = violations.limit(5).collect()
    if found:
        raise LabelError(what, found)


def report(labels: DataFrame, matches: DataFrame, key: str, likes: DataFrame | None = None, examples: int = 4) -> DataFrame:
    """For each label, in the order of `pos`, how many rows have it (0 too) and its best examples.

    labels: (pos, label). A row's confidence for a label is its highest; ties of examples go to more likes, then the key.
    """
    top = matches.groupBy("label", key).agg(F.max("confidence").alias("confidence"))
    top = top.join(likes, key, "left") if likes is not None else top.withColumn("likes", F.lit(0))
    by = W.partitionBy("label").orderBy(F.desc("confidence"), F.desc_nulls_last("likes"), key)
    best = top.withColumn("k", F.row_number().over(by)).where(F.col("k") <= examples)
    lists = best.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", key))), lambda x: x[key]).alias("examples"))
    counts = top.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    joined = labels.join(counts, "label", "left").join(lists, "label", "left")
    kind = dict(best.dtypes)[key]
    return joined.select("pos", "label", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("examples", F.array().cast(f"array<{kind}>")).alias("examples"))


def evaluation(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Micro-averaged counts and ratios of two array columns; a null prediction counts as no labels, an empty denominator as 1."""
    p = F.coalesce(F.col(predicted), F.array().cast("array<string>"))
    sums = pairs.agg(
        F.sum(F.size(F.array_intersect(gold, p))).alias("tp"),
        F.sum(F.size(F.array_except(p, F.col(gold)))).alias("fp"),
        F.sum(F.size(F.array_except(F.col(gold), p))).alias("fn"),
        F.count_if(F.array_sort(gold) == F.array_sort(p)).alias("exact"),
        F.count(F.lit(1)).alias("n"),
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("*", precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
