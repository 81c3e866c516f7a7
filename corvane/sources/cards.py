"""Reading cards, session logs and training rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.text import bounded, clean, normalized_tags, public_summary, public_title, slug

APP_CHARS = 2000
PUBLIC = ("id", "title", "summary", "tags", "models", "datasets", "likes", "sdk", "license", "created_at", "last_modified", "host", "url", "app_file")


def coerced(rows: DataFrame, url_of: str = "https://example.invalid/{id}") -> DataFrame:
    """Every column of the card schema, never null: empty text, empty array or 0; an id is required."""
    has = set(rows.columns)
    source = F.coalesce(*[F.col(c) for c in ("app_file_source", "app_source") if c in has], F.lit(""))
    out = []
    for field in schemas.PROJECT:
        name = field.name
        found = source if name == "app_file_source" else F.col(name) if name in has else F.lit(None)
        if name == "id":
            value = F.when(found.isNull() | (found == ""), F.raise_error(F.lit("a card without an id"))).otherwise(found)
        elif field.dataType == schemas.TEXTS:
            value = F.coalesce(found.cast(field.dataType), F.array().cast(field.dataType))
        elif field.dataType == schemas.LONG:
            value = F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))
        else:
            value = F.coalesce(found.cast("string"), F.lit(""))
        if name == "title":
            value = F.when(clean(value) == "", slug(F.col("id"))).otherwise(value)
        if name == "url":
            value = F.when(value == "", F.replace(F.lit(url_of), F.lit("{id}"), F.col("id"))).otherwise(value)
        out.append(value.alias(name))
    return rows.select(*out)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """The cards of a snapshot file (one JSON object with `projects`), with their place in `page`, from 1. Broken JSON is an error."""
    whole = spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.posexplode("projects").alias("at", "p")).select((F.col("at") + 1).alias("page"), "p.*")


def public(rows: DataFrame) -> DataFrame:
    """The public columns, with title, summary and tags made presentable."""
    made = {"title": public_title(F.col("title")), "summary": public_summary(F.col("summary")), "tags": normalized_tags(F.col("tags"))}
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in PUBLIC])


def searchable_text(rows: DataFrame) -> DataFrame:
    """Rows with `searchable_text`, labelled lines of what isn't blank; READMEs stay out, so that vectors can be reused."""
    parts = [F.col("title"), F.col("summary"), *[F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")) for name, c in (("tags", "tags"), ("models", "models"), ("datasets", "datasets"))], bounded(F.col("app_file_embedding_text"), APP_CHARS)]
    empty = [F.col("title"), F.col("summary"), F.array_join("tags", ""), F.array_join("models", ""), F.array_join("datasets", ""), F.col("app_file_embedding_text")]
    kept = F.array_compact(F.array(*[F.when(F.trim(e) != "", p) for p, e in zip(parts, empty, strict=True)]))
    return rows.withColumn("searchable_text", F.array_join(kept, "\n"))


def read_sessions(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(file, record_index, raw, record) of all *.jsonl below the roots. record is null where a line isn't JSON.

    The index is a line's place in its file, blank lines counted. Files are read in splits: a split's rows come in order and
    splits are told apart by where they begin, so that no file is held as one value."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(roots)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__k"), F.col("value").alias("raw"))
    numbered = placed.withColumn("record_index", F.row_number().over(W.partitionBy("file").orderBy("__at", "__k")) - 1)
    return numbered.where("trim(raw) <> ''").select("file", "record_index", "raw", F.try_parse_json("raw").alias("record"))


def session_records(lines: DataFrame) -> DataFrame:
    """Lines of read_sessions with session_id, timestamp, type and payload (JSON).

    All rows of a file have one session id: that of its last session_meta record, which may lack one; without such a record
    the file's name, without its ending and a leading `rollout-`."""
    text = lambda path: F.try_variant_get("record", path, "string")
    stem = F.regexp_replace(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", ""), "^rollout-", "")
    own = F.when(text("$.type") == "session_meta", F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("record", "$.payload.id", "variant")) == "STRING", text("$.payload.id")), stem))
    whole = W.partitionBy("file").orderBy("record_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = lines.withColumn("session_id", F.coalesce(F.last(own, ignorenulls=True).over(whole), stem))
    return rows.select("file", "record_index", "session_id", text("$.timestamp").alias("timestamp"), text("$.type").alias("type"), F.to_json(F.try_variant_get("record", "$.payload", "variant")).alias("payload"))


def read_examples(spark: SparkSession, path: str, manifest_needed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(examples, manifest) of a JSONL of training rows; a row of type `manifest` describes the others."""
    rows = spark.read.option("mode", "FAILFAST").json(path)
    if "type" not in rows.columns:
        if manifest_needed:
            raise ValueError("no manifest row")
        return rows, rows.limit(0)
    manifest = rows.where("type = 'manifest'")
    if manifest_needed and manifest.isEmpty():
        raise ValueError("no manifest row")
    return rows.where("type is null or type <> 'manifest'"), manifest


def resolved_under(root: str, relative: str) -> Path:
    """A path below root, or ValueError."""
    base, found = Path(root).resolve(), (Path(root) / relative).resolve()
    if not found.is_relative_to(base):
        raise ValueError(f"{relative} leads out of {root}")
    return found
