"""The crawl connector: listings of items as a table, texts of their files, and cards made of both.

`corvane_items` is a Python Data Source. A listing is one or more pages, each a text of JSON lines under a url (http, https
or file); a page is read by `workers` tasks, each of which takes its share of the lines while it streams the page, so neither the driver nor
a task holds a listing. An item is a row; what can't be read or isn't an item is a row with an error, so that one bad item or page fails no crawl.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.python_text import signals_of_source
from corvane.functions.text import bounded, frontmatter, humanized, joined_signals, normalized_tags, without_frontmatter

ATTEMPTS, TIMEOUT, WORKERS = 2, 45.0, 12
README_CHARS = APP_CHARS = 24_000
EMBEDDED_CHARS = 2000
_ITEM = "page int, position long, id string, item string, error string"


def crawl_workers(raw: str | None = None) -> int:
    """The environment's CORVANE_CRAWL_WORKERS, at least 1; 12 where it is unset or blank; anything but an integer is an error."""
    raw = (os.environ.get("CORVANE_CRAWL_WORKERS", "") if raw is None else raw).strip()
    if not raw:
        return WORKERS
    try:
        return max(1, int(raw))
    except ValueError as e:
        raise ValueError(f"CORVANE_CRAWL_WORKERS must be an integer, got {raw!r}") from e


def _is_absent(error: Exception) -> bool:
    return isinstance(error, HTTPError) and error.code == 404 or isinstance(getattr(error, "reason", None), FileNotFoundError)


def fetched(url: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> tuple[str | None, str | None]:
    """S10, optional form: (text, error). A missing file is an empty text; any other failure is tried again, then an error."""
    error = ""
    for _ in range(attempts):
        try:
            with urlopen(url, timeout=timeout) as answer:
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
        except (URLError, OSError) as e:
            if _is_absent(e):
                return "", None
            error = str(e)
    return None, f"{url}: {error} ({attempts} attempts)"


class _Share(InputPartition):
    def __init__(self, page: int, url: str, share: int):
        self.page, self.url, self.share = page, url, share


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = json.loads(options["pages"])
        self.workers, self.attempts, self.timeout = int(options.get("workers", WORKERS)), int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[_Share]:
        return [_Share(n, url, k) for n, url in enumerate(self.pages) for k in range(self.workers)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        # A page that breaks off is read again from its beginning; lines that were taken already are passed over.
        taken, error = 0, ""
        for _ in range(self.attempts):
            try:
                with urlopen(partition.url, timeout=self.timeout) as lines:
                    for at, line in enumerate(lines):
                        if at >= taken:
                            taken = at + 1
                            if at % self.workers == partition.share and line.strip():
                                yield from self._row(partition.page, at, line)
                return
            except (URLError, OSError) as e:
                error = str(e)
        if partition.share == 0:
            yield partition.page, None, None, None, f"{partition.url}: {error} ({self.attempts} attempts)"

    @staticmethod
    def _row(page: int, at: int, line: bytes) -> Iterator[tuple]:
        try:
            item = json.loads(line)
        except ValueError as e:
            yield page, at, None, None, f"not JSON: {e}"
            return
        if not isinstance(item, dict):
            yield page, at, None, None, "an item must be an object"
        elif not item.get("private"):
            known = str(item.get("id") or "")
            yield page, at, known or None, json.dumps(item, ensure_ascii=False, sort_keys=True), None if known else "an item without an id"


class Items(DataSource):
    """Options pages (a JSON list of urls), workers, attempts, timeout. Private items are left out; (page, position) is the input order."""

    @classmethod
    def name(cls) -> str:
        return "corvane_items"

    def schema(self) -> str:
        return _ITEM

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_items(spark: SparkSession, pages: list[str], workers: int | None = None, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> DataFrame:
    """(page, position, id, item, error); item is the JSON of an item. No pages give no rows."""
    spark.dataSource.register(Items)
    options = {"pages": json.dumps(pages), "workers": str(workers or crawl_workers()), "attempts": str(attempts), "timeout": str(timeout)}
    return spark.read.format("corvane_items").options(**options).load() if pages else spark.createDataFrame([], _ITEM)


def folder_pages(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """The urls of the files of a folder, in the order of their names; hidden files and those of other suffixes aside."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted((s.getPath().getName(), s.getPath().toUri().toString()) for s in found)
    return [url.replace("file:/", "file:///", 1) if url.startswith("file:/") and not url.startswith("file:///") else url for name, url in names if name[0] not in "._" and name.endswith(suffix)]


def with_texts(rows: DataFrame, url: Column, text: str, error: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, threads: int = WORKERS) -> DataFrame:
    """Rows with the text under a url and the error of those that couldn't be read. Null and empty urls give an
    empty text. A task has `threads` requests under way at a time and keeps the order of its rows."""
    at = "__url"
    schema = T.StructType([f for f in rows.schema.fields if f.name not in (text, error)] + [T.StructField(text, T.StringType()), T.StructField(error, T.StringType())])
    kept = [f.name for f in schema.fields[:-2]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                got = list(pool.map(lambda u: fetched(u, attempts, timeout) if u else ("", None), part.column(len(kept)).to_pylist()))
                ends = [pa.array([x[k] for x in got], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *ends], [*kept, text, error])

    return rows.select(*kept, url.alias(at)).mapInArrow(run, schema)


def app_file(path: Column) -> Column:
    """P25: a struct (path, error): the path without `.` parts and doubled slashes; absolute paths, `..` parts and a slash at the end are errors."""
    given = F.trim(F.coalesce(path, F.lit("")))
    parts = F.split(given, "/")
    bad = given.startswith("/") | given.endswith("/") | F.array_contains(parts, "..")
    plain = F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")
    return F.struct(F.when(bad, F.lit("")).otherwise(plain).alias("path"), F.when(bad, F.concat(F.lit("invalid app_file path: "), given)).alias("error"))


def embedding_text(path: Column, source: Column) -> Column:
    """The signals of a Python file, else the text itself, bounded; nothing without a path or a text."""
    body = F.when(F.lower(path).rlike(r"[^/]\.py$"), joined_signals(signals_of_source(source))).otherwise(source)
    return F.when((F.trim(F.coalesce(path, F.lit(""))) == "") | (F.trim(F.coalesce(source, F.lit(""))) == ""), F.lit("")).otherwise(bounded(body, EMBEDDED_CHARS))


def _texts(item: Column, *paths: str) -> Column:
    """The first of the paths that holds a list with something in it, as strings."""
    lists = [F.try_variant_get(item, p, "array<string>") for p in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, F.filter(x, lambda v: v.isNotNull())) for x in lists], F.array().cast("array<string>"))


def _first(item: Column, *paths: str) -> Column:
    """The first of the paths that holds a text other than the empty one."""
    return F.coalesce(*[F.nullif(F.try_variant_get(item, p, "string"), F.lit("")) for p in paths], F.lit(""))


def sibling_names(item: Column) -> Column:
    """The names of an item's files."""
    return F.transform(F.coalesce(F.try_variant_get(item, "$.siblings", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.try_variant_get(s, "$.rfilename", "string"))


def file_url(base: str, key: Column, name: Column) -> Column:
    """The address of a file of an item below base, quoted but for slashes."""
    quoted = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base.rstrip("/") + "/"), quoted(key), F.lit("/"), quoted(name))


def cards(raw: DataFrame, url_of: str = "https://example.invalid/{id}") -> DataFrame:
    """Cards of (page, position, id, item, readme, app_text, error), in the columns of the card schema and `error`.

    An item's own fields come before its card's for models and datasets, its card's before its own for title, tags and sdk."""
    v = F.col("__v")
    rows = raw.withColumn("__v", F.try_parse_json("item")).withColumn("__front", frontmatter(F.col("readme")))
    path = app_file(F.col("__front")["app_file"])
    app = F.left(F.coalesce("app_text", F.lit("")), F.lit(APP_CHARS))
    plain = lambda c: F.array_sort(F.array_distinct(c))
    host = _first(v, "$.subdomain")
    out = rows.withColumn("__path", path).select(
        "page",
        "position",
        "id",
        F.coalesce(F.nullif(_first(v, "$.cardData.title"), F.lit("")), humanized(F.substring_index("id", "/", -1))).alias("title"),
        _first(v, "$.cardData.short_description", "$.cardData.description").alias("summary"),
        normalized_tags(plain(_texts(v, "$.cardData.tags", "$.tags"))).alias("tags"),
        _texts(v, "$.models", "$.cardData.models").alias("models"),
        _texts(v, "$.datasets", "$.cardData.datasets").alias("datasets"),
        F.coalesce(F.try_variant_get(v, "$.likes", "long"), F.lit(0)).alias("likes"),
        _first(v, "$.cardData.sdk", "$.sdk").alias("sdk"),
        _first(v, "$.cardData.license").alias("license"),
        _first(v, "$.created_at").alias("created_at"),
        _first(v, "$.last_modified").alias("last_modified"),
        F.coalesce(F.nullif(_first(v, "$.host"), F.lit("")), F.when(host != "", F.concat(F.lit("https://"), host, F.lit(".hf.space"))), F.lit("")).alias("host"),
        F.replace(F.lit(url_of), F.lit("{id}"), F.col("id")).alias("url"),
        F.col("__path.path").alias("app_file"),
        app.alias("app_file_source"),
        F.left(without_frontmatter(F.col("readme")), F.lit(README_CHARS)).alias("readme_body"),
        F.coalesce("error", "__path.error").alias("error"),
    )
    return out.withColumn("app_file_embedding_text", embedding_text(F.col("app_file"), F.col("app_file_source")))


def crawl(spark: SparkSession, pages: list[str], base: str, workers: int | None = None, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> DataFrame:
    """The cards of all public items of a listing, one row each, with what went wrong in `error`. READMEs and app files
    are read below base, each only if the item names it among its files; texts are read once, not in every later use of the result."""
    items = read_items(spark, pages, workers, attempts, timeout).withColumn("__names", sibling_names(F.try_parse_json("item")))
    readmes = with_texts(items, F.when(F.array_contains("__names", "README.md"), file_url(base, F.col("id"), F.lit("README.md"))), "readme", "readme_error", attempts, timeout)
    path = app_file(frontmatter(F.col("readme"))["app_file"])["path"]
    named = readmes.withColumn("__path", F.coalesce(path, F.lit("")))
    texts = with_texts(named, F.when((F.col("__path") != "") & F.array_contains("__names", F.col("__path")), file_url(base, F.col("id"), F.col("__path"))), "app_text", "app_error", attempts, timeout)
    return cards(texts.withColumn("error", F.coalesce("error", "readme_error", "app_error")))
