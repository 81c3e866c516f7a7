"""Label analysis of rows by a model that the caller gives: prompts, a ladder of repairs, merged results, and a cache that knows what made a result
(P21, C4-C9, C14, X3, X10, K3, S19, J8, A20).

A model is a function from texts to texts. Whatever a row's model or its answer does wrong is that row's error; others go on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.python_text import repaired_json
from corvane.functions.text import clipped, stripped
from corvane.operators.answers import MATCH, checked
from corvane.operators.publication import quoted
from corvane.operators.training_rows import NO_APP, NO_README
from corvane.sources.work import written

BATCH = 8
SCHEMA_VERSION = 1
#: What a prompt shows of the two segments.
README_LIMIT, APP_LIMIT = 1500, 1900
Model = Callable[[list[str]], list[str]]

# The prompt's lines before and behind the list of labels.
PROMPT_HEAD = (
    "Classify this hackathon project against the quest dimensions below.",
    "Read the two evidence segments (README and APP_FILE) and judge each quest only from them.",
    "",
    "Quests (copy the id on the left verbatim):",
)
PROMPT_RULES = (
    "",
    "Rules:",
    "- Include a quest only when a segment gives clear, specific evidence.",
    "- quest must be one id from the list above, copied exactly. Never invent or rephrase a quest name.",
    "- confidence is a number between 0 and 1.",
    "- evidence is a 3-to-12 word quote or tight paraphrase taken from the segment you cite.",
    '- source is "readme" when the evidence is in the README segment, "app_file" when it is in the APP_FILE segment.',
    "- At most one match per quest. Sort matches by confidence, highest first.",
    "- If no quest has clear evidence, return an empty matches list.",
    '- Output exactly one JSON object: {"matches":[{"quest":"...","confidence":0.0,"evidence":"...","source":"readme"}]}.',
    "- No markdown, no code fences, no commentary, no extra keys.",
    "",
)


def canonical(value) -> str:
    """X1 of a value outside a table: keys sorted at every level, no blanks, UTF-8 as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_json(text: Column) -> Column:
    """X1 of a column: the JSON with keys sorted at every level and no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _spaced(values: Column) -> Column:
    """A list of strings as JSON with a blank behind each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), quoted), ", "), F.lit("]"))


def prompt(title: Column, sdk: Column, models: Column, tags: Column, readme: Column, app_name: Column, app: Column, labels: Column, strip: Callable[[Column], Column] = stripped) -> Column:
    """The classification prompt, byte for byte. labels: an array of structs (id, description, signals) of the labels asked for; signals null: without them.
    strip: what takes blanks off the ends of title and segments, of every kind if not given."""
    line = F.transform(labels, lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["description"], F.coalesce(F.concat(F.lit(" Signals: "), x["signals"]), F.lit(""))))
    text = lambda c, limit, none: F.coalesce(F.nullif(clipped(c, limit, strip=strip), F.lit("")), F.lit(none))
    metadata = F.concat(F.lit('METADATA: {"title": '), quoted(strip(F.coalesce(title, F.lit("")))), F.lit(', "sdk": '), quoted(stripped(sdk)), F.lit(', "declared_models": '), _spaced(models), F.lit(', "tags": '), _spaced(tags), F.lit("}"))
    name = F.coalesce(F.nullif(stripped(app_name), F.lit("")), F.lit("(unknown)"))
    lines = F.concat(F.array(*map(F.lit, PROMPT_HEAD)), line, F.array(*map(F.lit, PROMPT_RULES)), F.array(metadata, F.lit(""), F.lit("[README]"), text(readme, README_LIMIT, NO_README), F.lit(""), F.concat(F.lit("[APP_FILE] "), name), text(app, APP_LIMIT, NO_APP)))
    return F.array_join(lines, "\n")


def called(model: Model, batch: int = BATCH):
    """C14: a pandas UDF text -> (text, error) that gives the model at most `batch` texts at a time. Where a batch fails, its
    texts are tried one by one, so that one bad text costs no other its answer. Null texts aren't asked."""

    @F.pandas_udf("text string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None]

        def attempt(places: list[int]) -> None:
            try:
                for i, answer in zip(places, model([texts.iloc[i] for i in places]), strict=True):
                    out[i] = (answer, None)
            except Exception as e:  # the caller's model may fail in any way
                if len(places) == 1:
                    out[places[0]] = (None, f"{type(e).__name__}: {e}")
                else:
                    for i in places:
                        attempt([i])

        for at in range(0, len(asked), batch):
            attempt(asked[at : at + batch])
        return pd.DataFrame(out, columns=["text", "error"])

    return run


def merged(declared: Column, inferred: Column) -> Column:
    """U2 within a row: declared matches, then inferred ones of other labels."""
    names = F.transform(declared, lambda m: m["quest"])
    return F.concat(declared, F.filter(inferred, lambda m: ~F.array_contains(names, m["quest"])))


def analyzed(rows: DataFrame, key: str, prompt_col: str, declared: str, model: Model, repair: Model | None = None, descriptions: list[str] = [], batch: int = BATCH) -> DataFrame:  # noqa: B006
    """Rows with `matches`, `error` and `rung`. A row without a prompt (all its labels are declared) keeps what it declares.

    The rungs: the answer's JSON, its quotes mended (`parsed`); what `repair` makes of an answer that isn't JSON or breaks the
    contract, given it with the error (`repaired`); the declared matches alone, with the error (`declared`). Only rows that need a rung
    are taken there, and each model is asked once for a row: its answers are written before they are read."""
    ask, has = called(model, batch), F.col(prompt_col).isNotNull()
    asked = written(rows.withColumn("__a", ask(prompt_col)), "answers")
    read = asked.withColumn("__json", repaired_json("__a.text"))
    read = written(read.withColumn("__c", F.when(F.col("__a.error").isNotNull(), F.struct(F.lit(None).cast(f"array<{MATCH}>").alias("matches"), F.col("__a.error").alias("error"))).otherwise(checked(F.col("__json"), descriptions))), "checked")
    none, columns = F.array().cast(f"array<{MATCH}>"), [F.col(c) for c in rows.columns]
    own = F.coalesce(F.col(declared), none)
    fine = read.where(~has | F.col("__c.error").isNull())
    good = fine.select(*columns, F.when(has, merged(own, F.col("__c.matches"))).otherwise(own).alias("matches"), F.lit(None).cast("string").alias("error"), F.when(has, "parsed").otherwise("declared").alias("rung"))
    bad = read.where(has & F.col("__c.error").isNotNull())
    if repair is None:
        return good.unionByName(bad.select(*columns, own.alias("matches"), F.col("__c.error").alias("error"), F.lit("declared").alias("rung")))
    mend = called(repair, batch)
    request = F.concat(F.lit("error: "), F.col("__c.error"), F.lit("\n"), F.coalesce("__json", "__a.text", F.lit("")))
    again = written(bad.withColumn("__m", mend(request)), "mended").withColumn("__d", checked(repaired_json("__m.text"), descriptions))
    second = F.coalesce("__m.error", "__d.error")
    last = again.withColumn("__e", F.when(second.isNotNull(), F.concat("__c.error", F.lit("; repair failed: "), second)))
    return good.unionByName(last.select(*columns, F.when(F.col("__e").isNull(), merged(own, F.col("__d.matches"))).otherwise(own).alias("matches"), F.col("__e").alias("error"), F.when(F.col("__e").isNull(), "repaired").otherwise("declared").alias("rung")))


def file_digest(path: str) -> str:
    """The SHA-256 of a local file, read in pieces."""
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(path: str) -> str:
    """The SHA-256 over the names and contents of the files of a local folder in the order of their paths, or of one file; empty where there is none."""
    root = Path(path).expanduser() if path else None
    if root is None or not root.exists():
        return ""
    whole = hashlib.sha256()
    for f in [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.is_file()):
        whole.update((f.name if root.is_file() else f.relative_to(root).as_posix()).encode() + b"\0")
        with f.open("rb") as opened:
            while piece := opened.read(1 << 20):
                whole.update(piece)
        whole.update(b"\0")
    return whole.hexdigest()


def identified(rows: DataFrame, key: str, prompt_col: str, taxonomy, analyzer, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """Rows with prompt_hash, taxonomy_hash, analyzer_fingerprint (canonical JSON) and cache_key, the digest of the canonical
    JSON of all that decides a result. taxonomy and analyzer: values that JSON can hold; the order of their keys doesn't matter, nor
    does the rows' order or partitioning."""
    fingerprint, labels = canonical(analyzer), hashlib.sha256(canonical(taxonomy).encode()).hexdigest()
    known = rows.withColumn("prompt_hash", F.sha2(F.coalesce(prompt_col, F.lit("")), 256)).withColumn("taxonomy_hash", F.lit(labels)).withColumn("analyzer_fingerprint", F.lit(fingerprint))
    payload = F.concat(F.lit(f'{{"analyzer_fingerprint":{fingerprint},"project_id":'), quoted(F.col(key).cast("string")), F.lit(',"prompt_hash":"'), "prompt_hash", F.lit(f'","schema_version":{schema_version},"taxonomy_hash":"{labels}"}}'))
    return known.withColumn("cache_key", F.sha2(payload, 256))


def entries(rows: DataFrame, key: str, source: Column, at: Column) -> DataFrame:
    """K3: (cache_key, prefix, payload) of identified rows with valid matches; prefix, two digits of the key, is what a store is partitioned by."""
    fields = {"analyzer_fingerprint": F.parse_json("analyzer_fingerprint"), "cache_key": F.col("cache_key"), "generated_at": at, "matches": F.col("matches"), "project_id": F.col(key).cast("string"), "prompt_hash": F.col("prompt_hash"), "schema_version": F.lit(SCHEMA_VERSION), "source": source, "taxonomy_hash": F.col("taxonomy_hash")}
    whole = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return rows.select("cache_key", F.left("cache_key", F.lit(2)).alias("prefix"), whole.alias("payload"))


def lookup(rows: DataFrame, cache: DataFrame, key: str, descriptions: list[str] = []) -> DataFrame:  # noqa: B006
    """Identified rows with `cached` (matches, null without a hit) and `reason`: hit, absent, invalid_json,
    invalid_payload, or invalid_schema with what differs. cache: (cache_key, payload), one entry a key."""
    payload = F.try_parse_json("payload")
    text = lambda name: F.try_variant_get(payload, f"$.{name}", "string")
    answer = F.when(F.col("payload").isNotNull(), F.concat(F.lit('{"matches":'), F.coalesce(F.to_json(F.try_variant_get(payload, "$.matches", "variant")), F.lit("[]")), F.lit("}")))
    joined = rows.join(cache.select("cache_key", "payload"), "cache_key", "left").withColumn("__c", checked(answer, descriptions))
    differs = F.lit(None).cast("string")
    for name, own in (("taxonomy_hash", F.col("taxonomy_hash")), ("prompt_hash", F.col("prompt_hash")), ("cache_key", F.col("cache_key")), ("project_id", F.col(key).cast("string"))):
        differs = F.when(~F.coalesce(text(name) == own, F.lit(False)), F.lit(f"cache {name} mismatch")).otherwise(differs)
    other = F.to_json(F.try_variant_get(payload, "$.analyzer_fingerprint", "variant"))
    differs = F.when(~F.coalesce(F.try_variant_get(payload, "$.schema_version", "int") == SCHEMA_VERSION, F.lit(False)), F.lit("unsupported cache schema")).otherwise(
        F.coalesce(differs, F.when(~F.coalesce(other == canonical_json(F.col("analyzer_fingerprint")), F.lit(False)), F.lit("cache analyzer_fingerprint mismatch")), F.col("__c.error"))
    )
    reason = (
        F.when(F.col("payload").isNull(), F.lit("absent"))
        .when(payload.isNull(), F.lit("invalid_json"))
        .when(~F.schema_of_variant(payload).startswith("OBJECT"), F.lit("invalid_payload"))
        .when(differs.isNotNull(), F.concat(F.lit("invalid_schema:"), differs))
        .otherwise(F.lit("hit"))
    )
    found = joined.withColumn("reason", reason)
    return found.withColumn("cached", F.when(F.col("reason") == "hit", F.col("__c.matches"))).drop("__c", "payload")


def run_records(rows: DataFrame, key: str) -> DataFrame:
    """What a run did with each row: (key, cache_key, prompt_hash, taxonomy_hash, status, matches)."""
    return rows.select(key, "cache_key", "prompt_hash", "taxonomy_hash", F.when(F.col("reason") == "hit", "cached").otherwise("analyzed").alias("status"), "matches")
