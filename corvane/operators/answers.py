"""What a model answers about labels, read and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import clean, let
from corvane.operators.labels import EVIDENCE_CHARS, SOURCES, canonical_all, repeats_taxonomy

MATCH = "struct<quest:string,confidence:double,evidence:string,source:string>"


def checked(answer: Column, descriptions: list[str] = []) -> Column:  # noqa: B006
    """A struct (matches, error) of a JSON answer {"matches": [...]}: matches with canonical labels (a name of several
    gives one each), rounded confidence and cut evidence; the first thing that is wrong with them makes the error."""
    none = F.array().cast(f"array<{MATCH}>")
    found = F.try_variant_get(F.try_parse_json(answer), "$.matches", "variant")
    is_list = F.coalesce(F.schema_of_variant(found).startswith("ARRAY"), F.lit(False))

    def read(m: Column) -> Column:
        field = lambda name: F.try_variant_get(m, f"$.{name}", "string")
        evidence, confidence, ids = clean(field("evidence")), F.try_variant_get(m, "$.confidence", "double"), canonical_all(field("quest"))
        error = (
            F.when(~F.schema_of_variant(m).startswith("OBJECT"), F.lit("matches must be objects"))
            .when(ids.isNull(), F.concat(F.lit("unknown quest: "), F.coalesce(field("quest"), F.lit(""))))
            .when(confidence.isNull(), F.lit("confidence must be numeric"))
            .when((confidence <= 0) | (confidence > 1), F.lit("confidence must be greater than 0 and no more than 1"))
            .when(evidence == "", F.lit("evidence must not be empty"))
            .when(repeats_taxonomy(evidence, descriptions), F.lit("evidence must come from README or APP_FILE, not quest instructions"))
            .when(~F.coalesce(field("source").isin(*SOURCES), F.lit(False)), F.concat(F.lit(f"source must be one of {', '.join(SOURCES)}, got "), F.coalesce(field("source"), F.lit(""))))
        )
        match = lambda i: F.struct(i.alias("quest"), F.bround(confidence, 3).alias("confidence"), F.left(evidence, F.lit(EVIDENCE_CHARS)).alias("evidence"), field("source").alias("source"))
        return F.struct(F.when(error.isNull(), F.transform(ids, match)).alias("matches"), error.alias("error"))

    def whole(rows: Column) -> Column:
        errors = F.array_compact(F.transform(rows, lambda r: r["error"]))
        matches = F.flatten(F.transform(rows, lambda r: F.coalesce(r["matches"], none)))
        names = F.transform(matches, lambda m: m["quest"])
        again = F.get(F.filter(F.transform(names, lambda n, k: F.when(F.array_position(names, n) <= k, n)), lambda n: n.isNotNull()), F.lit(0))
        error = F.coalesce(F.get(errors, F.lit(0)), F.concat(F.lit("duplicate quest: "), again))
        return F.struct(F.when(error.isNull(), matches).alias("matches"), error.alias("error"))

    missing = F.struct(F.lit(None).cast(f"array<{MATCH}>").alias("matches"), F.when(answer.isNull(), F.lit("no JSON object in the answer")).otherwise("matches must be a list").alias("error"))
    return F.when(is_list, let(F.transform(found.cast("array<variant>"), read), whole)).otherwise(missing)
