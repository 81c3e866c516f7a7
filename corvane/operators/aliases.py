"""Correction of names that were heard or typed wrong (J13, M18): aliases met with the runs of words of a text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let

LEAST = 0.88
WORD = r"([A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)?)"
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: Column) -> Column:
    """A-Z in lower case; every place of the text stays where it is."""
    return F.translate(text, *_LETTERS)


def runs(text: Column, longest: int = 3) -> Column:
    """The distinct runs of one to `longest` words, each joined by single spaces, in lower case."""
    none = F.array().cast("array<string>")

    def of(words: Column) -> Column:
        joined = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        parts = [F.when(F.size(words) >= n, joined(n)).otherwise(none) for n in range(1, longest + 1)]
        return F.array_distinct(F.concat(*parts))

    return let(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(1)), of)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


#: Not worked out again by a filter on its result.
matching_ratio = F.pandas_udf(_ratios, T.DoubleType()).asNondeterministic()


def compact(text: Column) -> Column:
    return F.regexp_replace(lowered(text), "[^a-z0-9]", "")


def _near(spans: DataFrame, letters: Column, aliases: DataFrame, least: float) -> DataFrame:
    """spans with `span_letters` (letters) and every alias (name, place, variant_place, letters) that lengths and letters allow. The aliases
    are a list of names, so they are sent to the runs, and runs that are like none of them go no farther.

    A ratio is twice what matches over both lengths, so it can't reach `least` where the shorter is under least / (2 - least)
    of the longer, nor where too many letters are in one alone. Runs meet aliases on the lengths that leaves, by equality."""
    short = least / (2 - least)
    own = spans.withColumn("span_letters", letters).where("span_letters <> ''").withColumn("size", F.length("span_letters"))
    names = aliases.select("name", "place", "variant_place", compact(F.col("variant")).alias("letters")).where("letters <> ''")
    n = F.length("letters")
    lengths = F.sequence(F.ceil(n * short).cast("int"), F.floor(n / short).cast("int"))
    pairs = own.join(F.broadcast(names.withColumn("size", F.explode(lengths))), "size")
    # Letters that the other side lacks are unmatched.
    without = lambda a, b: F.length(F.call_function("translate", F.col(a), F.col(b), F.lit("")))
    lone = without("span_letters", "letters") + without("letters", "span_letters")
    return pairs.where(lone <= (1 - least) * (F.col("size") + n) + 1e-9).drop("size")


def alike(spans: DataFrame, aliases: DataFrame, least: float = LEAST, letters: Column | None = None) -> DataFrame:
    """The rows of spans for each alias (name, place, variant_place, score) that their run (`span`) is like: score is 1 if
    letters and digits are equal, else their matching ratio, from `least` on. Every pair of letters is compared once, however many rows have it.
    letters: the letters and digits of a run, if there is a cheaper way to them.

    No side is broadcast for its estimated size: runs are many times what the planner takes them for."""
    near = _near(spans, compact(F.col("span")) if letters is None else letters, aliases, least)
    given = [*spans.columns, "name", "place", "variant_place"]
    equal = near.where("span_letters = letters").select(*given, F.lit(1.0).alias("score"))
    other = near.where("span_letters <> letters")
    rated = other.select("span_letters", "letters").distinct().withColumn("score", matching_ratio("letters", "span_letters")).where(F.col("score") >= least)
    return equal.unionByName(other.join(rated.hint("merge"), ["span_letters", "letters"]).select(*given, "score"))


def corrected(rows: DataFrame, aliases: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """(key, text, corrections): for each name, in the order of its place, the run most like one of its aliases (ties: the
    earlier alias, the longer run, the smaller text) is replaced by the name where it first occurs, in any case. A run serves one
    name only, and a name stays. corrections: (original, canonical, confidence) in that order. Null texts stay null; keys must be distinct.

    Only runs that may be like an alias are moved, and each is compared once, however many texts have it."""
    hits = alike(rows.select(key, F.explode(runs(F.col(text))).alias("span")), aliases, least, F.translate("span", " .-", ""))
    order = F.struct((-F.col("score")).alias("less"), "variant_place", (-F.length("span")).alias("shorter"), "span")
    best = hits.groupBy(key, "name", "place").agg(F.min(order).alias("b")).select(key, "name", "place", F.col("b.span").alias("span"), (-F.col("b.less")).alias("score")).where("span <> name")
    first = best.groupBy(key, "span").agg(F.min(F.struct("place", "name", "score")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("x.place", "span", "x.name", "x.score"))), lambda c: F.struct(c["span"].alias("original"), c["name"].alias("canonical"), F.round(c["score"], 3).alias("confidence")))
    fixes = first.groupBy(key).agg(listed.alias("corrections"))

    def replaced(held: Column, fix: Column) -> Column:
        at = F.instr(lowered(held), fix["original"])
        return F.when(at > 0, F.concat(F.substring(held, F.lit(1), at - 1), fix["canonical"], F.substring(held, at + F.length(fix["original"]), F.length(held)))).otherwise(held)

    none = F.array().cast("array<struct<original:string,canonical:string,confidence:double>>")
    joined = rows.select(key, text).join(fixes.hint("merge"), key, "left").withColumn("corrections", F.coalesce("corrections", none))
    return joined.select(key, F.aggregate("corrections", F.col(text), replaced).alias("text"), "corrections")


def alias_table(spark, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Names with their aliases as the table that `corrected` takes."""
    return spark.createDataFrame([(n, i, v, k) for i, (n, variants) in enumerate(names.items()) for k, v in enumerate(variants)], "name string, place int, variant string, variant_place int")

