"""Read-only reports over a corpus of cards: top lists, activity, resolution of names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import clean
from corvane.operators.labels import LABELS, canonical
from corvane.sources.work import written


def top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """One sort and a limit, planned as a top-k; at least one row is asked for."""
    return rows.orderBy(*order).limit(max(1, limit))


def overview(rows: DataFrame, **counts: Column) -> DataFrame:
    """Several counts in one scan."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def resolve_contained(candidates: DataFrame, wanted: DataFrame, name: str, question: str, least: int = 4) -> DataFrame:
    """J15, by names alone: for each question the candidate whose name it is, else the longest whose name it contains, ties to the smaller name."""
    named = candidates.select(F.struct(F.lower(name).alias("low"), name).alias("pos"), name, F.array(name).alias("names"))
    return resolve_projects(named, wanted, "pos", name, "names", question, least)


def resolve_projects(candidates: DataFrame, wanted: DataFrame, pos: str, value: str, names: str, question: str, least: int = 4) -> DataFrame:
    """(question, match): the value of the first candidate one of whose names (id, slug, title) is the question; else of the one
    with the longest name, of at least `least` characters, that the question contains, ties to the first candidate (by pos) and its first name.

    Case and runs of white space don't matter. Exact names meet questions by equality. So do contained ones: wherever the first `least`
    characters of a name stand in a question, what stands there in the lengths of names that begin so is looked up, so that no
    name meets a question that doesn't contain it, however many names begin alike; punctuation and affixes are harmless.

    No side is broadcast for its estimated size: names and what questions hold are many times what the planner takes them for."""
    size = max(1, least)
    fold = lambda c: F.lower(clean(c))
    asked = wanted.select(question, fold(F.col(question)).alias("__q")).where("__q <> ''").distinct()
    named = candidates.select(F.col(pos).alias("__pos"), F.col(value).alias("__value"), F.posexplode(names).alias("__place", "__raw")).withColumn("__name", fold(F.col("__raw"))).where("__name <> ''").drop("__raw").hint("merge")
    exact = asked.join(named, F.col("__q") == F.col("__name")).groupBy(question).agg(F.min_by("__value", "__pos").alias("__exact"))
    # Written, so that its true size decides whether places in questions move to meet it.
    begins = written(named.where(F.length("__name") >= size).groupBy(F.left("__name", F.lit(size)).alias("__g")).agg(F.array_sort(F.collect_set(F.length("__name"))).alias("__lengths")), "begins")
    places = F.transform(F.sequence(F.lit(1), F.length("__q") - size + 1), lambda i: F.struct(i.alias("i"), F.substring("__q", i, F.lit(size)).alias("g")))
    grams = asked.where(F.length("__q") >= size).select(question, F.explode(places).alias("__p")).select(question, F.col("__p.i").alias("__i"), F.col("__p.g").alias("__g"))
    rest = F.length("__q") - F.col("__i") + 1
    held = grams.join(begins, "__g").withColumn("__q", fold(F.col(question))).select(question, "__q", "__i", F.explode(F.filter("__lengths", lambda n: n <= rest)).alias("__n"))
    hits = held.select(question, F.substring("__q", F.col("__i"), F.col("__n")).alias("__name")).join(named, "__name")
    best = F.min_by("__value", F.struct((-F.length("__name")).alias("n"), "__pos", "__place"))
    contained = hits.groupBy(question).agg(best.alias("__contained"))
    joined = wanted.select(question).distinct().join(exact.hint("merge"), question, "left").join(contained.hint("merge"), question, "left")
    return joined.select(question, F.coalesce("__exact", "__contained").alias("match"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _ratios(asked: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([[SequenceMatcher(None, q, x).ratio() for x in row] for q, row in zip(asked, labels, strict=True)])


def resolve_clusters(clusters: list[tuple[str, str, list[str]]], wanted: DataFrame, question: str, least: float = 0.6) -> DataFrame:
    """(question, match, rung): the id of the first cluster (id, label, keywords; in their order, some tens at most) whose id is the
    question; else whose label is; else whose label contains it or is contained; else with a keyword among its words; else whose
    label is most like it, from `least` on. Only questions that reach the last rung are compared letter by letter."""
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(" ".join(x.split()).lower()).alias("label"), F.array(*[F.lit(k.lower()) for k in words]).cast("array<string>").alias("words"), F.lit(i.lower()).alias("low")) for i, x, words in clusters])
    q = F.col("__q")
    rungs = [
        lambda c: c["low"] == q,
        lambda c: c["label"] == q,
        lambda c: F.contains(c["label"], q) | F.contains(q, c["label"]),
        lambda c: F.arrays_overlap(c["words"], F.split(q, " ")),
    ]
    asked = wanted.select(question).distinct().withColumn("__q", F.lower(clean(F.col(question))))
    found = F.lit(None).cast("struct<id:string,rung:int>")
    for k, holds in reversed(list(enumerate(rungs))):
        own = F.get(F.filter(known, holds), F.lit(0))
        found = F.when(own.isNotNull(), F.struct(own["id"].alias("id"), F.lit(k).alias("rung"))).otherwise(found)
    first = asked.withColumn("__f", F.when(q != "", found))
    labels = F.transform(known, lambda c: c["label"])
    left = first.where((q != "") & F.col("__f").isNull()).withColumn("__r", _ratios(q, labels))
    most = F.array_max("__r")
    alike = F.when(most >= least, F.get(F.transform(known, lambda c: c["id"]), (F.array_position("__r", most) - 1).cast("int")))
    settled = first.where((q == "") | F.col("__f").isNotNull()).select(question, F.col("__f.id").alias("match"), F.col("__f.rung").alias("rung"))
    return settled.unionByName(left.select(question, alike.alias("match"), F.when(alike.isNotNull(), F.lit(len(rungs))).alias("rung")))


def resolve_label(text: Column) -> Column:
    """The label of a text: a canonical name or alias, else the first label whose id or name the text contains; null without one."""
    low = F.lower(clean(text))
    out = F.lit(None).cast("string")
    for i, name in reversed(LABELS):
        out = F.when(low.contains(i.lower()) | low.contains(name.lower()), F.lit(i)).otherwise(out)
    return F.when(low != "", F.coalesce(canonical(text), out))


def resolve_ladder(candidates: DataFrame, wanted: str, key: str, label: str) -> DataFrame:
    """The best candidate for one name: equal id, equal label, either contains the other, by that priority, then by key."""
    w = wanted.strip().lower()
    rung = F.when(F.lower(F.col(key).cast("string")) == w, 0).when(F.lower(label) == w, 1).when(F.lower(label).contains(w) | F.lit(w).contains(F.lower(label)), 2)
    return candidates.withColumn("rung", rung).where("rung is not null").orderBy("rung", key).limit(1)
