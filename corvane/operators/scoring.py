"""Rubric scores of ideas and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import bounded_score, prefixes_seen

# Word beginnings that each score counts.
DELIGHT = ["story", "visual", "game", "ritual", "share", "voice"]
NECESSITY = ["agent", "model", "embed", "search", "personal", "speech", "local"]
COMPLEX = ["realtime", "video", "multiplayer", "payments", "social"]
FIT = ["local", "offline", "small", "llama", "fine", "trace", "gradio"]
WEIGHTS = {"originality": 0.30, "delight": 0.20, "ai_necessity": 0.20, "feasibility": 0.15, "goal_fit": 0.15}
NEW_BELOW, ECHO_FROM = 0.16, 0.12


def with_scores(rows: DataFrame, words: Column, top: Column, hits: Column, goals: Column) -> DataFrame:
    """Five scores of 1 to 10, their weighted mean and a verdict. words: array of tokens; top: best affine score; hits: affine scores of the nearest; goals: their number."""
    # The words are gone through once; no beginning is the beginning of another.
    seen = prefixes_seen(words, sorted({*DELIGHT, *NECESSITY, *COMPLEX, *FIT}))
    met = lambda prefixes: F.size(F.array_intersect("__seen", F.array(*map(F.lit, prefixes))))
    scored = rows.withColumn("__seen", seen).select(
        *[F.col(c) for c in rows.columns],
        bounded_score(F.lit(10) - F.bround(top * 18).cast("int")).alias("originality"),
        bounded_score(met(DELIGHT) * 2 + 4).alias("delight"),
        bounded_score(met(NECESSITY) * 2 + 3).alias("ai_necessity"),
        bounded_score(F.lit(8) - met(COMPLEX)).alias("feasibility"),
        bounded_score(met(FIT) * 2 + 4 + F.least(goals, F.lit(3))).alias("goal_fit"),
        F.when(top < NEW_BELOW, F.lit("UNWRITTEN")).otherwise(F.concat(F.lit("ECHO x"), F.size(F.filter(hits, lambda s: s >= ECHO_FROM)).cast("string"))).alias("verdict"),
    )
    return scored.withColumn("overall", overall())


def weighted() -> Column:
    return sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))


def overall() -> Column:
    """The weighted mean, one place."""
    return F.bround(weighted(), 1)


def aligned(rows: DataFrame, gap: Column) -> DataFrame:
    """A clear gap (0.70 or more) makes an idea original (8 at least) and unwritten."""
    clear = gap >= 0.70
    return rows.withColumn("originality", F.when(clear, F.greatest("originality", F.lit(8))).otherwise(F.col("originality"))).withColumn("verdict", F.when(clear, F.lit("UNWRITTEN")).otherwise(F.col("verdict"))).withColumn("overall", overall())


def ranked(rows: DataFrame, title: str, limit: int) -> DataFrame:
    """By overall, originality, ai_necessity and folded title, all falling."""
    return rows.orderBy(F.desc("overall"), F.desc("originality"), F.desc("ai_necessity"), F.desc(F.lower(title))).limit(max(1, limit))
