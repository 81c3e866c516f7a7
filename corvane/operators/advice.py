"""Plans, goals, context lines, digests of results and the dots of an idea's map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import scatter, short_value
from corvane.operators.exports import background_dots, echo_radius

# Keys that a digest leaves out, and the fields of a profile in the order in which they shape a plan.
DROPPED = ("url", "id", "score", "host", "quest_ids")
PROFILE_STEPS = (
    ("time", "Scope the first prototype to {}; cut anything that cannot fit that window."),
    ("skills", "Use your {} strength for the first working surface before adding new tooling."),
    ("constraints", "Test the constraint early: {}. Do this before polishing the artifact."),
    ("preferences", "Shape the demo around {} so the result feels intentional, not generic."),
)
PLAN_STEPS = (
    "Lock a one-sentence promise and one test input that proves what is different.",
    "Compare against the nearest echoes, then sharpen the part only this idea can own.",
    "Build the smallest happy path: input, nearby project citations, score, and one shareable output.",
    "Add one selected-goal feature only after the core loop is smooth enough to explain without narration.",
    "Write build notes from the exact decisions, screenshots, and outputs.",
)
TUNING_STEP = "Collect successful advisor examples before training a tiny LoRA."
PALE_CAPTION = "Your page sits in a pale margin beyond the nearest inked clusters."
NEAR_CAPTION = "Your page is pressed close to {}; the red dots are the strongest echoes."
IDEA_RADIUS = 8


def wanted_goals(goals: Column, known: tuple[str, ...], default: Column | None = None) -> Column:
    """The known ones of a list of goals, each once, in its order; the default where there is no list."""
    kept = F.array_distinct(F.filter(goals, lambda g: g.isin(*known)))
    none = F.array().cast("array<string>")
    return F.coalesce(kept, none if default is None else default)


def labelled_goals(goals: Column, labels: dict[str, str]) -> Column:
    """The labels of goals; a goal without one stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.transform(goals, lambda g: F.coalesce(F.try_element_at(names, g), g))


def profile_steps(profile: Column, steps: tuple[tuple[str, str], ...] = PROFILE_STEPS) -> Column:
    """The steps that a profile (map of strings) adds to a plan, in the order of the steps; blank fields add none."""
    made = []
    for field, text in steps:
        value = short_value(F.try_element_at(profile, F.lit(field)))
        before, after = text.split("{}")
        made.append(F.when(value != "", F.concat(F.lit(before), value, F.lit(after))))
    return F.array_compact(F.array(*made))


def plan(steps: Column, profile: Column, goals: Column, at: int = 1) -> Column:
    """A plan with its profile's steps put in behind the first `at` ones, and, where a goal is to be well tuned, the step that
    collects examples before the last one."""
    none = F.create_map().cast("map<string,string>")
    tuned = F.exists(F.coalesce(goals, F.array().cast("array<string>")), lambda g: g.contains("Well"))
    rest = F.slice(steps, F.lit(at + 1), F.greatest(F.size(steps) - at, F.lit(0)))
    kept = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))
    more = F.when(tuned, F.array(F.lit(TUNING_STEP))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(steps, 1, at), profile_steps(F.coalesce(profile, none)), kept, more, F.slice(rest, F.greatest(F.size(rest), F.lit(1)), F.lit(1)))


def context_lines(rows: Column, line, most: int = 3) -> Column:
    """C17: the last `most` items of an array as lines, `- empty` where there are none."""
    last = F.slice(rows, F.greatest(F.lit(1), F.size(rows) - most + 1), most)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) == 0, F.lit("- empty")).otherwise(F.array_join(F.transform(last, lambda r: F.concat(F.lit("- "), line(r))), "\n"))


def digest_lines(value: Column, levels: int = 4, indent: int = 0) -> Column:
    """A variant object as lines of `key: value`, strings in quotes, DROPPED keys left out at every level; objects and lists
    below a key are indented, and an object in a list is one line of its plain values. Deeper than `levels` a value is its JSON."""
    pad = "  " * indent

    def plain(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(kind == "STRING", F.concat(F.lit('"'), v.cast("string"), F.lit('"'))).when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(F.to_json(v))).otherwise(F.to_json(v))

    def is_nested(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return kind.startswith("OBJECT") | kind.startswith("ARRAY")

    def entries(v: Column) -> Column:
        return F.filter(F.map_entries(v.cast("map<string,variant>")), lambda e: ~e["key"].isin(*DROPPED))

    def item(v: Column) -> Column:
        flat = F.transform(F.filter(entries(v), lambda e: ~is_nested(e["value"])), lambda e: F.concat(e["key"], F.lit(": "), plain(e["value"])))
        return F.concat(F.lit(f"{pad}- "), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array_join(flat, ", ")).otherwise(plain(v)))

    def field(e: Column) -> Column:
        below = digest_lines(e["value"], levels - 1, indent + 1) if levels > 1 else F.concat(F.lit(pad + "  "), F.to_json(e["value"]))
        own = F.concat(F.lit(pad), e["key"], F.lit(":"))
        return F.when(is_nested(e["value"]), F.when(below == "", own).otherwise(F.concat(own, F.lit("\n"), below))).otherwise(F.concat(own, F.lit(" "), plain(e["value"])))

    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), F.array_join(F.transform(entries(value), field), "\n"))
        .when(kind.startswith("ARRAY"), F.array_join(F.transform(value.cast("array<variant>"), item), "\n"))
        .otherwise(F.concat(F.lit(pad), plain(value)))
    )


def map_dots(projects: DataFrame, layout: DataFrame, hits: DataFrame, key: str, order: list[Column], idea: tuple[str, str], place: tuple[float, float] | None = None, most: int = 5) -> DataFrame:
    """C11: (kind, item, title, x, y, radius) of an idea's map: background projects (`inked`), the best echoes, and the idea itself.

    projects: key, title; layout: key, x, y, of projects that have a place (others get one by their key); hits: key, score, of which none is
    background; idea: its id and title; place: where it lies, if it has a place. An echo's radius follows its score."""
    best = hits.orderBy(F.desc("score"), key).limit(most)
    back = background_dots(projects, hits, key, order).select(key, F.lit("inked").alias("kind"), F.lit(None).cast("double").alias("score"))
    dots = back.unionByName(best.select(key, F.lit("echo").alias("kind"), F.col("score").cast("double").alias("score")))
    by_key = scatter(F.col(key).cast("string"))
    joined = dots.join(projects.select(key, "title"), key).join(layout.select(key, "x", "y"), key, "left")
    shown = joined.select("kind", F.col(key).cast("string").alias("item"), F.col("title"), F.coalesce("x", by_key["x"]).cast("int").alias("x"), F.coalesce("y", by_key["y"]).cast("int").alias("y"), F.when(F.col("kind") == "echo", echo_radius(F.col("score"))).otherwise(3).alias("radius"))
    own = scatter(F.lit(f"idea:{idea[0]}:{idea[1]}"))
    x, y = (own["x"], own["y"]) if place is None else map(F.lit, place)
    mark = projects.sparkSession.range(1).select(F.lit("idea").alias("kind"), F.lit(idea[0]).alias("item"), F.lit(idea[1]).alias("title"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(IDEA_RADIUS).alias("radius"))
    return shown.dropDuplicates(["kind", "item"]).unionByName(mark)


def caption(verdict: Column, titles: Column) -> Column:
    """C11: the line below the map, by the verdict and the titles of the echoes, best first."""
    before, after = NEAR_CAPTION.split("{}")
    names = F.when(F.coalesce(F.size(titles), F.lit(0)) > 0, F.array_join(F.slice(titles, 1, 2), ", ")).otherwise(F.lit("nearby pages"))
    return F.when(verdict.startswith("UNWRITTEN"), F.lit(PALE_CAPTION)).otherwise(F.concat(F.lit(before), names, F.lit(after)))
