"""Training rows of the label classifier: segments, branches of augmentation, invariants, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import clean
from corvane.operators.answers import checked
from corvane.operators.etl import shuffled_split, upweighted

# Sizes of segments, and the patterns of the invariants.
SCHEMA_VERSION = 1
README_CHARS, APP_CHARS, IMPORTS, ASSETS = 3000, 3800, 40, 12
REMOTE = r"(?i)InferenceClient|endpoints\.huggingface|\breplicate\b|\btogether\b|openrouter|gradio_client|\.modal\.run|api\.openai|api\.anthropic|generativeai|cohere\.Client"
OPENBMB = r"(?i)openbmb/|minicpm|opencpm"
IMPORT = r"^\s*(?:import\s+\w|from\s+\w[\w.]*\s+import)\b"
REPO_ID = r"\b[\w-]+/[\w.\-]+\b"
NO_README, NO_APP = "(no README description provided)", "(no app file available)"
#: Variants of rows that are written by hand.
MADE = ("contradiction", "empty", "hard_negative")
NOISE = ("asdf123", "xx", "region:us", "untitled", "draft")


def readme_segment(body: Column) -> Column:
    """White space collapsed, the first README_CHARS characters."""
    return F.left(clean(body), F.lit(README_CHARS))


def app_segment(source: Column, signals: Column) -> Column:
    """P20: distinct import lines first, then the source, cut; repository ids of the signals that the cut lacks follow as ASSETS."""
    text, marks = F.coalesce(source, F.lit("")), F.coalesce(signals, F.lit(""))
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(IMPORT))
    imports = F.slice(F.array_distinct(F.transform(lines, lambda x: F.trim(x))), 1, IMPORTS)
    head = F.left(F.when(F.size(imports) > 0, F.concat(F.array_join(imports, "\n"), F.lit("\n\n"), text)).otherwise(text), F.lit(APP_CHARS))
    ids = F.array_distinct(F.regexp_extract_all(marks, F.lit(f"({REPO_ID})"), F.lit(1)))
    lost = F.slice(F.array_sort(F.filter(ids, lambda i: ~F.contains(head, i))), 1, ASSETS)
    whole = F.when(F.size(lost) > 0, F.concat(head, F.lit("\n\nASSETS: "), F.array_join(lost, ", "))).otherwise(head)
    return F.when((F.trim(text) == "") & (F.trim(marks) == ""), F.lit("")).otherwise(whole)


def completion(matches: Column) -> Column:
    """An array of matches (label, confidence, evidence, source) as the compact JSON that a model is to give, confidence falling, equal ones in their order."""
    placed = F.transform(matches, lambda m, i: F.struct((-m["confidence"]).alias("c"), i.alias("i"), m.alias("m")))
    rows = F.transform(F.array_sort(placed), lambda p: F.struct(p["m"]["label"].alias("quest"), p["m"]["confidence"].alias("confidence"), p["m"]["evidence"].alias("evidence"), p["m"]["source"].alias("source")))
    return F.concat(F.lit('{"matches":'), F.to_json(rows), F.lit("}"))


def labelled_inputs(results: DataFrame, inputs: DataFrame, key: str, covered: DataFrame | None = None) -> DataFrame:
    """Results with their input; those without one, or covered already, are left out."""
    joined = results.join(inputs, key)
    return joined if covered is None else joined.join(covered.select(key), key, "left_anti")


def branches(rows: DataFrame, key: str, app_only: int = 16, readme_only: int = 16, noisy: int = 8, remote: DataFrame | None = None, made: DataFrame | None = None) -> DataFrame:
    """Rows (key, title, tags, readme, app, matches) as they are, and the variants of those richest in matches of a source.

    Ties go to the smaller key. Variants keep the matches of the source that they keep. remote: keys of rows known to call
    remote inference; those that no `app_only` row shows become `remote_app_only`. made: rows written by hand, with a variant
    of their own (`contradiction`, `empty`, `hard_negative`); an empty one has no matches whatever it says.
    """
    own = lambda source: F.filter("matches", lambda m: m["source"] == source)

    def richest(count: Column, most: int) -> DataFrame:
        return rows.withColumn("__n", count).where("__n > 0").orderBy(F.desc("__n"), key).limit(most).drop("__n")

    app = richest(F.size(own("app_file")), app_only).withColumns({"readme": F.lit(NO_README), "matches": own("app_file"), "variant": F.lit("app_only")})
    readme = richest(F.size(own("readme")), readme_only).withColumns({"app": F.lit(NO_APP), "matches": own("readme"), "variant": F.lit("missing_app_file")})
    noise = richest(F.size("matches"), noisy).withColumns({"tags": F.concat("tags", F.array(*map(F.lit, NOISE))), "title": F.concat("title", F.lit(" ::: TODO copy of template (do not read title)")), "variant": F.lit("noisy_metadata")})
    out = rows.withColumn("variant", F.lit("natural")).unionByName(app).unionByName(readme).unionByName(noise)
    if remote is not None:
        left = rows.join(remote.select(key).distinct(), key, "left_semi").join(app.select(key), key, "left_anti")
        out = out.unionByName(left.withColumns({"readme": F.lit(NO_README), "matches": own("app_file"), "variant": F.lit("remote_app_only")}))
    if made is not None:
        known = made.where(F.col("variant").isin(*MADE))
        none = F.filter("matches", lambda m: F.lit(False))
        out = out.unionByName(known.withColumn("matches", F.when(F.col("variant") == "empty", none).otherwise(F.col("matches"))).select(*out.columns))
    return out


def violations(examples: DataFrame, key: str) -> DataFrame:
    """(key, variant, problem) of rows whose labels contradict what they show; `labels.require` turns rows into an error."""
    has = lambda label: F.exists("matches", lambda m: m["label"] == label)
    body = F.concat_ws("\n", "title", F.array_join("tags", ", "), "readme", "app")
    remote = F.when(F.col("app").rlike(REMOTE) & has("Off the Grid"), F.lit("remote inference, yet Off the Grid"))
    foreign = F.when(~body.rlike(OPENBMB) & has("OpenBMB"), F.lit("OpenBMB without a model of its family"))
    return examples.select(key, "variant", F.explode(F.array_compact(F.array(remote, foreign))).alias("problem"))


def manifest(examples: DataFrame, labels: list[str]) -> DataFrame:
    """(what, name, n): rows, empty rows, rows of each variant, and rows of each label, zero included."""
    sizes = examples.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("matches") == 0).alias("empty"))
    totals = sizes.select(F.explode(F.array(F.struct(F.lit("total").alias("what"), F.lit("rows").alias("name"), F.col("rows").alias("n")), F.struct(F.lit("total").alias("what"), F.lit("empty").alias("name"), F.col("empty").alias("n")))).alias("x")).select("x.*")
    variants = examples.groupBy(F.col("variant").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("variant").alias("what"), "name", "n")
    seen = examples.select(F.explode(F.array_distinct(F.transform("matches", lambda m: m["label"]))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    space = examples.sparkSession.createDataFrame([(x,) for x in labels], "name string")
    counts = space.join(seen, "name", "left").select(F.lit("label").alias("what"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    return totals.unionByName(variants).unionByName(counts)


def json_lines(examples: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """(pos, line): the manifest first, then a line for each example by key and variant."""
    first = summary.agg(F.to_json(F.struct(F.lit("lora_sft_manifest").alias("type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "what", "name"), "n")))).alias("counts"))).alias("line"))
    rest = examples.select(key, "variant", F.to_json(F.struct(F.lit("lora_sft_example").alias("type"), key, "variant", F.size("matches").alias("match_count"), completion(F.col("matches")).alias("completion"))).alias("line"))
    return first.select(F.lit(0).alias("pos"), F.lit(None).cast(dict(examples.dtypes)[key]).alias(key), F.lit(None).cast("string").alias("variant"), "line").unionByName(rest.select(F.lit(1).alias("pos"), key, "variant", "line"))


def example_line(prompt: Column, system: str, key: Column, variant: Column, matches: Column, base_model: str, task: str) -> Column:
    """One training example as compact JSON: the three messages of a chat, whose last is what the model is to answer,
    and what the example is about. Labels are listed once each, in alphabetic order."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fields = {
        "type": F.lit("lora_sft_example"), "schema_version": F.lit(SCHEMA_VERSION), "base_model": F.lit(base_model), "adapter_task": F.lit(task), "example_kind": F.lit("quest_classification"),
        "project_id": key.cast("string"), "variant": variant, "match_count": F.size(matches), "quests": F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))),
        "messages": F.array(message("system", F.lit(system)), message("user", prompt), message("assistant", completion(matches))),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def training_file(examples: DataFrame, summary: DataFrame, key: str, line: str, source: str) -> DataFrame:
    """(pos, key, variant, line) of a training file: the manifest with the counts of `manifest`, then each example's line."""
    counts = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("name", "n")))))
    total = lambda name: F.sum(F.when((F.col("what") == "total") & (F.col("name") == name), F.col("n")))
    whole = summary.agg(F.to_json(F.struct(F.lit("lora_sft_manifest").alias("type"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("chat-jsonl").alias("format"), F.lit(source).alias("source"), total("rows").alias("example_count"), total("empty").alias("empty_match_examples"), counts("variant").alias("variant_counts"), counts("label").alias("quest_positive_counts"))).alias("line"))
    kind = dict(examples.dtypes)[key]
    first = whole.select(F.lit(0).alias("pos"), F.lit(None).cast(kind).alias(key), F.lit(None).cast("string").alias("variant"), "line")
    return first.unionByName(examples.select(F.lit(1).alias("pos"), key, "variant", F.col(line).alias("line")))


def file_problems(lines: DataFrame, at: str, line: str) -> DataFrame:
    """(at, problem) of the lines of a training file that are no manifest: lines that aren't examples, have no messages, no
    answer at their end, or an answer without a list of matches that hold."""
    tree = F.try_parse_json(line)
    text = lambda path: F.try_variant_get(tree, path, "string")
    messages = F.try_variant_get(tree, "$.messages", "array<variant>")
    last = F.try_element_at(messages, F.lit(-1))
    answer = F.try_variant_get(last, "$.content", "string")
    problem = (
        F.when(text("$.type") == "lora_sft_manifest", F.lit(None))
        .when(~F.coalesce(text("$.type") == "lora_sft_example", F.lit(False)), F.lit("not an example"))
        .when(F.coalesce(F.size(messages), F.lit(0)) < 2, F.lit("no chat messages"))
        .when((F.coalesce(F.try_variant_get(last, "$.role", "string"), F.lit("")) != "assistant") | (F.coalesce(answer, F.lit("")) == ""), F.lit("no answer of the assistant"))
        .otherwise(checked(answer)["error"])
    )
    return lines.select(at, problem.alias("problem")).where("problem IS NOT NULL")


def split_rows(examples: DataFrame, key: str, variant: str, weights: dict[str, int], holdout: float, seed: int = 13) -> DataFrame:
    """Examples as often as their variants' weights say, with `copy`, and `split`: by the hash of key and seed a share is held
    out, each example with all of its copies on one side."""
    return shuffled_split(upweighted(examples, variant, weights), key, holdout, seed)
