"""Publication of session logs: allowed fields by type of record, redaction, caps, privacy filter, and counts.

A payload is a JSON object of any shape and depth. An expression on variants walks LEVELS levels of it; what lies below is cut
out as rows of their own and walked in the next round, until nothing is left, and put back from the last round to the first.
Tables without such payloads, which one scan tells, need no second round. Nothing is left out for its depth. The walk
puts marks in the place of texts and of what it cuts out, which no JSON text can hold, and fills them in again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let, redact_spans, redacted, redaction_label, truncated
from corvane.operators.etl import session_stats
from corvane.sources.work import written

# Fields that a record of each type may keep, kinds of items that may stay, and keys whose strings are texts.
KEEP = {
    "session_meta": "id timestamp cwd originator cli_version source thread_source model_provider memory_mode git".split(),
    "turn_context": "turn_id cwd workspace_roots current_date timezone model personality effort summary realtime_active collaboration_mode".split(),
    "event_msg": "type turn_id started_at model_context_window collaboration_mode_kind phase message images local_images text_elements".split(),
    "response_item": "type name arguments input output call_id status action".split(),
}
ITEMS = "function_call function_call_output custom_tool_call custom_tool_call_output web_search_call image_generation_call image_generation_call_output".split()
TEXT_KEYS = "arguments content images input local_images message output queries query summary text text_elements".split()
CAPS = {"message": 4000, "tool_argument": 2000, "tool_output": 120, "other": 1000}
CHUNK, OVERLAP, CALL = 12_000, 256, 32
#: Where a text goes, and where what lies deeper goes: control characters, which JSON only has escaped.
MARK, BELOW = "\x01", "\x02"
#: The analyzer resolves an expression level by level, a hundred steps at most.
LEVELS = 6
SPAN = "struct<begin:int,end:int,label:string,score:double>"
#: What finds private spans: texts to spans of each, as (begin, end, label, score).
Finder = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def depth(json: Column) -> Column:
    """How deep objects and lists are nested in a JSON text; 0 for a plain value and for null."""
    # Without escapes no string holds a quote, and without strings every bracket counts.
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(json, F.lit("")), r"\\.", ""), '"[^"]*"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"([\[\]{}])"), F.lit(1)), lambda b: F.when(b.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")))["most"]


_DEEP = "array<struct<key:string,listed:boolean,json:string>>"


def _node(json: Column, texts: Column, cut: Column, omitted: Column, deep: Column | None = None) -> Column:
    deep = F.array().cast(_DEEP) if deep is None else deep
    return F.struct(json.alias("json"), texts.alias("texts"), cut.cast("long").alias("cut"), omitted.cast("long").alias("omitted"), deep.alias("deep"))


def _joined(nodes: Column, is_list: Column) -> Column:
    """One node of several (key, node): a list, or an object."""
    total = lambda name: F.aggregate(nodes, F.lit(0).cast("long"), lambda s, n: s + n["node"][name])
    every = lambda name: F.flatten(F.transform(nodes, lambda n: n["node"][name]))
    parts = F.transform(nodes, lambda n: F.when(n["key"].isNull(), n["node"]["json"]).otherwise(F.concat(quoted(n["key"]), F.lit(":"), n["node"]["json"])))
    begin, end = F.when(is_list, "[").otherwise("{"), F.when(is_list, "]").otherwise("}")
    return _node(F.concat(begin, F.array_join(parts, ","), end), every("texts"), total("cut"), total("omitted"), every("deep"))


def walked(value: Column, key: Column, cap: Callable[[Column], Column], roots: tuple[tuple[str, str], ...], levels: int = LEVELS, listed: Column | None = None) -> Column:
    """A variant as a struct (json, texts, cut, omitted, deep): its JSON with strings redacted and, under text keys, capped;
    texts are taken out of it in their order and marked by MARK, objects and lists below `levels` levels by BELOW, with the key
    they lie under. Strings in a list under a text key are texts too, but aren't cut; a list within a list has the key of the outer one."""
    listed = F.lit(False) if listed is None else listed
    kind, zero, none = F.schema_of_variant(value), F.lit(0), F.array().cast("array<string>")
    is_list, is_object, is_text = kind.startswith("ARRAY"), kind.startswith("OBJECT"), key.isin(TEXT_KEYS)

    def string(short: Column) -> Column:
        return _node(F.when(is_text, F.lit(MARK)).otherwise(quoted(short["text"])), F.when(is_text, F.array(short["text"])).otherwise(none), (short["omitted"] > 0).cast("int"), short["omitted"])

    # A cap of 0 cuts nothing.
    limit = F.when(is_text & ~listed, cap(key)).otherwise(0)
    out = F.when(kind == "STRING", let(redacted(value.cast("string"), roots), lambda text: let(truncated(text, limit), string)))
    if levels:
        child = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
        items = F.when(is_list, F.transform(value.cast("array<variant>"), lambda v: child(F.lit(None).cast("string"), v)))
        items = items.when(is_object, F.transform(F.map_entries(value.cast("map<string,variant>")), lambda e: child(e["key"], e["value"])))
        nodes = F.transform(items, lambda c: F.struct(c["key"].alias("key"), walked(c["value"], F.coalesce(c["key"], key), cap, roots, levels - 1, c["key"].isNull()).alias("node")))
        out = out.when(is_list | is_object, let(nodes, lambda x: _joined(x, is_list)))
    else:
        below = F.array(F.struct(key.alias("key"), listed.alias("listed"), F.to_json(value).alias("json")))
        out = out.when(is_list | is_object, _node(F.lit(BELOW), none, zero, zero, below))
    return out.otherwise(_node(F.to_json(value), none, zero, zero))


def _put_back(node: Column, below: Column) -> Column:
    """A node with the walked nodes of what was cut out of it, in their order."""
    parts = F.split(node["json"], BELOW, -1)
    texts_in = lambda p: F.length(p) - F.length(F.replace(p, F.lit(MARK), F.lit("")))
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, p: s + texts_in(p))
    none = F.array().cast("array<string>")
    json = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(below, i)["json"], F.lit("")))), "")
    texts = F.flatten(F.transform(parts, lambda p, i: F.concat(F.slice(node["texts"], before(i) + 1, texts_in(p)), F.coalesce(F.get(below, i)["texts"], none))))
    total = lambda name: node[name] + F.aggregate(below, F.lit(0).cast("long"), lambda s, n: s + n[name])
    return F.when(F.size(node["deep"]) > 0, _node(json, texts, total("cut"), total("omitted"))).otherwise(node)


def _deeper(rows: DataFrame, cap, roots: tuple[tuple[str, str], ...]) -> DataFrame:
    """rows with a column __node, __kind and __item, the nodes made whole: round by round what was cut out is walked, and then put back."""
    rounds = [written(rows.withColumn("__id", F.monotonically_increasing_id()), "walked")]
    while not rounds[-1].where(F.size("__node.deep") > 0).isEmpty():
        cut = rounds[-1].select(F.col("__id").alias("__of"), "__kind", "__item", F.posexplode("__node.deep").alias("__pos", "__d"))
        node = walked(F.parse_json("__d.json"), F.col("__d.key"), cap, roots, LEVELS, F.col("__d.listed"))
        rounds.append(written(cut.select("__of", "__pos", "__kind", "__item", node.alias("__node")).withColumn("__id", F.monotonically_increasing_id()), "walked"))
    whole = rounds.pop()
    while rounds:
        below = whole.groupBy("__of").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__node"))), lambda x: x["__node"]).alias("__below")).withColumnRenamed("__of", "__id")
        joined = rounds.pop().join(below, "__id", "left")
        whole = joined.withColumn("__node", F.when(F.col("__below").isNull(), F.col("__node")).otherwise(_put_back(F.col("__node"), F.col("__below")))).drop("__below")
    return whole.drop("__id")


def filled(json: Column, texts: Column) -> Column:
    """JSON with its marks replaced by the texts in their order."""
    parts = F.split(json, MARK, -1)
    return let(parts, lambda p: F.concat(F.get(p, 0), F.array_join(F.zip_with(texts, F.slice(p, F.lit(2), F.size(p) - 1), lambda t, rest: F.concat(quoted(t), rest)), "")))


def span_finder(find: Finder, call: int = CALL):
    """A pandas UDF from an array of texts to an array of spans for each, which gives `find` at most `call` texts at a time."""

    def run(rows: pd.Series) -> pd.Series:
        own = [list(r) if r is not None else [] for r in rows]
        flat = [x or "" for r in own for x in r]
        spans = [s for at in range(0, len(flat), call) for s in find(flat[at : at + call])]
        out, at = [], 0
        for r in own:
            out.append([[{"begin": int(b), "end": int(e), "label": str(label), "score": float(score)} for b, e, label, score in s] for s in spans[at : at + len(r)]])
            at += len(r)
        return pd.Series(out)

    # Once written as a column, it stays one: the finder isn't asked again where the column is used again.
    return F.pandas_udf(run, f"array<array<{SPAN}>>").asNondeterministic()


def with_filtered(rows: DataFrame, texts: Column, out: str, finder, least: float = 0.5, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows with a column `out`, for an array of texts an array of structs (text, labels): each text with its
    private spans replaced by [LABEL], and how often each label occurs.

    Long texts go to the finder in pieces of `chunk` characters and the `overlap` that follow, so that a span over a cut is seen
    whole; spans move back to their place in the text, and what overlaps or touches is one. Spans that end before they begin are dropped."""
    starts = F.transform(texts, lambda t: F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(chunk)))
    places = F.flatten(F.transform(starts, lambda s, k: F.transform(s, lambda at: F.struct(k.alias("of"), at.alias("at")))))
    pieces = F.transform("__places", lambda p: F.substring(F.get("__texts", p["of"]), p["at"] + 1, F.lit(chunk + overlap)))
    asked = rows.withColumn("__texts", texts).withColumn("__places", places).withColumn("__found", finder(pieces))
    moved = F.flatten(F.zip_with("__found", "__places", lambda spans, p: F.transform(F.filter(spans, lambda s: s["begin"] < s["end"]), lambda s: F.struct(p["of"].alias("of"), (s["begin"] + p["at"]).alias("begin"), (s["end"] + p["at"]).alias("end"), redaction_label(s["label"]).alias("label"), s["score"].alias("score")))))
    own = lambda k: F.transform(F.filter("__moved", lambda s: s["of"] == k), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score")))
    safe = F.transform("__texts", lambda t, k: redact_spans(t, own(k), least))
    return asked.withColumn("__moved", moved).withColumn(out, safe).drop("__texts", "__places", "__found", "__moved")


def label_counts(results: Column) -> Column:
    """The maps of labels of several texts as one, in the order of the labels."""
    every = F.flatten(F.transform(results, lambda r: F.map_entries(r["labels"])))
    names = F.array_sort(F.array_distinct(F.transform(every, lambda e: e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.aggregate(F.filter(every, lambda e: e["key"] == n), F.lit(0), lambda s, e: s + e["value"])))


def public_records(rows: DataFrame, kind: str, payload: str, roots: tuple[tuple[str, str], ...] = (), caps: dict[str, int] = CAPS, finder=None, least: float = 0.5) -> DataFrame:
    """Rows with `public` (JSON of the allowed fields; null where a record is dropped), `texts`, `cut`, `omitted`,
    and, if a finder is given (see span_finder), `private`, a map of labels to how often they were replaced.

    In this order: strings are redacted, texts are cut to their caps, and private spans in texts are replaced. Payloads that
    aren't objects, unknown types, and items that aren't calls are dropped. One pass over the payloads finds how deep they go."""
    levels = rows.agg(F.coalesce(F.max(depth(F.col(payload))), F.lit(0))).first()[0]
    tree = F.try_parse_json(payload)
    whole = F.when(F.schema_of_variant(tree).startswith("OBJECT"), tree.cast("map<string,variant>"))
    item = F.try_variant_get(tree, "$.type", "string")
    keep = F.lit(None).cast("array<string>")
    for name, fields in KEEP.items():
        keep = F.when(F.col(kind) == name, F.array(*map(F.lit, fields))).otherwise(keep)
    keep = F.when((F.col(kind) != "response_item") | item.isin(ITEMS), keep)

    def cap(key: Column) -> Column:
        of, own = F.col("__kind"), F.col("__item")
        rule = F.when((of == "event_msg") & (key == "message"), caps["message"])
        rule = rule.when(own.isin("function_call_output", "custom_tool_call_output") & (key == "output"), caps["tool_output"])
        return rule.when(own.isin("function_call", "custom_tool_call") & key.isin("arguments", "input"), caps["tool_argument"]).otherwise(caps["other"])

    # Of a turn's mode only the mode itself is public, and nothing if there is none.
    is_mode = lambda k: (F.col(kind) == "turn_context") & (k == "collaboration_mode")
    mode_of = lambda v: F.try_variant_get(v, "$.mode", "variant")
    mode = lambda k, v: F.when(is_mode(k), F.parse_json(F.concat(F.lit('{"mode":'), F.to_json(mode_of(v)), F.lit("}")))).otherwise(v)
    kept = F.map_filter(whole, lambda k, v: F.array_contains(keep, k) & (~is_mode(k) | mode_of(v).isNotNull()))
    # A message without a type says so.
    kept = F.when((F.col(kind) == "event_msg") & ~F.map_contains_key(kept, "type"), F.map_concat(kept, F.create_map(F.lit("type"), F.parse_json(F.lit("null"))))).otherwise(kept)
    public = F.when(keep.isNotNull() & whole.isNotNull(), F.parse_json(F.to_json(F.transform_values(kept, mode))))
    tagged = rows.withColumn("__kind", F.col(kind)).withColumn("__item", item).withColumn("__public", public)
    node = walked(F.col("__public"), F.lit(""), cap, roots, min(LEVELS, levels))
    out = tagged.withColumn("__node", F.when(F.col("__public").isNotNull(), node)).drop("__public")
    if levels > LEVELS:
        out = _deeper(out, cap, roots)
    zero = lambda name: F.coalesce(F.col(f"__node.{name}"), F.lit(0)).alias(name)
    texts, more = F.col("__node.texts"), []
    if finder is not None:
        out = with_filtered(out, F.coalesce(texts, F.array().cast("array<string>")), "__safe", finder, least)
        texts, more = F.transform("__safe", lambda r: r["text"]), [label_counts(F.col("__safe")).alias("private")]
    shown = F.when(F.col("__node").isNotNull(), filled(F.col("__node.json"), texts))
    return out.select(*[F.col(c) for c in rows.columns], shown.alias("public"), F.coalesce(F.size("__node.texts").cast("long"), F.lit(0).cast("long")).alias("texts"), zero("cut"), zero("omitted"), *more)


def merged_counts(rows: DataFrame, key: str, counts: str) -> DataFrame:
    """The maps of counts of each key added up, as a map in the order of its names."""
    sums = rows.select(key, F.explode(counts).alias("label", "n")).groupBy(key, "label").agg(F.sum("n").alias("n"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias(counts))


def manifest(records: DataFrame, session: str) -> DataFrame:
    """K5: one row of totals of public_records(): sessions, records read, published and dropped, texts, and what was cut."""
    return records.agg(
        F.count_distinct(session).alias("sessions"),
        F.count(F.lit(1)).alias("records"),
        F.count("public").alias("published"),
        F.count_if(F.col("public").isNull()).alias("dropped"),
        F.sum("texts").alias("texts"),
        F.sum("cut").alias("truncated_fields"),
        F.sum("omitted").alias("omitted_chars"),
    )


def session_totals(records: DataFrame, session: str, order: str, at: str) -> DataFrame:
    """A13, A24 of public_records(): a row for each session, with its records, its first and last time seen, its texts and what was cut."""
    stats = session_stats(records, session, order, at, F.col("public").isNotNull())
    sums = records.groupBy(session).agg(F.sum("texts").alias("texts"), F.sum("cut").alias("truncated_fields"), F.sum("omitted").alias("omitted_chars"))
    return stats.join(sums, session)


def write_dataset(records: DataFrame, path: str, session: str, index: str, at: str, kind: str, version: int = 1) -> dict:
    """K5: the published records as JSON lines under path/records, and beside them path/manifest, one JSON object with the totals, which it
    returns. Lines hold schema_version, session_id, record_index, timestamp, type and the public payload. An existing dataset is an error."""
    whole = written(records, "records")
    line = F.concat(
        F.lit(f'{{"schema_version":{version},"session_id":'), quoted(F.col(session)), F.lit(',"record_index":'), F.col(index).cast("string"), F.lit(',"timestamp":'),
        F.coalesce(quoted(F.col(at)), F.lit("null")), F.lit(',"type":'), quoted(F.col(kind)), F.lit(',"payload":'), F.col("public"), F.lit("}"),
    )
    whole.where("public IS NOT NULL").select(line.alias("value")).write.mode("errorifexists").text(f"{path}/records")
    totals = manifest(whole, session).withColumn("schema_version", F.lit(version))
    totals.select(F.to_json(F.struct(*sorted(totals.columns))).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return totals.first().asDict()
