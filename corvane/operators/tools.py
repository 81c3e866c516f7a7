"""Tool calls of a model: parsing, checks against contracts, what to do with broken ones, and routing of messages by rules.

Everything is column expressions. A call is a struct (name, arguments, error), arguments being a variant object.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import clean, let
from corvane.operators.exports import idea
from corvane.operators.publication import quoted


@dataclass(frozen=True)
class Field:
    """An argument: its JSON type, whether it is needed, the values it may have, and the type of a list's items."""

    type: str
    required: bool = False
    enum: tuple[str, ...] = ()
    items: str | None = None


Specs = dict[str, dict[str, Field]]

# The tools of the advisor and of the chat with their arguments.
ADVISOR_TOOLS: Specs = {
    "list_projects": {"track": Field("string"), "sort": Field("string", enum=("likes", "recent", "title"))},
    "search_projects": {"query": Field("string", True)},
    "get_project": {"id": Field("string", True)},
    "find_whitespace": {},
    "save_idea": {"title": Field("string", True), "pitch": Field("string", True)},
    "score_idea": {"id": Field("string")},
    "compare_ideas": {},
    "make_plan": {"id": Field("string")},
    "update_profile": {"field": Field("string", True, ("skills", "time", "preferences", "constraints")), "value": Field("string", True)},
    "set_goals": {"goals": Field("array", True, items="string")},
}
# Phrases that choose a tool, the first rule that fits counts.
LISTING_WORDS = ("projects", "spaces", "current map", "project map")
LISTING_PREFIXES = ("list projects", "list spaces", "show projects", "show spaces", "show current map", "show project map", "open current map", "browse projects", "browse spaces")
READING_PREFIXES = ("read project ", "open project ", "show project ", "read space ", "open space ", "show space ")
COMMANDS = {
    "compare_ideas": ("compare", "compare ideas", "choose", "rank", "rank ideas"),
    "make_plan": ("plan", "make a plan", "make a build plan", "draft a plan", "draft a build plan", "build plan", "roadmap", "next step", "milestone"),
    "find_whitespace": ("gap", "find gap", "find a gap", "find whitespace", "write bolder", "bolder", "unwritten", "make it more original", "new direction"),
    "search_projects": ("search", "search for", "find similar", "similar", "is this already", "already built", "check overlap", "overlap", "show echoes", "echo"),
}
DETAIL = ("what is in", "what's in", "inside", "show me the", "tell me about", "about the")
LEADERS = ("leaderboard", "most quest", "who completed", "top project", "top team", "winning")
CLUSTERS = ("cluster", "theme", "group", "region")
QUESTS = ("quest", "badge", "challenge")
RECENT = ("recent", "latest", "newest", "just updated", "activity")
OVERVIEW = ("overview", "everyone building", "everyone doing", "whole field", "summary of the", "most liked", "most popular", "coolest", "best project", "favorite project")
INSIDE = ("readme", "app file", "source code", "how does", "how is", "what does", "built with")
SEARCHES = ("find ", "search", "looking for", "projects about", "projects on", "show me", "anything about", "who is building", "how many", "number of", "count of", "is there a", "are there any")
SMALLTALK = ("hi", "hello", "hey", "yo", "thanks", "thank you", "ok", "okay", "cool", "nice", "bye", "goodbye", "why", "really", "are you sure", "who are you", "what are you", "what can you do", "how do you work", "help")

_BLOCK = r"(?s)<function\b([^>]*)>(.*?)</function>"


def _unescaped(text: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def _name(attributes: Column) -> Column:
    return F.trim(_unescaped(F.coalesce(F.nullif(F.regexp_extract(attributes, r'\bname="([^"]*)"', 1), F.lit("")), F.regexp_extract(attributes, r"\bname='([^']*)'", 1))))


def _call(name: Column, arguments: Column, error: Column) -> Column:
    bad = error.isNotNull()
    return F.struct(F.when(~bad, name).alias("name"), F.when(~bad, arguments).alias("arguments"), error.alias("error"))


def normalized_output(output: Column) -> Column:
    """An opening that the model left out, and an end that it didn't reach, put back."""
    text = F.trim(output)
    text = F.when(text.startswith('name="'), F.concat(F.lit("<function "), text)).otherwise(text)
    return F.when(text.startswith("<function ") & ~text.endswith("</function>"), F.concat(text, F.lit("</function>"))).otherwise(text)


def without_calls(text: Column) -> Column:
    """The text without its calls."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<function\b.*?</function>", ""))


def json_call(output: Column) -> Column:
    """The one `<function name="...">{...}</function>` of an output, its arguments as JSON. What is no call has an error."""
    text = F.trim(F.coalesce(output, F.lit("")))
    blocks = F.regexp_count(text, F.lit(_BLOCK))
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)<function\b[^>]*/>", ""), _BLOCK, "")
    # Between calls there may be text and whole elements of other kinds.
    broken = F.regexp_replace(rest, r"(?s)<(\w+)[^<>]*(?:/>|>[^<>]*</\1>)", "").rlike("[<>]") | F.regexp_extract(text, _BLOCK, 2).rlike("<")
    name = _name(F.regexp_extract(text, _BLOCK, 1))
    raw = F.trim(_unescaped(F.regexp_extract(text, _BLOCK, 2)))
    arguments = F.try_parse_json(F.when(raw == "", F.lit("{}")).otherwise(raw))
    error = (
        F.when(broken, F.lit("invalid XML tool call"))
        .when(blocks != 1, F.concat(F.lit("expected exactly one function call, got "), blocks.cast("string")))
        .when(name == "", F.lit("function call is missing a name"))
        .when(arguments.isNull(), F.lit("function arguments are not valid JSON"))
        .when(~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("function arguments must be a JSON object"))
    )
    return _call(name, arguments, error)


def native_call(output: Column) -> Column:
    """The first `<function>` of a text with its `<param name="...">` values, as strings; text around it is passed over."""
    text = F.coalesce(output, F.lit(""))
    param = r"(?s)<param\b([^>]*)>(.*?)</param>"
    name, body = _name(F.regexp_extract(text, _BLOCK, 1)), F.regexp_extract(text, _BLOCK, 2)
    heads, values = (F.regexp_extract_all(body, F.lit(param), F.lit(i)) for i in (1, 2))
    names = F.transform(heads, _name)
    pairs = F.map_from_entries(F.zip_with(names, F.transform(values, lambda v: F.trim(_unescaped(F.regexp_replace(v, "<[^>]*>", "")))), lambda n, v: F.struct(n, v)))
    other = F.regexp_extract(F.regexp_replace(body, param, ""), r"<(\w+)", 1)
    error = (
        F.when(~text.rlike(_BLOCK), F.lit("no <function> call found in model output"))
        .when(name == "", F.lit("function call is missing a name"))
        .when(other != "", F.concat(F.lit("unexpected element <"), other, F.lit("> in function call")))
        .when(F.array_contains(names, ""), F.lit("param is missing a name"))
        .when(F.size(F.array_distinct(names)) < F.size(names), F.lit("param is given twice"))
    )
    return _call(name, F.parse_json(F.to_json(F.when(error.isNull(), pairs))), error)


def _is(value: Column, type_: str) -> Column:
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return {
        "string": kind == "STRING",
        "integer": numeric & F.to_json(value).rlike("^-?[0-9]+$"),
        "number": numeric,
        "boolean": kind == "BOOLEAN",
        "array": kind.startswith("ARRAY"),
        "object": kind.startswith("OBJECT"),
    }[type_]


def _argument_errors(tool: str, name: str, field: Field, value: Column) -> Column:
    """What is wrong with an argument that is there: its type, else its value, else its items."""
    where = f"{tool}.{name}"
    none = F.array().cast("array<string>")
    wrong = F.when(~_is(value, field.type), F.array(F.lit(f"{where} must be {field.type}")))
    if field.enum:
        wrong = wrong.when(~value.cast("string").isin(*field.enum), F.array(F.lit(f"{where} must be one of: {', '.join(field.enum)}")))
    if field.items:
        items = F.transform(value.cast("array<variant>"), lambda v, i: F.when(~_is(v, field.items), F.concat(F.lit(f"{where}["), i.cast("string"), F.lit(f"] must be {field.items}"))))
        wrong = wrong.when(_is(value, "array"), F.array_compact(items))
    return wrong.otherwise(none)


def violations(call: Column, specs: Specs = ADVISOR_TOOLS) -> Column:
    """What is wrong with a call, none for a good one: its parse error, else an unknown tool, else arguments that the tool
    doesn't have, needed ones that lack, and ones of a wrong type, value or item, in the order of their names."""
    name = call["name"]
    given = F.coalesce(call["arguments"].cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    none = F.array().cast("array<string>")
    names = lambda values: F.array(*map(F.lit, values)) if values else none
    listed = lambda text, found: F.when(F.size(found) > 0, F.array(F.concat(F.lit(text), F.array_join(F.array_sort(found), ", ")))).otherwise(none)

    def of(tool: str, fields: dict[str, Field]) -> Column:
        keys = F.map_keys(given)
        parts = [listed(f"unexpected arguments for {tool}: ", F.array_except(keys, names(sorted(fields)))), listed(f"missing required arguments for {tool}: ", F.array_except(names(sorted(n for n, f in fields.items() if f.required)), keys))]
        parts += [F.when(F.map_contains_key(given, n), _argument_errors(tool, n, f, F.try_element_at(given, F.lit(n)))).otherwise(none) for n, f in sorted(fields.items())]
        return F.concat(*parts)

    out = F.array(F.concat(F.lit("unknown tool: "), name))
    for tool, fields in specs.items():
        out = F.when(name == tool, of(tool, fields)).otherwise(out)
    return F.when(call["error"].isNotNull(), F.array(call["error"])).otherwise(out)


def _resolution(status: str | Column, name: str | Column, arguments: Column, errors: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(status).alias("status"), text(name).cast("string").alias("name"), arguments.alias("arguments"), errors.alias("errors"))


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def resolved(call: Column, query: Column, specs: Specs = ADVISOR_TOOLS) -> Column:
    """(status, name, arguments as JSON, errors): a good call as it is (`valid`); else a search for the query, and without a
    query a look for gaps (`defaulted`)."""
    text = F.trim(F.coalesce(query, F.lit("")))
    none = F.array().cast("array<string>")
    return let(violations(call, specs), lambda errors: F.when(F.size(errors) == 0, _resolution("valid", call["name"], F.to_json(call["arguments"]), none)).when(text != "", _resolution("defaulted", "search_projects", _json(query=text), errors)).otherwise(_resolution("defaulted", "find_whitespace", F.lit("{}"), errors)))


def chat_resolved(output: Column, message: Column, specs: Specs) -> Column:
    """X8 of the chat: no call (`none`), a good one (`valid`), or what the message's own words ask for (`defaulted`)."""
    none = F.array().cast("array<string>")
    call = native_call(output)
    own = chat_route(message)
    return F.when(~F.coalesce(output, F.lit("")).rlike(r"<function\b"), _resolution("none", F.lit(None), F.lit(None).cast("string"), none)).otherwise(
        let(violations(call, specs), lambda errors: F.when(F.size(errors) == 0, _resolution("valid", call["name"], F.to_json(call["arguments"]), none)).otherwise(_resolution("defaulted", own["name"], own["arguments"], errors)))
    )


def mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    """the text holds one of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def is_command(text: Column, phrases: tuple[str, ...]) -> Column:
    """the text is one of the phrases or goes on after it."""
    found = text.isin(*phrases)
    for p in phrases:
        found = found | text.startswith(f"{p} ")
    return found


def wants_listing(text: Column) -> Column:
    """F13."""
    found = text.isin(*LISTING_WORDS)
    for p in LISTING_PREFIXES:
        found = found | text.startswith(p)
    return found


def is_smalltalk(message: Column) -> Column:
    """greetings, questions about the assistant, and nothing at all."""
    text = F.rtrim(F.lower(clean(message)), F.lit(".!?"))
    return (text == "") | is_command(text, SMALLTALK)


def reference_id(text: Column, site: str = r"^https?://[^/\s]+/spaces/") -> Column:
    """The first word behind `read project` and its like, without the site's address and punctuation at its ends; empty without such a beginning."""
    raw, low = F.lit(""), F.lower(text)
    for p in reversed(READING_PREFIXES):
        raw = F.when(low.startswith(p), F.trim(F.substring(text, len(p) + 1, 2**31 - 1))).otherwise(raw)
    word = F.get(F.split(F.regexp_replace(raw, f"(?i){site}", ""), r"\s+"), 0)
    return F.btrim(word, F.lit(".,;:!?\"'"))


def _first(rules: list[tuple[Column, str, Column]], name: Column, arguments: Column) -> Column:
    """The call of the first rule (condition, tool, arguments) that holds, else the one given."""
    out = F.struct(name.alias("name"), arguments.alias("arguments"))
    for holds, tool, given in reversed(rules):
        out = F.when(holds, F.struct(F.lit(tool).alias("name"), given.alias("arguments"))).otherwise(out)
    return out


def advisor_route(message: Column) -> Column:
    """(name, arguments as JSON) of the tool that a message asks for, by the first rule that fits; else it is an idea to save."""
    empty, likes = F.lit("{}"), F.lit('{"sort":"likes"}')

    def of(x: Column) -> Column:
        arguments = {"search_projects": _json(query=x["text"])}
        rules = [(x["text"] == "", "list_projects", likes), (wants_listing(x["low"]), "list_projects", likes), (x["known"] != "", "get_project", _json(id=x["known"]))]
        rules += [(is_command(x["low"], phrases), tool, arguments.get(tool, empty)) for tool, phrases in COMMANDS.items()]
        return _first(rules, F.lit("save_idea"), _json(title=x["page"]["title"], pitch=x["page"]["pitch"]))

    return let(clean(message), lambda text: let(F.struct(text.alias("text"), F.lower(text).alias("low"), reference_id(text).alias("known"), idea(text).alias("page")), of))


def chat_intent(message: Column) -> Column:
    """(name, arguments as JSON) of the data that a message clearly asks for; name is null where it doesn't."""
    text = clean(message)
    low, empty = F.lower(text), F.lit("{}")
    says = lambda *phrases: mentions(low, phrases)
    detail = says(*DETAIL)
    rules = [
        (says(*LEADERS), "top_projects_by_quests", empty),
        (says(*CLUSTERS) & detail, "show_cluster", _json(label=text)),
        (says(*CLUSTERS), "list_clusters", empty),
        (says(*QUESTS) & detail, "show_quest", _json(quest=text)),
        (says(*QUESTS), "list_quests", empty),
        (says(*RECENT), "recent_activity", empty),
        (says(*OVERVIEW), "atlas_overview", empty),
        (says(*INSIDE) | detail, "show_project", _json(project=text)),
        (says(*SEARCHES), "search_projects", _json(query=text)),
    ]
    return _first(rules, F.lit(None).cast("string"), F.lit(None).cast("string"))


def chat_route(message: Column) -> Column:
    """The intent of a message, else a search for it, and for an empty one the overview."""
    text = clean(message)
    return let(chat_intent(message), lambda i: F.when(i["name"].isNotNull(), i).when(text != "", F.struct(F.lit("search_projects").alias("name"), _json(query=text).alias("arguments"))).otherwise(F.struct(F.lit("atlas_overview").alias("name"), F.lit("{}").alias("arguments"))))
