"""Calls, contracts and routes on outputs written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import tools

ROW = "t string"


def shown(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], ROW).select(column).collect()]


def test_parse_errors(spark):
    texts = [
        '<function name="save_idea">{"title": "A &amp; B", "pitch": "p"}</function>',
        'prose <b>x</b> <function name="compare_ideas"></function>',
        '<function name="a">{}</function><function name="b">{}</function>',
        "no call",
        '<function name=" ">{}</function>',
        '<function name="a">{"x": </function>',
        '<function name="a">[1]</function>',
        '<function name="a">{}',
        None,
    ]
    got = shown(spark, texts, tools.json_call(F.col("t")).alias("c"))
    assert [g["error"] for g in got] == [None, None, "expected exactly one function call, got 2", "expected exactly one function call, got 0", "function call is missing a name", "function arguments are not valid JSON", "function arguments must be a JSON object", "invalid XML tool call", "expected exactly one function call, got 0"]
    assert got[0]["name"] == "save_idea" and json.loads(str(got[0]["arguments"].toJson()))["title"] == "A & B"


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("save_idea", {"title": "t", "pitch": "p"}, []),
        ("fly", {}, ["unknown tool: fly"]),
        ("save_idea", {"title": 1, "z": 2, "a": 3}, ["unexpected arguments for save_idea: a, z", "missing required arguments for save_idea: pitch", "save_idea.title must be string"]),
        ("update_profile", {"field": "mood", "value": "x"}, ["update_profile.field must be one of: skills, time, preferences, constraints"]),
        ("update_profile", {"field": None, "value": "x"}, ["update_profile.field must be string"]),
        ("set_goals", {"goals": ["a", 1, None, ["b"]]}, ["set_goals.goals[1] must be string", "set_goals.goals[2] must be string", "set_goals.goals[3] must be string"]),
        ("set_goals", {"goals": "a"}, ["set_goals.goals must be array"]),
        ("list_projects", {"sort": "title"}, []),
        ("find_whitespace", {"q": 1}, ["unexpected arguments for find_whitespace: q"]),
    ],
)
def test_contracts(spark, name, arguments, errors):
    output = f'<function name="{name}">{json.dumps(arguments)}</function>'
    rows = spark.createDataFrame([(output,)], ROW).withColumn("c", tools.json_call(F.col("t")))
    assert rows.select(tools.violations(F.col("c"))).first()[0] == errors
    done = rows.select(tools.resolved(F.col("c"), F.lit(" a query ")).alias("a"), tools.resolved(F.col("c"), F.lit(" ")).alias("b")).first()
    assert done["a"]["status"] == ("valid" if not errors else "defaulted") and done["a"]["errors"] == errors
    assert errors == [] or (done["a"]["name"], done["a"]["arguments"], done["b"]["name"], done["b"]["arguments"]) == ("search_projects", '{"query":"a query"}', "find_whitespace", "{}")


@pytest.mark.parametrize(("kind", "good", "bad"), [("integer", [1, -5], [1.5, True, "1", None]), ("number", [1, 1.5, 1e30], [True, "1"]), ("boolean", [True], [1, "true"]), ("object", [{"a": 1}], [[1], "x"]), ("array", [[], [1]], [{}, "x"])])
def test_types(spark, kind, good, bad):
    specs = {"t": {"x": tools.Field(kind, True)}}
    texts = [f'<function name="t">{json.dumps({"x": v})}</function>' for v in good + bad]
    got = shown(spark, texts, tools.violations(tools.json_call(F.col("t")), specs))
    assert got == [[]] * len(good) + [[f"t.x must be {kind}"]] * len(bad)


def test_chat_calls(spark):
    specs = {"show": {"what": tools.Field("string", True)}}
    texts = ['I look: <function name="show"><param name="what"> a &lt;b&gt; </param></function>', '<function name="show"><other/></function>', "just words", '<function name="show"><param>x</param></function>', "<function name='show'>", None]
    got = shown(spark, texts, tools.chat_resolved(F.col("t"), F.lit("the latest"), specs).alias("r"))
    assert [g["status"] for g in got] == ["valid", "defaulted", "none", "defaulted", "defaulted", "none"]
    assert got[0]["arguments"] == '{"what":"a <b>"}' and got[1]["errors"] == ["unexpected element <other> in function call"] and got[1]["name"] == "recent_activity"
    assert got[3]["errors"] == ["param is missing a name"] and got[4]["errors"] == ["no <function> call found in model output"]


def test_outputs_put_right(spark):
    texts = ['name="a">{}', '<function name="a">{}', '<function name="a">{}</function>', " plain "]
    assert shown(spark, texts, tools.normalized_output(F.col("t"))) == ['<function name="a">{}</function>'] * 3 + ["plain"]
    assert shown(spark, ["a <function x>1</function> b<function>\n2</function>", None], tools.without_calls(F.col("t"))) == ["a  b", ""]


ROUTES = {
    "": ("list_projects", '{"sort":"likes"}'),
    "  Show   Projects now": ("list_projects", '{"sort":"likes"}'),
    "Read project https://host.example/spaces/org/Tide-Clock!": ("get_project", '{"id":"org/Tide-Clock"}'),
    "compare": ("compare_ideas", "{}"),
    "comparedly": ("save_idea", None),
    "Make a  build plan please": ("make_plan", "{}"),
    "bolder": ("find_whitespace", "{}"),
    'search for "tides"': ("search_projects", '{"query":"search for \\"tides\\""}'),
    "build a tide clock": ("save_idea", None),
}


def test_advisor_routes(spark):
    got = shown(spark, ROUTES, tools.advisor_route(F.col("t")).alias("r"))
    for (message, (name, arguments)), g in zip(ROUTES.items(), got, strict=True):
        assert g["name"] == name and (arguments is None or g["arguments"] == arguments), message
    assert json.loads(got[-1]["arguments"]) == {"title": "A tide clock...", "pitch": "build a tide clock"}


def test_chat_routes(spark):
    asked = {"Who completed most?": "top_projects_by_quests", "what is in the green cluster": "show_cluster", "themes": "list_clusters", "tell me about the badge": "show_quest", "which quest": "list_quests", "latest": "recent_activity", "the coolest": "atlas_overview", "how does it work": "show_project", "projects about tides": "search_projects", "tides": "search_projects", " ": "atlas_overview"}
    assert [g["name"] for g in shown(spark, asked, tools.chat_route(F.col("t")).alias("r"))] == list(asked.values())
    assert shown(spark, ["tides", "Thanks!!", "hi there", "history", "", None], tools.chat_intent(F.col("t"))["name"]) == [None] * 6
    assert shown(spark, ["tides", "Thanks!!", "hi there", "history", "", None], tools.is_smalltalk(F.col("t"))) == [False, True, True, False, True, True]
