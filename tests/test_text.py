"""Text functions on literals worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import python_text as P
from corvane.functions import text as T


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "tokens"), [("Foo-bar. a 10.5", ["foo-bar", "10.5"]), ("", []), (None, []), ("_x x", [])])
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokens(F.col("t")), t=text) == tokens if text is not None else True


@pytest.mark.parametrize(("text", "tokens"), [("project-7", ["project-7", "project"]), ("7", ["7"]), ("the of x", [])])
def test_search_tokens(spark, text, tokens):
    assert one(spark, T.search_tokens(F.col("t")), t=text) == tokens


def test_clean_and_bounded(spark):
    assert one(spark, T.clean(F.col("t")), t="  a \n b ") == "a b"
    assert one(spark, T.bounded(F.col("t"), 11), t="abc defghij klm") == "abc ... klm"
    assert one(spark, T.bounded(F.col("t"), 11), t="short") == "short"


def test_truncation_fits_its_cap(spark):
    r = one(spark, T.truncated(F.col("t"), 80), t="x" * 120)
    assert (len(r["text"]), r["omitted"]) == (80, 40)
    mark = "\n[truncated 40 chars before privacy filtering]"
    assert r["text"] == "x" * 34 + mark and len(mark) == 46
    assert one(spark, T.truncated(F.col("t"), 80), t="x" * 80)["omitted"] == 0
    assert tuple(one(spark, T.truncated(F.col("t"), 10), t="x" * 120)) == ("filtering]", 110)
    assert tuple(one(spark, T.truncated(F.col("t"), 0), t="xyz")) == ("xyz", 0)


def test_short_values(spark):
    assert one(spark, T.short_value(F.col("t"), 12), t=" a  b ") == "a b"
    assert one(spark, T.short_value(F.col("t"), 12), t="one two, and more") == "one two..."


def test_snippets(spark):
    terms = F.array(F.lit("needle"))
    assert one(spark, T.snippet(F.col("t"), terms), t="  a  needle here ") == "a needle here"
    long = "x " * 200 + "needle"
    cut = one(spark, T.snippet(F.col("t"), terms), t=long)
    assert cut.startswith("... ") and cut.endswith("needle") and len(cut) >= 170
    middle = one(spark, T.snippet(F.col("t"), terms), t="y" * 300 + " needle " + "z" * 300)
    assert middle.startswith("... y") and middle.endswith("z ...") and "needle" in middle


def test_titles_and_tags(spark):
    assert one(spark, T.public_title(F.col("t")), t="My  Build Small Hackathon") == "Untitled project"
    assert one(spark, T.public_title(F.col("t")), t=" A  b ") == "A b"
    assert one(spark, T.public_summary(F.col("t")), t=" TODO ") == ""
    assert one(spark, T.normalized_tags(F.split("t", ",")), t="a, b ,region:us,,a") == ["a", "b"]


def test_redaction_keeps_names(spark):
    secret = "API_KEY = 'abc123' and ghp_" + "a" * 24 + " in /home/me/x/y"
    r = one(spark, T.redacted(F.col("t"), (("/home/me", "~"), ("/home/me/x", "$ROOT"))), t=secret)
    assert r.startswith("API_KEY=[REDACTED_SECRET]") and "ghp_" not in r and r.endswith("$ROOT/y")


def test_style_blob(spark):
    blob = "a{b:c;d:e;}" * 10
    assert one(spark, T.is_style_blob(F.col("t")), t=blob) is True
    assert one(spark, T.is_style_blob(F.col("t")), t="a{b:c;d:e;}") is False
    assert one(spark, T.embedding_signal(F.col("t")), t="<p>Hi  <b>you</b></p>") == "Hi you"


def test_scatter(spark):
    digest = hashlib.sha256(b"owner/card-1").hexdigest()
    assert tuple(one(spark, T.scatter(F.col("t")), t="owner/card-1")) == (8 + int(digest[:4], 16) % 84, 8 + int(digest[4:8], 16) % 84)


def test_frontmatter(spark):
    text = "---\ntitle: 'A b' \nsdk: gradio # x\n  in: no\n- item\n---\nBody\n"
    m = one(spark, T.frontmatter(F.col("t")), t=text)
    assert m == {"title": "A b", "sdk": "gradio"}
    assert one(spark, T.without_frontmatter(F.col("t")), t=text) == "Body"
    assert one(spark, T.without_frontmatter(F.col("t")), t="---\nopen\n") == "---\nopen"


def test_chunks(spark):
    assert one(spark, T.packed_chunks(F.col("t"), 6), t="ab cd ef g") == ["ab cd ", "ef g"]


def test_python_signals():
    assert P.python_signals("def go(x, *, k=lambda q: q):\n    return a.b(x, key='v')\n") == ["go", "x", "a.b", "key", "v"]
    assert P.python_signals("not python (") == ["not python ("]


def test_json_repair():
    assert P.first_object('```json\n{"a": "x "y" z"}\n```') == '{"a":"x \\"y\\" z"}'
    assert P.first_object("none") is None


def test_spans(spark):
    kind = "text string, found array<struct<begin:int,end:int,label:string,score:double>>"
    rows = spark.createDataFrame([("call Ann Lee now", [(5, 8, "NAME", 0.9), (8, 12, "NAME", 0.8), (0, 4, "X", 0.1)]), ("abcdef", [(2, 5, "B", 1.0), (0, 3, "A", 1.0)]), ("ab cd", [(3, 5, "N", 1.0), (0, 2, "N", 1.0)]), ("plain", [])], kind)
    got = rows.select(T.redact_spans(F.col("text"), F.col("found")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("call [NAME] now", {"NAME": 1}), ("[PRIVATE]f", {"PRIVATE": 1}), ("[N] [N]", {"N": 2}), ("plain", {})]


def test_redaction_labels(spark):
    for raw, label in (("B-private_name", "PRIVATE_NAME"), ("", "PRIVATE"), ("E-mail address", "MAIL_ADDRESS"), ("--", "PRIVATE"), ("X-1", "X_1"), (None, "PRIVATE")):
        assert one(spark, T.redaction_label(F.col("t")), t=raw) == label, raw


def test_title_case(spark):
    for raw, shown in (("text-to-speech", "Text-To-Speech"), ("llama.cpp 2go", "Llama.Cpp 2Go"), ("ÉTÉ", "Été"), ("", "")):
        assert one(spark, T.title_case(F.col("t")), t=raw) == shown
    assert one(spark, T.humanized(F.col("t")), t="my_app--2go") == "My App 2Go" and one(spark, T.clean(F.col("t")), t="a\x1c\x1f b\u00a0c ") == "a b c"


def test_quotes_are_mended_in_one_pass():
    assert P.with_escaped_quotes('{"a": "x "y" z", "b\\"c": 1}') == '{"a": "x \\"y\\" z", "b\\"c": 1}' and P.with_escaped_quotes('\\" "') == '\\" "'
    assert len(P.with_escaped_quotes('{"a": "' + 'b "c" ' * 20_000)) > 100_000
