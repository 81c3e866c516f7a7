"""Session files, published datasets, traces, training files, index headers, plans and maps."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import advice, exports, index, publication, training_rows
from corvane.sources import cards


@pytest.fixture
def roots(tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    lines = [{"type": "event_msg", "timestamp": "t2", "payload": {"type": "m", "message": "see /home/me"}}, None, {"type": "session_meta", "payload": {"id": "first"}}, "broken", {"type": "session_meta", "timestamp": "t1", "payload": {"id": "last", "cwd": "/home/me/x"}}, {"type": "response_item", "timestamp": "t0", "payload": {"type": "message"}}]
    (tmp_path / "deep/er/rollout-a.jsonl").write_text("\n".join("" if x is None else x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    (tmp_path / "deep/rollout-b.c.jsonl").write_text(json.dumps({"type": "event_msg", "payload": {"type": "m"}}) + "\n" + json.dumps({"type": "session_meta", "payload": {"id": 5}}))
    (tmp_path / "deep/none.txt").write_text("{}")
    return [str(tmp_path)]


def test_session_files(spark, roots):
    rows = cards.session_records(cards.read_sessions(spark, roots)).orderBy("file", "record_index").collect()
    assert [(r["file"].rpartition("/")[2], r["record_index"], r["session_id"], r["type"]) for r in rows] == [
        ("rollout-a.jsonl", 0, "last", "event_msg"), ("rollout-a.jsonl", 2, "last", "session_meta"), ("rollout-a.jsonl", 3, "last", None), ("rollout-a.jsonl", 4, "last", "session_meta"), ("rollout-a.jsonl", 5, "last", "response_item"),
        ("rollout-b.c.jsonl", 0, "b.c", "event_msg"), ("rollout-b.c.jsonl", 1, "b.c", "session_meta"),
    ]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = cards.read_sessions(spark, [str(tmp_path)])
        assert got.rdd.getNumPartitions() >= 1 and [(r["record_index"], json.loads(r["raw"])["n"]) for r in got.orderBy("record_index").collect()] == [(i, i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_published_dataset(spark, roots, tmp_path):
    records = publication.public_records(cards.session_records(cards.read_sessions(spark, roots)), "type", "payload", (("/home/me", "~"),))
    out = f"file://{tmp_path}/dataset"
    totals = publication.write_dataset(records, out, "session_id", "record_index", "timestamp", "type")
    assert (totals["sessions"], totals["records"], totals["published"], totals["dropped"]) == (2, 7, 5, 2)
    lines = [json.loads(r[0]) for r in spark.read.text(f"{out}/records").collect()]
    assert {"schema_version": 1, "session_id": "last", "record_index": 0, "timestamp": "t2", "type": "event_msg", "payload": {"type": "m", "message": "see ~"}} in lines and len(lines) == 5
    assert json.loads(spark.read.text(f"{out}/manifest").first()[0])["published"] == 5
    stats = {r["session_id"]: r for r in publication.session_totals(records, "session_id", "record_index", "timestamp").collect()}
    assert (stats["last"]["first_at"], stats["last"]["last_at"], stats["last"]["records"], stats["last"]["published"], stats["last"]["texts"]) == ("t2", "t0", 5, 3, 1)
    with pytest.raises(Exception, match="already exists"):
        publication.write_dataset(records, out, "session_id", "record_index", "timestamp", "type")


TURNS = "s string, turn int, input string, response string, status string, tool string, arguments string, tools array<struct<name:string,summary:string>>, verdict string, overall int, plan_steps int, artifact_title string, errors array<string>"


def test_traces(spark):
    rows = [("a", 4, "hello", " hi  there ", "valid", "look", '{"z": 1, "a": {"c": 2, "b": 1}}', [("look", "Looked.")], "UNWRITTEN", 7, 2, "T", []), ("a", 9, "x", "y", "defaulted", "look", "{}", None, None, None, None, None, ["bad"]), ("a", 10, None, None, None, None, "{broken", None, None, None, None, None, None), ("b", 1, " ", "y", "valid", "look", "{}", None, None, None, None, None, None)]
    turns = spark.createDataFrame(rows, TURNS)
    ideas = spark.createDataFrame([("a", 3)], "s string, ideas int")
    out = {(r["s"], r["pos"]): r["line"] for r in exports.trace_lines(turns, "s", "turn", {"algorithm": "x"}, ideas).collect()}
    assert json.loads(out["a", 0]) == {"type": "trace_manifest", "schema_version": 1, "idea_count": 3, "turn_count": 3, "index": {"algorithm": "x", "index_generated_at": "", "snapshot_digest": "", "snapshot_generated_at": ""}}
    first, last = json.loads(out["a", 1]), json.loads(out["a", 3])
    assert first["tool_resolution"] == {"call": {"arguments": {"z": 1, "a": {"b": 1, "c": 2}}, "name": "look"}, "errors": [], "status": "valid"} and first["tools"] == [{"name": "look", "summary": "Looked."}] and first["overall"] == 7
    assert last == {"artifact_title": "", "input": "", "overall": None, "plan_steps": 0, "response": "", "schema_version": 1, "tool_resolution": {"call": {"arguments": {}, "name": ""}, "errors": [], "status": ""}, "tools": [], "turn_index": 3, "type": "agent_turn", "verdict": ""}
    assert list(json.loads(out["a", 1])) == sorted(first) and len(out) == 6
    pairs = exports.trace_examples(turns, "s", "turn", ("call", "answer")).orderBy("example_index").collect()
    assert [(r["s"], r["turn_index"], r["kind"]) for r in pairs] == [("a", 1, "tool_call"), ("a", 1, "advisor_response")]
    call = '<function name="look">{"a":{"b":1,"c":2},"z":1}</function>'
    assert [m["content"] for m in pairs[0]["messages"]] == ["call", "hello", call] and [m["content"] for m in pairs[1]["messages"]] == ["answer", f"hello\n\nTool call: {call}", "hi there"]


MATCHES = "array<struct<label:string,confidence:double,evidence:string,source:string>>"


def test_branches_by_hand_and_remote(spark):
    m = lambda label, source: (label, 0.5, "e", source)
    rows = spark.createDataFrame([(1, "one", ["a"], "r", "app", [m("Modal", "app_file"), m("Codex", "readme")]), (2, "two", [], "r", "app", [m("Codex", "readme")]), (3, "three", [], "r", "app", [m("Modal", "app_file"), m("Codex", "app_file")])], f"id long, title string, tags array<string>, readme string, app string, matches {MATCHES}")
    made = spark.createDataFrame([(-1, "hard_negative", [m("Codex", "readme")]), (-2, "empty", [m("Codex", "readme")]), (-3, "unknown", [])], f"id long, variant string, matches {MATCHES}").selectExpr("id", "'t' title", "array('x') tags", "'r' readme", "'a' app", "matches", "variant")
    remote = spark.createDataFrame([(1,), (2,), (3,), (99,)], "id long")
    out = {(r["id"], r["variant"]): r for r in training_rows.branches(rows, "id", 1, 1, 1, remote, made).collect()}
    assert {k for k in out if k[1] not in ("natural", "noisy_metadata", "missing_app_file")} == {(3, "app_only"), (1, "remote_app_only"), (2, "remote_app_only"), (-1, "hard_negative"), (-2, "empty")}
    assert [x["label"] for x in out[1, "remote_app_only"]["matches"]] == ["Modal"] and out[2, "remote_app_only"]["matches"] == [] and out[1, "remote_app_only"]["readme"] == training_rows.NO_README
    assert out[-2, "empty"]["matches"] == [] and len(out[-1, "hard_negative"]["matches"]) == 1
    examples = spark.createDataFrame([(r["id"], r["variant"], r["matches"]) for r in out.values()], f"id long, variant string, matches {MATCHES}")
    lined = examples.withColumn("line", training_rows.example_line(F.lit("p"), "s", F.col("id"), F.col("variant"), F.col("matches"), "b", "t"))
    whole = training_rows.training_file(lined, training_rows.manifest(lined, ["Codex", "Modal", "None"]), "id", "line", "src").orderBy("pos").collect()
    head = json.loads(whole[0]["line"])
    assert head["example_count"] == len(out) == len(whole) - 1 and head["quest_positive_counts"]["None"] == 0 and head["variant_counts"]["remote_app_only"] == 2
    one = json.loads(next(r["line"] for r in whole if r["id"] == 3 and r["variant"] == "app_only"))
    assert one["quests"] == ["Codex", "Modal"] and [x["role"] for x in one["messages"]] == ["system", "user", "assistant"] and len(json.loads(one["messages"][2]["content"])["matches"]) == 2
    split = training_rows.split_rows(examples, "id", "variant", {"app_only": 3}, 0.5)
    sides = {}
    for r in split.collect():
        sides.setdefault((r["id"], r["variant"]), []).append(r["split"])
    assert all(len(set(s)) == 1 for s in sides.values()) and len(sides[3, "app_only"]) == 3 and len(sides[1, "natural"]) == 1


def test_training_file_problems(spark):
    chat = lambda answer, role="assistant": json.dumps({"type": "lora_sft_example", "messages": [{"role": "user", "content": "x"}, {"role": role, "content": answer}]})
    lines = [json.dumps({"type": "lora_sft_manifest"}), chat('{"matches": []}'), chat("none"), chat("", "assistant"), chat('{"matches": []}', "user"), json.dumps({"type": "lora_sft_example", "messages": [{}]}), "{}", "broken", chat('{"matches": [{"quest": "Nope", "confidence": 1, "evidence": "e", "source": "readme"}]}')]
    got = {r["i"]: r["problem"] for r in training_rows.file_problems(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), "i", "line").collect()}
    assert got == {2: "matches must be a list", 3: "no answer of the assistant", 4: "no answer of the assistant", 5: "no chat messages", 6: "not an example", 7: "not an example", 8: "unknown quest: Nope"}


def test_index_headers(spark):
    rows = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, None, [0.0, 2.0])], "id long, text string, vec array<double>")
    snapshot = {"generated_at": "t", "source": "s", "digest": "d"}
    head = index.header(index.built(rows, "id", "text", "vec"), snapshot)
    assert index.header_problems(head, snapshot, 2).collect() == [] and head.first()["embedding"]["dimensions"] == 2
    wrong = head.withColumn("schema_version", F.lit(1)).withColumn("algorithm", F.lit("y")).withColumn("embedding", F.lit(None).cast(head.schema["embedding"].dataType))
    found = {r[0] for r in index.header_problems(wrong, {"generated_at": "u", "source": "v", "digest": "w"}, 3).collect()}
    assert found == {"unsupported schema version", "unsupported algorithm", "built from a snapshot of another time", "built from a snapshot of another source", "the snapshot's digest differs", "no embedding", "no dimensions", "another number of documents"}
    assert [r[0] for r in index.header_problems(index.header(index.built(rows, "id", "text", "vec"), snapshot, {"runtime": "z"}), snapshot, 2).collect()] == ["another runtime"]
    for bad, said in ((rows.limit(0), "must not be empty"), (rows.unionByName(spark.createDataFrame([(3, "b", [1.0])], rows.schema)), "one shared dimension")):
        with pytest.raises(Exception, match=said):
            index.header(index.built(bad, "id", "text", "vec"), snapshot).collect()
    placed = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, pos int")
    other = spark.createDataFrame([(1, 0), (3, 1), (2, 2), (9, 3)], "id long, pos int")
    assert {tuple(r) for r in index.order_problems(other, placed, "id", "pos").collect()} == {(2, 1, 3), (3, 2, 2), (None, 3, 9)}


def test_plans(spark):
    rows = spark.createDataFrame([({"time": "two  days", "preferences": None, "skills": " "}, ["Well-Tuned", "x", "Well-Tuned"]), (None, None), ({}, []), ({"constraints": "word " * 40}, ["Field Notes"])], "p map<string,string>, g array<string>")
    known = ("Well-Tuned", "Field Notes")
    got = rows.select(advice.plan(F.array(*map(F.lit, advice.PLAN_STEPS)), F.col("p"), F.col("g")).alias("plan"), advice.wanted_goals(F.col("g"), known, F.array(F.lit("d"))).alias("goals")).collect()
    assert got[0]["plan"] == [advice.PLAN_STEPS[0], "Scope the first prototype to two days; cut anything that cannot fit that window.", *advice.PLAN_STEPS[1:4], advice.TUNING_STEP, advice.PLAN_STEPS[4]]
    assert got[1]["plan"] == list(advice.PLAN_STEPS) == got[2]["plan"] and len(got[3]["plan"]) == 6 and got[3]["plan"][1].startswith("Test the constraint early: word word")
    assert [r["goals"] for r in got] == [["Well-Tuned"], ["d"], [], ["Field Notes"]]


def test_digests_and_captions(spark):
    value = {"url": "u", "b": "x", "a": [{"id": 1, "t": "A / B", "n": 2, "in": {"q": 1}}, 3, None], "c": {"score": 1}, "d": {"e": {"f": [True]}}}
    got = spark.createDataFrame([(json.dumps(value),), ("[1, \"x\"]",), ('"s"',)], "j string").select(advice.digest_lines(F.parse_json("j"))).collect()
    assert got[0][0] == 'a:\n  - n: 2, t: "A / B"\n  - 3\n  - None\nb: "x"\nc:\nd:\n  e:\n    f:\n      - True' and got[1][0] == '- 1\n- "x"' and got[2][0] == '"s"'
    rows = spark.createDataFrame([("UNWRITTEN", ["a"]), ("ECHO x2", ["a", "b", "c"]), ("ECHO x1", None)], "v string, t array<string>")
    assert [r[0] for r in rows.select(advice.caption(F.col("v"), F.col("t"))).collect()] == [advice.PALE_CAPTION, advice.NEAR_CAPTION.format("a, b"), advice.NEAR_CAPTION.format("nearby pages")]
    lines = spark.createDataFrame([(["a", "b", "c", "d"],), ([],), (None,)], "x array<string>").select(advice.context_lines(F.col("x"), lambda r: r)).collect()
    assert [r[0] for r in lines] == ["- b\n- c\n- d", "- empty", "- empty"]


def test_maps(spark):
    projects = spark.createDataFrame([(i, f"p{i}", 100 - i) for i in range(30)], "id long, title string, likes long")
    layout = spark.createDataFrame([(0, 10.0, 20.0), (3, 30.0, 40.0)], "id long, x double, y double")
    hits = spark.createDataFrame([(i, 1 - i / 10) for i in range(7)], "id long, score double")
    out = advice.map_dots(projects, layout, hits, "id", [F.desc("likes")], ("i", "Idea"), (50, 60)).collect()
    kinds = {k: sorted(int(r["item"]) for r in out if r["kind"] == k) for k in ("inked", "echo")}
    assert kinds == {"inked": list(range(7, 22)), "echo": list(range(5))}
    assert {(r["x"], r["y"]) for r in out if r["item"] in ("0", "3")} == {(10, 20), (30, 40)} and [(r["x"], r["y"], r["radius"]) for r in out if r["kind"] == "idea"] == [(50, 60, 8)]
    assert [r["radius"] for r in sorted(out, key=lambda r: r["item"]) if r["kind"] == "echo"] == [9] * 5
