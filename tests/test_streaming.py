"""Streams give what the batch gives."""

import datetime

import pytest

from corvane.streaming import refresh, sessions, turns

DATA = "/root/testdata/sf0.001"


def fed(chunks, thinking=True):
    held, out = "", []
    for chunk in chunks:
        pieces, held, thinking = turns.feed(chunk, held, thinking)
        assert len(held) <= 7
        out += pieces
    return out + turns.finish(held, thinking)


def test_splitter():
    assert fed(["plan the ", "answer</th", "ink>\n\nHello", " there"]) == [("thinking", "plan the "), ("thinking", "answer"), ("answer", "Hello"), ("answer", " there")]
    assert fed(["a < b </thin", "g"]) == [("thinking", "a < b "), ("thinking", "</thing")]
    assert fed(["cut </th"]) == [("thinking", "cut "), ("thinking", "</th")]
    assert fed(["straight", "", "</think> through"], thinking=False) == [("answer", "straight"), ("answer", "</think> through")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = turns.tumbling(stream, "1 day", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {tuple(r) for r in spark.table("tumbled").select("window_start", "event_type", "n").collect()}
    assert found == {tuple(r) for r in turns.tumbling(events, "1 day", "event_type", "value").select("window_start", "event_type", "n").collect()}


def test_stateful_splitter(spark, tmp_path):
    rows = spark.createDataFrame([("t", i, c, i == 3) for i, c in enumerate(["a<th", "ink b</thi", "nk>\nc<", "d"])], "turn_id string, seq long, text string, final boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = turns.split_thinking(stream).writeStream.outputMode("append").format("memory").queryName("split").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("split").orderBy("seq").collect()
    assert "".join(r["text"] for r in got if r["kind"] == "answer") == "c<d"
    assert "".join(r["text"] for r in got if r["kind"] == "thinking") == "a<think b"


def run(query, seconds=180):
    query.awaitTermination(seconds)
    query.stop()


def test_stages_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = [("start", None), ("stage", "planning"), ("model_progress", None), ("stage", "running_tool"), ("tool_event", None), ("stage", "writing"), ("token", None), ("done", None)]
    rows = [(turn, i, start + datetime.timedelta(milliseconds=100 * i + (7 if turn == "late" else 0)), k, s, 3 * i) for turn in ("good", "late") for i, (k, s) in enumerate(kinds)]
    rows += [("swapped", i, start + datetime.timedelta(milliseconds=100 * i), k, s, None) for i, (k, s) in enumerate([*kinds[:4], kinds[6], kinds[4]])]
    rows += [("none", 0, start, "fallback", None, None)]
    events = spark.createDataFrame(rows, "turn_id string, seq long, ts timestamp, type string, stage string, tokens long")
    batch = {r["turn_id"]: r for r in turns.stages(events).collect()}
    good = batch["good"]
    assert (good["total_ms"], good["decode_ms"], good["tools_ms"], good["write_ms"], good["tokens"], good["tools"], good["in_order"]) == (700, 200, 200, 200, 6, 1, True)
    assert sorted(good["at"]) == ["planning", "running_tool", "writing"] and batch["none"]["at"] == {} and batch["none"]["fell_back"] and batch["none"]["in_order"]
    assert not batch["swapped"]["in_order"] and batch["swapped"]["write_ms"] is None
    events.orderBy("tokens").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(turns.stages(stream, watermark="1 hour").writeStream.outputMode("complete").format("memory").queryName("staged").trigger(availableNow=True).start())
    assert {r["turn_id"]: r for r in spark.table("staged").collect()} == batch


EVENTS = [
    ("a", 0, "save_idea", "Tide", "a clock", None, None, None),
    ("a", 1, "save_idea", " tide ", "a clock", None, None, None),
    ("a", 2, "set_goals", None, None, None, None, ["Codex", "Field Notes", "Off-Brand", "Field Notes"]),
    ("a", 3, "save_idea", "Moon", "a clock", None, None, None),
    ("a", 4, "update_profile", None, None, "time", "an hour", None),
    ("a", 5, "update_profile", None, None, "time", "a day", None),
    ("b", 0, "look", None, None, None, None, None),
    ("b", 1, "set_goals", None, None, None, None, []),
    ("b", 2, "save_idea", "One", "x" * 300, None, None, None),
    *[("c", i, "look", None, f"look {i}", None, None, None) for i in range(20)],
]
KIND = "session string, seq long, action string, title string, pitch string, field string, value string, goals array<string>"


def test_sessions_of_a_table(spark):
    out = {r["session"]: r for r in sessions.session_states(spark.createDataFrame(EVENTS, KIND)).collect()}
    first, second = out["a"]["ideas"]
    assert (first["title"], first["goals"], second["title"], second["goals"]) == (" tide ", ["Field Notes", "Off-Brand"], "Moon", ["Field Notes", "Off-Brand"])
    assert out["a"]["current"] == second["id"] and out["a"]["profile"] == {"time": "a day"} and out["b"]["goals"] == [] and out["b"]["ideas"][0]["goals"] == []
    assert out["c"]["goals"] == list(sessions.GOALS[:3]) and [x["seq"] for x in out["c"]["trace"]] == list(range(8, 20)) and len(out["b"]["trace"][-1]["input"]) == 240


def test_sessions_of_a_stream(spark, tmp_path):
    """Events in several triggers, one of which brings an event again, leave the state of the table."""
    events = spark.createDataFrame(EVENTS, KIND)
    for part in ("seq < 2", "seq >= 1 AND seq < 4", "seq >= 4"):
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run(sessions.streamed_states(stream).writeStream.outputMode("update").format("memory").queryName("sessioned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    rows = spark.table("sessioned").collect()
    last = {s: max((r for r in rows if r["session"] == s), key=lambda r: r["seq"]) for s in "abc"}
    assert last == {r["session"]: r for r in sessions.session_states(events).collect()} and len(rows) > 3


def test_refresh_that_breaks_off(spark, tmp_path):
    """A trigger that dies after it has written is started again: every row is in the store once, and hits aren't asked again."""
    store, progress, checkpoint = (str(tmp_path / n) for n in ("store", "progress", "cp"))
    for rows in ([("k1", "a"), ("k2", "b"), ("k2", "b")], [("k1", "a"), ("k3", "bad"), ("k4", "d")], [("k3", "c"), ("k4", "d"), ("k5", "e")]):
        spark.createDataFrame(rows, "key string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    asked, dies = [], [True]

    def analyze(rows):
        asked.append(sorted(r["key"] for r in rows.collect()))
        if len(asked) == 2 and dies:
            dies.clear()
            # As if the driver were lost between the results and the end of the trigger.
            rows.selectExpr("key", "text AS result", "CAST(NULL AS STRING) AS error").write.mode("overwrite").parquet(f"{store}/batch=1")
            raise RuntimeError("lost")
        return rows.selectExpr("key", "IF(text = 'bad', NULL, upper(text)) AS result", "IF(text = 'bad', 'bad row', NULL) AS error")

    def start():
        stream = spark.readStream.schema("key string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return refresh.refresh(stream, store, progress, checkpoint, "key", analyze, "key string, result string, error string")

    broken = start()
    with pytest.raises(Exception, match="lost"):
        broken.awaitTermination(120)
    run(start())
    done = refresh.stored(spark, store)
    good = sorted((r["key"], r["result"]) for r in done.where("error IS NULL").collect())
    assert [k for k, _ in good] == ["k1", "k2", "k3", "k4", "k5"] and dict(good) in ({"k1": "A", "k2": "B", "k3": "C", "k4": "D", "k5": "E"},)
    assert asked[1] == asked[2] and sum("k1" in keys for keys in asked) == 1
    counts = sorted(tuple(r[c] for c in ("batch", "rows", "hits", "misses", "analyzed", "failed")) for r in refresh.progress_of(spark, progress).collect())
    assert [c[0] for c in counts] == [0, 1, 2] and sum(c[1] for c in counts) == 9 and sum(c[5] for c in counts) == 1 and sum(c[4] for c in counts) == 5
    assert refresh.stored(spark, str(tmp_path / "none")) is None and refresh.progress_of(spark, str(tmp_path / "none")).collect() == []
