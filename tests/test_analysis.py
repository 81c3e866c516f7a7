"""The ladder, the cache and the prompt."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from corvane.operators import analysis

GOOD = {"quest": "Modal", "confidence": 0.5, "evidence": "uses it", "source": "readme"}
DECLARED = [("Codex", 1.0, "tag", "metadata")]
TAXONOMY = {"b": 1, "a": {"d": [1, 2], "c": "é"}}


def answer(**changed):
    return json.dumps({"matches": [{**GOOD, **changed}]})


def test_checked(spark):
    cases = {
        answer(): None,
        answer(quest="OpenBMB / Codex"): None,
        answer(confidence="0.25"): None,
        json.dumps({"matches": []}): None,
        answer(quest="nothing"): "unknown quest: nothing",
        answer(confidence=None): "confidence must be numeric",
        answer(confidence=0): "confidence must be greater than 0 and no more than 1",
        answer(evidence=" \n"): "evidence must not be empty",
        answer(evidence="has Signals: x"): "evidence must come from README or APP_FILE, not quest instructions",
        answer(evidence="Runs  on one machine"): "evidence must come from README or APP_FILE, not quest instructions",
        answer(source="web"): "source must be one of readme, app_file, metadata, got web",
        json.dumps({"matches": [GOOD, GOOD]}): "duplicate quest: Modal",
        json.dumps({"matches": [1]}): "matches must be objects",
        json.dumps({"matches": {}}): "matches must be a list",
        "{}": "matches must be a list",
        None: "no JSON object in the answer",
    }
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select(analysis.checked(F.col("a"), ["Runs on one"]).alias("c")).collect()
    assert [r["c"]["error"] for r in rows] == list(cases.values())
    assert [tuple(m) for m in rows[1]["c"]["matches"]] == [("OpenBMB", 0.5, "uses it", "readme"), ("Codex", 0.5, "uses it", "readme")] and rows[2]["c"]["matches"][0]["confidence"] == 0.25


def test_ladder(spark):
    """One row of each rung, and none of them fails the others; a model is never asked twice for a row."""
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        if "raise" in prompts:
            raise RuntimeError("down")
        return [{"good": answer(), "fence": f"```json\n{answer()}\n```", "quotes": answer().replace("uses it", 'uses "it" so'), "range": answer(confidence=5), "cut": answer()[:-3], "known": answer(quest="codex")}[p] for p in prompts]

    def repair(requests):
        return [answer() if "no JSON object" in r else "still broken" for r in requests]

    prompts = ["good", "fence", "quotes", "range", "cut", "raise", "known", None]
    rows = spark.createDataFrame([(i, p, DECLARED if p != "good" else None) for i, p in enumerate(prompts)], f"id int, p string, d array<{analysis.MATCH}>").coalesce(1)
    out = {r["id"]: r for r in analysis.analyzed(rows, "id", "p", "d", model, repair).collect()}
    assert [out[i]["rung"] for i in range(8)] == ["parsed", "parsed", "parsed", "declared", "repaired", "declared", "parsed", "declared"]
    assert [[m["quest"] for m in out[i]["matches"]] for i in range(8)] == [["Modal"], ["Codex", "Modal"], ["Codex", "Modal"], ["Codex"], ["Codex", "Modal"], ["Codex"], ["Codex"], ["Codex"]]
    assert out[2]["matches"][1]["evidence"] == 'uses "it" so'
    assert [out[i]["error"] is not None for i in range(8)] == [False, False, False, True, False, True, False, False]
    assert "greater than 0" in out[3]["error"] and "repair failed" in out[3]["error"] and "RuntimeError: down" in out[5]["error"]
    # One call of eight (or seven) that fails, then each by itself.
    assert asked.value == 7 + 7
    alone = {r["id"]: r["rung"] for r in analysis.analyzed(rows, "id", "p", "d", model).collect()}
    assert alone[4] == "declared" and alone[0] == "parsed"
    assert analysis.analyzed(rows.limit(0), "id", "p", "d", model, repair).collect() == []


def test_identity_whatever_the_order(spark):
    rows = spark.createDataFrame([(f"p/{i}", f"prompt {i} é\"") for i in range(30)], "id string, p string")
    want = {}
    for key, prompt in [(f"p/{i}", f"prompt {i} é\"") for i in range(30)]:
        own = {"schema_version": 1, "project_id": key, "prompt_hash": hashlib.sha256(prompt.encode()).hexdigest(), "taxonomy_hash": hashlib.sha256(json.dumps(TAXONOMY, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), "analyzer_fingerprint": {"model": "m", "n": 1}}
        want[key] = hashlib.sha256(json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    for n, taxonomy, analyzer in ((1, TAXONOMY, {"model": "m", "n": 1}), (7, {"a": {"c": "é", "d": [1, 2]}, "b": 1}, {"n": 1, "model": "m"})):
        got = analysis.identified(rows.repartition(n), "id", "p", taxonomy, analyzer)
        assert {r["id"]: r["cache_key"] for r in got.collect()} == want
    texts = ['{"b": {"y": [1, {"d": 1, "c": 2}], "x": null}, "a": "é\\n"}', '{"a":"é\\n","b":{"x":null,"y":[1,{"c":2,"d":1}]}}', "no"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.canonical_json(F.col("t"))).collect()]
    assert got == [texts[1], texts[1], None] == [analysis.canonical(json.loads(texts[0])), texts[1], None]


def test_cache(spark):
    rows = analysis.identified(spark.createDataFrame([(f"p{i}", f"prompt {i}") for i in range(8)], "id string, p string"), "id", "p", TAXONOMY, {"m": 1})
    with_matches = rows.withColumn("matches", F.array(F.struct(F.lit("Modal").alias("quest"), F.lit(0.5).alias("confidence"), F.lit("e").alias("evidence"), F.lit("readme").alias("source"))))
    stored = analysis.entries(with_matches, "id", F.lit("model"), F.lit("2024-01-01T00:00:00+00:00")).collect()
    assert {r["prefix"] == r["cache_key"][:2] for r in stored} == {True}
    places = {r["id"]: r["cache_key"] for r in rows.select("id", "cache_key").collect()}
    whole = {next(i for i, k in places.items() if k == r["cache_key"]): json.loads(r["payload"]) for r in stored}
    whole["p1"]["schema_version"] = 2
    whole["p2"]["prompt_hash"] = "x"
    whole["p3"]["analyzer_fingerprint"] = {"m": 2}
    whole["p4"]["matches"][0]["confidence"] = 7
    payloads = {i: json.dumps(p) for i, p in whole.items()} | {"p5": "{broken", "p6": "[1]"}
    del payloads["p7"]
    cache = spark.createDataFrame([(places[i], p) for i, p in payloads.items()], "cache_key string, payload string")
    found = {r["id"]: r for r in analysis.lookup(rows, cache, "id").collect()}
    assert [found[f"p{i}"]["reason"] for i in range(8)] == ["hit", "invalid_schema:unsupported cache schema", "invalid_schema:cache prompt_hash mismatch", "invalid_schema:cache analyzer_fingerprint mismatch", "invalid_schema:confidence must be greater than 0 and no more than 1", "invalid_json", "invalid_payload", "absent"]
    assert [m["quest"] for m in found["p0"]["cached"]] == ["Modal"] and found["p1"]["cached"] is None
    records = analysis.run_records(analysis.lookup(with_matches, cache, "id"), "id")
    assert {r["id"]: r["status"] for r in records.collect()} == {f"p{i}": "cached" if i == 0 else "analyzed" for i in range(8)}


def rendered(title, sdk, models, tags, readme, name, app, labels):
    """The prompt in plain Python."""
    cut = lambda t, n: t.strip() if len(t.strip()) <= n else t.strip()[:n].rstrip() + " ..."
    meta = json.dumps({"title": title.strip(), "sdk": sdk.strip(), "declared_models": models, "tags": tags}, ensure_ascii=False)
    lines = [*analysis.PROMPT_HEAD, *(f"- {i}: {d}" + (f" Signals: {s}" if s is not None else "") for i, d, s in labels), *analysis.PROMPT_RULES, f"METADATA: {meta}", "", "[README]", cut(readme, 1500) or "(no README description provided)", "", f"[APP_FILE] {name.strip() or '(unknown)'}", cut(app, 1900) or "(no app file available)"]
    return "\n".join(lines)


def test_prompt_byte_for_byte(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice('aé"\\/\t\n <>& 世') for _ in range(n))
    cases = [(text(9), text(5), [text(4), "org/m"], [text(3)], text(n), text(3), text(n + 300), [("A", text(6), text(4)), ("B", "d", None)]) for n in (0, 40, 1500, 1700)]
    cases.append(("", "", [], [], "", "", "", []))
    kind = "title string, sdk string, models array<string>, tags array<string>, readme string, name string, app string, labels array<struct<id:string,description:string,signals:string>>"
    rows = spark.createDataFrame(cases, kind)
    got = [x[0] for x in rows.select(analysis.prompt(*[F.col(c) for c in rows.columns])).collect()]
    assert got == [rendered(*c) for c in cases]
    nothing = spark.range(1).select(analysis.prompt(*[F.lit(None).cast(k) for k in ("string", "string", "array<string>", "array<string>", "string", "string", "string")], F.array().cast("array<struct<id:string,description:string,signals:string>>"))).first()[0]
    assert nothing == rendered(*cases[-1])


def test_artifact_digests(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x").write_bytes(b"1")
    (tmp_path / "a").write_bytes(b"22")
    assert analysis.tree_digest(str(tmp_path)) == hashlib.sha256(b"a\x0022\x00b/x\x001\x00").hexdigest()
    assert analysis.tree_digest(str(tmp_path / "a")) == hashlib.sha256(b"a\x0022\x00").hexdigest() and analysis.file_digest(str(tmp_path / "a")) == hashlib.sha256(b"22").hexdigest()
    assert analysis.tree_digest("") == "" == analysis.tree_digest(str(tmp_path / "none"))
