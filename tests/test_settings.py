"""Settings, small files, leases and tolerant parsing."""

import pytest
from pyspark.sql import functions as F

from corvane import settings
from corvane.functions import text as T
from corvane.operators import dashboard, labels
from corvane.sources import snapshots
from corvane.streaming import refresh
from tests.test_mechanisms import made_payload


def test_settings(monkeypatch):
    env = {"A": " Yes ", "B": "off", "C": "maybe", "D": " 7 ", "E": "x", "F": " "}
    assert [settings.flag(n, env=env) for n in "ABCDZ"] == [True, False, None, None, None] and settings.flag("C", True, env) is True
    assert settings.whole("D", env=env) == 7 and settings.whole("F", 3, env=env) == 3 and settings.whole("Z", env=env) is None
    for name, low, high in (("E", None, None), ("D", 8, None), ("D", None, 6)):
        with pytest.raises(settings.SettingError):
            settings.whole(name, 1, low, high, env)
    assert settings.text("A", env=env) == " Yes " and settings.text("Z", "d", env) == "d" and settings.first(["Z", "F", "D"], "q", env) == "7" and settings.first(["Z"], "q", env) == "q"
    monkeypatch.setenv("CORVANE_TEST", "on")
    assert settings.flag("CORVANE_TEST") is True and settings.utc_now().endswith("+00:00")


def test_tolerant_parsing(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("[1, 2]",), ("broken",), (None,), ("",)], "j string")
    got = rows.select(F.to_json(T.object_or_empty(F.col("j"))).alias("o"), F.size(T.list_or_empty(F.col("j"))).alias("n")).collect()
    assert [(r["o"], r["n"]) for r in got] == [('{"a":1}', 0), ("{}", 2), ("{}", 0), ("{}", 0), ("{}", 0)]


def test_small_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    snapshots.write_json(spark, f"{root}/x.json", {"b": "é", "a": [1]})
    assert (tmp_path / "x.json").read_text() == '{\n  "b": "é",\n  "a": [\n    1\n  ]\n}\n' and snapshots.read_json(spark, f"{root}/x.json") == {"b": "é", "a": [1]}
    snapshots.write_json(spark, f"{root}/x.json", [1])
    (tmp_path / "y.json").write_text("{broken")
    for name in "xy":
        with pytest.raises(snapshots.SnapshotError):
            snapshots.read_json(spark, f"{root}/{name}.json")
    assert snapshots.read_json(spark, f"{root}/none.json") is None and snapshots.require_writable(spark, root) == root
    with pytest.raises(snapshots.SnapshotError, match="no folder"):
        snapshots.require_writable(spark, f"{root}/x.json")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["x.json", "y.json"]


def test_stored_dashboards(spark, tmp_path):
    root = f"file://{tmp_path}"
    bundled = {"points": spark.range(3)}
    assert snapshots.initial(spark, root, bundled) is bundled and snapshots.initial(spark, None, bundled) is bundled
    parts = dashboard.payload(*made_payload(spark), "id", T.tokens(F.col("title")), "rules", "2024")
    dashboard.publish(parts, root, "run-1", "id")
    assert dashboard.latest(spark, root, "id")["points"].count() == 6 and snapshots.initial(spark, root, bundled)["points"].count() == 6
    snapshots.write_snapshot(spark, root, "run-2", {**parts, "links": spark.createDataFrame([(0, 99, 1.0)], "source long, target long, score double")})
    with pytest.raises(labels.LabelError):
        dashboard.latest(spark, root, "id")
    snapshots.write_snapshot(spark, root, "run-3", {"points": parts["points"]})
    with pytest.raises(snapshots.SnapshotError, match="lacks"):
        dashboard.latest(spark, root, "id")


def test_leases(spark, tmp_path):
    now = [100.0]
    make = lambda run: refresh.Lease(spark, f"file://{tmp_path}", run, 10, lambda: now[0])
    a, b = make("a"), make("b")
    assert a.holder() is None and not a.renew() and not a.release()
    a.acquire()
    with pytest.raises(refresh.LeaseTaken, match="run a"):
        b.acquire()
    assert not b.release() and not b.renew() and a.holder() == "a"
    now[0] = 109
    assert a.renew()
    now[0] = 115
    with pytest.raises(refresh.LeaseTaken):
        b.acquire()
    now[0] = 120
    b.acquire()
    assert not a.renew() and not a.release() and b.release() and b.holder() is None
    (tmp_path / "refresh.lease").write_text("{broken")
    (tmp_path / ".refresh.lease.crc").unlink(missing_ok=True)
    a.acquire()
    assert a.holder() == "a"
