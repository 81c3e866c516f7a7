"""The crawl connector against a folder and a local server that fails."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corvane.sources import crawl

ITEMS = [
    {"id": "org/tide-clock_2go", "likes": 3, "tags": ["b", "a", "region:us", "a"], "siblings": [{"rfilename": "README.md"}, {"rfilename": "src/app.py"}], "subdomain": "org-tide"},
    {"id": "org/hidden", "private": True},
    {"id": "org/plain", "host": "https://h", "models": ["m"], "cardData": {"title": "Plain One", "models": ["other"], "sdk": "static", "tags": ["x"]}, "sdk": "gradio"},
    {"id": "org/bad path", "siblings": [{"rfilename": "README.md"}]},
    {"id": "org/gone", "siblings": [{"rfilename": "README.md"}]},
    {"no": "id"},
]
READMES = {
    "org/tide-clock_2go": "---\napp_file: ./src//app.py\n---\n\n# Tides\n",
    "org/bad path": "---\napp_file: ../x.py\n---\nbody",
}
APP = "import os\n\ndef tell(tide):\n    return os.path.join('dial', tide)\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "list").mkdir()
    lines = [json.dumps(i) for i in ITEMS]
    (tmp_path / "list/a.jsonl").write_text("\n".join([*lines[:3], "{broken", "", "[1]"]) + "\n")
    (tmp_path / "list/b.jsonl").write_text("\n".join(lines[3:]))
    for key, text in READMES.items():
        (tmp_path / key).mkdir(parents=True)
        (tmp_path / key / "README.md").write_text(text)
    (tmp_path / "org/tide-clock_2go/src").mkdir()
    (tmp_path / "org/tide-clock_2go/src/app.py").write_text(APP)
    return tmp_path


def test_folder(spark, folder):
    pages = crawl.folder_pages(spark, f"file://{folder}/list", ".jsonl")
    assert [p.rpartition("/")[2] for p in pages] == ["a.jsonl", "b.jsonl"]
    out = crawl.crawl(spark, pages, f"file://{folder}", workers=3).orderBy("page", "position").collect()
    assert [(r["page"], r["position"]) for r in out] == [(0, 0), (0, 2), (0, 3), (0, 5), (1, 0), (1, 1), (1, 2)]
    first, plain, broken, lists, bad, gone, nameless = out
    assert first["title"] == "Tide Clock 2Go" and first["tags"] == ["a", "b"] and first["likes"] == 3 and first["error"] is None
    assert first["host"] == "https://org-tide.hf.space" and first["app_file"] == "src/app.py" and first["readme_body"] == "# Tides" and first["app_file_source"] == APP
    assert first["app_file_embedding_text"] == "tell tide os.path.join dial"
    assert (plain["title"], plain["sdk"], plain["models"], plain["tags"], plain["host"]) == ("Plain One", "static", ["m"], ["x"], "https://h")
    assert broken["error"].startswith("not JSON") and lists["error"] == "an item must be an object" and nameless["error"] == "an item without an id"
    assert bad["error"] == "invalid app_file path: ../x.py" and bad["app_file"] == "" and bad["readme_body"] == "body"
    # A file that the listing names and that isn't there is an empty text.
    assert gone["error"] is None and gone["readme_body"] == ""
    assert crawl.crawl(spark, [], "file:///none").collect() == []


def test_server_that_fails(spark, folder):
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            if self.path == "/list" and asked[self.path] == 1 or "bad%20path" in self.path:
                self.send_error(500)
                return
            where = folder / ("list/b.jsonl" if self.path == "/list" else self.path.lstrip("/"))
            if not where.exists():
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(where.read_bytes())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        out = crawl.crawl(spark, [f"{base}/list", f"{base}/nowhere"], base, workers=1, timeout=10).orderBy("page", "position").collect()
    finally:
        server.shutdown()
    assert [r["id"] for r in out] == ["org/bad path", "org/gone", None, None]
    assert "500" in out[0]["error"] and "2 attempts" in out[0]["error"] and asked["/org/bad%20path/README.md"] % 2 == 0
    assert out[1]["error"] is None and "404" in out[3]["error"]


def test_workers(monkeypatch):
    monkeypatch.delenv("CORVANE_CRAWL_WORKERS", raising=False)
    assert [crawl.crawl_workers(x) for x in ("", " 3 ", "0", "-2")] == [12, 3, 1, 1] and crawl.crawl_workers() == 12
    with pytest.raises(ValueError, match="must be an integer"):
        crawl.crawl_workers("many")


@pytest.mark.parametrize(("path", "plain", "wrong"), [("app.py", "app.py", False), (" ./a//b.py ", "a/b.py", False), ("", "", False), (None, "", False), ("/etc/x", "", True), ("a/../x", "", True), ("src/", "", True)])
def test_app_file(spark, path, plain, wrong):
    got = spark.createDataFrame([(path,)], "p string").select(crawl.app_file(F.col("p")).alias("x")).first()["x"]
    assert got["path"] == plain and (got["error"] is not None) == wrong


def test_embedding_text(spark):
    rows = [("A.PY", "def f(x): pass"), ("page.html", "<b>" + "word " * 1000), ("x.py", "not python ("), ("x.py", " "), (None, "text"), (".py", "raw")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, s string").select(crawl.embedding_text(F.col("p"), F.col("s"))).collect()]
    assert got[0] == "f x" and " ... " in got[1] and len(got[1]) <= 2000 and got[2:] == ["not python (", "", "", "raw"]
