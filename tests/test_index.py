import io
import json
import os
import pickle
import re
import socket
import subprocess
import threading
from datetime import UTC, datetime, timedelta
from http.client import HTTPConnection
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from gleaner import cli
from gleaner.errors import ConfigError, EmbedderError, StaleSchemaError, StoreError
from gleaner.operators import ranking, schema
from gleaner.operators.embedding import HashingEmbedder, HttpEmbedder, batch_numbers
from gleaner.operators.indexer import index_source
from gleaner.operators.store import Files, FreshnessLog, JsonFile, Store, keep_since
from gleaner.sources import config as cfg
from gleaner.sources import files as fs


class Clock:
    def __init__(self):
        self.now = datetime(2026, 1, 1, tzinfo=UTC)

    def __call__(self):
        self.now += timedelta(minutes=1)
        return self.now


def _source(path, **more):
    return cfg.SourceConfig("notes", path, "markdown", **more)


def _run(store, source, embedder=HashingEmbedder(4), force=False):
    return {os.path.basename(r["path"]): r["status"] for r in index_source(store, source, embedder, force)}


class Failing(HashingEmbedder):
    def vector(self, text):
        raise EmbedderError("service is down")


def test_index_life(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.md").write_text("# A\nalpha\n")
    (tree / "b.py").write_bytes(b"x\r\ny\xff\n")
    (tree / "empty.md").write_text(" \n")
    (tree / ".hidden.md").write_text("# H\n")
    (tree / "skip.png").write_text("no")
    (tree / "big.txt").write_text("x" * 1_048_576)
    store = Store(spark, f"{tmp_path}/db", 4, clock=Clock())
    first = _run(store, _source(tree))
    assert first == {"a.md": "embedded", "b.py": "embedded", "empty.md": "empty", ".hidden.md": "embedded", "big.txt": "skipped_oversize"}
    rows = {os.path.basename(r["source_path"]): r for r in store.table("notes").collect()}
    assert rows["b.py"]["text"] == "x\ny�\n" and rows["a.md"]["heading_path"] == "/A" and len(rows["a.md"]["vector"]) == 4
    second = _run(store, _source(tree))
    assert second == first | {"a.md": "unchanged", "b.py": "unchanged", ".hidden.md": "unchanged"}
    (tree / "a.md").write_text("# A\nbeta\n")
    (tree / "b.py").unlink()
    assert _run(store, _source(tree), Failing(4)) == first | {"a.md": "error", ".hidden.md": "unchanged", "empty.md": "error", "b.py": "deleted"}
    assert store.table("notes").where("text like '%alpha%'").count() == 1
    third = _run(store, _source(tree))
    assert third["a.md"] == "embedded" and store.counts() == {"notes": 2}
    assert set(_run(store, _source(tree), force=True).values()) == {"embedded", "empty", "skipped_oversize"}


def test_store_changes(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db", 1, keep_runs=2, clock=Clock())
    store.ensure("s")
    store.ensure("s")
    row = lambda p, t: (f"{p}::0", p, "h", 0, 0, 1, "", t, [1.0], None, None, [], "text")
    make = lambda *rows: spark.createDataFrame(list(rows), store.table("s").schema)
    store.upsert("s", make(row("it's", "a"), row("q", "b")))
    store.upsert("s", make(row("q", "c")))
    assert {r["text"] for r in store.table("s").collect()} == {"a", "c"}
    assert store.delete_file("s", "it's") == 1 and store.delete_file("s", "it's") == 0
    with pytest.raises(ValueError, match="dim"):
        store.upsert("s", make(row("w", "d")).withColumn("vector", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))))
    for text in "defgh":
        store.upsert("s", make(row("q", text)))
        store.optimize("s")
    states = {store.table("s", v).where("source_path = 'q'").first()["text"] for v in store.versions("s")[1:]}
    assert 2 <= len(states) <= 4 and "h" in states
    assert len(store.run_log.read()["s"]) == 3
    store.optimize("s", keep_runs=0)
    assert len(store.versions("s")) == 1
    store.ensure("t")
    store.optimize("t")
    store.recreate("s")
    assert store.counts() == {"s": 0, "t": 0} and set(store.run_log.read()) == {"t"}


def _row(path, text):
    return (f"{path}::0", path, "h", 0, 0, 1, "", text, [1.0], None, None, [], "text")


def _found(store, word):
    scores = ranking.bm25_scores(store.terms(), ranking.make_queries(store.spark, [(0, word, [1.0])]))
    return sorted(r["id"] for r in scores.collect())


def test_a_change_writes_what_has_changed(spark, tmp_path):
    """Parts hide older rows and their postings, merge into one, and go when no version needs them."""
    store = Store(spark, f"{tmp_path}/db", 1, clock=Clock(), merge_at=4)
    make = lambda *rows: spark.createDataFrame(list(rows), schema.CHUNK_SCHEMA)
    store.ensure("s")
    store.upsert("s", make(_row("a", "otter raft"), _row("b", "otter")))
    first = store.parts("s")
    store.commit("s", make(_row("a", "heron")), spark.createDataFrame([("a",), ("new",)], "source_path string"))
    assert store.parts("s")[:-1] == first and spark.read.parquet(f"{tmp_path}/db/s/{store.parts('s')[-1]['part']}/rows").count() == 1
    assert _found(store, "otter") == ["b::0"] and _found(store, "heron") == ["a::0"]
    store.delete_file("s", "b")
    assert _found(store, "otter") == [] and store.counts() == {"s": 1} and len(store.parts("s")) == 4
    assert [r["text"] for r in store.by_ids("s", ["a::0", "a::0", "b::0"]).collect()] == ["heron"]
    assert store.table("s", 2).count() == 2
    store.upsert("s", make(_row("b", "otter again")))
    store.optimize("s", keep_runs=0)
    (only,) = store.parts("s")
    assert not only["hides"] and sorted(os.listdir(f"{tmp_path}/db/s")) == [only["part"]]
    assert store.counts() == {"s": 2} and _found(store, "otter") == ["b::0"]


def test_only_rows_that_can_be_hidden_are_joined(spark, tmp_path):
    """Empty parts are no part of a plan, and rows of the last part that hides pass by the join."""
    store = Store(spark, f"{tmp_path}/db", 1, clock=Clock())
    make = lambda *rows: spark.createDataFrame(list(rows), schema.CHUNK_SCHEMA)
    plan = lambda: store.corpus()._jdf.queryExecution().optimizedPlan().toString()
    store.ensure("s")
    assert store.corpus().collect() == []
    store.upsert("s", make(_row("a", "otter"), _row("b", "otter")))
    assert "Join" not in plan() and "Union" not in plan()
    store.commit("s", make(), spark.createDataFrame([("a",)], "source_path string"))
    store.upsert("s", make(_row("b", "heron"), _row("c", "heron")))
    assert "LeftAnti" in plan()
    assert sorted((r["id"], r["text"]) for r in store.table("s").collect()) == [("b::0", "heron"), ("c::0", "heron")]
    assert _found(store, "otter") == [] and _found(store, "heron") == ["b::0", "c::0"]
    store.delete_file("s", "b")
    store.delete_file("s", "c")
    assert store.table("s").collect() == [] and store.counts() == {"s": 0}


def test_two_writers(spark, tmp_path, monkeypatch):
    """The one that comes second builds on the first, and a merge that was overtaken is dropped."""
    one, two = Store(spark, f"{tmp_path}/db", 1), Store(spark, f"{tmp_path}/db", 1)
    make = lambda *rows: spark.createDataFrame(list(rows), schema.CHUNK_SCHEMA)
    one.ensure("s")
    two.ensure("s")
    write, busy = Files.write, []

    def late(self, path, content, replace):
        if "/manifest/" in path and not busy:
            busy.append(path)
            two.upsert("s", make(_row("b", "second")))
        return write(self, path, content, replace)

    monkeypatch.setattr(Files, "write", late)
    one.upsert("s", make(_row("a", "first")))
    assert sorted(r["text"] for r in one.table("s").collect()) == ["first", "second"] and len(one.versions("s")) == 3
    busy.clear()
    real = Store._write

    def slow(self, *args):
        part = real(self, *args)
        if self is one:
            two.delete_file("s", "a")
        return part

    monkeypatch.setattr(Files, "write", write)
    monkeypatch.setattr(Store, "_write", slow)
    one.merge("s")
    assert [r["text"] for r in one.table("s").collect()] == ["second"] and len(one.parts("s")) == 4


def test_trouble_with_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/db", 1, clock=Clock(), merge_at=2)
    make = lambda *rows: spark.createDataFrame(list(rows), schema.CHUNK_SCHEMA)
    store.ensure("other")
    store.ensure("s")
    for text in "ab":
        store.upsert("s", make(_row("p", text)))
    there = sorted(os.listdir(f"{tmp_path}/db/s"))

    def broken(*args, **kwargs):
        raise StoreError("no answer")

    for name in ("read", "write"):
        with monkeypatch.context() as patch:
            patch.setattr(Files, name, broken)
            for act in (lambda: store.upsert("s", make(_row("p", "c"))), lambda: store.optimize("s", keep_runs=0)):
                with pytest.raises(StoreError):
                    act()
    assert set(there) <= set(os.listdir(f"{tmp_path}/db/s")) and store.names() == ["other", "s"]
    assert [r["text"] for r in store.table("s").collect()] == ["b"] and store.table("s", 2).count() == 1
    newest = max(os.listdir(f"{tmp_path}/db/manifest"), key=lambda n: (n[0] != ".", len(n), n))
    (tmp_path / "db" / "manifest" / newest).write_text("{")
    for crc in (tmp_path / "db" / "manifest").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(StoreError, match="damaged"):
        store.upsert("s", make(_row("p", "c")))
    (tmp_path / "db" / "run_log.json").write_text("{")
    assert JsonFile(spark, f"{tmp_path}/db/run_log.json").read() == {}


def test_only_the_embedders_faults_are_kept(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.md").write_text("# A\nalpha\n")

    class Buggy(HashingEmbedder):
        def vector(self, text):
            raise KeyError("a bug")

    store = Store(spark, f"{tmp_path}/db", 4, clock=Clock())
    assert [(r["status"], r["error"]) for r in index_source(store, _source(tree), Failing(4))] == [("error", "service is down")]
    assert [r["status"] for r in index_source(store, _source(tree), HashingEmbedder(5))] == ["error"]
    with pytest.raises(PythonException, match="a bug"):
        index_source(store, _source(tree), Buggy(4))


def test_stale_tables(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db", 4)
    old = store.spark.createDataFrame([("p::0", "p", "h", 0, 0, 1, "", "x", [1.0])], "id string, source_path string, file_hash string, chunk_index long, char_start long, char_end long, heading_path string, text string, vector array<float>")
    store._commit("notes", old)
    assert store.stale(["notes", "absent"]) == ["notes"] and store.table("notes").first()["kind"] == "text"
    (tmp_path / "tree").mkdir()
    with pytest.raises(StaleSchemaError):
        index_source(store, _source(tmp_path / "tree"), HashingEmbedder(4))
    assert store.counts() == {"notes": 1}
    index_source(store, _source(tmp_path / "tree"), HashingEmbedder(4), force=True)
    assert store.stale(["notes"]) == []


def test_retention_rule():
    now = datetime(2026, 1, 2, tzinfo=UTC)
    days = [(now - timedelta(days=d)).isoformat() for d in (3, 2, 1)]
    assert keep_since(days, 0, now) == timedelta(0)
    assert keep_since(days, 2, now) == timedelta(days=2)
    assert keep_since(days, 4, now) > timedelta(days=10_000) and keep_since(["bad"], 1, now) > timedelta(days=10_000)
    assert keep_since([(now + timedelta(days=1)).isoformat()], 1, now) == timedelta(0)


def test_freshness(spark, tmp_path):
    log = FreshnessLog(spark, f"{tmp_path}/db", Clock())
    assert log.read() == {}
    log.record_run("s", [{"path": "a", "status": "embedded"}, {"path": "b", "status": "error", "error": "boom"}, {"path": "c", "status": "error", "error": "boom"}, {"path": "d", "status": "skipped_unreadable"}], "m")
    first = log.read()["s"]
    assert first["failures"] == [{"error": "boom", "count": 2, "example_path": "b"}, {"error": "skipped_unreadable", "count": 1, "example_path": "d"}]
    log.record_run("s", [{"path": "a", "status": "unchanged"}], "m")
    assert log.read()["s"]["last_change"] == first["last_change"] != log.read()["s"]["last_run"]
    log.record_error(["s", "new"], "down")
    assert log.read()["s"]["last_run"] and log.read()["new"]["last_run"] is None and log.read()["new"]["last_error"] == "down"


@pytest.mark.parametrize(("globs", "path", "hit"), [
    ([".editor/**"], ".editor/config.json", True), ([".editor/**"], ".editor/deep/more.json", True), (["*.tmp"], "a/b/c.tmp", True), (["/a"], "b/a", False),
    (["a/"], "x/a/y", True), (["a/"], "a", False), (["a"], "x/a/y", True), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True), (["**/b"], "x/b", True), (["?.md"], "ab.md", False),
    (["[ab].md"], "b.md", True), (["[!ab].md"], "b.md", False), (["*.md", "!keep.md"], "keep.md", False), (["!keep.md", "*.md"], "keep.md", True), (["# no", ""], "# no", False), (["\\#x"], "#x", True),
    (["a*"], "ab/c", True), (["a/*"], "a/b/c", True), (["*/c"], "a/b/c", False),
])
def test_ignore_patterns(spark, globs, path, hit):
    state = False
    for regex, negated in filter(None, map(fs.glob_regex, globs)):
        state = (not negated) if re.search(regex, path) else state
    assert state is hit


def test_git_walk(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "build").mkdir(parents=True)
    for name in ("keep.py", "secret.py", "build/out.py"):
        (root / name).write_text("x")
    (root / ".gitignore").write_text("build/\nsecret.py\n")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    names = lambda df: sorted(r["rel_path"] for r in df.collect())
    assert names(fs.walk(spark, root, respect_gitignore=True)) == ["keep.py"]
    assert "secret.py" in names(fs.walk(spark, root))
    assert names(fs.walk(spark, root / "build", respect_gitignore=True)) == ["out.py"]


class _Service(BaseHTTPRequestHandler):
    sizes: list[int] = []

    def log_message(self, *args):
        pass

    def _send(self, value):
        body = json.dumps(value).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._send({"models": [{"name": "m:latest"}]})

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        self.sizes.append(len(texts))
        self._send({"embeddings": [[0.6, 0.8]] * (len(texts) - (texts[0] == "short"))})


def test_http_embedder(spark):
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpEmbedder(f"http://127.0.0.1:{server.server_port}", "m", 2)
    client.health_check()
    client.verify_normalization()
    assert len(client.embed(["t"] * 130)) == 130 and _Service.sizes[-3:] == [64, 64, 2] and client.embed([]) == []
    rows = spark.range(3).select(client.embed_column(F.lit("x")).alias("v")).collect()
    assert [len(r["v"]) for r in rows] == [2, 2, 2]
    for bad, match in ((["short"], "expected 1"), (["y" * 30_001], "30001")):
        with pytest.raises(EmbedderError, match=match):
            client.embed(bad)
    with pytest.raises(EmbedderError, match="list of 3"):
        HttpEmbedder(client.url, "m", 3).embed(["x"])
    with pytest.raises(EmbedderError, match="pull"):
        HttpEmbedder(client.url, "other", 2).health_check()
    server.shutdown()
    server.server_close()
    with pytest.raises(EmbedderError):
        client.health_check()
    with pytest.raises(ValueError, match="batch_size"):
        HttpEmbedder("u", "m", 2, batch_size=0)
    with pytest.raises(ValueError, match="batch"):
        batch_numbers(spark.range(1), ["id"], 0)


def test_lines_to_the_service(spark):
    """A client keeps its line, opens another when the service has ended it, and leaves one that was handed in open."""
    lines = []

    class Kept(_Service):
        protocol_version = "HTTP/1.1"

        def setup(self):
            lines.append(self)
            super().setup()

        def _send(self, value):
            body = json.dumps(value).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Kept)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    with HttpEmbedder(url, "m", 2) as client:
        client.health_check()
        client.embed(["a"])
        assert len(lines) == 1
        lines[0].connection.shutdown(socket.SHUT_RDWR)
        client.embed(["a"])
        assert len(lines) == 2
        assert pickle.loads(pickle.dumps(client)) == HttpEmbedder(url, "m", 2)
    assert client._own is None
    handed = HTTPConnection("127.0.0.1", server.server_port)
    with HttpEmbedder(url, "m", 2, connection=handed) as client:
        client.embed(["a"])
    assert handed.sock is not None
    handed.close()
    server.shutdown()
    server.server_close()


def _toml(tmp_path, **changes):
    parts = {"db": f'db_path = "{tmp_path}/db"', "embedding": '[embedding]\nprovider="hashing"\nmodel="m"\nurl="u"\ndim=16',
             "sources": f'[[sources]]\nname="notes"\npath="{tmp_path}/tree"\ntype="markdown"', "store": ""} | changes
    (tmp_path / "tree").mkdir(exist_ok=True)
    file = tmp_path / "config.toml"
    file.write_text("\n".join(parts.values()), encoding="utf-8-sig")
    return file


@pytest.mark.parametrize(("changes", "match"), [
    ({"db": ""}, "db_path: is needed"), ({"db": "db_path = 1"}, "db_path: should be a text, not 1"), ({"embedding": '[embedding]\nprovider="p"\nmodel="m"\nurl="u"\ndim=true'}, "embedding.dim: .* not True"),
    ({"embedding": '[embedding]\nmodel=2\nurl="u"\ndim=8'}, "embedding.provider: is needed; embedding.model: should be a text"), ({"embedding": "embedding = 1"}, "embedding: should be a table"),
    ({"sources": "sources = []"}, "sources: should be a list"), ({"sources": "sources = [1]"}, "sources.0.: should be a table"), ({"store": "[store]\nkeep_runs = 2.5"}, "store.keep_runs"), ({"store": "[store]\nkeep_runs = -1"}, "from 0"),
    ({"store": "[store]\nkeep_runs = true"}, "store.keep_runs"), ({"store": 'ignore = "x"'}, "ignore: should be a list"), ({"store": "respect_gitignore = 1"}, "true or false"), ({"store": 'status_field = ""'}, "status_field"),
    ({"store": 'date_fields = [""]'}, "date_fields"), ({"db": "x ="}, "not TOML"), ({"store": 'type = "prose"', "sources": '[[sources]]\nname="n"\npath="/absent"'}, "type: should be one of code, markdown, not 'prose'; .*path: should be"),
])
def test_bad_configs(tmp_path, changes, match):
    if changes.get("sources", "").startswith("sources") or changes.get("embedding", "").startswith("embedding"):
        top = [v for v in changes.values() if v[0] != "["]
        changes = {"db": "\n".join(['db_path = "x"', *top]), **{k: "" for k in changes}}
    with pytest.raises(ConfigError, match=match):
        cfg.load(_toml(tmp_path, **changes))


def test_repeated_names(tmp_path):
    source = f'[[sources]]\nname="notes"\npath="{tmp_path}"\ntype="code"\n'
    with pytest.raises(ConfigError, match="sources.1..name: 'notes' is taken"):
        cfg.load(_toml(tmp_path, sources=source * 2))


def test_config_defaults(tmp_path, monkeypatch):
    config = cfg.load(_toml(tmp_path, store="date_fields = []"))
    assert config.keep_runs == 24 and config.sources[0].frontmatter.date_fields == () and config.sources[0].ignore == []
    with pytest.raises(ConfigError, match="no such file"):
        cfg.load(tmp_path / "absent")
    monkeypatch.setenv(cfg.ENV, str(tmp_path / "c.toml"))
    assert cfg.default_path() == tmp_path / "c.toml"
    (tmp_path / "latin").write_bytes(b"\xe9 = 1")
    with pytest.raises(ConfigError, match="not UTF-8"):
        cfg.load(tmp_path / "latin")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    file = str(_toml(tmp_path))
    (tmp_path / "tree" / "a.md").write_text("---\nstatus: done\n---\n# Otter\notter raft\n")
    run = lambda *args: cli.main(["--config", file, *args], spark)
    assert run("eval", "--golden", file) == 2
    assert run("index") == 0 and "1 embedded" in capsys.readouterr().out
    assert run("index", "nope") == 2 and run("search", "x", "--sources", "nope") == 2 and run("bogus") == 2
    assert run("list") == 0 and capsys.readouterr().out == "notes\t1\n"
    assert run("search", "otter") == 0
    out = capsys.readouterr().out
    assert "heading_path: /Otter" in out and "status: done" in out and "bm25=0." in out
    golden = tmp_path / "g.toml"
    golden.write_text('[[queries]]\nquery="otter"\nexpected_paths=["a.md"]\n')
    assert run("eval", "--golden", str(golden)) == 0 and "recall@5 1.000" in capsys.readouterr().out
    ask = [{"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "otter", "k": 3}}},
           {"id": 4, "method": "tools/call", "params": {"name": "search"}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "tools/call", "params": {"name": "list_sources"}}, {"id": 7, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "x", "k": "y"}}}]
    monkeypatch.setattr("sys.stdin", io.StringIO("".join(json.dumps(m) + "\n" for m in ask) + "\n{\n[]\n"))
    assert run("serve") == 0
    answers = {a["id"]: a for a in map(json.loads, capsys.readouterr().out.splitlines()) if a["id"]}
    assert [t["name"] for t in answers[2]["result"]["tools"]] == ["search", "list_sources", "index_status"]
    hit = json.loads(answers[3]["result"]["content"][0]["text"])[0]
    assert len(hit) == 13 and hit["status"] == "done" and hit["note_date"] is None and hit["bm25"] > 0
    assert answers[4]["error"]["code"] == -32602 and answers[5]["error"]["code"] == -32601 and answers[7]["result"]["isError"]
    assert json.loads(answers[6]["result"]["content"][0]["text"]) == [{"name": "notes", "chunk_count": 1}]
    assert run("status") == 0 and json.loads(capsys.readouterr().out)["total_chunks"] == 1
    assert cli.main(["--config", str(tmp_path / "absent"), "list"], spark) == 2
