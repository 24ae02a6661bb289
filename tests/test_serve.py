"""Command line, settings, JSON-RPC, tools and the streaming refresh."""

import io
import json
import os
import threading
import urllib.request

import pytest
from minirepo import make

from citespan import cli, config
from citespan.serve import index as serving
from citespan.serve.rpc import Server, http_server, serve_stdio
from citespan.streaming.refresh import refresh_stream


def test_rpc():
    server = Server(lambda q: f"re: {q}" if q != "boom" else 1 / 0)
    call = lambda **p: server.handle({"id": 1, "method": "tools/call", "params": p})
    assert server.handle({"id": 1, "method": "initialize"})["result"]["protocolVersion"] and server.handle({"id": 1, "method": "ping"})["result"] == {}
    assert server.handle({"id": 1, "method": "nope"})["error"]["code"] == -32601 and call()["error"]["code"] == -32602 and call(name="x")["error"]["code"] == -32602
    assert call(name="ask")["error"]["message"] == "missing 'question'" and call(name="ask", arguments={"question": " "})["result"]["isError"]
    assert call(name="ask", arguments={"question": "hi"})["result"]["content"][0]["text"] == "re: hi" and call(name="ask", arguments={"question": "boom"})["result"]["isError"]
    assert server.handle_text("{")["error"]["code"] == -32700 and server.handle_text("{")["id"] is None and server.handle({"method": "notifications/initialized"}) is None
    assert server.handle({"id": 1, "method": "resources/list"})["result"] == {"resources": []} and server.handle({"id": 1, "method": "tools/list"})["result"]["tools"][0]["name"] == "ask"
    out = io.StringIO()
    serve_stdio(server, io.StringIO('{"id":7,"method":"ping"}\n\nbad\n{"method":"ping"}\n'), out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [7, None]


def test_http():
    http = http_server(Server(str.upper), 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    post = lambda body: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}/", json.dumps(body).encode()))
    with post({"id": 1, "method": "ping"}) as r:
        assert r.status == 200 and json.load(r)["result"] == {}
    with post({"method": "ping"}) as r:
        assert r.status == 202 and r.read() == b"null"
    http.shutdown()


def test_config(tmp_path, monkeypatch, capsys):
    path = tmp_path / "c" / "config.toml"
    monkeypatch.setenv("CITESPAN_CONFIG", str(path))
    assert config.load() == config.Config()
    assert cli.main(["config", "init"]) == 0 and cli.main(["config", "init"]) == 1
    assert cli.main(["config", "set", "chat.api_key", "s3cret"]) == 0 and cli.main(["config", "set", "model", "m"]) == 0 and cli.main(["config", "set", "summarize.max_input_chars", "9"]) == 0
    assert "s3cret" not in capsys.readouterr().out
    assert cli.main(["config", "show"]) == 0
    shown = capsys.readouterr().out
    assert "s3cret" not in shown and "****" in shown
    assert cli.main(["config", "get", "chat.api_key"]) == 0 and "s3cret" in capsys.readouterr().out and cli.main(["config", "get", "nope"]) == 1
    c = config.load()
    assert (c.chat.api_key, c.default.model, c.summarize.max_input_chars) == ("s3cret", "m", 9)
    assert config.resolve(c, "chat", "model", fallback="z") == "m" and config.resolve(c, "chat", "base_url", fallback="z") == "z" and config.resolve(c, "chat", "model", flag="f") == "f"
    monkeypatch.setenv("CITESPAN_MODEL", "env")
    assert config.resolve(c, "chat", "model", env=config.MODEL_ENV) == "env"


def test_guards_and_info(tmp_path, capsys):
    for bad in ("/", str(tmp_path / "none"), "~"):
        with pytest.raises(SystemExit):
            cli.guard(bad if bad != "~" else str(cli.Path.home()))
    root = make(tmp_path / "r")
    i = cli.project_info(str(root))
    assert (i["name"], i["authors"], i["web_url"]) == ("app", ["A <a@x>", "B"], "https://host.example/team/app")
    for preset, (name, _) in cli.PRESETS.items():
        if not (root / name).exists():
            assert cli.write_preset(str(root), preset).exists()
        with pytest.raises(FileExistsError):
            cli.write_preset(str(root), preset)
    assert cli.slash("/q") == ("exit", "") and cli.slash("hi") is None and cli.slash("/model x") == ("model", "x") and cli.slash("/zz")[0] == "unknown"
    assert cli.elapsed_text(0.0421) == "42ms" and cli.elapsed_text(1.5) == "1.50s" and cli.size_text(1536) == "1.5 KB" and cli.age_text(0, 7200) == "2 hr ago" and cli.continued(["a\\", "b"]) == "a\nb"


def test_ask_and_tools(spark, tmp_path):
    root = make(tmp_path / "r")
    index = serving.Index(spark, str(root), str(tmp_path / "s"), now=lambda: 1_700_000_000)
    index.refresh()
    session = serving.Session()
    assert serving.list_files(index, session, "src/")["files"] == ["src/main.rs"] and serving.list_files(index, session, "zzz")["total"] == 0
    assert serving.find_symbol(index, session, "MAIN")["hits"][0]["path"] == "src/main.rs" and "error" in serving.find_symbol(index, session, " ")
    assert serving.read_file(index, session, "keep.log")["content"] == "yes" and serving.read_file(index, session, "../x")["error"] and "error" in serving.read_file(index, session)
    got = serving.read_project_files(index, None, [{"path": "keep.log"}, {"path": "nope"}])
    assert got["results"][0]["content"] == "yes" and got["results"][1]["error"]
    assert serving.search_project(index, None, "fn main")["hits"][0]["line"] == 6 and "note" in serving.search_project(index, None, "qqqq") and "error" in serving.search_project(index, None, "a(")
    answer = serving.ask(index, "Where is main?")
    assert answer.spans and answer.text.endswith("**Sources:**\n- src/main.rs:6\n")


def test_model_client(monkeypatch):
    from citespan.serve.model import DirSummarizer, FileSummarizer, Model, ModelError, answerer

    sent, replies = [], []
    monkeypatch.setattr(Model, "send", lambda self, **body: sent.append(body) or replies.pop(0))
    m = Model("http://x/v1", "m")
    replies += [{"content": " three lines "}, {"content": "", "reasoning": "thought"}, {"content": ""}]
    assert FileSummarizer(m)("a.py", "python", "x") == "three lines" and sent[0]["max_tokens"] == 1200 and sent[0]["temperature"] == 0
    assert DirSummarizer(m)("p") == "thought" and sent[1]["max_tokens"] == 800
    with pytest.raises(ModelError):
        m.complete("p", 1)
    replies += [{"tool_calls": [{"id": "1", "function": {"name": "list_files", "arguments": "{}"}}, {"id": "2", "function": {"name": "read_file", "arguments": "{"}}]}, {"content": "done"}]
    events = []
    assert answerer(m, lambda k, w: events.append(k))("q", lambda tool, **a: {"tool": tool}) == "done"
    assert events == ["call", "response", "response", "content"] and "bad arguments" in sent[-1]["messages"][-2]["content"]
    monkeypatch.setenv("CITESPAN_CONFIG", "/nonexistent/c.toml")
    monkeypatch.delenv("CITESPAN_API_KEY", raising=False)
    with pytest.raises(ModelError):
        Model.of("chat")


def test_streamed_turns_and_cancelling(monkeypatch):
    import http.server
    import threading

    from citespan.serve.model import Cancelled, Model, answerer

    say = lambda **delta: f"data: {json.dumps({'choices': [{'delta': delta}]})}\n\n".encode()
    turns = [
        [say(reasoning="hm"), say(tool_calls=[{"index": 0, "id": "1", "function": {"name": "list_files", "arguments": "{\"path_"}}]), say(tool_calls=[{"index": 0, "function": {"arguments": "contains\": \"a\"}"}}]), b": note\n\n", b"data: [DONE]\n\n"],
        [say(content="do"), say(content="ne"), b"data: {\"choices\": []}\n\n", b"data: [DONE]\n\n"],
    ]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            for part in turns.pop(0):
                self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        m, events = Model(f"http://127.0.0.1:{server.server_port}/v1", "m", timeout=10), []
        again = list(turns)
        assert answerer(m, lambda k, w: events.append((k, w)), streaming=True)("q", lambda tool, **a: {"got": a}) == "done"
        assert events == [("reasoning", "hm"), ("call", ("list_files", {"path_contains": "a"})), ("response", ("list_files", {"got": {"path_contains": "a"}})), ("content", "do"), ("content", "ne")]
        turns += again
        heard = []
        with pytest.raises(Cancelled):
            answerer(m, lambda k, w: heard.append(k), streaming=True, cancelled=lambda: bool(heard))("q", lambda tool, **a: {})
        assert heard == ["reasoning"]
    finally:
        server.shutdown()


def test_summaries_and_their_search(spark, tmp_path):
    root = make(tmp_path / "r")
    times = iter(range(1_700_000_000, 1_700_001_000))
    index = serving.Index(spark, str(root), str(tmp_path / "s"), now=lambda: next(times))
    index.refresh()
    assert serving.semantic_search(index, None, "anything") == {"hits": [], "count": 0, "truncated": False}
    files, dirs = index.summarize(lambda path, lang, content: f"Running functions of {path.replace('/', ' ')}")
    known = {r.path for r in index.table("file_summaries").collect()}
    assert files == len(known) > 5 and dirs == index.table("dir_hashes").count() == index.table("dir_summaries").count()
    assert not known & {"bin.dat", "latin1.txt", "big.py"}
    got = serving.semantic_search(index, None, "function runs main", 5)
    assert [h["path"] for h in got["hits"]] == ["src/main.rs"] and not got["truncated"] and got["hits"][0]["rank"] < 0
    assert serving.semantic_search(index, None, "functions", 3)["truncated"] and "error" in serving.semantic_search(index, None, "AND") and "error" in serving.semantic_search(index, None, " ")
    assert index.summarize(lambda *_: 1 / 0) == (0, 0)
    # A changed file's summary is no longer valid and is made anew; a deleted file's leaves the text index.
    (root / "src" / "main.rs").write_text("fn other() {}\n")
    (root / "keep.log").unlink()
    index.refresh()
    assert "keep.log" not in {r.path for r in index.table("postings").collect()} and "keep.log" not in {r.path for r in index.table("doc_lengths").collect()}
    assert index.summarize(lambda path, lang, content: f"Rewritten {content}")[0] == 1
    assert [h["path"] for h in serving.semantic_search(index, None, "rewritten other")["hits"]] == ["src/main.rs"] and not serving.semantic_search(index, None, "main")["hits"]
    assert {r.term for r in index.table("postings").filter("path = 'src/main.rs'").collect()} == {"rewritten", "fn", "other"}


def test_search_by_grams_sees_live_files(spark, tmp_path):
    """Files that changed after the refresh are found too; unchanged ones only if the index allows."""
    root = make(tmp_path / "repo")
    for p in root.rglob("*"):
        if p.is_file():
            os.utime(p, (1_000, 1_000))
    index = serving.Index(spark, str(root), str(tmp_path / "store"))
    index.refresh()
    read = lambda pattern: {r.path for r in index.searchable(pattern).select("path").collect()}
    assert read("needle") == {"big.py"} and "src/main.rs" in read("struct S") and len(read("struct S")) < 5
    (root / "new.txt").write_text("a needle in here")
    (root / "keep.log").write_text("needle, too")
    assert read("needle") == {"big.py", "new.txt", "keep.log"}
    got = serving.search_project(index, None, "NEEDLE", case_insensitive=True, max_hits=1000)["hits"]
    assert {h["path"] for h in got} >= {"big.py"} and {h["path"] for h in serving.search_project(index, None, "needle", "keep")["hits"]} == {"keep.log"}


def test_streaming_refresh(spark, tmp_path):
    from citespan.operators.snapshot import SnapshotStore

    events = str(tmp_path / "events")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, size long, mtime long, content binary").coalesce(1).write.mode("append").parquet(events)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    read = lambda: spark.readStream.schema("path string, size long, mtime long, content binary").parquet(events)
    rows(("a.py", 12, 1, b"def f(): 1\n"), ("b.py", 12, 1, b"def g(): 1\n"))
    refresh_stream(read(), store, lambda: 5, str(tmp_path / "cp")).awaitTermination()
    assert {r.name for r in store.read("symbols").collect()} == {"f", "g"}
    rows(("a.py", 13, 2, b"def h(): 1\n"), ("b.py", 0, 2, None))
    refresh_stream(read(), store, lambda: 6, str(tmp_path / "cp")).awaitTermination()
    assert {r.name for r in store.read("symbols").collect()} == {"h"} and [r.path for r in store.read("files").collect()] == ["a.py"]
