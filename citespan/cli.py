"""The command line: scan, info, chat, cache, mcp and config."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from . import config
from .functions.hashing import repo_id
from .operators.extract.manifests import detect_header, git_remote, web_url


class Refused(SystemExit):
    pass


def guard(root: str) -> str:
    """The folder's absolute path; exits with 1 for what isn't a folder, for / and for the home folder."""
    path = Path(root).resolve()
    problem = "not a directory" if not path.is_dir() else "refusing to index the file system root" if path == Path("/") else "refusing to index the home directory" if path == Path.home().resolve() else ""
    if problem:
        print(f"{problem}: {root}", file=sys.stderr)
        raise Refused(1)
    return str(path)


def project_info(root: str) -> dict:
    name, authors = detect_header(root)
    git = Path(root) / ".git"
    remote = git_remote(git)
    return {"name": name, "authors": authors, "git_init": git.exists(), "remote_url": remote, "web_url": web_url(remote), "abs_path": os.path.abspath(root)}


def size_text(n: int) -> str:
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"


def age_text(unix: int, now: float) -> str:
    diff = int(now) - unix
    if diff < 60:
        return "just now"
    return next(f"{diff // s} {u} ago" for s, u, most in ((60, "min", 3600), (3600, "hr", 86400), (86400, "days", 1 << 62)) if diff < most)


def elapsed_text(seconds: float) -> str:
    ms = int(seconds * 1000)
    return f"{ms}ms" if ms < 1000 else f"{seconds:.2f}s"


PRESETS = {
    "claude": (".mcp.json", lambda root: {"mcpServers": {"citespan": {"command": "citespan", "args": ["mcp", "serve", root]}}}),
    "vscode": (".vscode/mcp.json", lambda root: {"servers": {"citespan": {"type": "stdio", "command": "citespan", "args": ["mcp", "serve", root]}}}),
    "cursor": (".cursor/mcp.json", lambda root: {"mcpServers": {"citespan": {"command": "citespan", "args": ["mcp", "serve", root]}}}),
    "zed": (".zed/settings.json", lambda root: {"context_servers": {"citespan": {"command": "citespan", "args": ["mcp", "serve", root]}}}),
}


def write_preset(root: str, preset: str) -> Path:
    """Write an editor's integration file; raises FileExistsError rather than overwrite."""
    name, make = PRESETS[preset]
    path = Path(root) / name
    if path.exists():
        raise FileExistsError(f"already exists: {path}")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(make(os.path.abspath(root)), indent=2) + "\n", "utf-8")
    return path


def _index(root: str):
    from .serve.index import Index
    from .session import session

    spark = session(os.environ.get("CITESPAN_MASTER", "local[*]"), 8, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    return Index(spark, guard(root))


def _print_report(index, report) -> None:
    r = report
    print(f"index: {index.store.folder}")
    print(f"repo_id: {repo_id(index.root, git_remote(Path(index.root) / '.git'))}")
    print(f"scanned={r.scanned} new={r.added} changed={r.changed} unchanged={r.unchanged} removed={r.deleted}")
    print(f"manifests={r.manifests} run_configs={r.run_configs} readmes={r.readmes} symbols={r.symbols_total} symbol_files={r.symbols_files}")


def cache(args) -> int:
    from .operators import aggregates

    index = _index(args.path)
    if args.op == "build":
        _print_report(index, index.refresh(args.verify))
        return 0
    store = index.open()
    if args.op == "summarize":
        files, dirs = index.summarize(*_summarizers())
        print(f"summarised: {files} files, {dirs} directories")
        return 0
    if args.op == "clear":
        store.clear()
        print(f"removed: {store.folder}")
        return 0
    files, symbols = store.read("files"), store.read("symbols")
    scanned = store.read("repo").first()
    last = scanned.last_scan_at if scanned else None
    if args.op == "status":
        s = aggregates.index_stats(files, store.read("manifests"), store.read("run_configs"), store.read("readmes"), symbols).first()
        print(f"index: {store.folder}\nfiles: {s.files}\nmanifests: {s.manifests}\nrun_configs: {s.run_configs}\nreadmes: {s.readmes}\nsymbols: {s.symbols} ({s.symbol_files} files indexed)")
        print(f"last_scan_at: {f'{last} (unix)' if last else 'never'}")
        return 0
    shown = {k: df.collect() for k, df in aggregates.inspect(files, symbols, last).items()}
    t = shown["totals"][0]
    print(f"\nIndex of {index.root}\nlast scan:    {age_text(last, time.time()) if last else 'never: run `citespan cache build`'}")
    if t.newest_mtime is not None:
        print(f"newest file:  {age_text(t.newest_mtime, time.time())}")
    if t.stale_files is not None:
        print(f"  {t.stale_files} file(s) modified since last scan" if t.stale_files else "  index up to date")
    print(f"\nFiles ({t.total_files})\n  total size: {size_text(t.total_bytes)}" + (f"  ({t.binary_files} binary)" if t.binary_files else ""))
    for r in shown["files_by_lang"]:
        print(f"  {r.lang:<12}  {r.files}")
    print(f"\nSymbols ({sum(r.symbols for r in shown['symbols_by_kind'])})")
    for r in shown["symbols_by_kind"]:
        print(f"  {r.kind:<12}  {r.symbols}")
    for r in shown["top_symbol_files"]:
        print(f"  {r.symbols:>4}  {r.path}")
    return 0


def _summarizers() -> tuple:
    """The configured model's, or none for those that only quote."""
    from .serve import model as serving

    if not serving.configured("summarize"):
        return ()
    m = serving.Model.of("summarize")
    return serving.FileSummarizer(m), serving.DirSummarizer(m)


def search(args) -> int:
    """Search the summaries of the index."""
    from .serve.index import semantic_search

    got = semantic_search(_index(args.path), None, args.query, args.limit)
    if "error" in got:
        print(got["error"], file=sys.stderr)
        return 1
    for hit in got["hits"]:
        print(f"{hit['rank']:.4f}  {hit['path']}  {hit['summary']}")
    return 0


def configure(args) -> int:
    try:
        if args.op == "init":
            print(f"created: {config.init()}")
        elif args.op == "show":
            print(config.censored(config.config_path().read_text("utf-8")), end="")
        elif args.op == "get":
            value = config.get(args.key)
            if value is None:
                raise KeyError(f"key not found: {config.normal_key(args.key)}")
            print(value if isinstance(value, str) else json.dumps(value))
        else:
            print(config.set_value(args.key, args.value))
    except (OSError, KeyError, ValueError) as e:
        print(e.args[0] if isinstance(e, KeyError) else e, file=sys.stderr)
        return 1
    return 0


def scan(args) -> int:
    from .sources.repo import char_counts, repo_files

    index = _index(args.path)
    for r in char_counts(repo_files(index.spark, index.root)).orderBy("path").toLocalIterator():
        print(f"{r.path}: {r.shown}")
    return 0


def info(args) -> int:
    for key, value in project_info(guard(args.path)).items():
        print(f"{key}: {', '.join(value) if isinstance(value, list) else '' if value is None else value}")
    return 0


SLASH = {"help": ("help", "h", "?"), "clear": ("clear", "cls"), "reset": ("reset", "new"), "exit": ("exit", "quit", "q"), "model": ("model",)}


def slash(line: str) -> tuple[str, str] | None:
    """(command, argument) of a line that starts with a slash; an unknown one is ('unknown', name)."""
    if not line.strip().startswith("/"):
        return None
    name, _, rest = line.strip()[1:].partition(" ")
    return next(((k, rest.strip()) for k, names in SLASH.items() if name.lower() in names), ("unknown", name))


def continued(lines: list[str]) -> str:
    """Lines joined where one ends in a backslash."""
    return "\n".join(lines).replace("\\\n", "\n").rstrip("\\")


def _answerer(model: str | None = None):
    """The configured model's, or else the one that only quotes definitions."""
    from .serve import model as serving
    from .serve.index import extractive_answerer

    if not serving.configured("chat", model):
        return extractive_answerer

    def show(kind: str, what: object) -> None:
        if kind == "call":
            print(f"  {kind}: {str(what)[:160]}", file=sys.stderr)
        elif kind == "reasoning":
            print(what, end="", file=sys.stderr, flush=True)

    return serving.answerer(serving.Model.of("chat", model), show, streaming=True)


def chat(args) -> int:
    from .serve.index import ask

    index = _index(args.path)
    _print_report(index, index.refresh())
    answer = _answerer(args.model)
    if args.message:
        print(ask(index, args.message, answer).text)
        return 0
    while True:
        lines = [input("> ")]
        while lines[-1].endswith("\\"):
            lines.append(input(". "))
        text = continued(lines).strip()
        command = slash(text)
        if command is None and text:
            try:
                began = time.monotonic()
                print(ask(index, text, answer).text)
                print(f"({elapsed_text(time.monotonic() - began)})", file=sys.stderr)
            except (KeyboardInterrupt, RuntimeError) as e:
                print(f"cancelled: {e}" if isinstance(e, RuntimeError) else "cancelled", file=sys.stderr)
        elif command and command[0] == "model":
            answer = _answerer(command[1] or args.model)
        elif command and command[0] == "exit":
            return 0
        elif command and command[0] in ("help", "unknown"):
            print("commands: " + ", ".join("/" + k for k in SLASH))


def mcp(args) -> int:
    root = guard(args.path)
    if args.op == "init":
        try:
            print(f"created: {write_preset(root, args.preset)}")
        except FileExistsError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    from .serve.index import ask
    from .serve.rpc import Server, http_server, serve_stdio

    index = _index(root)
    report = index.refresh()
    print(f"citespan: indexed {report.scanned} files ({report.symbols_total} symbols across {report.symbols_files} files) at {root}", file=sys.stderr)
    answer = _answerer()
    server = Server(lambda question: ask(index, question, answer).text)
    if args.transport == "http":
        http_server(server, args.port).serve_forever()
    else:
        serve_stdio(server)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="citespan")
    sub = p.add_subparsers(dest="command")

    def add(name, run, ops=(), path=True, to=sub):
        q = to.add_parser(name)
        q.set_defaults(run=run)
        if ops:
            q.add_argument("op", choices=ops)
        if path:
            q.add_argument("path", nargs="?", default=".")
        return q

    add("scan", scan)
    add("info", info)
    c = add("chat", chat)
    c.add_argument("-m", "--message")
    c.add_argument("--model")
    add("cache", cache, ("build", "status", "clear", "inspect", "summarize")).add_argument("--verify", action="store_true")
    s = sub.add_parser("search")
    s.set_defaults(run=search)
    s.add_argument("query")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("--limit", type=int, default=20)
    m = add("mcp", mcp, ("init", "serve"))
    m.add_argument("--preset", choices=sorted(PRESETS), default="claude")
    m.add_argument("--transport", choices=("stdio", "http"), default="stdio")
    m.add_argument("--port", type=int, default=8765)
    f = add("config", configure, ("init", "show", "set", "get"), path=False)
    f.add_argument("key", nargs="?", default="")
    f.add_argument("value", nargs="?", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    known = {"scan", "info", "chat", "cache", "search", "mcp", "config", "-h", "--help"}
    args = parser().parse_args(argv if argv and argv[0] in known else ["scan", *argv])
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
