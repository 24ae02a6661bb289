"""The index of a real folder: scanning, extraction, refresh, and a refresh after edits against a rebuild."""

import json
import os

import pytest
from minirepo import make
from pyspark.sql import functions as F

from citespan.functions.hashing import xxh3_bytes
from citespan.operators import lookup, overview, snapshot, tree
from citespan.sources.ignore import Ignore, rules
from citespan.sources.repo import char_counts, classified, repo_files, walk


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return make(tmp_path_factory.mktemp("repo"))


@pytest.fixture(scope="module")
def index(spark, root, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    store, report = snapshot.refresh_repo(spark, str(root), folder, 1_700_000_000)
    return store, report, folder


def test_walk(root):
    found = {p for p, _, _ in walk(root)}
    assert {".gitignore", ".hidden", "_priv/z.txt", "empty.txt", "keep.log"} <= found
    assert not found & {"target/x.rs", "a.log", ".git/config"}


@pytest.mark.parametrize(
    "text,path,is_dir,ignored",
    [("/a", "a", False, True), ("/a", "b/a", False, False), ("a/b", "a/b", False, True), ("a/b", "x/a/b", False, False), ("**/b", "x/a/b", False, True), ("a/**", "a/x/y", False, True), ("a/**/b", "a/b", False, True), ("d/", "d", False, False),
     ("d/", "x/d", True, True), ("*.o\n!k.o", "k.o", False, False), ("[ab].c", "b.c", False, True), ("[!ab].c", "b.c", False, False), ("?x", "ax", False, True), ("\\#h", "#h", False, True), ("# c", "# c", False, False)],
)
def test_ignore(text, path, is_dir, ignored):
    assert Ignore(rules(text)).ignored(path, is_dir) == ignored


def test_rules_of_parents(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("/sub/deep/a.txt\nsub/*.tmp\n*.log\n/b.txt\nsub/deep/gone/\n")
    below = tmp_path / "sub" / "deep"
    (below / "gone").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "x.tmp", "y.log", "gone/z", "keep.log"):
        (below / name).write_text("")
    (below / ".gitignore").write_text("!keep.log\n")
    assert {p for p, _, _ in walk(below)} == {".gitignore", "b.txt", "x.tmp", "keep.log"}
    (tmp_path / "sub" / "t.tmp").write_text("")
    assert {p for p, _, _ in walk(tmp_path / "sub")} == {"deep/.gitignore", "deep/b.txt", "deep/x.tmp", "deep/keep.log"}


def test_source_pushes_path_filters(spark, root):
    df = repo_files(spark, str(root)).filter("path = 'empty.txt'")
    assert [(r.path, r.size, bytes(r.content)) for r in df.collect()] == [("empty.txt", 0, b"")]
    assert repo_files(spark, str(root), content=False).filter("content IS NOT NULL").count() == 0


def test_executors_walk_what_may_hold_a_path(spark, tmp_path, monkeypatch):
    """Below its first directories a tree is walked by tasks, with the rules from above, and only where a path can be."""
    from citespan.sources import repo

    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("*.tmp\n/a/skip/\n")
    for i in range(6):
        for j in range(4):
            (tmp_path / f"{'abcdef'[i]}/d{j}/e").mkdir(parents=True)
            for name in ("x.py", "y.tmp", "z.txt"):
                (tmp_path / f"{'abcdef'[i]}/d{j}/e/{name}").write_text(f"{i}{j}")
    (tmp_path / "a/skip").mkdir()
    (tmp_path / "a/skip/no.py").write_text("")
    (tmp_path / "b/d1/.gitignore").write_text("e/z.txt\n")
    want = sorted(p for p, _, _ in walk(tmp_path))
    assert len(want) == 6 * 4 * 2 + 1 and "b/d1/e/z.txt" not in want and "a/skip/no.py" not in want
    monkeypatch.setattr(repo, "FOLDERS", 10)
    reader = repo.RepoReader(str(tmp_path), True)
    parts = reader.partitions()
    assert sum(len(p.folders) for p in parts) == 24 and all(not p.files or not p.folders for p in parts)
    assert sorted(r[0] for p in parts for r in reader.read(p)) == want
    one = repo.RepoReader(str(tmp_path), False)
    assert not list(one.pushFilters([repo.StringStartsWith(("path",), "c/d2")]))
    seen = []
    monkeypatch.setattr(repo.os, "scandir", lambda place, real=os.scandir: seen.append(str(place)) or real(place))
    assert sorted(r[0] for p in one.partitions() for r in one.read(p)) == ["c/d2/e/x.py", "c/d2/e/z.txt"]
    assert len(seen) == 4  # the root, c, c/d2, c/d2/e
    assert sorted(r.path for r in repo_files(spark, str(tmp_path), content=False).select("path").collect()) == want


def test_classified(spark, root):
    got = {r.path: r for r in classified(repo_files(spark, str(root))).collect()}
    assert got["bin.dat"].is_binary and not got["empty.txt"].is_binary and not got["latin1.txt"].is_binary
    assert got["latin1.txt"].content is None and got["src/main.rs"].lang == "rust" and got[".hidden"].lang is None
    assert bytes(got["keep.log"].hash) == xxh3_bytes(b"yes")
    shown = {r.path: r.shown for r in char_counts(repo_files(spark, str(root))).collect()}
    assert shown["empty.txt"] == "0 [empty]" and shown["latin1.txt"] == "4 [binary]" and shown["keep.log"] == "3"


def test_symbols(index):
    got = {}
    for r in index[0].read("symbols").collect():
        got.setdefault(r.path, []).append((r.name, r.kind, r.start_line))
    assert sorted(got["src/main.rs"]) == [("S", "impl", 3), ("S", "struct", 2), ("a::b", "import", 1), ("go", "function", 4), ("main", "function", 6)]
    assert sorted(got["py/app.py"]) == [("C", "class", 3), ("a", "import", 2), ("f", "function", 6), ("f", "function", 6), ("os", "import", 1), ("sys", "import", 1)]
    assert sorted(got["web/index.ts"]) == [("E", "enum", 5), ("I", "interface", 3), ("T", "type", 4), ("f", "export", 1), ("f", "function", 1), ("g", "const", 2)]
    assert not set(got) & {"big.py", "bin.dat", "target/x.rs"}


def test_manifests(index):
    got = {r.path: r.manifest for r in index[0].read("manifests").collect()}
    c = got["Cargo.toml"]
    assert (c.ecosystem, c.name, c.version, c.language_version, c.workspace.kind, c.workspace.members) == ("rust", "app", "1.2.3", "1.80", "cargo", ["web", "py"])
    assert [tuple(s) for s in c.scripts] == [("tool", "src/main.rs")] and c.top_deps == [f"d{i:02d}" for i in range(10)]
    w = got["web/package.json"]
    assert (w.ecosystem, w.language_version, w.top_deps, w.workspace.kind, len(w.scripts)) == ("node", ">=20", ["a", "b"], "npm/yarn/pnpm", 2)
    assert got["py/pyproject.toml"].top_deps == ["requests", "pkg"]
    assert "python" not in got["poet/pyproject.toml"].top_deps and len(got["poet/pyproject.toml"].top_deps) == 9


def test_run_configs(index):
    got = {(r.path, r.field, r.value, r.line) for r in index[0].read("run_configs").collect()}
    assert {x for x in got if x[0] == "Dockerfile"} == {("Dockerfile", "from", "c", 2), ("Dockerfile", "expose", "80", 3), ("Dockerfile", "expose", "443", 3), ("Dockerfile", "cmd", '["x", "y"]', 4)}
    assert {x[2] for x in got if x[0] == "Makefile"} == {".PHONY", "all"} and {x[2] for x in got if x[0] == "justfile"} == {"version", "build"}
    assert ("Procfile", "process", "web: run --port 1", 1) in got and {x[2:] for x in got if x[0] == "compose.yml"} == {("web", 2), ("db", 0)}


def test_readme_and_report(index):
    r = index[0].read("readmes").first()
    assert (r.path, r.line_count, r.text_head.count("\n")) == ("README.md", 100, 79)
    report = index[1]
    assert report.added == report.scanned and report.manifests == 4 and report.run_configs == 5 and report.readmes == 1 and report.dirs_hashed == 6


def test_overview(spark, index):
    store = index[0]
    project = spark.sql("SELECT 'app' AS name, true AS git_init")
    out = json.loads(overview.project_overview(*[store.read(t) for t in ("files", "manifests", "run_configs", "readmes")], project).first().overview)
    assert out["workspace"]["marker_path"] == "Cargo.toml" and out["workspace"]["members"] == ["web", "py"]
    apps = {a["manifest"]: a for a in out["applications"]}
    assert len(apps["Cargo.toml"]["run_configs"]) == 5 and apps["Cargo.toml"]["readme"]["path"] == "README.md" and apps["web/package.json"]["readme"] is None
    assert [e["source"] for e in apps["Cargo.toml"]["entrypoints"]] == ["manifest.scripts", "Dockerfile.CMD"]
    assert [e["target"] for e in apps["py/pyproject.toml"]["entrypoints"]][:2] == ["py/src/main.py", "py/main.py"]
    assert len(out["global_run_configs"]) == 5


def test_refresh_after_edits_is_a_rebuild(spark, root, index, tmp_path):
    store, _, folder = index
    again = snapshot.refresh_repo(spark, str(root), folder, 1_700_000_001)[1]
    assert (again.added, again.changed, again.deleted, again.symbols_total) == (0, 0, 0, 0) and again.unchanged == again.scanned
    os.utime(root / "README.md", (1, 1))  # another time, the same text
    (root / "src/main.rs").write_text("fn other() {}\n")
    (root / "Procfile").unlink()
    (root / "latin1.txt").write_text("now text")
    (root / "py/pyproject.toml").write_bytes(b"[project]\nname='\xff'\n")  # no longer UTF-8: derived rows go
    (root / "new").mkdir()
    (root / "new/n.go").write_text("package n\nfunc N() {}\n")
    report = snapshot.refresh_repo(spark, str(root), folder, 1_700_000_002)[1]
    assert (report.added, report.changed, report.deleted) == (1, 3, 1)
    rebuilt, _ = snapshot.refresh_repo(spark, str(root), str(tmp_path), 1_700_000_002)
    for name, drop in (("files", ["updated_at"]), ("symbols", []), ("manifests", []), ("run_configs", []), ("readmes", []), ("dir_hashes", ["updated_at"])):
        a, b = (s.read(name).drop(*drop) for s in (store, rebuilt))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    assert len([n for n in os.listdir(f"{folder}/{os.listdir(folder)[0]}") if n.startswith("v")]) == 2


def test_merkle_follows_paths_and_contents(spark):
    rows = [("a/b/x", b"1"), ("a/y", b"2"), ("z", b"3")]
    hashes = lambda rows: {r.dir_path: (bytes(r.child_hash), r.file_count) for r in tree.merkle(spark.createDataFrame(rows, "path string, hash binary")).collect()}
    one, renamed = hashes(rows), hashes([("a/b/w", b"1"), *rows[1:]])
    inner = xxh3_bytes(b"a/b/x\x001\x00")
    assert one["a/b"] == (inner, 1) and one["a"] == (xxh3_bytes(b"a/y\x002\x00a/b\x00" + inner + b"\x00"), 2) and one[""][1] == 3
    assert all(one[d][0] != renamed[d][0] for d in ("", "a", "a/b"))
    assert hashes([]) == {}


def test_search_and_reads(spark, root):
    contents = repo_files(spark, str(root)).select("path", F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("content"))
    assert [(r.path, r.line) for r in lookup.search(contents, "needle", max_hits=2).collect()] == [("big.py", 3), ("big.py", 4)]
    asked = spark.createDataFrame([(0, "empty.txt", None, None), (1, "empty.txt", None, 5), (2, "README.md", 99, 500), (3, "README.md", 0, 1), (4, "a..b", None, None), (5, "none", None, None), (6, "latin1.txt", None, None), (7, "keep.log", 9, None)], "ordinal int, path string, start_line int, end_line int")
    got = {r.ordinal: r for r in lookup.read_spans(contents, asked).collect()}
    assert got[0].error == "start_line (1) greater than end_line (0)" and (got[1].end_line, got[1].content, got[1].error) == (0, "", None)
    assert (got[2].start_line, got[2].end_line, got[2].content) == (99, 100, "line 99\nline 100") and (got[3].start_line, got[3].end_line) == (1, 1)
    assert got[4].error == "path traversal not allowed" and got[5].error == "file not found" and "UTF-8" in (got[6].error or "UTF-8") and got[7].error == "start_line (9) greater than end_line (1)"
