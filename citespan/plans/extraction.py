"""Queries of what is extracted from files: the files are rendered from table rows, so SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, snapshot
from ..operators.extract.manifests import parse_manifests
from ..operators.extract.run_configs import parse_run_configs
from ..operators.extract.symbols import extract_symbols
from ..schemas import MAX_PARSED_BYTES
from ..sources import corpus
from ..sources.repo import classified
from .registry import query


def _read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns)


def _dealt(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    """Rows that files are rendered from, dealt out over tasks: a few bytes of a row are a file that takes Python long
    to parse, so the splits of a small table would be far too few tasks."""
    return _read(spark, d, table, *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _flat(manifests: DataFrame) -> DataFrame:
    """A manifest's struct as plain columns."""
    scripts = F.array_join(F.transform("manifest.scripts", lambda s: F.concat(s["name"], F.lit("="), s["target"])), ",")
    m = [F.col(f"manifest.{c}").alias(c) for c in ("ecosystem", "name", "version", "language_version")]
    return manifests.select("path", *m, scripts.alias("scripts"), F.array_join("manifest.top_deps", ",").alias("deps"), F.col("manifest.workspace.kind").alias("workspace"), F.array_join("manifest.workspace.members", ",").alias("members"))


# --- manifests ------------------------------------------------------------------------------------

_CARGO = r"""concat('[package]\nname = "part-', k, '"\n', if(k % 5 = 0, 'version.workspace = true\n', concat('version = "', s, '.', k % 10, '.0" # "x"\n')), if(k % 3 = 0, '', concat('rust-version = "1.', s, '"\n')),
  '\n[[bin]]\nname = "b', k, '"\npath = "src/b', k, '.rs"\n\n[[bin]]\npath = "nameless"\n\n[dependencies]\n', array_join(transform(sequence(0, int(k % 14)), i -> concat('d', lpad(string(13 - i), 2, '0'), if(i % 2 = 0, ' = "1"\n', ' = { version = "2", features = [] }\n'))), ''),
  if(k % 7 = 0, concat('\n[workspace]\nmembers = ["a', k, '", "b"]\n'), ''), if(k % 11 = 0, 'name = = 1\n', ''))"""


@query("manifest_cargo", """SELECT 'p' || k || '/Cargo.toml' AS path, 'rust' AS ecosystem, 'part-' || k AS name, CASE WHEN k % 5 <> 0 THEN s || '.' || (k % 10) || '.0' END AS version, CASE WHEN k % 3 <> 0 THEN '1.' || s END AS language_version,
  'b' || k || '=src/b' || k || '.rs' AS scripts, array_to_string(list_sort([('d' || lpad(CAST(13 - i AS VARCHAR), 2, '0')) FOR i IN range(0, CAST(k % 14 + 1 AS BIGINT))])[1:10], ',') AS deps, CASE WHEN k % 7 = 0 THEN 'cargo' END AS workspace, CASE WHEN k % 7 = 0 THEN 'a' || k || ',b' END AS members
  FROM (SELECT p_partkey AS k, p_size AS s FROM part) WHERE k % 11 <> 0""")
def manifest_cargo(spark, d):
    rows = _dealt(spark, d, "part", "p_partkey", "p_size").toDF("k", "s")
    return _flat(parse_manifests(rows.select(F.expr("concat('p', k, '/Cargo.toml')").alias("path"), F.expr(_CARGO).alias("content"))))


_PACKAGE = r"""concat('{"name": "@s/', k, '", "version": ', if(k % 4 = 0, '3', concat('"', k % 9, '.1"')), if(k % 3 = 0, '', concat(', "engines": {"node": ">=', k % 20, '"}')), ', "scripts": {"test": "t ', k, '", "build": "b", "n": 1}, "dependencies": {',
  array_join(transform(sequence(0, int(k % 12)), i -> concat('"m', lpad(string(11 - i), 2, '0'), '": "^1"')), ', '), '}', if(k % 5 = 0, concat(', "workspaces": ["w', k, '", 7]'), if(k % 5 = 1, ', "workspaces": {"packages": ["x", "y"]}', '')), if(k % 13 = 0, ']', '}'))"""


@query("manifest_package_json", """SELECT 's' || k || '/package.json' AS path, 'node' AS ecosystem, '@s/' || k AS name, CASE WHEN k % 4 <> 0 THEN (k % 9) || '.1' END AS version, CASE WHEN k % 3 <> 0 THEN '>=' || (k % 20) END AS language_version,
  'build=b,test=t ' || k AS scripts, array_to_string(list_sort([('m' || lpad(CAST(11 - i AS VARCHAR), 2, '0')) FOR i IN range(0, CAST(k % 12 + 1 AS BIGINT))])[1:10], ',') AS deps, CASE WHEN k % 5 < 2 THEN 'npm/yarn/pnpm' END AS workspace, CASE k % 5 WHEN 0 THEN 'w' || k WHEN 1 THEN 'x,y' END AS members
  FROM (SELECT c_custkey AS k FROM customer) WHERE k % 13 <> 0""")
def manifest_package_json(spark, d):
    rows = _dealt(spark, d, "customer", "c_custkey").toDF("k")
    return _flat(parse_manifests(rows.select(F.expr("concat('s', k, '/package.json')").alias("path"), F.expr(_PACKAGE).alias("content"))))


_PYPROJECT = r"""if(k % 2 = 0,
  concat('[project]\nname = "o', k, '"\nversion = "', k % 7, '"\nrequires-python = ">=3.', k % 13, '"\ndependencies = [', array_join(transform(sequence(0, int(k % 12)), i -> concat('"q', i, '_x[extra] >= ', i, '"')), ', '), ']\n[project.scripts]\nz = "m:z"\na = "m:a', k, '"\n'),
  concat('[tool.poetry]\nname = "o', k, '"\nversion = "', k % 7, '"\n[tool.poetry.dependencies]\npython = "^3"\n', array_join(transform(sequence(0, int(k % 12)), i -> concat('q', lpad(string(i), 2, '0'), ' = "*"\n')), ''), '[tool.poetry.scripts]\nrun = "m:', k, '"\n[tool.uv.workspace]\nmembers = ["u', k, '"]\n'))"""


@query("manifest_pyproject", """SELECT 'o' || k || '/pyproject.toml' AS path, 'python' AS ecosystem, 'o' || k AS name, CAST(k % 7 AS VARCHAR) AS version, CASE WHEN k % 2 = 0 THEN '>=3.' || (k % 13) END AS language_version,
  CASE WHEN k % 2 = 0 THEN 'a=m:a' || k || ',z=m:z' ELSE 'run=m:' || k END AS scripts,
  CASE WHEN k % 2 = 0 THEN array_to_string([('q' || i || '_x') FOR i IN range(0, least(CAST(k % 12 + 1 AS BIGINT), 10))], ',') ELSE array_to_string([('q' || lpad(CAST(i AS VARCHAR), 2, '0')) FOR i IN range(0, least(CAST(k % 12 + 1 AS BIGINT), 9))], ',') END AS deps,
  CASE WHEN k % 2 = 1 THEN 'uv' END AS workspace, CASE WHEN k % 2 = 1 THEN 'u' || k END AS members FROM (SELECT o_orderkey AS k FROM orders)""")
def manifest_pyproject(spark, d):
    """``python`` sorts before ``q..``, so it is among the first ten and dropped after they are taken."""
    rows = _dealt(spark, d, "orders", "o_orderkey").toDF("k")
    return _flat(parse_manifests(rows.select(F.expr("concat('o', k, '/pyproject.toml')").alias("path"), F.expr(_PYPROJECT).alias("content"))))


# --- run configurations ---------------------------------------------------------------------------

_RUN_CONFIGS = {
    "Dockerfile": r"concat('FROM old AS x\nRUN a\nfrom img:', k % 5, ' # base\nEXPOSE 80 ', k, '\n# EXPOSE 1\nCMD [\"run\", \\\n   \"', k, '\"]\nENTRYPOINT e', k, '\n')",
    "Makefile": r"concat('.PHONY: all\nall: b', k, '\n\techo hi\nV := 1\nb', k, ': # note\n\techo\n# c: d\n')",
    "Procfile": r"concat('web: serve ', k, '\nempty:\n# x: y\nworker:  work # w\n')",
    "docker-compose.yml": r"concat('version: \"3\"\nservices:\n  db', k, ':\n    image: x\n  web:\n    image: y\nvolumes:\n  v: {}\n')",
    "justfile": r"concat('build', k, ' arg:\n  x\ntest:\n  y\n')",
}


@query("run_configs", """WITH b AS (SELECT s_suppkey AS k FROM supplier),
  r AS (SELECT k, unnest([{'f': 'Dockerfile', 'kind': 'Dockerfile', 'field': 'from', 'value': 'img:' || (k % 5), 'line': 3}, {'f': 'Dockerfile', 'kind': 'Dockerfile', 'field': 'expose', 'value': '80', 'line': 4}, {'f': 'Dockerfile', 'kind': 'Dockerfile', 'field': 'expose', 'value': CAST(k AS VARCHAR), 'line': 4},
    {'f': 'Dockerfile', 'kind': 'Dockerfile', 'field': 'cmd', 'value': '["run", "' || k || '"]', 'line': 6}, {'f': 'Dockerfile', 'kind': 'Dockerfile', 'field': 'entrypoint', 'value': 'e' || k, 'line': 8},
    {'f': 'Makefile', 'kind': 'Makefile', 'field': 'target', 'value': '.PHONY', 'line': 1}, {'f': 'Makefile', 'kind': 'Makefile', 'field': 'target', 'value': 'all', 'line': 2}, {'f': 'Makefile', 'kind': 'Makefile', 'field': 'target', 'value': 'b' || k, 'line': 5},
    {'f': 'Procfile', 'kind': 'Procfile', 'field': 'process', 'value': 'web: serve ' || k, 'line': 1}, {'f': 'Procfile', 'kind': 'Procfile', 'field': 'process', 'value': 'worker: work', 'line': 4},
    {'f': 'docker-compose.yml', 'kind': 'DockerCompose', 'field': 'service', 'value': 'db' || k, 'line': 3}, {'f': 'docker-compose.yml', 'kind': 'DockerCompose', 'field': 'service', 'value': 'web', 'line': 5},
    {'f': 'justfile', 'kind': 'Justfile', 'field': 'target', 'value': 'build' || k, 'line': 1}, {'f': 'justfile', 'kind': 'Justfile', 'field': 'target', 'value': 'test', 'line': 3}]) AS x FROM b)
  SELECT 'r' || k || '/' || x.f AS path, x.kind AS kind, x.field AS field, x.value AS value, x.line AS line FROM r""")
def run_configs(spark, d):
    rows = _dealt(spark, d, "supplier", "s_suppkey").toDF("k")
    files = F.array(*[F.struct(F.lit(name).alias("f"), F.expr(text).alias("content")) for name, text in _RUN_CONFIGS.items()])
    return parse_run_configs(rows.select("k", F.explode(files).alias("x")).select(F.concat(F.lit("r"), "k", F.lit("/"), "x.f").alias("path"), "x.content"))


# --- symbols --------------------------------------------------------------------------------------

#: Of each language a file, and what must be found in it: (name, kind, line); {k} is the row's number.
_SOURCES: dict[str, tuple[str, str, list[tuple[str, str, int]]]] = {
    "rust": ("a.rs", "use a::b{k};\n// fn no() {}\npub struct S{k};\npub fn go{k}() { let s = \"fn x()\"; }\nimpl S{k} {\n    fn m(&self) {}\n}\nenum E{k} { A }\n", [("a::b{k}", "import", 1), ("S{k}", "struct", 3), ("go{k}", "function", 4), ("S{k}", "impl", 5), ("m", "function", 6), ("E{k}", "enum", 8)]),
    "python": ("a.py", "import os{k}\nfrom pkg import x\nclass C{k}:\n    def m{k}(self):\n        return 'def no(): pass'\n", [("os{k}", "import", 1), ("pkg", "import", 2), ("C{k}", "class", 3), ("m{k}", "function", 4)]),
    "go": ("a.go", "package a\n\nfunc F{k}(x int) int { return x }\nfunc (t T) M{k}() {}\ntype T{k} struct {}\n", [("F{k}", "function", 3), ("M{k}", "method", 4), ("T{k}", "type", 5)]),
    "java": ("A.java", "class A{k} {\n  public int get{k}() { return 1; }\n  // int no() {}\n}\ninterface I{k} {}\nenum E{k} { X }\n", [("A{k}", "class", 1), ("get{k}", "method", 2), ("I{k}", "interface", 5), ("E{k}", "enum", 6)]),
    "c": ("a.c", "/* int no() {} */\nstruct s{k} { int x; };\nint main{k}(int a) {\n  return 0;\n}\n", [("s{k}", "struct", 2), ("main{k}", "function", 3)]),
    "ruby": ("a.rb", "module M{k}\n  class C{k}\n    def run{k}\n    end\n  end\nend\n", [("M{k}", "module", 1), ("C{k}", "class", 2), ("run{k}", "method", 3)]),
    "javascript": ("a.js", "import z from 'lib{k}';\nfunction f{k}() {}\nclass C{k} {}\nconst g{k} = () => 1;\n", [("lib{k}", "import", 1), ("f{k}", "function", 2), ("C{k}", "class", 3), ("g{k}", "const", 4)]),
    "typescript": ("a.ts", "interface I{k} { a: number }\ntype T{k} = string;\nenum E{k} { A }\nfunction f{k}(): void {}\n", [("I{k}", "interface", 1), ("T{k}", "type", 2), ("E{k}", "enum", 3), ("f{k}", "function", 4)]),
    "csharp": ("A.cs", "namespace N{k} {\n  class A{k} {\n    public int Get{k}() { return 1; }\n  }\n  struct S{k} {}\n}\n", [("N{k}", "namespace", 1), ("A{k}", "class", 2), ("Get{k}", "method", 3), ("S{k}", "struct", 5)]),
    "cpp": ("a.cpp", "namespace n{k} {\nclass C{k} {};\nstruct S{k} {};\n}\nint f{k}(int a) {\n  return a;\n}\n", [("n{k}", "namespace", 1), ("C{k}", "class", 2), ("S{k}", "struct", 3), ("f{k}", "function", 5)]),
}
_WANTED = ", ".join(f"('{f}', '{name}', '{kind}', {line})" for f, _, found in _SOURCES.values() for name, kind, line in found)


@query("symbols_extracted", f"WITH w(f, name, kind, line) AS (VALUES {_WANTED}) SELECT 'q' || s_suppkey || '/' || f AS path, replace(name, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS name, kind, line AS start_line, line AS end_line FROM supplier, w")
def symbols_extracted(spark, d):
    rows = _dealt(spark, d, "supplier", "s_suppkey").toDF("k")
    sources = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(lang).alias("lang"), F.replace(F.lit(text), F.lit("{k}"), F.col("k").cast("string")).alias("content")) for lang, (f, text, _) in _SOURCES.items()])
    files = rows.select("k", F.explode(sources).alias("x")).select(F.concat(F.lit("q"), "k", F.lit("/"), "x.f").alias("path"), "x.lang", "x.content")
    return extract_symbols(files.withColumn("size", F.octet_length("content").cast("long")).withColumn("is_binary", F.lit(False))).drop("signature")


# --- bytes: sniffing, the gate of what is parsed, the byte cap -----------------------------------

_KINDS = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'zero' WHEN 2 THEN 'late zero' WHEN 3 THEN 'not utf8' ELSE 'text' END"


@query("sniff_and_gate", f"""WITH k AS (SELECT doc_id, {_KINDS} AS kind, text FROM documents), s AS (SELECT doc_id, kind, text, CASE kind WHEN '' THEN 0 WHEN 'zero' THEN 101 + strlen(text) WHEN 'late zero' THEN 9001 + strlen(text) WHEN 'not utf8' THEN 1 + strlen(text) ELSE strlen(text) END AS size FROM k)
  SELECT 'f' || doc_id AS path, CAST(size AS BIGINT) AS size, kind = 'zero' AS is_binary, kind <> 'not utf8' AS is_text, kind NOT IN ('zero', 'not utf8') AND size <= {MAX_PARSED_BYTES} AS parsed FROM s""")
def sniff_and_gate(spark, d):
    """Files with a zero byte early, late or nowhere, files that aren't UTF-8, and empty ones."""
    docs = _read(spark, d, "documents", "doc_id", "text").withColumn("kind", F.expr(_KINDS))
    a = lambda n: F.repeat(F.lit("a"), n).cast("binary")
    raw, zero = F.col("text").cast("binary"), F.lit(b"\x00")
    content = F.when(F.col("kind") == "", F.lit(b"")).when(F.col("kind") == "zero", F.concat(a(100), zero, raw)).when(F.col("kind") == "late zero", F.concat(a(9000), zero, raw)).when(F.col("kind") == "not utf8", F.concat(F.lit(b"\xff"), raw)).otherwise(raw)
    files = docs.select(F.concat(F.lit("f"), "doc_id").alias("path"), content.alias("content")).withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))
    gate = (F.col("size") <= MAX_PARSED_BYTES) & ~F.col("is_binary") & F.col("content").isNotNull()
    return classified(files).select("path", "size", "is_binary", F.col("content").isNotNull().alias("is_text"), gate.alias("parsed"))


@query("read_file_capped_lines", """WITH l AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, replace(replace(text, chr(10), ' '), chr(13), ' ') AS t FROM documents), c AS (SELECT path, t, strlen(t) AS n, CASE WHEN strlen(t) > 500 THEN substr(t, 1, CAST((SELECT max(i) FROM range(0, 501) r(i) WHERE strlen(substr(t, 1, i)) <= 500) AS BIGINT)) ELSE t END AS content FROM l)
  SELECT path, CASE WHEN n > 0 THEN 1 END AS end_line, CASE WHEN n > 0 THEN content END AS content, CASE WHEN n > 500 THEN '... file continues, returned ' || strlen(content) || ' of ' || n || ' bytes. Call read_file again with start_line=2 to continue.' END AS truncated FROM c""")
def read_file_capped_lines(spark, d):
    """Texts of one line each, cut within the line, at a code point; an empty one has no line to read."""
    one = F.translate("content", "\n\r", "  ").alias("content")
    whole = corpus.contents(spark, d).select("path", one)
    asked = whole.select(F.lit(0).alias("ordinal"), "path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return lookup.capped(lookup.read_spans(whole, asked), 500).select("path", "end_line", "content", "truncated")


@query("symbol_lookup", "SELECT p_brand AS path, p_name AS name, p_type AS kind, p_size AS start_line, p_size AS end_line FROM part WHERE p_brand = 'Brand#13'")
def symbol_lookup(spark, d):
    return lookup.lookup(corpus.part_symbols(spark, d), path="Brand#13")


# --- the refresh itself ---------------------------------------------------------------------------


def _tree_of(docs: DataFrame, late: bool) -> DataFrame:
    """path, size, mtime, content: a source file, or every 10th time a manifest, run configuration or README."""
    changed = F.lit(late) & (F.col("doc_id") % 5 == 0)
    body = F.concat(F.lit("def f"), "doc_id", F.lit("():\n    return "), F.when(changed, 2).otherwise(1), F.lit("\n"))
    name = F.expr("CASE doc_id % 10 WHEN 3 THEN 'Cargo.toml' WHEN 5 THEN 'Makefile' WHEN 7 THEN 'README.md' ELSE concat('m', doc_id, '.py') END")
    text = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit('[package]\nname = "p'), "doc_id", F.lit('"\n'))).when(F.col("doc_id") % 10 == 5, F.concat(F.lit("t"), "doc_id", F.lit(":\n\techo "), F.when(changed, "b").otherwise("a"), F.lit("\n"))).when(F.col("doc_id") % 10 == 7, F.lit("# Title\n")).otherwise(body)
    path = F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/e"), "doc_id", F.lit("/"), name)
    rows = docs.select(path.alias("path"), text.cast("binary").alias("content"), (F.lit(1000) + F.when(changed, 1).otherwise(0)).cast("long").alias("mtime"))
    return rows.select("path", F.octet_length("content").cast("long").alias("size"), "mtime", "content")


@query("refresh_report", """WITH new AS (SELECT doc_id, doc_id % 4 = 0 AS is_new, doc_id % 5 = 0 AS is_late FROM documents WHERE doc_id % 9 <> 0), s AS (SELECT *, is_new OR is_late AND doc_id % 10 NOT IN (3, 7) AS touched FROM new)
  SELECT count(*) AS scanned, count(*) FILTER (is_new) AS added, count(*) FILTER (NOT is_new AND touched) AS changed, count(*) FILTER (NOT touched) AS unchanged, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0 AND doc_id % 4 <> 0) AS deleted,
    count(*) FILTER (touched AND doc_id % 10 = 3) AS manifests, count(*) FILTER (touched AND doc_id % 10 = 5) AS run_configs, count(*) FILTER (touched AND doc_id % 10 = 7) AS readmes,
    count(*) FILTER (touched AND doc_id % 10 NOT IN (3, 5, 7)) AS symbols_files, count(*) FILTER (touched AND doc_id % 10 NOT IN (3, 5, 7)) AS symbols_total, 1 + count(DISTINCT doc_id % 7) + count(*) AS dirs_hashed FROM s""")
def refresh_report(spark, d):
    """The counters of the second of two refreshes of an index: every 4th file is new, every 5th has changed, every 9th is gone."""
    docs = _read(spark, d, "documents", "doc_id")
    store = snapshot.SnapshotStore(spark, corpus.scratch(spark))
    snapshot.refresh(_tree_of(docs.filter("doc_id % 4 != 0"), False), store, 1)
    report = snapshot.refresh(_tree_of(docs.filter("doc_id % 9 != 0"), True), store, 2)
    store.clear()
    return spark.createDataFrame([tuple(report.as_dict().values())], ", ".join(f"{k} long" for k in report.as_dict()))
