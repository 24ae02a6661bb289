"""The registered queries over the index, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import aggregates, blocks, evidence, grams, lookup, overview, snapshot, summaries, tree
from ..sources import corpus
from ..sources.corpus import EPOCH
from ..sources.repo import char_counts
from . import extraction  # noqa: F401  (registers its queries)
from .registry import ORACLE_SQL, QUERIES, Query, query  # noqa: F401

# --- SQL that several oracles share --------------------------------------------------------------

_FILES = f"files AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, md5(text) AS hash, {EPOCH} + doc_id * 60 AS mtime, CAST(strlen(text) AS BIGINT) AS size, lang, false AS is_binary, text, doc_id FROM documents)"
_LINES = r"(CASE WHEN {t} = '' THEN [] ELSE list_transform(string_split(CASE WHEN {t} LIKE '%' || chr(10) THEN substr({t}, 1, length({t}) - 1) ELSE {t} END, chr(10)), lambda x: CASE WHEN x LIKE '%' || chr(13) THEN substr(x, 1, length(x) - 1) ELSE x END) END)"
_PAGES = r"pages_ AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/$', ''), '/$', '') AS path FROM pages)"
_PAGE_SYMBOLS = _PAGES + r""", symbols AS (
  SELECT path, unnest(regexp_extract_all(html, '<title(?: [^>]*)?>([^<]*)</title>', 1)) AS name, 'title' AS kind FROM pages_
  UNION ALL SELECT path, unnest(regexp_extract_all(html, '<h1(?: [^>]*)?>([^<]*)</h1>', 1)), 'h1' FROM pages_
  UNION ALL SELECT path, unnest(regexp_extract_all(html, '<a(?: [^>]*)?>([^<]*)</a>', 1)), 'a' FROM pages_), named AS (SELECT * FROM symbols WHERE name <> '')"""
_PARENT = "regexp_replace({p}, '/?[^/]*$', '')"
_EXT = r"CASE WHEN regexp_matches(regexp_extract({p}, '([^/]*)$', 1), '^.+\.[^.]*$') THEN lower(regexp_extract({p}, '\.([^.]*)$', 1)) END"
_UPPER, _LOWER = X._UPPER, X._LOWER


# --- aggregates ----------------------------------------------------------------------------------


@query("lang_histogram", "SELECT coalesce(lang, '(none)') AS lang, count(*) AS files FROM documents GROUP BY documents.lang ORDER BY files DESC, lang")
def lang_histogram(spark, d):
    return aggregates.files_by_lang(corpus.listed(spark, d))


def _tables(spark, d):
    docs = corpus.listed(spark, d)
    return docs, corpus.pages(spark, d), corpus.part_symbols(spark, d), corpus.page_symbols(spark, d)


@query("index_stats", f"WITH {_PAGE_SYMBOLS} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM pages) AS manifests, (SELECT count(DISTINCT p_brand) FROM part) AS run_configs, (SELECT count(*) FROM pages) AS readmes, (SELECT count(*) FROM named) AS symbols, (SELECT count(DISTINCT path) FROM named) AS symbol_files")
def index_stats(spark, d):
    docs, pages, parts, symbols = _tables(spark, d)
    return aggregates.index_stats(docs, pages, parts, pages, symbols)


@query("inspect_totals", f"WITH {_FILES} SELECT count(*) AS total_files, CAST(count(*) FILTER (is_binary) AS BIGINT) AS binary_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, max(mtime) AS newest_mtime, count(*) FILTER (mtime > {EPOCH + 6000}) AS stale_files FROM files")
def inspect_totals(spark, d):
    return aggregates.inspect_totals(corpus.files(spark, d), EPOCH + 6000)


@query("symbols_by_kind", f"WITH {_PAGE_SYMBOLS} SELECT kind, count(*) AS symbols FROM named GROUP BY kind")
def symbols_by_kind(spark, d):
    return aggregates.symbols_by_kind(corpus.page_symbols(spark, d))


@query("top_symbol_files", f"WITH {_PAGE_SYMBOLS} SELECT path, count(*) AS symbols FROM named GROUP BY path ORDER BY symbols DESC, path LIMIT 5")
def top_symbol_files(spark, d):
    return aggregates.top_symbol_files(corpus.page_symbols(spark, d))


@query("ext_top15", f"WITH {_PAGES}, p AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents UNION ALL SELECT path FROM pages_), e AS (SELECT {_EXT.format(p='path')} AS ext FROM p) SELECT ext, count(*) AS files FROM e WHERE ext IS NOT NULL GROUP BY ext ORDER BY files DESC, ext LIMIT 15")
def ext_top15(spark, d):
    return aggregates.top_extensions(corpus.listed(spark, d).select("path").unionByName(corpus.pages(spark, d).select("path")))


@query("top_dirs_top20", f"WITH {_PAGES} SELECT split_part(path, '/', 1) AS dir, count(*) AS files FROM pages_ WHERE contains(path, '/') GROUP BY 1 ORDER BY files DESC, dir LIMIT 20")
def top_dirs_top20(spark, d):
    return aggregates.top_dirs(corpus.pages(spark, d))


@query("project_stats", rf"""WITH {_PAGES},
e AS (SELECT {_EXT.format(p='path')} AS ext, count(*) AS n FROM pages_ GROUP BY 1 HAVING ext IS NOT NULL ORDER BY n DESC, ext LIMIT 15),
g AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS n FROM pages_ WHERE contains(path, '/') GROUP BY 1 ORDER BY n DESC, dir LIMIT 20)
SELECT (SELECT count(*) FROM pages_) AS total, (SELECT coalesce(string_agg(ext || '=' || n, ',' ORDER BY n DESC, ext), '') FROM e) AS extensions, (SELECT coalesce(string_agg(dir || '=' || n, ',' ORDER BY n DESC, dir), '') FROM g) AS dirs, 0 AS manifests, 0 AS entrypoints""")
def project_stats(spark, d):
    out = aggregates.project_stats(corpus.pages(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("=", s["name"], s["files"].cast("string"))), ",").alias(c)
    return out.select("total", text("extensions"), text("dirs"), F.size("manifests").alias("manifests"), F.size("entrypoints").alias("entrypoints"))


@query("dir_tree", f"""WITH {_FILES}, parts AS (SELECT string_split(path, '/') AS p FROM files),
n AS (SELECT array_to_string(p[1:i], '/') AS node, CAST(i AS INTEGER) AS depth, i < len(p) AS is_dir FROM (SELECT p, unnest(range(1, least(len(p), 4) + 1)) AS i FROM parts)),
g AS (SELECT node, depth, bool_or(is_dir) AS is_dir, count(*) FILTER (is_dir) AS files, {_PARENT.format(p='node')} AS parent FROM n GROUP BY node, depth),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY files DESC, regexp_extract(node, '([^/]*)$', 1)) AS INTEGER) AS child_rank FROM g),
m AS (SELECT parent, greatest(count(*) - 25, 0) AS more FROM g GROUP BY parent),
v1 AS (SELECT * FROM r WHERE depth = 1 AND child_rank <= 25), v2 AS (SELECT r.* FROM r JOIN v1 ON r.parent = v1.node WHERE r.child_rank <= 25), v3 AS (SELECT r.* FROM r JOIN v2 ON r.parent = v2.node WHERE r.child_rank <= 25 AND r.depth <= 3)
SELECT v.node, v.parent, v.depth, v.is_dir, v.files, v.child_rank, coalesce(m.more, 0) AS more_children FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3) v LEFT JOIN m ON m.parent = v.node""")
def dir_tree(spark, d):
    return tree.dir_tree(corpus.listed(spark, d))


class _Md5Text:
    def __init__(self):
        self._state = hashlib.md5()

    def update(self, data: bytes) -> None:
        self._state.update(data.replace(b"\x00", b"\x01"))

    def digest(self) -> bytes:
        return self._state.hexdigest().encode()


@query("merkle_dirs", f"""WITH {_FILES}, d3 AS (SELECT {_PARENT.format(p='path')} AS dir, md5(string_agg(path || chr(1) || hash || chr(1), '' ORDER BY path)) AS h, count(*) AS n FROM files GROUP BY 1),
d2 AS (SELECT {_PARENT.format(p='dir')} AS dir, md5(string_agg(dir || chr(1) || h || chr(1), '' ORDER BY dir)) AS h, sum(n) AS n FROM d3 GROUP BY 1),
d1 AS (SELECT {_PARENT.format(p='dir')} AS dir, md5(string_agg(dir || chr(1) || h || chr(1), '' ORDER BY dir)) AS h, sum(n) AS n FROM d2 GROUP BY 1)
SELECT dir AS dir_path, h AS child_hash, CAST(n AS BIGINT) AS file_count FROM (SELECT * FROM d3 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d1)""")
def merkle_dirs(spark, d):
    """Hashes as md5 text and 1 for 0 bytes, which DuckDB's strings can't hold."""
    files = corpus.files(spark, d).select("path", F.col("hash").cast("binary").alias("hash"))
    return tree.merkle(files, _Md5Text).select("dir_path", F.col("child_hash").cast("string").alias("child_hash"), "file_count")


# --- listing, symbols, search, reads --------------------------------------------------------------


def _listing(rows: str) -> str:
    return f"""b AS ({rows}), s AS (SELECT path, sum(strlen(path) + 1) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS spent FROM b), k AS (SELECT path FROM s WHERE spent <= 40000)
SELECT path, (SELECT count(*) FROM b) AS total, (SELECT count(*) FROM k) AS count, (SELECT count(*) FROM b) - (SELECT count(*) FROM k) AS omitted FROM k"""


@query("list_files_budgeted", f"WITH {_PAGES}, {_listing('SELECT path FROM pages_')}")
def list_files_budgeted(spark, d):
    return lookup.list_files(corpus.pages(spark, d))


@query("list_files_filtered", f"WITH {_FILES}, {_listing('''SELECT path FROM files WHERE contains(path, '/src1')''')}")
def list_files_filtered(spark, d):
    return lookup.list_files(corpus.listed(spark, d), "/src1")


_FOLD = f"translate({{c}}, '{_UPPER}', '{_LOWER}')"


def _find(table: str, where: str) -> str:
    return f"SELECT path, name, kind, start_line, end_line FROM {table} WHERE {where} ORDER BY name, path, start_line, kind, end_line LIMIT 50"


_PARTS = "parts AS (SELECT p_brand AS path, p_name AS name, p_type AS kind, p_size AS start_line, p_size AS end_line FROM part)"


@query("find_symbol", f"WITH {_PARTS} {_find('parts', _FOLD.format(c='name') + ''' LIKE '%re%g%' ''')}")
def find_symbol(spark, d):
    return lookup.find_symbol(corpus.part_symbols(spark, d),  " Re%G ")


@query("find_symbol_kind", f"WITH {_PAGE_SYMBOLS}, l AS (SELECT *, 1 AS start_line, 1 AS end_line FROM named) {_find('l', _FOLD.format(c='name') + ''' LIKE '%th_%' AND kind = 'h1' ''')}")
def find_symbol_kind(spark, d):
    return lookup.find_symbol(corpus.page_symbols(spark, d), "Th_", kind="h1")


@query("find_symbol_path", f"WITH {_PARTS} {_find('parts', _FOLD.format(c='name') + ''' LIKE '%ring%' AND ''' + _FOLD.format(c='path') + ''' LIKE '%brand#1%' ''')}")
def find_symbol_path(spark, d):
    return lookup.find_symbol(corpus.part_symbols(spark, d), "ring", path_contains="brand#1")


@query("scan_char_counts", "SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, CAST(length(text) AS BIGINT) AS chars, CASE WHEN length(text) = 0 THEN '0 [empty]' ELSE CAST(length(text) AS VARCHAR) END AS shown FROM documents")
def scan_char_counts(spark, d):
    contents = corpus.contents(spark, d)
    return char_counts(contents.select("path", F.col("content").cast("binary").alias("content"), F.octet_length("content").alias("size")))


def _search(pattern: str, column: str, path: str = "true", limit: int = 100) -> str:
    return rf"""WITH {_FILES}, l AS (SELECT path, unnest({_LINES.format(t='text')}) AS t, generate_subscripts({_LINES.format(t='text')}, 1) AS line FROM files WHERE {path}),
h AS (SELECT * FROM l WHERE regexp_matches(t, '{pattern}') ORDER BY path, line LIMIT {limit})
SELECT path, CAST(line AS INTEGER) AS line, CAST(length(regexp_extract(t, '{column}', 1)) + 1 AS INTEGER) AS col, CASE WHEN length(rtrim(t)) > 200 THEN substr(rtrim(t), 1, 200) || '…' ELSE rtrim(t) END AS snippet FROM h"""


@query("search_regex", _search("token = |licen[sc]e", "^(.*?)(?:token = |licen[sc]e)"))
def search_regex(spark, d):
    return lookup.search(corpus.contents(spark, d), "token = |licen[sc]e")


@query("search_indexed", _search("(thing|thatin)[a-z]*[ ,.](?:the|and)", "^(.*?)(?:(?:thing|thatin)[a-z]*[ ,.](?:the|and))"))
def search_indexed(spark, d):
    """The same kind of search over the texts that the gram index doesn't rule out."""
    pattern = "(thing|thatin)[a-z]*[ ,.](?:the|and)"
    left = grams.candidates_of_blocks(corpus.gram_index(spark, d), grams.condition(pattern))
    return lookup.search(corpus.contents(spark, d).join(left, "path", "left_semi"), pattern)


@query("search_ci_path", _search("(?i)(?:LICENSE|copyright)", "(?i)^(.*?)(?:LICENSE|copyright)", "contains(path, 'en/src')", 20))
def search_ci_path(spark, d):
    return lookup.search(corpus.contents(spark, d), "LICENSE|copyright", path_contains="en/src", max_hits=20, case_insensitive=True)


_READ = rf"""WITH {_FILES}, r AS (SELECT doc_id AS ordinal, path, text, {{start}} AS s, {{end}} AS e FROM files),
l AS (SELECT *, {_LINES.format(t='text')} AS ls FROM r), c AS (SELECT *, greatest(coalesce(s, 1), 1) AS f, least(coalesce(e, len(ls)), greatest(len(ls), 1)) AS z FROM l)
SELECT ordinal, path, CASE WHEN f <= z THEN CAST(f AS INTEGER) END AS start_line, CASE WHEN f <= z THEN CAST(least(z, len(ls)) AS INTEGER) END AS end_line, CASE WHEN f <= z THEN CAST(len(ls) AS INTEGER) END AS total_lines,
  CASE WHEN f <= z THEN coalesce(array_to_string(ls[f:z], chr(10)), '') END AS content, CASE WHEN f > z THEN 'start_line (' || f || ') greater than end_line (' || z || ')' END AS error FROM c"""


@query("read_span", _READ.format(start="CAST(2 AS BIGINT)", end="CAST(5 AS BIGINT)"))
def read_span(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    asked = docs.select(F.col("doc_id").alias("ordinal"), "path", F.lit(2).alias("start_line"), F.lit(5).alias("end_line"))
    return lookup.read_spans(corpus.contents(spark, d), asked)


@query("read_spans_batch", _READ.format(start="doc_id % 7 - 1", end="CASE WHEN doc_id % 3 > 0 THEN doc_id % 11 END"))
def read_spans_batch(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    asked = docs.select(F.col("doc_id").alias("ordinal"), "path", (F.col("doc_id") % 7 - 1).alias("start_line"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 11).alias("end_line"))
    return lookup.tracked_spans(corpus.contents(spark, d), corpus.listed(spark, d), asked)


@query("read_file_capped", rf"""WITH {_FILES}, l AS (SELECT path, text, unnest({_LINES.format(t='text')}) AS t, generate_subscripts({_LINES.format(t='text')}, 1) AS i, len({_LINES.format(t='text')}) AS total FROM files WHERE strlen(text) > 0),
c AS (SELECT *, sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS upto FROM l), w AS (SELECT path, total, text, strlen(text) AS size, max(i) FILTER (upto < 2000 AND i < total OR strlen(text) <= 2000) AS last, string_agg(t, chr(10) ORDER BY i) FILTER (upto < 2000 AND i < total OR strlen(text) <= 2000) AS content FROM c GROUP BY path, total, text),
cut AS (SELECT path, total, size, coalesce(last, 1) AS last, CASE WHEN content IS NULL THEN substr(text, 1, CAST((SELECT max(i) FROM range(0, 2001) r(i) WHERE strlen(substr(text, 1, i)) <= 2000) AS BIGINT)) ELSE content END AS content FROM w)
SELECT path, 1 AS start_line, CAST(last AS INTEGER) AS end_line, CAST(total AS INTEGER) AS total_lines, content, CASE WHEN size > 2000 THEN '... file continues, returned ' || strlen(content) || ' of ' || size || ' bytes. Call read_file again with start_line=' || (last + 1) || ' to continue.' END AS truncated FROM cut
UNION ALL SELECT path, 1, 0, 0, '', NULL FROM files WHERE strlen(text) = 0""")
def read_file_capped(spark, d):
    """With a budget of 2000 bytes."""
    contents = corpus.contents(spark, d)
    spans = contents.select("path", F.lit(1).alias("start_line"), F.size(X.lines(F.col("content"))).alias("end_line"), F.size(X.lines(F.col("content"))).alias("total_lines"), F.array_join(X.lines(F.col("content")), "\n").alias("content"))
    return lookup.capped(spans, 2000)


@query("file_lookup", f"WITH {_FILES} SELECT path, hash, lang FROM files WHERE path LIKE '%/17.txt'")
def file_lookup(spark, d):
    """By its key, as the index looks a file up; what is asked for is the path of document 17."""
    files = corpus.files(spark, d)
    asked = files.filter(F.col("path").endswith("/17.txt")).select("path").first().path
    return lookup.lookup(files, path=asked).select("path", "hash", "lang")


@query("html_symbols", f"WITH {_PAGE_SYMBOLS} SELECT path, name, kind, 1 AS start_line, 1 AS end_line FROM named")
def html_symbols(spark, d):
    return corpus.page_symbols(spark, d)


# --- maintenance ----------------------------------------------------------------------------------

SNAPSHOTS = f"""d AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents),
old AS (SELECT path, md5(text) AS hash, {EPOCH} + doc_id * 60 AS mtime, CAST(strlen(text) AS BIGINT) AS size FROM d WHERE doc_id % 7 <> 0),
new AS (SELECT path, md5(t) AS hash, {EPOCH} + doc_id * 60 + late AS mtime, CAST(strlen(t) AS BIGINT) AS size FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS t, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 1 ELSE 0 END AS late FROM d) WHERE doc_id % 11 <> 0),
diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' WHEN old.hash <> new.hash THEN 'changed' ELSE 'unchanged' END AS status, old.hash AS old_hash, new.hash AS new_hash, new.mtime, new.size FROM old FULL JOIN new ON old.path = new.path)"""


@query("snapshot_diff", f"WITH {SNAPSHOTS} SELECT count(*) FILTER (status <> 'deleted') AS scanned, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM diff")
def snapshot_diff(spark, d):
    return snapshot.diff_report(snapshot.diff(*corpus.snapshots(spark, d)))


@query("snapshot_diff_rows", f"WITH {SNAPSHOTS} SELECT * FROM diff")
def snapshot_diff_rows(spark, d):
    return snapshot.diff(*corpus.snapshots(spark, d))


@query("snapshot_upsert", f"WITH {SNAPSHOTS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)")
def snapshot_upsert(spark, d):
    return snapshot.upsert(*corpus.snapshots(spark, d), ["path"])


@query("replace_symbols", f"WITH {SNAPSHOTS} SELECT path, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM d WHERE path IN (SELECT path FROM old) AND path NOT IN (SELECT path FROM diff WHERE status = 'changed') UNION ALL SELECT path, 'new' FROM diff WHERE status = 'changed'")
def replace_symbols(spark, d):
    old, new = corpus.snapshots(spark, d)
    symbols = corpus.contents(spark, d).join(old.select("path"), "path", "left_semi").select("path", F.explode(F.regexp_extract_all("content", F.lit("([A-Z][a-z]+)"), 1)).alias("name"))
    changed = snapshot.diff(old, new).filter("status = 'changed'").select("path")
    return snapshot.replace_for(symbols, changed.withColumn("name", F.lit("new")), changed)


@query("cascade_delete", f"WITH {SNAPSHOTS}, child AS (SELECT lang || '/' || source || '/' || d.doc_id || '.txt' AS path, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT * FROM child WHERE path IN (SELECT path FROM new)")
def cascade_delete(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    child = labels.join(docs, "doc_id").select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "quality", "toxic")
    return snapshot.cascade(child, corpus.snapshots(spark, d)[1])


@query("readme_head", rf"WITH {_FILES}, l AS (SELECT path, {_LINES.format(t='text')} AS ls FROM files) SELECT path, coalesce(array_to_string(ls[1:80], chr(10)), '') AS text_head, CAST(len(ls) AS INTEGER) AS line_count FROM l")
def readme_head(spark, d):
    return snapshot.readme_heads(corpus.contents(spark, d))


_KIND = "CASE WHEN n = 'dockerfile' OR n LIKE 'dockerfile.%' OR n LIKE '%.dockerfile' THEN 'Dockerfile' WHEN n IN ('makefile', 'gnumakefile') THEN 'Makefile' WHEN n IN ('justfile', '.justfile') THEN 'Justfile' WHEN n = 'procfile' THEN 'Procfile' WHEN n IN ('docker-compose.yml', 'docker-compose.yaml', 'compose.yml', 'compose.yaml') THEN 'DockerCompose' END"
_NAMES = ("Dockerfile", "x.dockerfile", "GNUmakefile", "justfile", "Procfile", "compose.yml", "main.rs", "app.PY", "lib.tsx", "a.tar.gz", ".bashrc", "x.h", "noext", "dot.")
_LANG_SQL = "CASE " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"


@query("detect_lang_kind", rf"WITH {_PAGES}, q AS (SELECT page_id, path || '/' || [{', '.join(repr(n) for n in _NAMES)}][page_id % {len(_NAMES)} + 1] AS path FROM pages_), r AS (SELECT page_id, path, {_EXT.format(p='path')} AS e, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM q) SELECT page_id, path, {_LANG_SQL} AS lang, {_KIND} AS kind, e AS ext, {_PARENT.format(p='path')} AS parent FROM r")
def detect_lang_kind(spark, d):
    names = F.array(*map(F.lit, _NAMES))
    pages = corpus.pages(spark, d).select("page_id", F.concat_ws("/", "path", F.element_at(names, (F.col("page_id") % len(_NAMES) + 1).cast("int"))).alias("path"))
    p = F.col("path")
    return pages.select("page_id", "path", P.language(p).alias("lang"), P.run_config_kind(P.basename(p)).alias("kind"), P.extension(p).alias("ext"), P.parent_dir(p).alias("parent"))


# --- applications, workspaces, summaries ----------------------------------------------------------


def _apps(spark, d):
    """Every document a manifest of its source, every 3rd a run configuration beside it, every 5th a README."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text")
    at = lambda name: F.concat_ws("/", F.concat("lang", F.lit("-"), "source", F.lit("-"), (F.col("doc_id") % 97).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(name)))
    script = F.when(F.col("doc_id") % 4 == 0, F.array(F.struct(F.lit("run").alias("name"), F.lit("main").alias("target")))).otherwise(F.array().cast("array<struct<name:string,target:string>>"))
    eco = F.element_at(F.array(F.lit("rust"), F.lit("python"), F.lit("node")), (F.col("doc_id") % 3 + 1).cast("int"))
    space = F.when(F.col("doc_id") % 50 == 7, F.struct(F.lit("cargo").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("members")))
    manifest = F.struct(eco.alias("ecosystem"), F.col("source").alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("language_version"), script.alias("scripts"), F.array().cast("array<string>").alias("top_deps"), space.alias("workspace"))
    manifests = docs.filter("doc_id % 2 = 0 OR doc_id % 50 = 7").select(at("/m.toml").alias("path"), manifest.alias("manifest"))
    manifests = manifests.withColumn("path", F.regexp_replace("path", "/([0-9]+)/m.toml$", "/m$1.toml"))
    configs = docs.filter("doc_id % 3 = 0").select(F.regexp_replace(at(""), "/([0-9]+)$", "/Dockerfile.$1").alias("path"), F.lit("Dockerfile").alias("kind"), F.lit("cmd").alias("field"), F.lit("go").alias("value"), F.lit(1).alias("line"))
    readmes = docs.filter("doc_id % 5 = 0").select(F.regexp_replace(at(""), "/([0-9]+)$", "/README$1.md").alias("path"), F.substring("text", 1, 20).alias("text_head"), F.lit(1).alias("line_count"))
    return manifests, configs, readmes


_APPS = """dir AS (SELECT doc_id, text, lang || '-' || source || '-' || (doc_id % 97) AS dir, source FROM documents),
m AS (SELECT doc_id, dir || '/m' || doc_id || '.toml' AS path, dir, source AS name, ['rust', 'python', 'node'][doc_id % 3 + 1] AS eco FROM dir WHERE doc_id % 2 = 0 OR doc_id % 50 = 7),
c AS (SELECT dir || '/Dockerfile.' || doc_id AS path, dir FROM dir WHERE doc_id % 3 = 0),
r AS (SELECT dir, min(dir || '/README' || doc_id || '.md') AS path FROM dir WHERE doc_id % 5 = 0 GROUP BY dir),
told AS (SELECT path, 0 AS tier, '' AS src, 0 AS i, 'manifest.scripts' AS source, 'run' AS name, 'main' AS target FROM m WHERE doc_id % 4 = 0 UNION ALL SELECT m.path, 1, c.path, 0, 'Dockerfile.CMD', c.path, 'go' FROM m JOIN c ON m.dir = c.dir),
h AS (SELECT path, dir, unnest(f) AS file, generate_subscripts(f, 1) - 1 AS i FROM (SELECT path, dir, CASE eco WHEN 'rust' THEN ['src/main.rs', 'src/lib.rs'] WHEN 'python' THEN ['src/main.py', 'main.py', 'app.py', 'server.py', '__main__.py'] ELSE ['src/index.ts', 'src/index.js', 'index.ts', 'index.js', 'src/server.ts', 'src/server.js'] END AS f FROM m WHERE path NOT IN (SELECT path FROM told))),
e AS (SELECT * FROM told UNION ALL SELECT path, 2, '', i, 'heuristic', NULL, dir || '/' || file FROM h)"""


@query("entrypoints", f"WITH {_APPS} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY tier, src, i) - 1 AS INTEGER) AS ordinal, source, name, target FROM e")
def entrypoints(spark, d):
    manifests, configs, _ = _apps(spark, d)
    return overview.entrypoints(manifests, configs)


@query("applications", f"""WITH {_APPS} SELECT m.dir AS root, m.path AS manifest, eco AS ecosystem, name, (SELECT count(*) FROM c WHERE c.dir = m.dir) AS run_configs, (SELECT min(path) FROM c WHERE c.dir = m.dir) AS first_config, r.path AS readme, (SELECT count(*) FROM e WHERE e.path = m.path) AS entrypoints FROM m LEFT JOIN r ON r.dir = m.dir""")
def applications(spark, d):
    out = overview.applications(*_apps(spark, d))
    first = F.get_json_object(F.get("run_configs", F.lit(0)), "$.path")
    return out.select("root", "manifest", "ecosystem", "name", F.size("run_configs").cast("long").alias("run_configs"), first.alias("first_config"), F.col("readme.path").alias("readme"), F.size("entrypoints").cast("long").alias("entrypoints"))


@query("workspace_detect", f"""WITH {_APPS}, k AS (SELECT min(path) AS p FROM m WHERE doc_id % 50 = 7)
SELECT true AS is_monorepo, 'cargo workspace marker in ' || p AS reason, 'cargo' AS marker_kind, p AS marker_path, 'a,b' AS members FROM k""")
def workspace_detect(spark, d):
    return overview.detect_workspace(_apps(spark, d)[0]).withColumn("members", F.array_join("members", ","))


@query("workspace_unmarked", f"""WITH {_APPS} SELECT count(DISTINCT dir) >= 2 AS is_monorepo, 'multiple sibling manifest files without workspace declaration' AS reason, CAST(NULL AS VARCHAR) AS marker_kind, CAST(NULL AS VARCHAR) AS marker_path, md5(string_agg(dir, ',' ORDER BY path)) AS members FROM m WHERE doc_id % 50 <> 7""")
def workspace_unmarked(spark, d):
    """The members are long here, so their digest is returned."""
    out = overview.detect_workspace(_apps(spark, d)[0].filter("manifest.workspace IS NULL"))
    return out.withColumn("members", F.md5(F.array_join("members", ",").cast("binary")))


def _summaries(spark, d):
    """First lines as summaries; every 4th was made of another content."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    h = F.md5(F.col("text").cast("binary"))
    return docs.filter("doc_id % 3 != 0").select(path.alias("path"), F.substring_index("text", "\n", 1).alias("summary"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise(h).alias("source_hash"))


_SUMS = f"{_FILES}, sums AS (SELECT path, split_part(text, chr(10), 1) AS summary, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE hash END AS source_hash FROM files WHERE doc_id % 3 <> 0), valid AS (SELECT f.path, f.hash, f.lang, CASE WHEN f.hash = s.source_hash THEN s.summary END AS summary FROM files f LEFT JOIN sums s ON s.path = f.path)"


@query("summary_valid_join", f"WITH {_SUMS} SELECT * FROM valid")
def summary_valid_join(spark, d):
    return summaries.valid_file_summaries(corpus.files(spark, d), _summaries(spark, d))


@query("summary_upsert", f"WITH {_SUMS} SELECT path, 'new' AS summary, hash AS source_hash FROM files WHERE doc_id % 6 = 1 UNION ALL SELECT * FROM sums WHERE path NOT IN (SELECT path FROM files WHERE doc_id % 6 = 1)")
def summary_upsert(spark, d):
    new = corpus.files(spark, d).filter(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long") % 6 == 1).select("path", F.lit("new").alias("summary"), F.col("hash").alias("source_hash"))
    return summaries.upsert_file_summaries(_summaries(spark, d), new)


@query("dir_children_summaries", f"WITH {_SUMS}, dirs AS (SELECT DISTINCT lang || '/' || source AS dir FROM documents) SELECT d.dir AS dir_path, coalesce(md5(string_agg(v.path || '=' || v.summary, chr(10) ORDER BY v.path)), md5('')) AS children, count(v.path) AS n FROM dirs d LEFT JOIN valid v ON v.summary IS NOT NULL AND {_PARENT.format(p='v.path')} = d.dir GROUP BY d.dir")
def dir_children_summaries(spark, d):
    files = corpus.files(spark, d)
    dirs = files.select(P.parent_dir(F.col("path")).alias("dir_path")).distinct().withColumn("child_hash", F.lit("h"))
    none = dirs.limit(0).select("dir_path", F.lit("").alias("summary"), "child_hash")
    out = summaries.valid_dir_summaries(dirs, none, files, _summaries(spark, d))
    joined = F.array_join(F.transform("children", lambda c: F.concat(c["path"], F.lit("="), c["summary"])), "\n")
    return out.select("dir_path", F.md5(joined.cast("binary")).alias("children"), F.size("children").cast("long").alias("n"))


@query("count_valid_summaries", f"WITH {_SUMS} SELECT count(summary) AS summaries FROM valid")
def count_valid_summaries(spark, d):
    return summaries.valid_file_summaries(corpus.files(spark, d), _summaries(spark, d)).agg(F.count("summary").alias("summaries"))


# --- ranked search --------------------------------------------------------------------------------

_TOKENS = r"tok AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok)"


def _score(name: str, tf: str) -> str:
    found = f"{name} AS (SELECT path, len(w) AS dl, {tf} AS tf FROM tok WHERE tf > 0)"
    df = f"(SELECT count(*) FROM {name})"
    idf = f"(CASE WHEN n <= 2 * {df} THEN 1e-6 ELSE ln((n - {df} + 0.5) / ({df} + 0.5)) END)"
    return f"{found}, {name}_s AS (SELECT path, {idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM {name}, corpus)"


def _ranked(ctes: list[str], scored: list[str], where: str, limit: int = 20) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {s}_s" for s in scored)
    return f"WITH {_TOKENS}, {', '.join(ctes)}, r AS (SELECT path, -sum(score) AS rank FROM ({union}) GROUP BY path HAVING {where} ORDER BY round(rank, 9), path LIMIT {limit}) SELECT r.path, t.text AS summary, round(r.rank, 4) AS rank FROM r JOIN tok t ON t.path = r.path"


def _fts(q: str, stemmed: bool = False) -> Query:
    def run(spark, d):
        texts = corpus.contents(spark, d).withColumnRenamed("content", "summary")
        return blocks.best_summaries_of_texts(texts, q, stemmed=stemmed).withColumn("rank", F.round("rank", 4))

    return run


_TF = "len(list_filter(w, lambda x: x = '{}'))"
query("fts_bm25", _ranked([_score("a", _TF.format("thesan"))], ["a"], "true"))(_fts("thesan"))
query("fts_and", _ranked([_score("a", _TF.format("thing")), _score("b", _TF.format("that"))], ["a", "b"], "path IN (SELECT path FROM a) AND path IN (SELECT path FROM b)"))(_fts("thing that"))
query("fts_or", _ranked([_score("a", _TF.format("thing")), _score("b", _TF.format("thand"))], ["a", "b"], "true"))(_fts("thing OR thand"))
query("fts_not", _ranked([_score("a", _TF.format("thing")), "c AS (SELECT path FROM tok WHERE list_contains(w, 'was'))"], ["a"], "path NOT IN (SELECT path FROM c)"))(_fts("thing NOT was"))
query("fts_phrase", _ranked([_score("a", "len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'thing'))")], ["a"], "true"))(_fts('"the thing"'))
query("fts_prefix", _ranked([_score("a", "len(list_filter(w, lambda x: x LIKE 'thesan%'))")], ["a"], "true"))(_fts("thesan*"))
_APART = "near AS (SELECT path FROM tok WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'thing' AND list_contains(w[greatest(1, i - 5):i + 5], 'the'))) > 0)"
query("fts_near", _ranked([_score("a", _TF.format("thing")), _APART], ["a"], "path NOT IN (SELECT path FROM near)"))(_fts('"thing" NOT NEAR(thing the, 4)'))
query("fts_first", _ranked([_score("a", "CAST(w[1] = 'the' AS INTEGER)"), _score("b", _TF.format("thing"))], ["a", "b"], "path IN (SELECT path FROM a) AND path IN (SELECT path FROM b)"))(_fts('"thing" AND ^the'))
query("fts_column", _ranked([_score("a", _TF.format("thing")), _score("b", _TF.format("the"))], ["a", "b"], "path IN (SELECT path FROM a) AND path IN (SELECT path FROM b)"))(_fts('"thing" AND summary : the NOT path : thing'))
query("fts_stemmed", _ranked([_score("a", "len(list_filter(w, lambda x: regexp_matches(x, '^thing(s|es?|eds?|ings?|ness(es)?|ful(s|ness(es)?)?|ative(s|ness(es)?)?|ativity)?$')))")], ["a"], "true"))(_fts("things", stemmed=True))


# --- evidence -------------------------------------------------------------------------------------

_SPANS = "spans AS (SELECT 'src/f' || (l_orderkey % 997) || '.py' AS path, CAST(l_partkey % 500 + 1 AS INTEGER) AS s, CAST(l_partkey % 500 + 1 AS INTEGER) + CAST(floor(l_quantity % 7) AS INTEGER) AS e FROM lineitem)"
_MERGED = f"{_SPANS}, u AS (SELECT DISTINCT * FROM spans), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM u), g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f), merged AS (SELECT path, min(s) AS start_line, max(e) AS end_line FROM g GROUP BY path, island)"


@query("merged_spans", f"WITH {_MERGED} SELECT * FROM merged")
def merged_spans(spark, d):
    return evidence.merge_spans(corpus.spans(spark, d))


@query("touched_only", f"WITH {_SPANS} SELECT DISTINCT path FROM (SELECT 'src/f' || (o_orderkey % 1500) || '.py' AS path FROM orders) WHERE path NOT IN (SELECT path FROM spans)")
def touched_only(spark, d):
    touched = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("src/f"), (F.col("o_orderkey") % 1500).cast("string"), F.lit(".py")).alias("path"))
    return evidence.touched_only(touched, corpus.spans(spark, d))


@query("sources_footer", f"""WITH {_MERGED}, c AS (SELECT string_agg('- ' || path || ':' || start_line || CASE WHEN start_line = end_line THEN '' ELSE '-' || end_line END || chr(10), '' ORDER BY path, start_line) AS t FROM merged)
SELECT chr(10) || chr(10) || '**Sources:**' || chr(10) || t || chr(10) || '*Also examined:* a.txt, b.txt' || chr(10) AS footer FROM c""")
def sources_footer(spark, d):
    return evidence.sources_footer(corpus.spans(spark, d), spark.sql("SELECT explode(array('b.txt', 'a.txt', 'b.txt')) AS path"))


@query("session_budget", "SELECT conv_id AS session, turn AS seq, CAST(strlen(text) AS BIGINT) AS cost, CAST(sum(strlen(text)) OVER w AS BIGINT) AS used, CAST(sum(strlen(text)) OVER w AS BIGINT) || ' / 200000 chars used' AS note FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def session_budget(spark, d):
    return evidence.session_usage(corpus.session_log(spark, d))


@query("call_pairing", """WITH c AS (SELECT conv_id AS session, 'call' || (turn // 2 % 2) AS name, turn AS seq, role FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY session, name, role = 'assistant' ORDER BY seq) AS k FROM c)
SELECT a.session, a.name, a.seq AS call_seq, b.seq AS response_seq FROM n a LEFT JOIN n b ON a.session = b.session AND a.name = b.name AND a.k = b.k AND b.role = 'assistant' WHERE a.role <> 'assistant'""")
def call_pairing(spark, d):
    log = corpus.session_log(spark, d).select("session", "seq", "tool", F.concat(F.lit("call"), (F.floor(F.col("seq") / 2) % 2).cast("string")).alias("name"))
    return evidence.pair_calls(log.filter("tool != 'assistant'"), log.filter("tool = 'assistant'"))


# --- scalars --------------------------------------------------------------------------------------


@query("weburl_normalize", r"""WITH r AS (SELECT page_id, url, ['git@' || regexp_extract(url, '://([^/]*)', 1) || ':team/p' || page_id || '.git', 'ssh://git@' || regexp_extract(url, '://([^/]*)', 1) || '/p' || page_id || '.git', url || '.git', 'file' || page_id, ''][page_id % 5 + 1] AS remote FROM pages)
SELECT page_id, remote, CASE WHEN remote = '' THEN NULL WHEN remote LIKE 'git@%' THEN 'https://' || regexp_replace(replace(substr(remote, 5), ':', '/'), '(\.git)+$', '') WHEN remote LIKE 'ssh://%' THEN 'https://' || regexp_replace(substr(remote, 11), '(\.git)+$', '') WHEN remote LIKE 'http%' THEN regexp_replace(remote, '(\.git)+$', '') ELSE remote END AS web FROM r""")
def weburl_normalize(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    host, n = F.regexp_extract("url", "://([^/]*)", 1), F.col("page_id").cast("string")
    forms = F.array(F.concat(F.lit("git@"), host, F.lit(":team/p"), n, F.lit(".git")), F.concat(F.lit("ssh://git@"), host, F.lit("/p"), n, F.lit(".git")), F.concat("url", F.lit(".git")), F.concat(F.lit("file"), n), F.lit(""))
    out = pages.select("page_id", F.element_at(forms, (F.col("page_id") % 5 + 1).cast("int")).alias("remote"))
    return out.select("page_id", "remote", P.web_url(F.col("remote")).alias("web"))


@query("dep_name", "SELECT p_partkey, replace(p_name, ' ', '-') || '[extra]>=' || p_size AS spec, regexp_extract(replace(p_name, ' ', '-') || '[extra]>=' || p_size, '^[A-Za-z0-9_.-]*', 0) AS dep FROM part")
def dep_name(spark, d):
    spec = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("[extra]>="), F.col("p_size").cast("string"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", spec.alias("spec")).select("p_partkey", "spec", P.dependency_name(F.col("spec")).alias("dep"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("config_resolution", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), nullif(d.lang, 'en'), 'default') AS value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def config_resolution(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.nullif("lang", F.lit("en")), F.lit("default")).alias("value"))


@query("size_age_text", f"WITH {_FILES}, s AS (SELECT path, size * 900 AS n, mtime FROM files) SELECT path, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size, CASE WHEN d < 60 THEN 'just now' WHEN d < 3600 THEN (d // 60) || ' min ago' WHEN d < 86400 THEN (d // 3600) || ' hr ago' ELSE (d // 86400) || ' days ago' END AS age FROM (SELECT *, {EPOCH + 90000} - mtime AS d FROM s)")
def size_age_text(spark, d):
    files = corpus.files(spark, d)
    return files.select("path", X.size_text(F.col("size") * 900).alias("size"), X.age_text(F.col("mtime"), F.lit(EPOCH + 90000)).alias("age"))


@query("distinct_dirs", f"WITH {_FILES} SELECT DISTINCT array_to_string(p[1:i], '/') AS dir FROM (SELECT p, unnest(range(0, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM files))")
def distinct_dirs(spark, d):
    return corpus.listed(spark, d).select(F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct()


from . import versions  # noqa: E402, F401  (registers its queries, which use the above)
