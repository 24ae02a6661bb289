"""Schemas of the index tables; limits that bound what is kept and returned."""

from __future__ import annotations


DIRECTIVE = "struct<value:string,line:int>"
MANIFEST = "struct<ecosystem:string,name:string,version:string,language_version:string,scripts:array<struct<name:string,target:string>>,top_deps:array<string>,workspace:struct<kind:string,members:array<string>>>"

REPO = "id string, abs_path string, git_remote string, last_scan_at long"
FILES = "path string, hash binary, mtime long, size long, lang string, is_binary boolean, updated_at long"
MANIFESTS = f"path string, manifest {MANIFEST}, hash binary"
RUN_CONFIGS = "path string, kind string, field string, value string, line int, hash binary"
READMES = "path string, text_head string, line_count int, hash binary"
SYMBOLS = "path string, name string, kind string, start_line int, end_line int, signature string"
DIR_HASHES = "dir_path string, child_hash binary, file_count long, updated_at long"
FILE_SUMMARIES = "path string, summary string, source_hash binary, generated_at long"
DIR_SUMMARIES = "dir_path string, summary string, child_hash binary, generated_at long"
#: The text index over file summaries: stemmed terms, and the length of every summary.
POSTINGS = "term string, path string, doc_length int, tf long, positions array<int>"
DOC_LENGTHS = "path string, doc_length int"
#: The same index in blocks: a row for each term and block of texts, and one for each block.
TERM_BLOCKS = "part string, block int, term string, n int, most int, shortest int, ords binary, tfs binary, sizes binary, positions binary"
DOC_BLOCKS = "part string, block int, paths array<string>, n long, tokens long"
#: The grams that a file holds, for content search.
GRAMS = "path string, gram string"
#: The same by blocks of texts: the numbers (two bytes each) of the texts with a gram, and where gram is '' the paths.
GRAM_BLOCKS = "block string, gram string, ords binary, paths array<string>"
#: Paths that a stream has deleted, and when: older events of theirs no longer count.
DELETED = "path string, mtime long"

TABLES = {
    "repo": REPO, "files": FILES, "manifests": MANIFESTS, "run_configs": RUN_CONFIGS, "readmes": READMES, "symbols": SYMBOLS,
    "dir_hashes": DIR_HASHES, "file_summaries": FILE_SUMMARIES, "dir_summaries": DIR_SUMMARIES,
    "postings": POSTINGS, "doc_lengths": DOC_LENGTHS, "term_blocks": TERM_BLOCKS, "doc_blocks": DOC_BLOCKS, "grams": GRAMS, "deleted": DELETED,
}
#: How files of a table are sorted, where it isn't by key.
SORTED = {"grams": ["gram", "path"], "postings": ["term", "path"], "symbols": ["path", "start_line"], "term_blocks": ["term", "part", "block"], "doc_blocks": ["part", "block"]}


def key_of(table: str) -> str | None:
    """The column by whose values a table's rows are replaced; the one row of repo is replaced as a whole."""
    return None if table == "repo" else "dir_path" if table.startswith("dir_") else "part" if table.endswith("_blocks") else "path"

# The documented limits.
MAX_PARSED_BYTES = 262_144
SNIFF_BYTES = 8_192
README_LINES = 80
LIST_BUDGET = 40_000
READ_BUDGET = 80_000
FIND_LIMIT, FIND_LIMIT_CHAT = 50, 100
SEARCH_LIMIT, SNIPPET_CHARS = 100, 200
SESSION_BUDGET = 200_000
TREE_DEPTH, TREE_CHILDREN = 3, 25
TOP_EXTENSIONS, TOP_DIRS, TOP_SYMBOL_FILES = 15, 20, 5
TOP_DEPENDENCIES = 10
SUMMARY_INPUT_CHARS = 8_000
