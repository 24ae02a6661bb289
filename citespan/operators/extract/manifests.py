"""Manifests as structs, and the naive header that the banner shows."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.paths import basename, is_manifest
from ...schemas import MANIFEST, TOP_DEPENDENCIES


def _at(value: object, *path: str) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _texts(value: object) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _table(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _scripts(table: object) -> list[dict]:
    return [{"name": k, "target": v} for k, v in sorted(_table(table).items()) if isinstance(v, str)]


def _workspace(kind: str, value: object) -> dict | None:
    return {"kind": kind, "members": _texts(_at(value, "members"))} if isinstance(value, dict) else None


def dependency(spec: str) -> str:
    return re.match(r"[A-Za-z0-9_.-]*", spec).group()


def cargo(text: str) -> dict:
    """An inherited version is a table, not a string, and so is null."""
    v = tomllib.loads(text)
    bins = [b for b in v.get("bin", []) if isinstance(b, dict)] if isinstance(v.get("bin"), list) else []
    return {
        "ecosystem": "rust",
        "name": _text(_at(v, "package", "name")),
        "version": _text(_at(v, "package", "version")),
        "language_version": _text(_at(v, "package", "rust-version")),
        "scripts": [{"name": b["name"], "target": _text(b.get("path")) or ""} for b in bins if _text(b.get("name"))],
        "top_deps": sorted(_table(v.get("dependencies")))[:TOP_DEPENDENCIES],
        "workspace": _workspace("cargo", v.get("workspace")),
    }


def package_json(text: str) -> dict:
    v = json.loads(text)
    spaces = _at(v, "workspaces")
    members = spaces if isinstance(spaces, list) else _at(spaces, "packages")
    return {
        "ecosystem": "node",
        "name": _text(_at(v, "name")),
        "version": _text(_at(v, "version")),
        "language_version": _text(_at(v, "engines", "node")),
        "scripts": _scripts(_at(v, "scripts")),
        "top_deps": sorted(_table(_at(v, "dependencies")))[:TOP_DEPENDENCIES],
        "workspace": {"kind": "npm/yarn/pnpm", "members": _texts(members)} if isinstance(spaces, (list, dict)) else None,
    }


def pyproject(text: str) -> dict:
    """PEP 621, else Poetry; of Poetry's dependencies python is dropped after the first ten are taken."""
    v = tomllib.loads(text)
    project, poetry = _table(v.get("project")), _table(_at(v, "tool", "poetry"))
    if isinstance(project.get("dependencies"), list):
        deps = [dependency(d) for d in project["dependencies"][:TOP_DEPENDENCIES] if isinstance(d, str)]
    else:
        deps = [k for k in sorted(_table(poetry.get("dependencies")))[:TOP_DEPENDENCIES] if k != "python"]
    either = lambda key: _text(project.get(key)) if _text(project.get(key)) is not None else _text(poetry.get(key))
    return {
        "ecosystem": "python",
        "name": either("name"),
        "version": either("version"),
        "language_version": _text(project.get("requires-python")),
        "scripts": _scripts(project.get("scripts")) + _scripts(poetry.get("scripts")),
        "top_deps": deps,
        "workspace": _workspace("uv", _at(v, "tool", "uv", "workspace")),
    }


PARSERS: dict[str, Callable[[str], dict]] = {"Cargo.toml": cargo, "package.json": package_json, "pyproject.toml": pyproject}


def parse(name: str, text: str) -> dict | None:
    """The manifest, or None if it can't be parsed."""
    try:
        return PARSERS[name](text)
    except (ValueError, RecursionError):
        return None


_TEXTS = pa.list_(pa.string())
#: MANIFEST as Arrow names it.
_ARROW = pa.struct([
    *[(c, pa.string()) for c in ("ecosystem", "name", "version", "language_version")],
    ("scripts", pa.list_(pa.struct([("name", pa.string()), ("target", pa.string())]))), ("top_deps", _TEXTS), ("workspace", pa.struct([("kind", pa.string()), ("members", _TEXTS)])),
])


def parse_manifests(contents: DataFrame) -> DataFrame:
    """path, manifest (struct) of the manifests among contents (path, content); broken ones have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, parse(p.rpartition("/")[2], t)) for p, t in zip(*(c.to_pylist() for c in b.columns))]
            rows = [r for r in rows if r[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([m for _, m in rows], _ARROW)], names=["path", "manifest"])

    files = contents.select("path", "content").filter(is_manifest(basename(F.col("path"))) & F.col("content").isNotNull())
    return files.mapInArrow(run, f"path string, manifest {MANIFEST}")


# --- the header: name and authors from the first manifest of the root, read line by line ------------


def setting(line: str, key: str) -> str | None:
    """The value of ``key = value`` with comments dropped."""
    m = re.match(rf"{re.escape(key)}\s*=(.*)", line.split("#", 1)[0].strip(), re.S)
    return m.group(1).strip() if m else None


def unquoted(text: str) -> str:
    text = text.strip().rstrip(",").strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def array_items(text: str) -> list[str]:
    """Items of a one-line array, split at commas outside quotes, tables and arrays."""
    inner = text.strip().lstrip("[").rstrip("]")
    out, start, nested, quote = [], 0, 0, ""
    for i, c in enumerate(inner + ","):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "{[":
            nested += 1
        elif c in "}]":
            nested -= 1
        elif c == "," and (nested == 0 or i == len(inner)):
            out.append(unquoted(inner[start:i]))
            start = i + 1
    if quote or nested:
        out.append(unquoted(inner[start:]))
    return [x for x in out if x]


def _json_value(text: str, key: str) -> str | None:
    """What stands after the first ``"key"`` and a colon."""
    _, found, after = text.partition(f'"{key}"')
    _, colon, rest = after.partition(":")
    return rest.lstrip() if found and colon else None


def header(name: str, text: str) -> tuple[str | None, list[str]]:
    if name == "package.json":
        field = lambda k: m.group(1) if (m := re.match(r'"([^"]*)"', _json_value(text, k) or "")) else None
        many = re.match(r"\[([^\]]*)\]", _json_value(text, "contributors") or "")
        more = [p.strip().strip('"') for p in many.group(1).split(",")] if many else []
        author = field("author")
        return field("name"), ([author] if author is not None else []) + [p for p in more if p]
    wanted = {"package"} if name == "Cargo.toml" else {"project", "tool.poetry"}
    section, title, authors = "", None, []
    for line in map(str.strip, text.split("\n")):
        if line.startswith("[") and (name == "Cargo.toml" or line.endswith("]")):
            section = line[1:-1] if name == "Cargo.toml" and line.endswith("]") else line.strip("[]") if name != "Cargo.toml" else line
            continue
        if section not in wanted:
            continue
        value = setting(line, "name")
        if value is not None and (title is None or name == "Cargo.toml"):
            title = unquoted(value)
        elif (value := setting(line, "authors")) is not None:
            items = array_items(value)
            if name == "Cargo.toml":
                authors = items
            else:
                for item in (i.lstrip("{").rstrip("}") for i in items):
                    m = re.match(r"name\s*=*(.*)", item, re.S)
                    authors.append(unquoted(m.group(1).strip().rstrip(",")) if m else item)
    return title, authors


def detect_header(root: str | Path) -> tuple[str | None, list[str]]:
    """Name and authors by the first of the root's manifests that is there and readable."""
    for name in PARSERS:
        file = Path(root) / name
        if file.is_file():
            try:
                return header(name, file.read_text("utf-8"))
            except (OSError, UnicodeDecodeError):
                continue
    return None, []


def git_remote(git_dir: str | Path) -> str | None:
    """The url of ``[remote "origin"]`` in a git folder's config."""
    try:
        text = (Path(git_dir) / "config").read_text("utf-8")
    except (OSError, UnicodeDecodeError):
        return None
    section = ""
    for line in map(str.strip, text.split("\n")):
        if line.startswith("["):
            section = line
        elif section == '[remote "origin"]' and (url := setting(line, "url")) is not None:
            return url
    return None


def web_url(remote: str | None) -> str | None:
    """A remote as a web address, in Python; functions.paths.web_url is the column form."""
    r = (remote or "").strip()
    plain = re.sub(r"(\.git)+$", "", r)
    if m := re.match(r"git@([^:]*):(.*)", plain) or re.match(r"ssh://(?:git@)?([^/]*)/(.*)", plain):
        return f"https://{m.group(1)}/{m.group(2)}"
    if r.startswith(("git@", "ssh://")) or not r:
        return None
    return plain if r.startswith(("http://", "https://")) else r
