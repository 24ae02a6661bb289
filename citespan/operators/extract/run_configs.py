"""Run configurations as long rows (path, kind, field, value, line)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.paths import basename, run_config_kind

Row = tuple[str, str, int]
_COMMENT = re.compile(r"#.*", re.S)


def text_lines(text: str) -> list[str]:
    """Lines without their ends \\n or \\r\\n; no empty line after a last end."""
    return re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text)) if text else []


def dockerfile(text: str) -> list[Row]:
    """The last FROM, CMD and ENTRYPOINT, and all EXPOSE ports.

    A directive's CMD or ENTRYPOINT runs on over lines that end in a backslash; FROM and EXPOSE are read
    from its first line only.  A comment sign ends a line anywhere.
    """
    last: dict[str, Row] = {}
    ports: list[Row] = []
    numbered = iter(enumerate(text_lines(text), 1))
    for number, first in numbered:
        whole = first
        while whole.rstrip().endswith("\\"):
            following = next(numbered, None)
            if following is None:
                break
            whole = whole.rstrip().rstrip("\\").rstrip() + " " + following[1].strip()
        word, *_ = _COMMENT.sub("", first).split(None, 1) or [""]
        rest = _COMMENT.sub("", first).strip()[len(word) :].strip()
        match word.upper():
            case "FROM":
                last["from"] = ("from", rest, number)
            case "CMD" | "ENTRYPOINT" as name:
                full = _COMMENT.sub("", whole).strip()
                last[name.lower()] = (name.lower(), full[len(word) :].strip(), number)
            case "EXPOSE":
                ports += [("expose", port, number) for port in rest.split()]
    return [last[k] for k in ("from", "cmd", "entrypoint") if k in last] + ports


def _headed(text: str, name: re.Pattern) -> Iterator[tuple[str, str, int]]:
    """(head, rest, line) of unindented lines that have a colon after a head that the pattern matches."""
    for number, line in enumerate(text_lines(text), 1):
        head, colon, rest = _COMMENT.sub("", line).partition(":")
        found = name.fullmatch(head.strip())
        if colon and line[:1] not in (" ", "\t") and found:
            yield found.group(1), rest, number


def makefile(text: str) -> list[Row]:
    return [("target", name, n) for name, rest, n in _headed(text, re.compile(r"([A-Za-z0-9._/-]+)")) if not rest.lstrip().startswith("=")]


def justfile(text: str) -> list[Row]:
    """Recipes; variables, settings and aliases look the same and are rows too."""
    return [("target", name, n) for name, _, n in _headed(text, re.compile(r"([A-Za-z0-9_-]+)(?:\s.*)?", re.S))]


def procfile(text: str) -> list[Row]:
    out = []
    for number, line in enumerate(text_lines(text), 1):
        name, _, command = (p.strip() for p in _COMMENT.sub("", line).partition(":"))
        if name and command:
            out.append(("process", f"{name}: {command}", number))
    return out


def _key_line(text: str, parent: str, child: str) -> int:
    """The first line below ``parent:`` that starts with ``child:``, before the indent falls back; else 0."""
    below = None
    for number, line in enumerate(text_lines(text), 1):
        key = line.lstrip()
        indent = len(line) - len(line.lstrip(" "))
        if below is None:
            below = indent if key.startswith(f"{parent}:") else None
        elif key and indent <= below:
            return 0
        elif key.startswith(f"{child}:"):
            return number
    return 0


def compose(text: str) -> list[Row]:
    import yaml

    value = yaml.safe_load(text)
    services = value.get("services") if isinstance(value, dict) else None
    names = [k for k in services if isinstance(k, str)] if isinstance(services, dict) else []
    return [("service", k, _key_line(text, "services", k)) for k in names]


PARSERS = {"Dockerfile": dockerfile, "Makefile": makefile, "Justfile": justfile, "Procfile": procfile, "DockerCompose": compose}


def parse(kind: str, text: str) -> list[Row] | None:
    """The rows of one file, or None if it can't be parsed."""
    try:
        return PARSERS[kind](text)
    except Exception:  # yaml has many kinds of error
        return None


def parse_run_configs(contents: DataFrame) -> DataFrame:
    """path, kind, field, value, line of the run configurations among contents (path, content).

    A file without directives has one row with null field; one that can't be parsed has none.
    """
    files = contents.withColumn("kind", run_config_kind(basename(F.col("path")))).filter("kind IS NOT NULL AND content IS NOT NULL")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, kind, text in zip(b["path"], b["kind"], b["content"]):
                found = parse(kind, text)
                if found is not None:
                    rows += [(path, kind, *r) for r in found] or [(path, kind, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "kind", "field", "value", "line"]).astype({"line": "Int32"})

    return files.select("path", "kind", "content").mapInPandas(run, "path string, kind string, field string, value string, line int")


def run_config_json(rows: DataFrame) -> DataFrame:
    """path, kind, config: one JSON object a file, each directive as {value, line}; nulls are written."""
    item = F.struct(F.col("value"), F.col("line"))
    first = lambda f: F.min_by(F.when(F.col("field") == f, item), F.when(F.col("field") == f, F.col("line")))
    many = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("line", "value")))), lambda s: F.struct(s["value"], s["line"]))
    grouped = rows.groupBy("path", "kind").agg(
        first("cmd").alias("cmd"), first("entrypoint").alias("entrypoint"), first("from").alias("from"), many("expose").alias("expose"), many("target").alias("targets"), many("process").alias("processes"), many("service").alias("services")
    )
    keep = {"ignoreNullFields": "false"}
    docker = F.to_json(F.struct("path", "kind", "cmd", "entrypoint", "expose", "from"), keep)
    other = lambda c: F.to_json(F.struct("path", "kind", c), keep)
    config = F.when(F.col("kind") == "Dockerfile", docker).when(F.col("kind").isin("Makefile", "Justfile"), other("targets")).when(F.col("kind") == "Procfile", other("processes")).otherwise(other("services"))
    return grouped.select("path", "kind", config.alias("config"))
