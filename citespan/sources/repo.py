"""The files of a repository as a DataFrame: ``spark.read.format("repo").option("path", root).load()``.

Spark's own file source drops dotfiles, names with a leading underscore and empty files, and knows no
ignore rules; this one lists them all.  The driver looks at the top of the tree only, until it has met some hundred
directories; executors walk those, and list or read what is in them.  A filter on ``path`` that is pushed down keeps
directories that can't hold such a path from being walked and files from being read, and content is read only if a
query asks for it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..functions.hashing import xxh3
from ..functions.paths import language
from ..schemas import SNIFF_BYTES
from .ignore import Ignore, rules

FILES_A_PARTITION, BYTES_A_PARTITION = 200, 64 << 20
#: Directories that the driver meets before it leaves the rest of the tree to executors.
FOLDERS = 128
SCHEMA = "path string, size long, mtime long, content binary"


def _start(root: str | Path) -> _Folder:
    """The root, with the rules that hold for it from above."""
    root = Path(root).resolve()
    top = next((p for p in (root, *root.parents) if (p / ".git").exists()), None)
    first = Ignore()
    if top:
        shared = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "git" / "ignore"
        for file in (shared, top / ".git" / "info" / "exclude"):
            try:
                first = Ignore(first.in_force + rules(file.read_text("utf-8", "replace")))
            except (OSError, RuntimeError):
                pass
        for parent in reversed([p for p in root.parents if top == p or top in p.parents]):
            # A parent's rules speak of paths from the parent.
            above = root.relative_to(parent).as_posix() + "/"
            first = Ignore(first.in_force + [replace(r, above=above) for r in Ignore().below(parent, "", True).in_force])

    return _Folder(str(root), "", first, top is not None)


def walk(root: str | Path, may_hold: Callable[[str], bool] = lambda base: True) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, mtime in seconds) of each file, by path in each directory.

    Dotfiles count; anything named .git doesn't; symbolic links aren't followed.  Ignore files apply down
    the tree, those of parents, .git/info/exclude and the user's own excludes too.  A file whose metadata
    can't be read is left out.  may_hold: whether a directory (its path, with a slash) is walked.
    """
    yield from _below(_start(root), may_hold)


@dataclass(frozen=True)
class _Folder:
    """A directory to walk: where it is, its path from the root with a slash, and the rules from above it."""

    place: str
    base: str
    ignore: Ignore
    in_repo: bool

    def entries(self) -> Iterator[_Folder | tuple[str, int, int]]:
        """Its files and directories, by name."""
        ignore = self.ignore.below(Path(self.place), self.base, self.in_repo)
        try:
            entries = sorted(os.scandir(self.place), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = self.base + e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name == ".git" or ignore.ignored(path, is_dir):
                continue
            if is_dir:
                yield _Folder(e.path, path + "/", ignore, self.in_repo)
                continue
            try:
                path.encode()
                s = e.stat(follow_symlinks=True)
            except (OSError, UnicodeEncodeError):
                continue
            if not os.path.isdir(e.path):
                yield path, s.st_size, int(s.st_mtime)


def _below(folder: _Folder, may_hold: Callable[[str], bool]) -> Iterator[tuple[str, int, int]]:
    for entry in folder.entries():
        if not isinstance(entry, _Folder):
            yield entry
        elif may_hold(entry.base):
            yield from _below(entry, may_hold)


class _Part(InputPartition):
    """Files that the driver has met, and directories that are walked where the partition is read."""

    def __init__(self, files: list[tuple[str, int, int]], folders: list[_Folder]):
        self.files, self.folders = files, folders


class RepoReader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content, self.tests = root, content, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            path = getattr(f, "attribute", None) == ("path",)
            if path and isinstance(f, (EqualTo, In, StringContains, StringStartsWith, StringEndsWith)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        check = {
            EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringContains: lambda f: f.value in path,
            StringStartsWith: lambda f: path.startswith(f.value), StringEndsWith: lambda f: path.endswith(f.value),
        }
        return all(check[type(f)](f) for f in self.tests)

    def _may_hold(self, base: str) -> bool:
        """Whether a wanted path can begin with base, a directory's path with a slash."""
        check = {EqualTo: lambda f: f.value.startswith(base), In: lambda f: any(v.startswith(base) for v in f.value), StringStartsWith: lambda f: f.value.startswith(base) or base.startswith(f.value)}
        return all(check[type(f)](f) for f in self.tests if type(f) in check)

    def partitions(self) -> list[InputPartition]:
        """Level by level, until there are FOLDERS directories to walk or none; these are dealt out one by one."""
        files, folders = [], [_start(self.root)]
        while folders and len(folders) < FOLDERS:
            below = []
            for folder in folders:
                for entry in folder.entries():
                    if not isinstance(entry, _Folder):
                        files.append(entry)
                    elif self._may_hold(entry.base):
                        below.append(entry)
            folders = below
        parts, now, size = [], [], 0
        for file in files:
            if self._wanted(file[0]):
                now.append(file)
                size += file[1]
                if len(now) >= FILES_A_PARTITION or size >= BYTES_A_PARTITION:
                    parts.append(_Part(now, []))
                    now, size = [], 0
        parts += [_Part(now, [])] if now or not (parts or folders) else []
        return parts + [_Part([], [folder]) for folder in folders]

    def read(self, partition: _Part) -> Iterator[tuple]:
        walked = (f for folder in partition.folders for f in _below(folder, self._may_hold) if self._wanted(f[0]))
        for path, size, mtime in chain(partition.files, walked):
            data = None
            if self.content:
                try:
                    data = (Path(self.root) / path).read_bytes()
                except OSError:
                    pass
            yield path, size, mtime, data


class RepoSource(DataSource):
    """Options: path, the repository's folder; content, "false" to list without reading."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(os.path.abspath(self.options["path"]), str(self.options.get("content", "true")).lower() != "false")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def repo_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("repo").option("path", root).option("content", str(content).lower()).load()


#: Bytes of contents that a reading task holds at once.
READ_TOGETHER = 16 << 20


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """listed (path, size, mtime) with content, read by executors from the folder; null if unreadable.

    Only the listed files are read.  They are dealt out evenly by name, so that a few changed files of a
    large tree, or all of it, are read by all executors.
    """
    root = os.path.abspath(root)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "size", "mtime", "content"])

        rows, held = [], 0
        for batch in batches:
            for path, size, mtime in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    data = (Path(root) / path).read_bytes()
                except OSError:
                    data = None
                rows.append((path, size, mtime, data))
                held += len(data or b"")
                if held >= READ_TOGETHER or len(rows) >= FILES_A_PARTITION:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    n = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path", "size", "mtime").repartition(n, "path").mapInArrow(run, SCHEMA)


def classified(files: DataFrame) -> DataFrame:
    """files with hash, lang, is_binary and text (null unless UTF-8) from path and content.

    is_binary: a zero byte among the first 8192; an empty file is text, an unreadable one is binary.
    """
    head = F.substring("content", 1, SNIFF_BYTES)
    binary = F.when(F.col("content").isNull(), True).when(F.col("size") == 0, False).otherwise(F.position(F.lit(b"\x00"), head) > 0)
    return files.select(
        "path", "size", "mtime", xxh3(F.col("content")).alias("hash"), language(F.col("path")).alias("lang"), binary.alias("is_binary"), F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("content")
    )


def char_counts(files: DataFrame) -> DataFrame:
    """path, chars (code points; null unless UTF-8), shown: the scan's line for each file."""
    chars = F.when(F.is_valid_utf8("content"), F.length(F.decode("content", "UTF-8"))).cast("long")
    shown = F.when(F.col("content").isNull() | chars.isNull(), F.concat(F.col("size").cast("string"), F.lit(" [binary]"))).when(chars == 0, "0 [empty]").otherwise(chars.cast("string"))
    return files.select("path", chars.alias("chars"), shown.alias("shown"))
