"""Directory rollups: the tree of file counts, and hashes from the bottom up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import Xxh3
from ..functions.paths import ancestors, depth, parent_dir
from ..schemas import TREE_CHILDREN, TREE_DEPTH


def dir_tree(files: DataFrame, max_depth: int = TREE_DEPTH, cap: int = TREE_CHILDREN) -> DataFrame:
    """node, parent, depth, is_dir, files, child_rank, more_children: the tree to max_depth.

    A directory's files are all below it, a file's are 0.  Of a directory's children the first ``cap`` by
    files and name are shown, and children of hidden ones are hidden too.  more_children: how many
    children of a shown directory are beyond the cap (at max_depth: all children count, none is shown).
    Paths are summed up to depth max_depth + 1 before anything else, so deep trees don't grow the shuffle.
    """
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth + 1))), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))
    nodes = files.select(F.explode(upto).alias("n")).select("n.*").groupBy("node", "depth").agg(F.max("is_dir").alias("is_dir"), F.count_if("is_dir").alias("files"))
    # A task passes on the first ``cap`` of a parent's children that it has, and their number, however many
    # children a flat directory has; only those are ranked together.
    nodes = nodes.withColumn("parent", parent_dir(F.col("node")))
    of_parent = Window.partitionBy("parent")
    rank = F.row_number().over(of_parent.orderBy(F.desc("files"), F.element_at(F.split("node", "/"), -1)))
    siblings = nodes.groupBy("parent").agg((F.greatest(F.count("*") - cap, F.lit(0))).alias("more_children"))
    shown = nodes.withColumn("child_rank", rank).filter((F.col("child_rank") <= cap) & (F.col("depth") <= max_depth))
    visible, level = None, shown.filter("depth = 1")
    for d in range(1, max_depth + 1):
        visible = level if visible is None else visible.unionByName(level)
        above = level.select(F.col("node").alias("parent"))
        level = shown.filter(F.col("depth") == d + 1).join(above, "parent", "left_semi").select(*shown.columns)
    return visible.join(siblings.withColumnRenamed("parent", "node"), "node", "left").select("node", "parent", "depth", "is_dir", "files", "child_rank", F.coalesce("more_children", F.lit(0)).alias("more_children"))


def _running(batches: Iterator[pa.RecordBatch], digest: Callable[[], Any]) -> Iterator[pa.RecordBatch]:
    """A row for each directory of children that come in order, one directory after the other; holds one
    running digest, however many children a directory has."""
    name, state, total = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state.digest()], pa.binary()), pa.array([total], pa.int64())], names=["dir_path", "child_hash", "file_count"])

    for b in batches:
        for parent, path, h, n in zip(*(b.column(c).to_pylist() for c in ("dir", "path", "hash", "n"))):
            if parent != name:
                if state:
                    yield row()
                name, state, total = parent, digest(), 0
            state.update(path.encode() + b"\x00" + h + b"\x00")
            total += n
    if state:
        yield row()


def merkle(files: DataFrame, digest: Callable[[], Any] = Xxh3, max_depth: int | None = None) -> DataFrame:
    """dir_path, child_hash, file_count (recursive) of every directory that has files below it, '' the root.

    files: path, hash (binary; null hashes are left out).  A directory's hash is that of its files and
    then its directories, each by path, as path, zero byte, hash, zero byte.  digest: makes the running hash
    (update, digest).  One shuffle a level, from the deepest up; what a level needs of the last one is its
    directories, so rows shrink upwards.
    """
    rows = files.filter("hash IS NOT NULL").select("path", "hash", parent_dir(F.col("path")).alias("dir"))
    rows = rows.withColumn("level", depth(F.col("dir")))
    deepest = max_depth if max_depth is not None else rows.agg(F.max("level")).first()[0]
    items = rows.select("level", "dir", F.lit(False).alias("is_dir"), "path", "hash", F.lit(1).cast("long").alias("n"))
    return _upwards(items, deepest if deepest is not None else -1, digest)


def _upwards(items: DataFrame, deepest: int, digest: Callable[[], Any]) -> DataFrame:
    """The directories' rows, from level ``deepest`` to the root; items: level, dir, is_dir, path, hash, n of their children,
    without the directories that are made here."""
    below, out = None, None
    for level in range(deepest, -1, -1):
        here = items.filter(F.col("level") == level).drop("level")
        if below is not None:
            here = here.unionByName(below.select(parent_dir(F.col("dir_path")).alias("dir"), F.lit(True).alias("is_dir"), F.col("dir_path").alias("path"), F.col("child_hash").alias("hash"), F.col("file_count").alias("n")))
        ordered = here.repartition("dir").sortWithinPartitions("dir", "is_dir", "path", "hash")
        below = ordered.mapInArrow(lambda it: _running(it, digest), "dir_path string, child_hash binary, file_count long")
        out = below if out is None else out.unionByName(below)
    return out if out is not None else items.limit(0).select(F.col("path").alias("dir_path"), F.col("hash").alias("child_hash"), F.lit(0).cast("long").alias("file_count"))


def merkle_update(files: DataFrame, stored: DataFrame, changed: DataFrame, write: Callable[[str, DataFrame], DataFrame], digest: Callable[[], Any] = Xxh3) -> tuple[DataFrame, DataFrame]:
    """(the new rows of directories above changed paths, those directories as dir_path).

    files: path, hash, as they are now; stored: dir_path, child_hash, file_count of before; changed: the paths that
    are new, gone or of another hash.  A directory that has no files any more has no new row.  Only directories
    above changes are hashed, from their files and their directories' hashes, of which those that aren't above a
    change are as stored.  write: keeps a small table that several steps read.
    """
    dirty = write("dirty", changed.select(F.explode(ancestors(F.col("path"))).alias("dir_path")).distinct())
    own = dirty.select(F.col("dir_path").alias("dir"))
    direct = files.filter("hash IS NOT NULL").select("path", "hash", parent_dir(F.col("path")).alias("dir")).join(own, "dir", "left_semi")
    clean = stored.filter("dir_path != ''").join(dirty, "dir_path", "left_anti").withColumn("dir", parent_dir(F.col("dir_path"))).join(own, "dir", "left_semi")
    items = direct.select("dir", F.lit(False).alias("is_dir"), "path", "hash", F.lit(1).cast("long").alias("n"))
    items = items.unionByName(clean.select("dir", F.lit(True).alias("is_dir"), F.col("dir_path").alias("path"), F.col("child_hash").alias("hash"), F.col("file_count").alias("n")))
    items = write("children", items.withColumn("level", depth(F.col("dir"))))
    deepest = items.agg(F.max("level")).first()[0]
    return _upwards(items, deepest if deepest is not None else -1, digest), dirty
