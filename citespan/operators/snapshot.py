"""Incremental maintenance: diff two snapshots, and bring an index up to date by what has changed.

Only changed files are hashed and extracted again, only the directories above them get new hashes, and only
their rows are written: each table gets a layer of changes, and all layers become one new version of
the index (see ``store``), so readers see the old index or the new one and never a mixture.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import repo_id
from ..functions.paths import basename, is_readme
from ..functions.text import lines
from ..schemas import MAX_PARSED_BYTES, README_LINES, TABLES
from .extract.manifests import parse_manifests
from .extract.run_configs import parse_run_configs
from .extract.symbols import extract_symbols
from . import blocks
from .fts import doc_lengths, postings, tokenized
from .grams import gram_rows
from .store import Change, Conflict, SnapshotStore  # noqa: F401  (the index's home for its users)
from .tree import merkle_update


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, changed, unchanged, deleted), old_hash, new_hash, mtime, size.

    old and new: path, hash, mtime, size.  Contents decide: new times with the same hash are unchanged.
    """
    was = old.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    now = new.select("path", F.col("hash").alias("new_hash"), "mtime", "size", F.lit(True).alias("now"))
    both = was.join(now, "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return both.select("path", status.alias("status"), "old_hash", "new_hash", "mtime", "size")


def diff_report(changes: DataFrame) -> DataFrame:
    """One row: scanned, added, changed, unchanged, deleted."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changes.agg(F.count_if(F.col("status") != "deleted").alias("scanned"), n("added"), n("changed"), n("unchanged"), n("deleted"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_for(old: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """old without the rows of these paths, and new: all of a path's rows are replaced together."""
    return old.join(paths.select("path").distinct(), "path", "left_anti").unionByName(new.select(*old.columns))


def cascade(child: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of child whose file is still there."""
    return child.join(files.select("path"), "path", "left_semi")


def readme_heads(contents: DataFrame, most: int = README_LINES) -> DataFrame:
    """path, text_head, line_count of contents (path, content): the first lines and how many there are."""
    all_ = lines(F.col("content"))
    return contents.filter("content IS NOT NULL").select("path", F.array_join(F.slice(all_, 1, most), "\n").alias("text_head"), F.size(all_).alias("line_count"))


@dataclass
class RefreshReport:
    scanned: int = 0
    added: int = 0
    changed: int = 0
    unchanged: int = 0
    deleted: int = 0
    manifests: int = 0
    run_configs: int = 0
    readmes: int = 0
    symbols_files: int = 0
    symbols_total: int = 0
    dirs_hashed: int = 0

    as_dict = asdict


def _reblocked(change: Change, paths: DataFrame) -> None:
    """Make the text index's parts anew that these paths are in, from the summaries that there are now."""
    summaries, now = change.read("file_summaries").select("path", "summary"), change.now
    n = summaries.count()
    if now.get("parts", 0) * blocks.PART_TEXTS * 8 <= n:
        now["parts"], all_ = blocks.parts_for(n), True
    else:
        all_ = False
    part = blocks.part_of(F.col("path"), now["parts"]).alias("part")
    touched = change.work("parts", paths.select(part).distinct())
    if not all_:
        summaries = summaries.withColumn("part", part).join(touched, "part", "left_semi").drop("part")
    made = change.work("blocks", blocks.build(tokenized(summaries), now["parts"]))
    for name, rows in (("term_blocks", blocks.term_blocks(made)), ("doc_blocks", blocks.doc_blocks(made))):
        if all_:
            change.replace(name, rows)
        else:
            change.put(name, rows, touched)


#: Changed files up to which one task writes a table's new rows.
FEW = 1000


def apply_changes(change: Change, seen: DataFrame, gone: DataFrame, now: int) -> RefreshReport:
    """Put files into the index that are new or have been read again, and take files out of it; what was found.

    seen: path, hash, mtime, size, lang, is_binary, content (null unless UTF-8), written once; gone: path.  Of
    seen, files whose hash is as before get their new time and size and nothing else.
    """
    spark = change.store.spark
    old = change.read("files").select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    known = seen.join(old, "path", "left")
    changed = change.work("changed", known.filter("was IS NULL OR old_hash != hash").drop("old_hash"))
    vanished = change.work("vanished", gone.select("path").distinct().join(old, "path").select("path"))
    n_old, n_gone = old.count(), vanished.count()
    n = changed.agg(F.count_if(F.col("was").isNull()).alias("added"), F.count("was").alias("changed")).first()
    change.buckets(n_old + n.added)
    scanned = n_old - n_gone + n.added

    few = n.added + n.changed + n_gone <= FEW
    touched = changed.select("path").unionByName(vanished)
    usable = changed.drop("was").filter((F.col("size") <= MAX_PARSED_BYTES) & ~F.col("is_binary") & F.col("content").isNotNull())
    hashes = changed.select("path", "hash")
    keys = change.keys(touched, few)
    layers = {
        "files": (seen.select("path", "hash", "mtime", "size", "lang", "is_binary", F.lit(now).cast("long").alias("updated_at")), seen.select("path").unionByName(vanished)),
        "manifests": (parse_manifests(usable).join(hashes, "path"), keys),
        "run_configs": (parse_run_configs(usable).join(hashes, "path"), keys),
        "readmes": (readme_heads(usable.filter(is_readme(basename(F.col("path"))))).join(hashes, "path"), keys),
        "symbols": (extract_symbols(usable), keys),
        "grams": (gram_rows(usable), keys),
    }
    with ThreadPoolExecutor(len(layers)) as pool:  # tables are written side by side
        made = dict(zip(layers, pool.map(lambda name: change.put(name, *layers[name], few=few), layers)))

    now_there = change.read("files").select("path", "hash")
    if change.now["tables"].get("file_summaries"):  # summaries of files that never were go too
        lost = vanished.unionByName(change.read("file_summaries").select("path").join(now_there, "path", "left_anti"))
        gone_keys = change.keys(lost, few)
        for name in ("postings", "doc_lengths", "file_summaries"):
            change.put(name, None, gone_keys)
        _reblocked(change, lost)
    hashed, dirty = merkle_update(now_there, change.read("dir_hashes"), touched, change.work)
    hashed = change.put("dir_hashes", hashed.withColumn("updated_at", F.lit(now).cast("long")), dirty, few)
    if change.now["tables"].get("dir_summaries"):
        change.put("dir_summaries", None, dirty.join(hashed.select("dir_path"), "dir_path", "left_anti"), few)

    tagged = [made[name].select(F.lit(name).alias("name"), "path") for name in ("manifests", "run_configs", "readmes", "symbols")]
    found = {r.name: r for r in reduce(DataFrame.unionByName, tagged).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).collect()}
    n_of = lambda name, what: found[name][what] if name in found else 0
    return RefreshReport(
        scanned=scanned, added=n.added, changed=n.changed, unchanged=scanned - n.added - n.changed, deleted=n_gone,
        manifests=n_of("manifests", "n"), run_configs=n_of("run_configs", "files"), readmes=n_of("readmes", "n"),
        symbols_files=n_of("symbols", "files"), symbols_total=n_of("symbols", "n"), dirs_hashed=change.read("dir_hashes").count(),
    )


SEEN = "path", "hash", "mtime", "size", "lang", "is_binary", "content"


def _described(change: Change, repo: dict | None, now: int) -> None:
    row = {"id": None, "abs_path": None, "git_remote": None, **(repo or {}), "last_scan_at": now}
    change.replace("repo", change.store.spark.createDataFrame([tuple(row[k] for k in ("id", "abs_path", "git_remote", "last_scan_at"))], TABLES["repo"]).coalesce(1))


def refresh(source: DataFrame, store: SnapshotStore, now: int, verify: bool = False, repo: dict | None = None, read: Callable[[DataFrame], DataFrame] | None = None) -> RefreshReport:
    """Bring the index up to date with source and publish it; what was found.

    source: path, size, mtime, content (binary; null if it can't be read), or without content, and then
    ``read`` adds it to the rows it is given: those of new or changed files.  A file whose time and size are as
    they were counts as unchanged and isn't read, unless ``verify``; one that is read but can't be keeps
    its old rows.  Files over 256 KiB, binary files and files that aren't UTF-8 lose their derived rows.

    Written are the rows of what has changed, and the hashes of the directories above it.  If another writer
    publishes files meanwhile, the refresh begins again from that version.
    """
    from ..sources.repo import classified

    def work(change: Change) -> RefreshReport:
        old = change.read("files")
        listed = change.work("listed", source.select("path", "size", "mtime"))  # the tree is walked once
        same = old.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
        as_before = listed.join(same, "path").filter("mtime = old_mtime AND size = old_size").select("path")
        wanted = listed if verify else listed.join(as_before, "path", "left_anti")
        candidates = read(wanted) if read else source.join(wanted.select("path"), "path", "left_semi")
        seen = change.work("seen", classified(candidates.filter("content IS NOT NULL")).select(*SEEN))  # hashed once
        gone = old.select("path").join(listed, "path", "left_anti")
        report = apply_changes(change, seen, gone, now)
        if change.now["tables"].get("deleted"):  # what is there is no longer deleted
            change.put("deleted", None, listed.select("path"))
        _described(change, repo, now)
        change.commit(depends=("files", "dir_hashes", "deleted", "file_summaries"))
        return report

    report = store.retried(work)
    store.compact()
    return report


def store_file_summaries(store: SnapshotStore, new: DataFrame) -> int:
    """Put summaries (path, summary, source_hash, generated_at) into the index, in place of their paths' old ones,
    and into its text index, in one version; how many.  A null summary takes the old one away."""

    def work(change: Change) -> int:
        staged = change.work("summaries", new.select("path", "summary", "source_hash", "generated_at"))
        made, paths = staged.filter("summary IS NOT NULL"), staged.select("path")
        change.put("file_summaries", made, paths)
        change.put("postings", postings(made), paths)
        change.put("doc_lengths", doc_lengths(made), paths)
        _reblocked(change, paths)
        n = made.count()
        change.commit(depends=("file_summaries",))
        return n

    return store.retried(work)


def store_dir_summaries(store: SnapshotStore, new: DataFrame) -> int:
    """Put summaries (dir_path, summary, child_hash, generated_at) into the index, in place of the old ones; how many."""

    def work(change: Change) -> int:
        staged = change.work("summaries", new.select("dir_path", "summary", "child_hash", "generated_at"))
        change.put("dir_summaries", staged, staged.select("dir_path"))
        n = staged.count()
        change.commit()
        return n

    return store.retried(work)


def refresh_repo(spark: SparkSession, root: str, store_folder: str, now: int, verify: bool = False) -> tuple[SnapshotStore, RefreshReport]:
    """Refresh the index of the repository at root."""
    import os

    from ..sources.repo import read_contents, repo_files
    from .extract.manifests import git_remote

    root = os.path.abspath(root)
    remote = git_remote(os.path.join(root, ".git"))
    name = repo_id(root, remote)
    store = SnapshotStore(spark, f"{store_folder.rstrip('/')}/{name}")
    described = {"id": name, "abs_path": root, "git_remote": remote}
    report = refresh(repo_files(spark, root, content=False), store, now, verify, described, lambda listed: read_contents(listed, root))
    return store, report
