"""Counts, sums and top-k over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, extension
from ..schemas import TOP_DIRS, TOP_EXTENSIONS, TOP_SYMBOL_FILES

# Names of manifests and of likely entry points.
STATS_MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "Gemfile", "Pipfile", "requirements.txt", "deno.json", "tsconfig.json", "CMakeLists.txt")
ENTRY_NAMES = ("main.rs", "main.go", "main.py", "main.ts", "main.js", "index.ts", "index.js", "app.py", "server.py", "__main__.py", "Main.java", "Main.kt")


def index_stats(files: DataFrame, manifests: DataFrame, run_configs: DataFrame, readmes: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, manifests, run_configs, readmes, symbols, symbol_files (exact)."""
    counts = [files.agg(F.count("*").alias("files")), manifests.agg(F.count("*").alias("manifests")), run_configs.agg(F.count_distinct("path").alias("run_configs")), readmes.agg(F.count("*").alias("readmes")), symbols.agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("symbol_files"))]
    out = counts[0]
    for one_row in counts[1:]:
        out = out.crossJoin(one_row)
    return out


def _few_sorted(counts: DataFrame, *order) -> DataFrame:
    """counts in order, where its rows are a row for each language or kind: many tasks sum, and one sorts the
    few sums, so there is no job that samples the rows for ranges."""
    return counts.repartition(1).sortWithinPartitions(*order)


def files_by_lang(files: DataFrame) -> DataFrame:
    """lang, files: most files first; no language counts as (none)."""
    return _few_sorted(files.groupBy("lang").agg(F.count("*").alias("files")).select(F.coalesce("lang", F.lit("(none)")).alias("lang"), "files"), F.desc("files"), "lang")


def inspect_totals(files: DataFrame, last_scan: int | None) -> DataFrame:
    """One row in one pass: total_files, binary_files, total_bytes, newest_mtime, stale_files (null if never scanned)."""
    stale = F.count_if(F.col("mtime") > F.lit(last_scan)) if last_scan is not None else F.lit(None).cast("long")
    return files.agg(F.count("*").alias("total_files"), F.count_if("is_binary").alias("binary_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.max("mtime").alias("newest_mtime"), stale.alias("stale_files"))


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    return _few_sorted(symbols.groupBy("kind").agg(F.count("*").alias("symbols")), F.desc("symbols"), "kind")


def top_symbol_files(symbols: DataFrame, n: int = TOP_SYMBOL_FILES) -> DataFrame:
    return symbols.groupBy("path").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "path").limit(n)


def top_extensions(files: DataFrame, n: int = TOP_EXTENSIONS) -> DataFrame:
    """ext, files; names without an extension don't count."""
    return files.select(extension(F.col("path")).alias("ext")).filter("ext IS NOT NULL").groupBy("ext").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(n)


def top_dirs(files: DataFrame, n: int = TOP_DIRS) -> DataFrame:
    """dir, files: first segments of paths that have more than one."""
    nested = files.filter(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("dir"))
    return nested.groupBy("dir").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(n)


def project_stats(files: DataFrame) -> DataFrame:
    """One row: total, extensions, dirs (ranked), manifests, entrypoints (sorted paths)."""
    ranked = lambda df, key: df.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("m"), F.col(key).alias("k")))), lambda s: F.struct(s["k"].alias("name"), (-s["m"]).alias("files"))).alias(key + "s"))
    named = lambda names: F.sort_array(F.collect_list(F.when(basename(F.col("path")).isin(*names), F.col("path"))))
    base = files.agg(F.count("*").alias("total"), named(STATS_MANIFESTS).alias("manifests"), named(ENTRY_NAMES).alias("entrypoints"))
    return base.crossJoin(ranked(top_extensions(files), "ext")).crossJoin(ranked(top_dirs(files), "dir")).select("total", F.col("exts").alias("extensions"), "dirs", "manifests", "entrypoints")


def inspect(files: DataFrame, symbols: DataFrame, last_scan: int | None) -> dict[str, DataFrame]:
    """What the inspection shows, by name."""
    return {"totals": inspect_totals(files, last_scan), "files_by_lang": files_by_lang(files), "symbols_by_kind": symbols_by_kind(symbols), "top_symbol_files": top_symbol_files(symbols)}
