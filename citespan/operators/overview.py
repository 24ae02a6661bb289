"""Applications, workspaces, entry points and the project overview, from manifests, run configurations and READMEs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_dir
from .aggregates import top_dirs, top_extensions
from .extract.run_configs import run_config_json
from .tree import dir_tree

# Where each ecosystem's programs usually start.
HEURISTIC_ENTRIES = {
    "rust": ("src/main.rs", "src/lib.rs"),
    "python": ("src/main.py", "main.py", "app.py", "server.py", "__main__.py"),
    "node": ("src/index.ts", "src/index.js", "index.ts", "index.js", "src/server.ts", "src/server.js"),
}
WRITE_NULLS = {"ignoreNullFields": "false"}


def first_readmes(readmes: DataFrame) -> DataFrame:
    """app_dir, readme: of each directory's READMEs the first by path."""
    return readmes.groupBy(parent_dir(F.col("path")).alias("app_dir")).agg(F.min_by(F.struct("path", "text_head", "line_count"), "path").alias("readme"))


def entrypoints(manifests: DataFrame, run_configs: DataFrame) -> DataFrame:
    """path, ordinal, source, name, target: scripts, then Dockerfile commands of the manifest's directory;
    where there are none, the ecosystem's usual files, which may not exist."""
    apps = manifests.select("path", parent_dir(F.col("path")).alias("app_dir"), "manifest")
    scripts = apps.select("path", F.posexplode("manifest.scripts").alias("i", "s")).select("path", F.lit(0).alias("tier"), F.lit("").alias("at"), "i", F.lit("manifest.scripts").alias("source"), F.col("s.name").alias("name"), F.col("s.target").alias("target"))
    docker = run_configs.filter(F.col("field").isin("cmd", "entrypoint") & (F.col("kind") == "Dockerfile"))
    docker = docker.select(parent_dir(F.col("path")).alias("app_dir"), F.col("path").alias("name"), F.when(F.col("field") == "cmd", 0).otherwise(1).alias("i"), F.concat(F.lit("Dockerfile."), F.upper("field")).alias("source"), F.col("value").alias("target"))
    commands = apps.join(docker, "app_dir").select("path", F.lit(1).alias("tier"), F.col("name").alias("at"), "i", "source", "name", "target")
    told = scripts.unionByName(commands)
    usual = F.create_map(*[x for eco, names in HEURISTIC_ENTRIES.items() for x in (F.lit(eco), F.array(*map(F.lit, names)))])
    silent = apps.join(told.select("path"), "path", "left_anti")
    guessed = silent.select("path", "app_dir", F.posexplode(F.try_element_at(usual, F.col("manifest.ecosystem"))).alias("i", "file"))
    under = F.when(F.col("app_dir") == "", F.col("file")).otherwise(F.concat_ws("/", "app_dir", "file"))
    guessed = guessed.select("path", F.lit(2).alias("tier"), F.lit("").alias("at"), "i", F.lit("heuristic").alias("source"), F.lit(None).cast("string").alias("name"), under.alias("target"))
    return told.unionByName(guessed).groupBy("path").agg(F.collect_list(F.struct("tier", "at", "i", "source", "name", "target")).alias("all")).select("path", F.posexplode(F.array_sort("all")).alias("ordinal", "e")).select("path", "ordinal", "e.source", "e.name", "e.target")


def applications(manifests: DataFrame, run_configs: DataFrame, readmes: DataFrame) -> DataFrame:
    """root, manifest, ecosystem, name, version, language_version, scripts, top_deps, run_configs, readme,
    entrypoints of each manifest; equi-joins on the directory."""
    apps = manifests.select("path", parent_dir(F.col("path")).alias("app_dir"), "manifest")
    configs = run_config_json(run_configs).groupBy(parent_dir(F.col("path")).alias("app_dir")).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "kind", "config"))), lambda s: s["config"]).alias("run_configs"))
    entries = entrypoints(manifests, run_configs).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source", "name", "target"))), lambda s: F.struct(s["source"].alias("source"), s["name"].alias("name"), s["target"].alias("target"))).alias("entrypoints"))
    joined = apps.join(configs, "app_dir", "left").join(first_readmes(readmes), "app_dir", "left").join(entries, "path", "left")
    root = F.when(F.col("app_dir") == "", ".").otherwise(F.col("app_dir"))
    return joined.select(
        root.alias("root"), F.col("path").alias("manifest"), "manifest.ecosystem", "manifest.name", "manifest.version", "manifest.language_version", "manifest.scripts", "manifest.top_deps",
        F.coalesce("run_configs", F.array().cast("array<string>")).alias("run_configs"), "readme", "entrypoints",
    )


def detect_workspace(manifests: DataFrame) -> DataFrame:
    """One row: is_monorepo, reason, marker_kind, marker_path, members.

    The first marker by path decides; without one, manifests in two or more directories do, and members
    are the directories of all manifests.
    """
    marked = F.when(F.col("manifest.workspace").isNotNull(), F.col("path"))
    agg = manifests.withColumn("dir", parent_dir(F.col("path"))).agg(
        F.count("*").alias("n"), F.count_distinct("dir").alias("dirs"), F.min(marked).alias("marker_path"), F.min_by("manifest.workspace", marked).alias("marker"),
        F.transform(F.array_sort(F.collect_list(F.struct("path", "dir"))), lambda s: s["dir"]).alias("all_dirs"),
    )
    has = F.col("marker_path").isNotNull()
    many = F.col("dirs") >= 2
    reason = (
        F.when(has, F.concat(F.col("marker.kind"), F.lit(" workspace marker in "), F.col("marker_path")))
        .when(many, "multiple sibling manifest files without workspace declaration").when(F.col("n") == 0, "no manifests detected").otherwise("single manifest at root or in one directory")
    )
    none = F.array().cast("array<string>")
    return agg.select((has | many).alias("is_monorepo"), reason.alias("reason"), F.when(has, F.col("marker.kind")).alias("marker_kind"), "marker_path", F.when(has, F.coalesce("marker.members", none)).when(many, F.col("all_dirs")).otherwise(none).alias("members"))


def global_run_configs(run_configs: DataFrame) -> DataFrame:
    """path, kind, config of the root's own run configurations."""
    return run_config_json(run_configs.filter(~F.contains("path", F.lit("/")))).orderBy("path")


def project_overview(files: DataFrame, manifests: DataFrame, run_configs: DataFrame, readmes: DataFrame, project: DataFrame) -> DataFrame:
    """One row: overview, a JSON object of project, structure, workspace, applications, global_run_configs.

    project: one row with name, authors, git_init, remote_url, web_url, abs_path, last_scan_at.  All parts are
    bounded: ranked lists, a capped tree, and a row for each manifest of one repository.
    """
    listed = lambda df, order, out: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))), WRITE_NULLS).alias(out))
    parts = [
        project.agg(F.first(F.to_json(F.struct(*project.columns), WRITE_NULLS)).alias("project")), files.agg(F.count("*").alias("total_files")),
        listed(top_extensions(files).select((-F.col("files")).alias("order"), "ext", "files"), ["order", "ext"], "extensions"), listed(top_dirs(files).select((-F.col("files")).alias("order"), "dir", "files"), ["order", "dir"], "dirs"),
        listed(dir_tree(files), ["depth", "parent", "child_rank", "node"], "tree"), detect_workspace(manifests).select(F.to_json(F.struct("*"), WRITE_NULLS).alias("workspace")),
        listed(applications(manifests, run_configs, readmes), ["manifest"], "applications"), listed(global_run_configs(run_configs), ["path"], "global_run_configs"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    text = lambda *pairs: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for k, c in pairs]), F.lit("}"))
    structure = row.withColumn("structure", text(("total_files", "total_files"), ("top_extensions", "extensions"), ("top_level_dirs", "dirs"), ("tree", "tree")))
    return structure.select(text(("project", "project"), ("structure", "structure"), ("workspace", "workspace"), ("applications", "applications"), ("global_run_configs", "global_run_configs")).alias("overview"))
