"""Columns over ``/``-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp", "swift": "swift", "md": "markdown", "markdown": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "sh": "shell", "bash": "shell",
}
#: Languages whose symbols are indexed.
SYMBOL_LANGUAGES = ("rust", "python", "typescript", "javascript", "go", "java", "c", "cpp", "csharp", "ruby")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """The directory of a path; the root is ''."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def depth(path: Column) -> Column:
    """Segments of a path; of '' none."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def extension(path: Column) -> Column:
    """The lower-case extension; null for names without one and for dotfiles, '' after a last dot."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, extension(path))


def ancestors(path: Column) -> Column:
    """All directories above a path, from the root '' down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def run_config_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when((low == "dockerfile") | low.startswith("dockerfile.") | low.endswith(".dockerfile"), "Dockerfile")
        .when(low.isin("makefile", "gnumakefile"), "Makefile")
        .when(low.isin("justfile", ".justfile"), "Justfile")
        .when(low == "procfile", "Procfile")
        .when(low.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), "DockerCompose")
    )


def is_readme(name: Column) -> Column:
    return F.lower(name).isin("readme", "readme.md", "readme.rst", "readme.txt", "readme.markdown")


def is_manifest(name: Column) -> Column:
    return name.isin("Cargo.toml", "package.json", "pyproject.toml")


def web_url(remote: Column) -> Column:
    """A git remote as a web address; null for an empty remote or one without a path."""
    r = F.trim(F.regexp_replace(remote, r"^\s+|\s+$", ""))
    no_git = lambda c: F.regexp_replace(c, r"(\.git)+$", "")
    scp, ssh = r"^git@([^:]*):(.*)$", r"^ssh://(?:git@)?([^/]*)/(.*)$"
    joined = lambda pattern: no_git(F.concat(F.lit("https://"), F.regexp_extract(r, pattern, 1), F.lit("/"), F.regexp_extract(r, pattern, 2)))
    return (
        F.when(r == "", None)
        .when(r.startswith("git@"), F.when(r.rlike(scp), joined(scp)))
        .when(r.startswith("ssh://"), F.when(r.rlike(ssh), joined(ssh)))
        .when(r.rlike("^https?://"), no_git(r))
        .otherwise(r)
    )


def dependency_name(spec: Column) -> Column:
    return F.regexp_extract(spec, "^[A-Za-z0-9_.-]*", 0)
