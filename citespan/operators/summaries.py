"""Summaries of files and directories, valid only while the content hash is the one they were made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_dir
from ..schemas import SUMMARY_INPUT_CHARS
from .snapshot import upsert


def valid_file_summaries(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """path, hash, lang, summary: null unless made of this very content."""
    made = summaries.select("path", "summary", "source_hash")
    joined = files.select("path", "hash", "lang").join(made, "path", "left")
    return joined.select("path", "hash", "lang", F.when(F.col("hash") == F.col("source_hash"), F.col("summary")).alias("summary"))


def valid_dir_summaries(dir_hashes: DataFrame, dir_summaries: DataFrame, files: DataFrame, file_summaries: DataFrame) -> DataFrame:
    """dir_path, child_hash, summary (null unless valid), children: the direct files' valid summaries by path."""
    made = dir_summaries.select("dir_path", "summary", F.col("child_hash").alias("made_of"))
    own = dir_hashes.select("dir_path", "child_hash").join(made, "dir_path", "left").select("dir_path", "child_hash", F.when(F.col("child_hash") == F.col("made_of"), F.col("summary")).alias("summary"))
    children = valid_file_summaries(files, file_summaries).filter("summary IS NOT NULL").groupBy(parent_dir(F.col("path")).alias("dir_path")).agg(F.array_sort(F.collect_list(F.struct("path", "summary"))).alias("children"))
    return own.join(children, "dir_path", "left").select("dir_path", "child_hash", "summary", F.coalesce("children", F.array().cast("array<struct<path:string,summary:string>>")).alias("children"))


def upsert_file_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["path"])


def upsert_dir_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["dir_path"])


def extractive(path: str, lang: str | None, content: str) -> str:
    """The summary when there is no model: the path, the language and the first line that says something."""
    first = next((s for line in content.split("\n") if (s := line.strip(" \t\r#/*-\"'"))), "")
    return f"{path.rpartition('/')[2]} ({lang or 'text'}): {first[:160]}"


def extractive_dir(prompt: str) -> str:
    """A directory's summary when there is no model: its name, how many of its files the prompt has, the first of them."""
    head, *rest = prompt.split("\n")
    names = [line[2:].partition(": ")[0].rpartition("/")[2] for line in rest if line.startswith("- ")]
    return f"{head.partition(': ')[2]}: {len(names)} summarised files" + (f" ({', '.join(names[:5])}{', ...' if len(names) > 5 else ''})" if names else "")


def summarize_dirs(prompts: DataFrame, summarizer: Callable[[str], str] = extractive_dir) -> DataFrame:
    """dir_path, summary, child_hash of prompts (dir_path, prompt, child_hash); a directory for which the
    summarizer raises gets no row."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, prompt, h in zip(b["dir_path"], b["prompt"], b["child_hash"]):
                try:
                    rows.append((path, summarizer(prompt), h))
                except Exception:  # whatever a model's client raises is that directory's alone
                    continue
            yield pd.DataFrame(rows, columns=["dir_path", "summary", "child_hash"])

    return prompts.select("dir_path", "prompt", "child_hash").mapInPandas(run, "dir_path string, summary string, child_hash binary")


def summarize(contents: DataFrame, summarizer: Callable[[str, str | None, str], str] = extractive) -> DataFrame:
    """path, summary, source_hash of contents (path, lang, content, hash).

    summarizer gets a path, a language and at most 8000 code points, and an ellipsis if there were more.
    A file for which it raises gets no row.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, lang, text, h in zip(b["path"], b["lang"], b["content"], b["hash"]):
                try:
                    rows.append((path, summarizer(path, lang, text if len(text) <= SUMMARY_INPUT_CHARS else text[:SUMMARY_INPUT_CHARS] + "…"), h))
                except Exception:  # whatever a model's client raises is that file's alone
                    continue
            yield pd.DataFrame(rows, columns=["path", "summary", "source_hash"])

    return contents.filter("content IS NOT NULL").select("path", "lang", "content", "hash").mapInPandas(run, "path string, summary string, source_hash binary")


def dir_prompts(valid: DataFrame, budget: int = SUMMARY_INPUT_CHARS) -> DataFrame:
    """dir_path, prompt: a directory's child summaries, whole ones while their bytes fit the budget, then a mark."""
    head = F.concat(F.lit("Directory: "), F.when(F.col("dir_path") == "", ".").otherwise(F.col("dir_path")), F.lit("\n"))
    line = lambda c: F.concat(F.lit("- "), c["path"], F.lit(": "), c["summary"], F.lit("\n"))
    start = F.struct(head.alias("text"), F.lit(False).alias("full"))

    def add(acc, c):
        fits = ~acc["full"] & (F.octet_length(acc["text"]) + F.octet_length(line(c)) <= budget)
        more = F.when(acc["full"], acc["text"]).when(fits, F.concat(acc["text"], line(c))).otherwise(F.concat(acc["text"], F.lit("[truncated]\n")))
        return F.struct(more.alias("text"), (acc["full"] | ~fits).alias("full"))

    return valid.select("dir_path", F.aggregate("children", start, add)["text"].alias("prompt"))
