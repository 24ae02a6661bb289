"""Listing, symbol lookup, content search and span reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import check_pattern, first_match_column, like_folded, lines, shortened, trim_end
from ..schemas import FIND_LIMIT, LIST_BUDGET, READ_BUDGET, SEARCH_LIMIT, SNIPPET_CHARS


def matching_paths(files: DataFrame, path_contains: str | None = None) -> DataFrame:
    """path of the files whose path holds path_contains, case-sensitive."""
    return files.select("path") if path_contains is None else files.select("path").filter(F.contains("path", F.lit(path_contains)))


def list_files(files: DataFrame, path_contains: str | None = None, budget: int = LIST_BUDGET) -> DataFrame:
    """path, total, count, omitted: the first paths in order whose bytes and line ends fit the budget.

    path_contains is case-sensitive.  A path costs at least two bytes, so only the budget's half of the
    smallest paths is ever windowed: Spark keeps those by a top-k, not by a sort of all.
    """
    paths = matching_paths(files, path_contains)
    total = paths.agg(F.count("*").alias("total"))
    first = paths.orderBy("path").limit(budget // 2 + 1)
    spent = F.sum(F.octet_length("path") + 1).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = first.withColumn("spent", spent).filter(F.col("spent") <= budget).select("path")
    count = kept.agg(F.count("*").alias("count"))
    return kept.crossJoin(F.broadcast(total.crossJoin(count))).select("path", "total", "count", (F.col("total") - F.col("count")).alias("omitted"))  # both sides of the inner one are one row


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None, path_contains: str | None = None, limit: int = FIND_LIMIT) -> DataFrame:
    """path, name, kind, start_line, end_line of symbols whose name holds ``name``, by name; a top-k.

    name and path_contains match as in LIKE: % and _ are wildcards, ASCII letters match in either case.
    """
    if not name.strip():
        raise ValueError("missing 'name' argument")
    wanted = like_folded(F.col("name"), name.strip())
    if kind is not None:
        wanted &= F.col("kind") == kind
    if path_contains is not None:
        wanted &= like_folded(F.col("path"), path_contains)
    return symbols.filter(wanted).select("path", "name", "kind", "start_line", "end_line").orderBy("name", "path", "start_line", "kind", "end_line").limit(limit)


def search(contents: DataFrame, pattern: str, path_contains: str | None = None, max_hits: int = SEARCH_LIMIT, case_insensitive: bool = False) -> DataFrame:
    """path, line, col, snippet: the first match of each matching line, in order of path and line.

    contents: path, content (null: not UTF-8, never matches).  A text without any match is dropped before
    its lines are made.  Raises ValueError for a pattern that linear-time engines don't have.
    """
    if not pattern:
        raise ValueError("missing 'pattern' argument")
    check_pattern(pattern)
    regex = f"(?iu)(?:{pattern})" if case_insensitive else pattern
    kept = contents if path_contains is None else contents.filter(F.contains("path", F.lit(path_contains)))
    # What matches in a line matches in its text, where line ends are ends too; only a text's own ends are other places.
    kept = kept if any(end in pattern for end in (r"\A", r"\z", r"\Z")) else kept.filter(F.col("content").rlike(f"(?m){regex}"))
    rows = kept.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text")).filter(F.col("text").rlike(regex))
    hits = rows.orderBy("path", "at").limit(max_hits)
    return hits.select("path", (F.col("at") + 1).alias("line"), first_match_column(F.col("text"), regex).alias("col"), shortened(trim_end(F.col("text")), SNIPPET_CHARS).alias("snippet"))


def _span(all_: Column, start: Column, end: Column) -> dict[str, Column]:
    """The columns of a span read of these lines: clamped lines, or an error."""
    total = F.size(all_)
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    last = F.least(F.coalesce(end, total), F.greatest(total, F.lit(1)))
    error = F.when(first > last, F.concat(F.lit("start_line ("), first.cast("string"), F.lit(") greater than end_line ("), last.cast("string"), F.lit(")")))
    fits = error.isNull()
    return {
        "start_line": F.when(fits, first), "end_line": F.when(fits, F.least(last, total)), "total_lines": F.when(fits, total),
        "content": F.when(fits, F.when(total == 0, "").otherwise(F.array_join(F.slice(all_, first, F.greatest(last - first + 1, F.lit(0))), "\n"))), "error": error,
    }


def read_spans(contents: DataFrame, requests: DataFrame) -> DataFrame:
    """ordinal, path, start_line, end_line, total_lines, content, error of each request, in any order.

    requests: ordinal, path, start_line, end_line (null: from the start, to the end).  Lines count from 1,
    ends are inside; ends beyond the text are pulled back.  A request that can't be met has an error and
    nothing else.  The contents side is joined on path; requests are a caller's list, and Spark broadcasts
    them if they are as small as they look.
    """
    asked = requests.select("ordinal", "path", F.col("start_line").cast("int").alias("start"), F.col("end_line").cast("int").alias("end"))
    texts = contents.select("path", F.col("content").alias("text"), F.lit(True).alias("there"))
    # The lines are a column of their own, so that they are made once and not for each column that needs them.
    joined = asked.join(texts, "path", "left").withColumn("lines", lines(F.col("text")))
    got = _span(F.col("lines"), F.col("start"), F.col("end"))
    refused = (
        F.when(F.contains("path", F.lit("..")), "path traversal not allowed").when(F.col("path") == "", "missing 'path' argument").when(F.col("there").isNull(), "file not found").when(F.col("text").isNull(), "stream did not contain valid UTF-8")
    )
    columns = [F.when(refused.isNull(), got[c]).alias(c) for c in ("start_line", "end_line", "total_lines", "content")]
    return joined.select("ordinal", "path", *columns, F.coalesce(refused, got["error"]).alias("error"))


def tracked_spans(contents: DataFrame, files: DataFrame, requests: DataFrame) -> DataFrame:
    """read_spans for requests whose path is among files; others have the error that it isn't indexed."""
    known = files.select("path").distinct().withColumn("known", F.lit(True))
    marked = requests.join(known, "path", "left")
    out = read_spans(contents, marked.filter("known").drop("known"))
    lost = marked.filter("known IS NULL").select("ordinal", "path", *[F.lit(None).cast(t).alias(c) for c, t in (("start_line", "int"), ("end_line", "int"), ("total_lines", "int"), ("content", "string"))], F.lit("path not in index").alias("error"))
    return out.unionByName(lost)


def capped(spans: DataFrame, budget: int = READ_BUDGET) -> DataFrame:
    """Spans (path, start_line, end_line, total_lines, content) with content cut to the byte budget.

    It is cut back to the last line end within the budget, and end_line follows; a single longer line is cut
    within itself, at a code point.  truncated: a note of where to go on, or null.
    """
    data = F.encode("content", "UTF-8")
    size = F.octet_length("content")
    # The longest prefix of whole code points: as a lead byte follows the cut, or up to three bytes back.
    byte_at = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int")
    inside = lambda back: byte_at(F.lit(budget + 1 - back)).between(128, 191)
    keep = F.when(~inside(0), budget).when(~inside(1), budget - 1).when(~inside(2), budget - 2).otherwise(budget - 3)
    head = F.decode(F.substring(data, F.lit(1), keep), "UTF-8")
    whole_lines = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    over = size > budget
    cut = spans.withColumn("over", over).withColumn("cut", F.when(F.col("over"), whole_lines).otherwise(F.col("content")))
    last = F.col("start_line") + F.greatest(F.size(lines(F.col("cut"))), F.lit(1)) - 1
    end = F.when(F.col("over"), last).otherwise(F.col("end_line"))
    note = F.concat(F.lit("... file continues, returned "), F.octet_length("cut").cast("string"), F.lit(" of "), size.cast("string"), F.lit(" bytes. Call read_file again with start_line="), (last + 1).cast("string"), F.lit(" to continue."))
    return cut.select("path", "start_line", end.alias("end_line"), "total_lines", F.col("cut").alias("content"), F.when(F.col("over"), note).alias("truncated"))


def lookup(table: DataFrame, **keys: str) -> DataFrame:
    """The rows with these key values; Parquet's statistics skip the row groups that can't hold them."""
    for column, value in keys.items():
        table = table.filter(F.col(column) == value)
    return table
