"""Evidence of what a caller has read: merged spans, untouched files, the sources footer, session use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SESSION_BUDGET


#: Lines of a stretch of a file whose spans are merged by themselves first.
STRETCH = 4096


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_line, end_line: the spans of each key merged where they overlap or touch."""
    ordered = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.when(F.col("start_line") <= reach + 1, 0).otherwise(1))
    island = flagged.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def merge_spans(spans: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """by, start_line, end_line: spans of a path merged where they overlap or touch.

    Two shuffles: spans by path and stretch of lines they start in, so that one path's are many tasks' work; then the
    merged ones by path, of which a stretch leaves half as many as it has lines at most.  Equal spans are merged
    as others are.
    """
    stretch = F.floor(F.col("start_line") / STRETCH)
    parts = _islands(spans.select(*by, "start_line", "end_line", stretch.alias("stretch")), [*by, "stretch"]).drop("stretch")
    return _islands(parts, list(by)).select(*by, "start_line", "end_line")


def touched_only(touched: DataFrame, spans: DataFrame) -> DataFrame:
    """path: touched but never read."""
    return touched.select("path").distinct().join(spans.select("path"), "path", "left_anti")


def sources_footer(spans: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """footer, one row: a line for each merged span, and the other touched paths; '' if there are neither.

    A footer is one caller's text: the rows gathered are that caller's spans.
    """
    merged = merge_spans(spans)
    cited = F.concat(F.lit("- "), "path", F.lit(":"), F.col("start_line").cast("string"), F.when(F.col("start_line") == F.col("end_line"), "").otherwise(F.concat(F.lit("-"), F.col("end_line").cast("string"))), F.lit("\n"))
    lines = merged.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "start_line", cited.alias("text")))), lambda s: s["text"]), "").alias("cited"))
    if touched is None:
        also = lines.select("cited", F.lit("").alias("also"))
    else:
        also = lines.crossJoin(touched_only(touched, spans).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("also")))
    more = F.when(F.col("also") == "", "").otherwise(F.concat(F.lit("\n*Also examined:* "), "also", F.lit("\n")))
    return also.select(F.when((F.col("cited") == "") & (F.col("also") == ""), "").otherwise(F.concat(F.lit("\n\n**Sources:**\n"), "cited", more)).alias("footer"))


def session_usage(log: DataFrame, budget: int = SESSION_BUDGET) -> DataFrame:
    """session, seq, cost, used (running), note; the budget is only told, never enforced."""
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum("cost").over(so_far)
    return log.select("session", "seq", "cost", used.alias("used")).withColumn("note", F.concat(F.col("used").cast("string"), F.lit(f" / {budget} chars used")))


def pair_calls(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """session, name, call_seq, response_seq: the n-th call of a name with the n-th response of it."""
    nth = F.row_number().over(Window.partitionBy("session", "name").orderBy("seq"))
    left = calls.select("session", "name", F.col("seq").alias("call_seq"), nth.alias("nth"))
    right = responses.select("session", "name", F.col("seq").alias("response_seq"), nth.alias("nth"))
    return left.join(right, ["session", "name", "nth"], "left").select("session", "name", "call_seq", "response_seq")
