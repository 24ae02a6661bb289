"""Columns over text: lines, matching, shortening, sizes and ages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of a text, without their ends \\n or \\r\\n; no empty line after a last end."""
    split = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def shortened(text: Column, most: int) -> Column:
    """text, or its first code points and an ellipsis if it has more than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def like_folded(value: Column, needle: str) -> Column:
    """LIKE '%needle%' that folds ASCII letters only; % and _ in the needle are wildcards."""
    pattern = "%" + needle.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"
    return F.translate(value, _UPPER, _LOWER).like(pattern)


def check_pattern(pattern: str) -> None:
    """Raise ValueError for patterns that a linear-time regex engine doesn't have, or that don't compile."""
    bare = re.sub(r"\\\\", "", pattern)
    outside = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "", bare)
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+", outside):
        raise ValueError(f"invalid regex: look-around and back-references aren't supported: {pattern}")
    try:
        re.compile(re.sub(r"\\z|\\A|\\p\{[^}]*\}|\\P\{[^}]*\}|\\x\{[^}]*\}", "a", pattern).replace("(?U)", "").replace("(?<", "(?P<").replace("(?P<=", "(?<="))
    except re.error as e:
        raise ValueError(f"invalid regex: {e}") from None


def first_match_column(line: Column, pattern: str) -> Column:
    """The 1-based code point at which the pattern first matches in a line that it matches."""
    return F.length(F.regexp_extract(line, f"(?s)^(.*?)(?:{pattern})", 1)) + 1


def size_text(n: Column) -> Column:
    part = lambda k: F.format_string("%.1f", F.bround(n.cast("double") / 1024.0**k, 1))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(part(1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(part(2), F.lit(" MB")))
        .otherwise(F.concat(part(3), F.lit(" GB")))
    )


def age_text(unix: Column, now: Column) -> Column:
    diff = now - unix
    count = lambda s, unit: F.concat(F.floor(diff / s).cast("string"), F.lit(unit))
    return F.when(diff < 60, "just now").when(diff < 3600, count(60, " min ago")).when(diff < 86400, count(3600, " hr ago")).otherwise(count(86400, " days ago"))
