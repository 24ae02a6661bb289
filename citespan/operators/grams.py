"""An index of three-letter sequences for content search, and what of it a pattern needs.

A row says that a file holds a gram (three code points, ASCII letters in lower case).  A pattern becomes a
condition on grams that every text with a match meets; where nothing is certain it is True, and all files are
candidates.  Candidates are searched as before, so the index never decides about a hit.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GRAM_BLOCKS

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Texts, and characters, of a block of the index in blocks; one longer text is a block of its own.
BLOCK_TEXTS, BLOCK_CHARS = 4096, 1 << 22
#: Characters of a class, and strings of a part of a pattern, that are told apart at most.
MOST_CHARS, MOST_STRINGS = 4, 16
#: What Java's and Python's patterns mean alike; other patterns get no condition.
_ALIKE = re.compile(r"(?:[^\\\[(&~]|\\[wWdDsSbBntr.*+?()|^$\[\]{}\\/\"'=:;,<>@#%!& -]|\((?!\?)|\(\?:|\[(?![\[:])|&(?!&))*")

#: A gram, True, or ("and" | "or", conditions).
Condition = bool | str | tuple[str, list]


def grams_of(text: str) -> set[str]:
    folded = text.translate(_FOLD)
    return {g for g in map("".join, zip(folded, folded[1:], folded[2:])) if "\n" not in g}


def gram_rows(contents: DataFrame) -> DataFrame:
    """path, gram: the distinct grams of contents (path, content); null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = sorted(grams_of(text)) if text else []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(found, pa.string())], names=["path", "gram"])

    return contents.filter("content IS NOT NULL").select("path", "content").mapInArrow(run, "path string, gram string")


def _block(texts: list[str]) -> tuple[list[str], list[bytes]]:
    """The distinct grams of a block's texts in order, and of each the numbers of the texts that hold it."""
    chars = np.frombuffer("\n\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    # Characters by their rank among those that are there, so that gram and text are mostly one number, and one sort is all.
    ranks = np.zeros(int(chars.max()) + 1, np.int64)
    ranks[chars] = 1
    there = np.flatnonzero(ranks)
    alphabet, ranks[there] = np.unique(np.where((there >= 65) & (there <= 90), there + 32, there), return_inverse=True)
    ranked = ranks[chars]
    inside = ranked != ranks[10]
    whole = inside[:-2] & inside[1:-1] & inside[2:]
    wide, text_bits = len(alphabet).bit_length(), len(texts).bit_length()
    codes, named = (ranked[:-2] << 2 * wide | ranked[1:-1] << wide | ranked[2:])[whole], None
    if 3 * wide + text_bits > 63:
        named, codes = np.unique(codes, return_inverse=True)
    held = np.sort(codes << text_bits | np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[:-2][whole])
    held = held[np.flatnonzero(np.diff(held, prepend=-1))]
    codes = held >> text_bits
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    ords = (held & (1 << text_bits) - 1).astype("<u2").tobytes()
    codes = codes[first] if named is None else named[codes[first]]
    mask = (1 << wide) - 1
    letters = alphabet[np.stack([codes >> 2 * wide, codes >> wide & mask, codes & mask], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    bounds = (2 * np.append(first, len(held))).tolist()
    return [letters[i : i + 3] for i in range(0, len(letters), 3)], [ords[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def gram_blocks(contents: DataFrame) -> DataFrame:
    """The grams of contents (path, content) in blocks of texts: GRAM_BLOCKS, a row for each gram of a block and one
    without a gram for its paths.  No shuffle; null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, paths, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def closed() -> pa.RecordBatch:
            found, ords = _block(texts)
            columns = [pa.array([f"{task}-{n}"] * (len(found) + 1)), pa.array(["", *found]), pa.array([None, *ords], pa.binary()), pa.array([paths] + [None] * len(found), pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "gram", "ords", "paths"])

        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                if texts and (len(texts) == BLOCK_TEXTS or size + len(text) > BLOCK_CHARS):
                    yield closed()
                    n, size, paths, texts = n + 1, 0, [], []
                paths.append(path)
                texts.append(text)
                size += len(text)
        if texts:
            yield closed()

    return contents.filter("content IS NOT NULL").select("path", "content").mapInArrow(run, GRAM_BLOCKS)


def _all(kind: str, conditions: list[Condition]) -> Condition:
    """and, or of conditions, without what is certain."""
    if kind == "or" and (True in conditions or not conditions):
        return True
    left: list = []
    for c in conditions:
        if c is not True and c not in left:
            left.append(c)
    return True if not left else left[0] if len(left) == 1 else (kind, left)


def _of_strings(strings: set[str]) -> Condition:
    """That one of these strings is in a text."""
    return _all("or", [_all("and", sorted(grams_of(s))) for s in sorted(strings)])


def _chars(op, value, ignore_case: bool) -> set[str] | None:
    """The characters that an item of a pattern may be, folded; None if they are too many or other ones fold to them."""
    if op is sre.LITERAL:
        chars = {chr(value)}
    elif op is sre.IN and all(o is sre.LITERAL or (o is sre.RANGE and v[1] - v[0] < MOST_CHARS) for o, v in value):
        chars = {chr(c) for o, v in value for c in ([v] if o is sre.LITERAL else range(v[0], v[1] + 1))}
    else:
        return None
    # Without regard to case, other letters than ASCII's match k and s, and letters beyond ASCII have cases too.
    if ignore_case and any(c in "kKsS" or ord(c) > 127 for c in chars):
        return None
    chars = {c.translate(_FOLD) for c in chars}
    return chars if len(chars) <= MOST_CHARS else None


def _exact(items, ignore_case: bool) -> set[str] | None:
    """All strings that a sequence can match, if they are few."""
    out = {""}
    for op, value in items:
        if op is sre.AT:
            continue
        if op is sre.SUBPATTERN:
            more = _exact(value[3], ignore_case)
        elif op is sre.BRANCH:
            each = [_exact(alternative, ignore_case) for alternative in value[1]]
            more = None if None in each else set().union(*each)
        elif op is sre.MAX_REPEAT and value[1] == 1:
            more = _exact(value[2], ignore_case)
            more = more and more | ({""} if value[0] == 0 else set())
        else:
            more = _chars(op, value, ignore_case)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _needed(items, ignore_case: bool) -> Condition:
    found: list[Condition] = []
    run = {""}

    def close():
        nonlocal run
        found.append(_of_strings(run))
        run = {""}

    for item in items:
        op, value = item
        exact = _exact([item], ignore_case)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        close()
        if exact is not None:
            run = exact
        elif op is sre.SUBPATTERN:
            found.append(_needed(value[3], ignore_case))
        elif op is sre.BRANCH:
            found.append(_all("or", [_needed(alternative, ignore_case) for alternative in value[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            found.append(_needed(value[2], ignore_case))
    close()
    return _all("and", found)


def condition(pattern: str, case_insensitive: bool = False) -> Condition:
    """What the grams of a text must meet if a line of it matches the pattern."""
    if pattern.startswith("(?i)"):
        pattern, case_insensitive = pattern[4:], True
    if not _ALIKE.fullmatch(pattern):
        return True
    try:
        return _needed(parser.parse(pattern), case_insensitive)
    except (re.error, OverflowError, RecursionError):
        return True


def met(wanted: Condition, grams: set[str]) -> bool:
    if isinstance(wanted, tuple):
        return (all if wanted[0] == "and" else any)(met(c, grams) for c in wanted[1])
    return wanted is True or wanted in grams


def _named(wanted: Condition) -> set[str]:
    return set().union(*(_named(c) for c in wanted[1])) if isinstance(wanted, tuple) else {wanted}


def _column(wanted: Condition):
    if not isinstance(wanted, tuple):
        return F.array_contains("grams", wanted)
    out = None
    for c in wanted[1]:
        out = _column(c) if out is None else out & _column(c) if wanted[0] == "and" else out | _column(c)
    return out


def candidates(index: DataFrame, wanted: Condition) -> DataFrame:
    """path of the files whose grams (path, gram) meet a condition other than True.

    Only the condition's grams are read, which is what the table is sorted for; a file's row has no more
    grams than the condition.
    """
    rows = index.filter(F.col("gram").isin(*sorted(_named(wanted))))
    return rows.groupBy("path").agg(F.collect_set("gram").alias("grams")).filter(_column(wanted)).select("path")


def candidates_of_blocks(index: DataFrame, wanted: Condition) -> DataFrame:
    """``candidates`` of an index in blocks: of each block the condition's grams and the paths meet in one group."""

    def masks(c: Condition, held: dict[str, np.ndarray], none: np.ndarray) -> np.ndarray:
        if not isinstance(c, tuple):
            return held.get(c, none)
        return (np.logical_and if c[0] == "and" else np.logical_or).reduce([masks(x, held, none) for x in c[1]])

    def run(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        paths = next(r["paths"] for r in rows if r["gram"] == "")
        none, held = np.zeros(len(paths), bool), {}
        for r in rows:
            if r["gram"]:
                held[r["gram"]] = none.copy()
                held[r["gram"]][np.frombuffer(r["ords"], "<u2")] = True
        return pa.table({"path": pa.array([paths[i] for i in np.flatnonzero(masks(wanted, held, none))], pa.string())})

    return index.filter(F.col("gram").isin("", *sorted(_named(wanted)))).groupBy("block").applyInArrow(run, "path string")
