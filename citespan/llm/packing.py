"""Best-fit decreasing packing of token sequences.

Every document is tokenised whole, an end id is added, and it is cut into full windows and a rest.
Rests are packed longest first, each into the tightest open window it fits in.  Packing needs of the
pieces only how many there are of each length, at most ``window`` numbers, so the driver plans on
counts and the pieces of one length are dealt to the planned places by rank:

* executors: tokenise, cut, count the pieces of each length in each partition;
* driver: a segment tree over remaining capacities plans runs of equal windows (see ``plan``);
* executors: rank pieces within their length (partition counts summed first, so that a length that
  a third of all pieces share is still ranked in parallel), look the rank up in the plan.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, cut, table

WINDOW, END = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A worker forgets the words it knows when it has so many (about 250 bytes each), and the chunks when it
#: has two fifths of that; the ids don't depend on it.
KNOWN_WORDS = 1_000_000


class CapacityTree:
    """Segment tree over remaining capacities 0..n: the smallest capacity >= s with open windows."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)
        self.open: list[list[tuple[int, int, int]]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, first: int, windows: int, used: int) -> None:
        """Open windows first, first + 1, ... with ``used`` tokens in each."""
        self.open[capacity].append((first, windows, used))
        i = capacity + self.size
        while i and not self.any[i]:
            self.any[i] = True
            i //= 2

    def take(self, capacity: int) -> tuple[int, int, int]:
        run = self.open[capacity].pop()
        i = capacity + self.size
        self.any[i] = bool(self.open[capacity])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]
        return run

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, rank, per, sequence, offset) in order of length and rank.

    The pieces of a length with rank, rank + 1, ... go ``per`` to a sequence, into sequence,
    sequence + 1, ..., the first at offset.  It is what best-fit decreasing does piece by piece: a
    window just filled is the tightest for the next piece of the same length as long as it fits.
    """
    tree, rows, sequence = CapacityTree(window), [], 0
    for s in sorted(counts, reverse=True):
        left, rank = counts[s], 0
        while left:
            r = tree.tightest(s)
            if r is None:
                first, windows, used, r, new = sequence, -(-left // (window // s)), 0, window, True
                sequence += windows
            else:
                (first, windows, used), new = tree.take(r), False
            per = r // s
            full, some = min(windows, left // per), left % per
            if full:
                rows.append((s, rank, per, first, used))
                rank, left = rank + full * per, left - full * per
                if r - per * s:
                    tree.add(r - per * s, first, full, used + per * s)
                first, windows = first + full, windows - full
            if windows and left:  # fewer than per are left
                rows.append((s, rank, per, first, used))
                if r - some * s:
                    tree.add(r - some * s, first, 1, used + some * s)
                rank, left, first, windows = rank + some, 0, first + 1, windows - 1
            if windows and not new:
                tree.add(r, first, windows, used)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


#: A chunk without white space that is one word of letters each of which has one lower case, with signs
#: round it that the tokenizer keeps apart from the word.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(dict):
    """A chunk's ids as little-endian bytes.  The tokenizer drops white space and never joins ids across
    it, so a text's ids are its chunks' ids, one after the other; those of a plain chunk are its signs'
    and its lower-case word's."""

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.encode, self.words, self.most = Tokenizer.from_file(path).encode, {}, most

    def raw(self, text: str) -> bytes:
        ids = array("I", self.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def word(self, text: str) -> bytes:
        """The ids of a word or of signs that isn't known yet."""
        if len(self.words) >= self.most:
            self.words = {}
        ids = self.raw(text)
        if len(text) < 64:
            self.words[text] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain:
            before, word, after = plain.groups()
            word, get = word.lower(), self.words.get
            ids = get(word) or self.word(word)
            if before:
                ids = (get(before) or self.word(before)) + ids
            if after:
                ids += get(after) or self.word(after)
        else:
            ids = self.raw(chunk)
        if 5 * len(self) >= 2 * self.most:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if _odd(text):
            return self.raw(text)
        return b"".join([self[w] for w in text.split()])


def _odd(text: str) -> bool:
    """Whether text holds what Python alone takes for white space, or a special id's name."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f") or "<|" in text


_loaded: dict[tuple[str, int], WordIds] = {}


def cut_documents(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, known: int) -> Iterator[pa.RecordBatch]:
    claim("packing", _loaded.clear)
    words = _loaded.get((path, known))
    if words is None:
        words = _loaded[path, known] = WordIds(path, known)
    last = np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = (words.of(text.as_py()) if text.is_valid else b"") + last
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start : 4 * (start + window)]
                rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, known: int = KNOWN_WORDS) -> DataFrame:
    """The pieces of each document's ids: full windows, then the rest."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: cut_documents(it, tokenizer, window, end, known), PIECES)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, known: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    A null text counts as empty: its document is one piece that holds the end id.  Repeated rows and
    repeated doc_ids are packed as they stand, a null doc_id too; an empty table gives an empty table.
    Only doc_id and text are read, so other columns can have any name.  known: words that a worker remembers.
    """
    cutting = cut(pieces(docs, tokenizer, window, end, known).withColumn("part", F.spark_partition_id()))
    counted = cutting.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``window`` rows
    runs = plan({r.length: r.n for r in by_length}, window)
    first = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("part", "length", first.alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cutting.withColumn("rank", local).join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(length, rank):
        import pandas as pd

        # A run's key: its length, then its first rank; the last key at or below a piece's own is its run.
        key = runs[:, 0].astype(np.float64) * 2.0**40 + runs[:, 1]
        run = runs[np.searchsorted(key, length.to_numpy() * 2.0**40 + rank.to_numpy(), side="right") - 1]
        k = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + k // run[:, 2], "offset": run[:, 4] + k % run[:, 2] * length.to_numpy()})

    import pandas as pd

    place.__annotations__ = {"length": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    placed = ranked.withColumn("at", F.pandas_udf(place, "sequence_id long, offset long")("length", "rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
