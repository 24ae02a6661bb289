"""Ranked lexical search over a tiered index.

Documents are dealt out to shards, as the scan's tasks meet them.  A shard keeps, for each term, its
postings (document, impact), where the impact is the part of a score that doesn't depend on the item.
Corpus-wide counts of postings by level of impact cut each term's postings into tiers, high impacts first;
each tier is a set of columns of its own, so that a round which needs the upper tiers reads only those.
For each term and tier the index has the residual bound: the highest impact of any posting below it.

A search goes through the tiers in rounds.  A round sums what the tiers so far say of each open item's
documents.  An item is done when no document that these tiers don't show can reach its k-th best sum: the
sum of its terms' weighted residual bounds is below it.  Items without that proof fall through to the next
tier; below the last one nothing remains, so the proof always comes.  Then the documents of an item that can
still reach its k-th best sum are looked up in the tiers below, which makes their scores exact.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Postings that the upper tiers hold of a term, about (a level is never split); the last tier has the rest.
TIER_POSTINGS = (4_096, 65_536, 1_048_576)
#: Levels of impact, all of one width; impacts are below TOP.
LEVELS, TOP = 64, 1_000_000
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 1_000_000
#: Items are searched for in blocks of about so many bytes of text; a block's terms are sent to all tasks.
BLOCK_BYTES = 16_000_000

#: What stands in terms (A-Z as a-z, digits, all beyond ASCII) and what parts them.
_TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order.  All bytes of a character beyond ASCII are above 127."""
    return data.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What a posting adds to a score, without its term's weight.  tf, n: occurrences, and the document's terms."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (100 - 50 + (50 * n * n_docs) // max(1, length)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _ints(column: pa.Array, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


_RAW = "shard long, docs long, length long, ids binary, named binary, numbers binary, starts binary, ords binary, tfs binary, sizes binary"


def scan(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """A row for each shard: its documents' ids, and the postings of the terms in ``numbers``.

    docs, length: its documents with a term, and all their terms.  named: 0 where the id is null.
    numbers, starts: the terms that occur, and where each one's postings start; ords, tfs, sizes: the
    postings' documents (places in ids), occurrences, and the documents' terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, shard = sent.value, set(sent.value), TaskContext.get().partitionId() << 32
        ids, named, sizes, lists, held, n_docs = array("q"), bytearray(), array("q"), {}, 0, 0

        def row():
            order = sorted(lists)
            counts = [len(lists[t][0]) for t in order]
            ords = np.concatenate([np.frombuffer(lists[t][0], np.uint32) for t in order] or [np.zeros(0, np.uint32)])
            tfs = np.concatenate([np.frombuffer(lists[t][1], np.int64) for t in order] or [np.zeros(0, np.int64)])
            size = np.frombuffer(sizes, np.int64) if len(sizes) else np.zeros(0, np.int64)
            cells = [ids.tobytes(), bytes(named), np.array(order, np.int32).tobytes(), np.cumsum([0, *counts]).astype(np.int64).tobytes(), ords.tobytes(), tfs.tobytes(), size[ords].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (shard, n_docs, int(size.sum()))] + [pa.array([c], pa.binary()) for c in cells], names=[c.split()[0] for c in _RAW.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                if not found:
                    continue
                counted = Counter(found)
                for t in wanted.intersection(counted):
                    number = known[t]
                    if number not in lists:
                        lists[number] = array("I"), array("q")
                    ords, tfs = lists[number]
                    ords.append(len(ids))
                    tfs.append(counted[t])
                    held += 1
                ids.append(0 if doc is None else doc)
                named.append(doc is not None)
                sizes.append(len(found))
                n_docs += 1
                if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield row()
                    shard += 1
                    ids, named, sizes, lists, held, n_docs = array("q"), bytearray(), array("q"), {}, 0, 0
        if n_docs:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _RAW)


def _levels(impact: np.ndarray) -> np.ndarray:
    """0 for the highest impacts."""
    return LEVELS - 1 - impact * LEVELS // TOP


def level_counts(raw: DataFrame, n_docs: int, length: int) -> DataFrame:
    """number, level, n, most: how many postings of a term have a level of impact, and the highest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                numbers, starts = _ints(batch.column(0), i, np.int32), _ints(batch.column(1), i, np.int64)
                impact = impacts(_ints(batch.column(2), i, np.int64), _ints(batch.column(3), i, np.int64), n_docs, length)
                key = np.repeat(np.arange(len(numbers)), np.diff(starts)) * LEVELS + _levels(impact)
                keys, at, n = np.unique(key, return_inverse=True, return_counts=True)
                most = np.zeros(len(keys), np.int64)
                np.maximum.at(most, at, impact)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[keys // LEVELS].astype(np.int32)), pa.array((keys % LEVELS).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(most)], names=["number", "level", "n", "most"])

    each = raw.select("numbers", "starts", "tfs", "sizes").mapInArrow(run, "number int, level int, n long, most long")
    return each.groupBy("number", "level").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


@dataclass
class Bounds:
    """Of each term by number: df, the first level of each tier below the first, and the highest impact
    at or below such a level (0 if there is none)."""

    df: np.ndarray
    cuts: np.ndarray
    residual: np.ndarray


def bounds(counts: DataFrame, n_terms: int, tiers: tuple[int, ...] = TIER_POSTINGS) -> Bounds:
    """counts: the rows of ``level_counts``, at most LEVELS for each term of a block of items."""
    got = counts.toArrow()
    n, most = np.zeros((n_terms, LEVELS), np.int64), np.zeros((n_terms, LEVELS + 1), np.int64)
    at = got.column("number").to_numpy(), got.column("level").to_numpy()
    n[at], most[at] = got.column("n").to_numpy(), got.column("most").to_numpy()
    sums = n.cumsum(axis=1)
    below = np.maximum.accumulate(most[:, ::-1], axis=1)[:, ::-1]  # the highest impact at a level or below
    cuts = np.stack([np.minimum((sums < t).sum(axis=1) + 1, LEVELS) for t in tiers] + [np.full(n_terms, LEVELS)], axis=1)
    return Bounds(sums[:, -1] if n_terms else np.zeros(0, np.int64), cuts, np.take_along_axis(below, cuts, axis=1))


def _tier_columns(tier: int) -> list[str]:
    return [f"{name}_{tier}" for name in ("numbers", "starts", "ords", "impacts")]


def tiered(raw: DataFrame, known: Bounds, n_docs: int, length: int) -> DataFrame:
    """A row for each shard: ids, named, and for each tier the columns numbers, starts, ords, impacts.

    The postings of a term are in order of ord within a tier.
    """
    tiers = known.cuts.shape[1]
    sent = raw.sparkSession.sparkContext.broadcast(known.cuts)
    names = ["ids", "named", *[c for t in range(tiers) for c in _tier_columns(t)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                numbers, starts, ords = _ints(batch.column(3), i, np.int32), _ints(batch.column(4), i, np.int64), _ints(batch.column(5), i, np.uint32)
                impact = impacts(_ints(batch.column(6), i, np.int64), _ints(batch.column(7), i, np.int64), n_docs, length)
                own = np.repeat(np.arange(len(numbers)), np.diff(starts))
                tier = (_levels(impact)[:, None] >= cuts[numbers[own]]).sum(axis=1)
                cells = [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()]
                for t in range(tiers):
                    here = np.flatnonzero(tier == t)
                    terms, first = np.unique(own[here], return_index=True)
                    cells += [numbers[terms].tobytes(), np.append(first, len(here)).astype(np.int64).tobytes(), ords[here].tobytes(), impact[here].astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1)] + [pa.array([c], pa.binary()) for c in cells], names=["shard", *names])

    made = raw.select("shard", "ids", "named", "numbers", "starts", "ords", "tfs", "sizes")
    return made.mapInArrow(run, "shard long, " + ", ".join(f"{c} binary" for c in names))


class _Lists:
    """A shard's postings in some tiers."""

    def __init__(self, batch: pa.RecordBatch, i: int, tiers: range):
        get = lambda name, kind: _ints(batch.column(batch.schema.get_field_index(name)), i, kind)
        self.named = get("named", np.uint8).astype(bool)
        self.ids = get("ids", np.int64)
        self.tiers = []
        for t in tiers:
            numbers, starts, ords, impact = (get(c, k) for c, k in zip(_tier_columns(t), (np.int32, np.int64, np.uint32, np.int32)))
            self.tiers.append(({int(n): (int(a), int(b)) for n, a, b in zip(numbers, starts, starts[1:])}, ords, impact))

    def of(self, tier: int, number: int) -> tuple[np.ndarray, np.ndarray] | None:
        where, ords, impact = self.tiers[tier]
        at = where.get(number)
        return at and (ords[at[0] : at[1]], impact[at[0] : at[1]].astype(np.int64))


@dataclass
class Item:
    """A row's place among its block's, its terms' numbers and weights, and the tier at which it was proven (-1: open)."""

    place: int
    numbers: list[int]
    weights: list[int]
    proven: int = -1
    least: int = 0


def _sums(shard: _Lists, item: Item, tiers: int, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document of a shard: the sum of what the first ``tiers`` tiers say of it, and how much the terms
    they don't show may add."""
    total = np.zeros(len(shard.ids), np.int64)
    rest = np.zeros(len(shard.ids), np.int64)
    for number, w in zip(item.numbers, item.weights):
        most = w * int(residual[number, tiers - 1])
        rest += most
        for t in range(tiers):
            found = shard.of(t, number)
            if found:
                total[found[0]] += w * found[1]
                rest[found[0]] -= most
    return total, rest


class _Best:
    """The k best (score, id) of each item that a task has met; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, place: int, score: np.ndarray, ids: np.ndarray) -> None:
        if place in self.held:
            score, ids = np.concatenate([self.held[place][0], score]), np.concatenate([self.held[place][1], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.held[place] = score[order], ids[order]

    def rows(self) -> pa.RecordBatch:
        places = sorted(self.held)
        sizes = [len(self.held[p][0]) for p in places]
        join = lambda i: np.concatenate([self.held[p][i] for p in places] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(places, np.int32), sizes)), pa.array(join(0)), pa.array(join(1))], names=["place", "score", "doc_id"])


def _leading(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of all scores above 0 that reach the k-th best."""
    at = np.flatnonzero(scores)
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


_FOUND = "place int, score long, doc_id long"


def _round(index: DataFrame, items: list[Item], tiers: int, residual: np.ndarray, k: int) -> dict[int, int]:
    """Of each item that k documents at least are found for in the first tiers: the k-th best sum there."""
    sent = index.sparkSession.sparkContext.broadcast((items, residual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (asked, least), best = sent.value, _Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Lists(batch, i, range(tiers))
                for item in asked:
                    total = np.where(shard.named, _sums(shard, item, tiers, least)[0], 0)
                    at = _leading(total, k)
                    best.add(item.place, total[at], shard.ids[at])
        yield best.rows()

    read = index.select("ids", "named", *[c for t in range(tiers) for c in _tier_columns(t)])
    kth = _ranked(read.mapInArrow(run, _FOUND), k).filter(F.col("rank") == k)
    return {r.place: r.score for r in kth.select("place", "score").collect()}  # a number for each item of the block


def _exact(index: DataFrame, items: list[Item], residual: np.ndarray, k: int) -> DataFrame:
    """place, score, doc_id, rank: of each item the k best documents.

    Candidates are the documents that can reach the item's k-th best sum of the tiers in which it was proven;
    what lower tiers say of them is looked up.
    """
    sent = index.sparkSession.sparkContext.broadcast((items, residual))
    tiers = residual.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (asked, least), best = sent.value, _Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Lists(batch, i, range(tiers))
                for item in asked:
                    total, rest = _sums(shard, item, item.proven + 1, least)
                    at = np.flatnonzero((total > 0) & (total + rest >= item.least) & shard.named)
                    scores = total[at]
                    for t in range(item.proven + 1, tiers) if len(at) else ():
                        for number, w in zip(item.numbers, item.weights):
                            if found := shard.of(t, number):
                                there = np.minimum(np.searchsorted(found[0], at), len(found[0]) - 1)
                                scores = scores + np.where(found[0][there] == at, w * found[1][there], 0)
                    lead = _leading(scores, k)
                    best.add(item.place, scores[lead], shard.ids[at[lead]])
        yield best.rows()

    return _ranked(index.drop("shard").mapInArrow(run, _FOUND), k)


def _block(docs: DataFrame, texts: list[tuple], k: int, tiers: tuple[int, ...]) -> DataFrame:
    """The results for one block of items (item_id, text)."""
    spark = docs.sparkSession
    found = [sorted(set(terms_of(text.encode()))) if text else [] for _, text in texts]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*found)))}
    raw = stored(scan(docs, numbers))
    n_docs, length = (int(v or 0) for v in raw.agg(F.sum("docs"), F.sum("length")).first())
    known = bounds(level_counts(raw, n_docs, length), len(numbers), tiers)
    index = stored(tiered(raw, known, n_docs, length))
    items = []
    for place, terms in enumerate(found):
        weighed = [(numbers[t], weight(n_docs, int(known.df[numbers[t]]))) for t in terms if known.df[numbers[t]]]
        items.append(Item(place, [n for n, _ in weighed], [w for _, w in weighed]))
    for tier in range(known.cuts.shape[1]):
        still = [x for x in items if x.proven < 0]
        left = {x.place: sum(w * int(known.residual[n, tier]) for n, w in zip(x.numbers, x.weights)) for x in still}
        # Where nothing remains below, there is nothing to prove.
        open_ = [x for x in still if left[x.place]]
        kth = _round(index, open_, tier + 1, known.residual, k) if open_ else {}
        for x in still:
            if not left[x.place] or kth.get(x.place, 0) > left[x.place]:
                x.proven, x.least = tier, kth.get(x.place, 0)
    named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(texts)], "place int, item_id long")
    best = _exact(index, items, known.residual, k)
    return best.join(F.broadcast(named), "place").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, tiers: tuple[int, ...] = TIER_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item its k best documents with a score above 0.

    docs: doc_id, text; items: item_id, text; other columns aren't read.  A null or empty text has no term: such
    a document isn't counted, such an item has no rows.  Items that repeat both their id and their text are
    asked once; one id with several texts is asked for each.  Documents are rows: one that stands twice
    counts twice and may be found twice.  A document without an id counts in all statistics and is never
    returned.  Equal scores go by ascending doc_id.

    Items are handled in blocks of about BLOCK_BYTES of text, each with an index of its own terms, so what is
    sent to all tasks is bounded by that (an item above it is a block of its own).  A task holds one shard and
    k results for each item of a block; a term that all documents hold is spread over all shards.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), F.col("text")).filter("text IS NOT NULL AND text != ''").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        texts = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [tuple(r) for r in texts.orderBy("item_id", "text").collect()]  # about BLOCK_BYTES
        if rows:
            found = _block(docs, rows, k, tiers)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
    FROM documents WHERE text IS NOT NULL
),
post AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM post, corpus GROUP BY term, docs
),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN post USING (term) JOIN size USING (doc_id), corpus
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
