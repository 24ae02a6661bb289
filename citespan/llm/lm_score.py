"""Language-model scores of texts: context-tree weighting over bytes, and a word-count baseline.

Training counts contexts of ``DEPTH`` bytes with the byte after them over all training texts.  Texts are
read in groups; a group's distinct keys (context and byte), with their counts in training texts, are dealt
out by the three most recent bytes of the context, hashed to ``BUCKETS``.  Each bucket sums its keys and
weights all nodes of the tree upwards from depth ``DEPTH`` to 3; these are summed by the two most recent
bytes, and the driver finishes the contexts of two bytes, one and none (``ctw``).  Then each bucket works out the log probability of
each of its keys from all nodes on the key's path and sends it to the groups that have the key, where it
meets their texts.  No node is left out, and no machine holds more of the tree than one bucket.

The baseline's counts of words can be any number, so the executors get only the most frequent ones, by a
count above which there are at most ``COMMON_WORDS``; texts' other words are joined with all counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw
from .common import bucket_of, claim, cut, table

DEPTH = 5
COMMON_WORDS, COMMON_BYTES = 300_000, 48
#: Bytes of text whose contexts are counted or scored at once.
CHUNK = 4_000_000
#: A group of texts ends after so many bytes, or so many keys distinct within each CHUNK.
GROUP_BYTES, GROUP_KEYS = 32_000_000, 4_000_000
#: Parts that the tree is dealt out in; three most recent bytes stand in one of them.
BUCKETS = 256
#: Depth of the nodes above which a bucket's own keys don't suffice.
TOP = 3
#: Keys of a group that are found at one look: at most 2**MEMORY_BITS; the others are searched for.
MEMORY_BITS = 22

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Stands for the end of a text among words; no word holds a space.
END = b" end"
_U = np.uint64


def words(raw: bytes) -> list[bytes]:
    """The tokens of a text: its words in lower case, and its end."""
    return [*_WORD.findall(raw.translate(_LOWER)), END]


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches again, in slices of about CHUNK bytes of text, with the texts as bytes."""
    for batch in batches:
        texts, start, size = [], 0, 0
        for i, t in enumerate(batch.column(column)):
            raw = (t.as_py() or "").encode()
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield batch.slice(start, i + 1 - start), texts
                texts, start, size = [], i + 1, 0
        if texts:
            yield batch.slice(start), texts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("language model")
    c: Counter[bytes] = Counter()
    for batch in batches:
        for t in batch.column(0):
            c.update(words((t.as_py() or "").encode()))
        if len(c) > 400_000:
            yield _pairs(c)
            c = Counter()
    if c:
        yield _pairs(c)


def _pairs(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), n over one column of texts, the end of a text among the words."""
    return texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blob(*columns) -> bytes:
    """Columns as one compressed value."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which compress well."""
    return np.diff(keys, prepend=_U(0))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.cumsum(batch.column(0).to_numpy(), dtype=np.uint64)


_ROWS = "chunk long, bucket int, place int, body binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["chunk", "bucket", "place", "body"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc_id, text, whether to learn from it: rows of a group's texts (bucket -1, by place), and of
    its distinct keys with their counts in training texts (0 for keys of other texts only), by bucket."""
    claim("language model")
    chunk, place, size = TaskContext.get().partitionId() << 32, 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def taken() -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        held.clear()
        return out

    def closed() -> Iterator[pa.RecordBatch]:
        keys, counts = ctw.summed(*taken())
        bucket = ((keys >> _U(8 * (DEPTH - 2))) * _U(0x9E3779B1) & _U(0xFFFFFFFF)) * _U(BUCKETS) >> _U(32)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1, dtype=np.uint64))
        rows = [(chunk, b, 0, _blob(_steps(keys[at]), counts[at])) for b in range(BUCKETS) if len(at := order[ends[b] : ends[b + 1]])]
        if rows:
            yield _rows(rows)

    for batch, texts in _chunks(batches, 1):
        keys, lengths = ctw.byte_keys(texts, DEPTH)
        taught = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), lengths)
        both, n = np.unique(keys << _U(1) | taught.astype(np.uint64), return_counts=True)
        held.append(ctw.summed(both >> _U(1), np.where(both & _U(1) > 0, n, 0)))
        yield _rows([(chunk, -1, place, _blob(batch.column(0), pa.array(texts, pa.large_binary())))])
        place, size = place + 1, size + int(lengths.sum())
        if size >= GROUP_BYTES or sum(len(k) for k, _ in held) >= GROUP_KEYS:
            yield from closed()
            chunk, place, size = chunk + 1, 0, 0
    if held:
        yield from closed()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]]:
    """(rows of groups, distinct keys, their counts) for each bucket; rows come sorted by bucket."""
    rows: list[tuple[int, bytes]] = []

    def done():
        keys, counts, more, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for i, (_, body) in enumerate(rows):
            b = _opened(body)
            more.append((_keys(b), b.column(1).to_numpy()))
            waiting += b.num_rows
            if waiting > max(1_000_000, len(keys)) or i == len(rows) - 1:
                keys, counts = ctw.summed(*(np.concatenate(c) for c in zip((keys, counts), *more)))
                more, waiting = [], 0
        return rows, keys, counts

    last = None
    for batch in batches:
        for chunk, bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if bucket != last and rows:
                yield done()
                rows = []
            last = bucket
            rows.append((chunk, body.as_py()))
    if rows:
        yield done()


def _taught(keys: np.ndarray, counts: np.ndarray):
    seen = counts > 0
    return ctw.weigh(keys[seen], counts[seen], DEPTH, TOP)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, zeros, ones, log Pw of all nodes of depth TOP."""
    for _, keys, counts in _buckets(batches):
        top = None
        for top in _taught(keys, counts):
            pass
        if top:
            _, node, n0, n1, pw, _ = top
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n0), pa.array(n1), pa.array(pw)], names=["node", "n0", "n1", "pw"])


def train(buckets: DataFrame) -> ctw.Table:
    """The nodes of depth 2, 1 and 0.  Those of depth 2 that occur come to the driver, summed: 255 * 65536
    at most, and far fewer in any text."""
    rows = buckets.mapInArrow(_tops, "node long, n0 long, n1 long, pw double")
    parent = F.shiftleft(F.shiftrightunsigned("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255)).alias("parent")
    sums = rows.groupBy(parent).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("kids")).orderBy("parent").toArrow()
    ids, n0, n1, kids = (c.to_numpy() for c in sums.columns)
    table, ids = ctw.Table(DEPTH), ids.view(np.uint64)
    for d in range(TOP - 1, -1, -1):
        pe = ctw.log_kt(n0, n1)
        pw = np.logaddexp(pe, kids) - np.log(2)
        table.put(*ctw.slots(d, ids), *ctw.quantised(n0, n1, np.exp(np.minimum(0, pe - np.log(2) - pw))))
        if d:  # a parent's counts are its children's sums
            ids, inv = np.unique(ids >> _U(16) << _U(8) | ids & _U(255), return_inverse=True)
            n0, n1 = (np.bincount(inv, c, len(ids)).astype(np.int64) for c in (n0, n1))
            kids = np.bincount(inv, pw, len(ids))
    return table


def _valued(batches: Iterator[pa.RecordBatch], top: ctw.Table) -> Iterator[pa.RecordBatch]:
    """For each group and bucket a row of the keys and their log probabilities, at place -1."""
    for rows, keys, counts in _buckets(batches):
        table = ctw.Table(DEPTH)
        table.levels[:TOP] = top.levels[:TOP]
        for d, node, n0, n1, _, stop in _taught(keys, counts):
            table.put(*ctw.slots(d, node), *ctw.quantised(n0, n1, stop))
        values = np.concatenate([table.log10_byte(keys[i : i + 100_000]) for i in range(0, len(keys), 100_000)]).astype(np.float32)
        for chunk, body in rows:
            own = _opened(body)
            yield _rows([(chunk, -1, -1, _blob(own.column(0), values[np.searchsorted(keys, _keys(own))]))])


_KEY_BITS = 8 * (DEPTH + 1)
_TAG_BITS = _KEY_BITS - MEMORY_BITS


class _Scorer:
    """log10 of texts whose keys' values are given.  A memory finds most at one look: an entry is a tag and
    a 32-bit float, and a key's slot and tag together are the key, stirred one to one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.known = keys[order], values[order]
        self.memory = np.full(1 << MEMORY_BITS, ~_U(0), np.uint64)
        slot, tag = self._place(self.keys)
        self.memory[slot] = tag << _U(32) | self.known.view(np.uint32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        keys, lengths = ctw.byte_keys(texts, DEPTH)
        values = np.zeros(len(keys) + 1)
        for at in range(0, len(keys), 1 << 19):
            part = keys[at : at + (1 << 19)]
            values[at : at + len(part)] = self._values(part)
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
        return np.where(lengths > 0, sums, 0.0)

    @staticmethod
    def _place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys * _U(0x9E3779B97F4A7C15) & _U((1 << _KEY_BITS) - 1)
        h ^= h >> _U(_KEY_BITS // 2)
        h = h * _U(0xD6E8FEB86659FD93) & _U((1 << _KEY_BITS) - 1)
        return (h >> _U(_TAG_BITS)).astype(np.int64), h & _U((1 << _TAG_BITS) - 1)

    def _values(self, keys: np.ndarray) -> np.ndarray:
        slot, tag = self._place(keys)
        entry = self.memory[slot]
        missing = np.flatnonzero(entry >> _U(32) != tag)
        values = (entry & _U(0xFFFFFFFF)).astype(np.uint32).view(np.float32)
        if len(missing):
            values[missing] = self.known[np.searchsorted(self.keys, keys[missing])]
        return values


def _with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], np.ndarray]]:
    """(doc_ids, texts, scores) of each row of texts; rows come sorted by group and place."""
    last, held, scorer = None, [], None
    for batch in batches:
        for chunk, place, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            b = _opened(body.as_py())
            if chunk != last:
                last, held, scorer = chunk, [], None
            if place < 0:
                held.append((_keys(b), b.column(1).to_numpy()))
                continue
            if scorer is None:
                scorer = _Scorer(*(np.concatenate(c) for c in zip(*held))) if held else _Scorer(np.zeros(0, np.uint64), np.zeros(0, np.float32))
                held = []
            texts = b.column(1).to_pylist()
            yield b.column(0), texts, scorer.score(texts)


_PARTS = "row long, doc_id long, word binary, times long, n_tokens long, n_common long, common double, score double"
_PART_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_common", pa.int64()), ("common", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, train_on) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    train_on: the condition, on doc_id, of rows to learn from.  A null text is empty: one token, its end,
    and a score of 0.  Repeated rows count as often as they stand there, in training and in the result.
    With no training rows every count is 0 and every bit has chance 1/2.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long"), "text")
    train_on = F.coalesce(train_on, F.lit(False))
    learn = read.filter(train_on).select("text")
    counts = cut(word_counts(learn))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = np.log10(total + 0.5 * (distinct + 1))
    # The least count with at most COMMON_WORDS words at or above it: by powers of two, as few rows as a long has bits.
    size = F.floor(F.log2("n")).cast("int")
    short = counts.filter(F.octet_length("word") <= COMMON_BYTES)
    level, n = 63, 0
    for r in sorted(short.groupBy(size.alias("size")).count().collect(), reverse=True):
        n += r["count"]
        if n > COMMON_WORDS:
            break
        level = r["size"]
    common = short.filter(size >= level).toArrow() if level < 63 else None
    known = dict(zip(common.column(0).to_pylist(), (np.log10(common.column(1).to_numpy() + 0.5) - base).tolist())) if common is not None else {}
    vocabulary = spark.sparkContext.broadcast(known)
    gathered = cut(read.select("doc_id", "text", train_on.alias("learn")).mapInArrow(_gather, _ROWS))
    buckets = gathered.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    top = spark.sparkContext.broadcast(train(buckets))
    values = buckets.mapInArrow(lambda it: _valued(it, top.value), _ROWS)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row of its own, and a row for each of its words that isn't common."""
        claim("language model")
        log, row = vocabulary.value, TaskContext.get().partitionId() << 40
        for ids, texts, scores in _with_scores(batches):
            n_tokens, n_common, common, times, rare = [], [], [], [], []
            n_rare = np.zeros(len(texts), np.int64)
            for i, raw in enumerate(texts):
                tokens = words(raw)
                found = list(map(log.get, tokens))
                n_tokens.append(len(tokens))
                n_common.append(len(tokens) - (missing := found.count(None)))
                if missing:
                    counts = Counter(t for t, v in zip(tokens, found) if v is None)
                    n_rare[i] = len(counts)
                    rare += counts.keys()
                    times += counts.values()
                    found = [v for v in found if v is not None]
                common.append(math.fsum(found))
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            # No word begins with a space, so these meet no count.
            own = [b" %d" % r for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(own, pa.binary()), pa.array(np.zeros(len(rows), np.int64)), pa.array(n_tokens, pa.int64()), pa.array(n_common, pa.int64()), pa.array(common, pa.float64()), pa.array(scores)], schema=_PART_SCHEMA)
            if rare:
                owner = np.repeat(np.arange(len(texts)), n_rare)
                none, zero = pa.array(np.zeros(len(rare), np.int64)), pa.array(np.zeros(len(rare)))
                more = pa.RecordBatch.from_arrays([pa.array(rows[owner]), ids.take(pa.array(owner)), pa.array(rare, pa.binary()), pa.array(times, pa.int64()), none, none, zero, zero], schema=_PART_SCHEMA)
                for at in range(0, len(rare), 20_000):
                    yield more.slice(at, 20_000)

    beside = gathered.filter("bucket < 0").unionByName(values).repartition("chunk").sortWithinPartitions("chunk", "place")
    joined = beside.mapInArrow(scored, _PARTS).join(counts, "word", "left")
    value = F.col("common") + F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(float(base)))
    known_here = F.col("n_common") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    sums = joined.groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(known_here).alias("n_known"), F.sum(value).alias("base_score"), F.sum("score").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by what the four fifths not held out teach."""
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 1, F.lit(False))
    out = score(table(spark, sf_dir, "documents", "doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
