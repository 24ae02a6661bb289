"""Nearest neighbours by inner product with additive quantisation.

A vector is encoded as the sum of one codeword from each of M codebooks; codewords have the vector's full
dimension.  Codebooks are fitted one after the other on residuals of a bounded sample, and refitted
together by least squares; encoding is a beam search over the codebooks.  A search adds up, for each
stored vector, M entries of a table of the query's inner products with all codewords, keeps the best
candidates, and ranks those by the exact inner products.  The norm of each reconstruction's error is
stored beside the codes: a candidate is kept as long as its approximate score plus what the error can add
(``SLACK`` typical deviations) reaches the best.

Equal vectors are encoded once; of each group the ids with the smallest numbers are kept, as many as an
answer can hold, which loses nothing since ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors the codebooks are fitted on, at most: those with the smallest hashes.
TRAIN_VECTORS = 8192
CODEBOOKS, CODEWORDS, BEAM = 16, 128, 4
#: Distinct vectors ranked exactly for each query and block of stored vectors.
RERANK, SLACK = 192, 0.5
#: Stored vectors and queries handled at once, and bytes of stored vectors that one task holds.
BLOCK, QUERY_BLOCK, STRIPE_BYTES = 4096, 512, 64_000_000


class Codebooks:
    """words: M x K x dimension, float32."""

    def __init__(self, words: np.ndarray):
        self.words = words
        flat = words.reshape(-1, words.shape[2])
        self.dots = flat @ flat.T if len(flat) else np.zeros((0, 0), np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of x (n x M), by beam search for the nearest sum of codewords."""
        m, k, _ = self.words.shape
        n = len(x)
        norms = np.einsum("mkd,mkd->mk", self.words, self.words)
        codes = np.zeros((n, 1, 0), np.int32)
        cost = np.zeros((n, 1), np.float32)
        for j in range(m):
            xw = x @ self.words[j].T  # n x K
            more = norms[j][None, None, :] - 2 * xw[:, None, :]
            for i in range(j):  # twice the inner products with the words chosen so far
                more = more + 2 * self.dots[i * k : (i + 1) * k, j * k : (j + 1) * k][codes[:, :, i]]
            total = (cost[:, :, None] + more).reshape(n, -1)
            b = min(beam, total.shape[1])
            best = np.argpartition(total, b - 1, axis=1)[:, :b]
            cost = np.take_along_axis(total, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None].astype(np.int32)], axis=2)
        return codes[np.arange(n), cost.argmin(axis=1)].astype(np.uint8 if k <= 256 else np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[j][codes[:, j]] for j in range(len(self.words)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        own = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres.astype(np.float32)


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 2, seed: int = 0) -> Codebooks:
    """Codebooks for x: k-means on residuals, then rounds of encoding and least squares over all codewords."""
    x = x.astype(np.float32)
    rng, rest, words = np.random.default_rng(seed), x.copy(), []
    k = min(codewords, max(1, len(x)))
    for _ in range(codebooks):
        c = _kmeans(rest, k, rng)
        words.append(c)
        rest -= c[(rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
    books = Codebooks(np.stack(words))
    for _ in range(rounds):
        codes = books.encode(x, 1).astype(np.int64) + np.arange(codebooks) * k
        a = np.zeros((codebooks * k, codebooks * k), np.float32)
        b = np.zeros((codebooks * k, x.shape[1]), np.float32)
        for i in range(codebooks):
            np.add.at(b, codes[:, i], x)
            for j in range(codebooks):
                np.add.at(a, (codes[:, i], codes[:, j]), 1)
        ridge = 0.1
        prior = books.words.reshape(-1, x.shape[1])
        solved = np.linalg.solve(a + ridge * np.eye(len(a), dtype=np.float32), b + ridge * prior)
        books = Codebooks(solved.reshape(codebooks, k, -1).astype(np.float32))
    return books


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part: no null, empty, zero, or null or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.col("vec_id").isNotNull() & ok)


def _thinned(batches: Iterator[pa.RecordBatch], dim: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Of each batch's rows with one vector the ``keep`` with the smallest ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column(0).to_numpy(), np.ascontiguousarray(_matrix(batch.column(1), dim))
        _, vector = np.unique(x.view(np.dtype((np.void, x.itemsize * dim))).ravel(), return_inverse=True)
        order = np.lexsort((ids, vector))
        starts = np.flatnonzero(np.concatenate(([True], vector[order][1:] != vector[order][:-1])))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        yield batch.take(pa.array(np.sort(order[nth < keep])))


def _distinct(valid: DataFrame, dim: int, keep: int) -> DataFrame:
    """v, ids: each distinct vector with its ``keep`` smallest ids.  Copies are thinned batch by batch
    before they are shuffled, and then in 64 groups by a hash of the id, so that no list is long."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    thin = valid.mapInArrow(lambda it: _thinned(it, dim, keep), valid.schema)
    part = thin.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    return part.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Best:
    """The k best (score, id) of each query of a block so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """More candidates, as many for each query; -inf for none.  An id that is there already stays once."""
        score, ids = np.concatenate([self.score, score], axis=1), np.concatenate([self.id, ids], axis=1)
        order = np.lexsort((ids, -score), axis=1)
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        again = np.zeros(score.shape, bool)
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (score[:, 1:] == score[:, :-1])
        order = np.argsort(again, axis=1, kind="stable")[:, : self.k]
        score = np.where(again, -np.inf, score)
        self.score, self.id = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _scan(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, errors: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores and ids of each query's candidates in one block of stored vectors.

    ids: a row for each vector, its smallest ids, -1 where there are no more.
    """
    lookup = np.einsum("mwd,qd->mwq", words, q.astype(np.float32), optimize=True)
    score = lookup[0][codes[:, 0]]
    for j in range(1, len(words)):
        score += lookup[j][codes[:, j]]
    # An error of norm e moves the inner product by about e |q| / sqrt(dimension).
    score += SLACK * errors[:, None] * (np.linalg.norm(q, axis=1) / np.sqrt(q.shape[1])).astype(np.float32)[None, :]
    top = min(RERANK, len(x))
    near = np.argpartition(-score, top - 1, axis=0)[:top].T  # queries x top
    exact = np.concatenate([np.einsum("qnd,qd->qn", x[near[i : i + 64]].astype(np.float64), q[i : i + 64]) for i in range(0, len(q), 64)])
    found = ids[near]  # queries x top x ids of a vector
    value = np.where((found < 0) | (found == qids[:, None, None]), -np.inf, exact[:, :, None])
    return value.reshape(len(q), -1), found.reshape(len(q), -1)


def grid(blocks: int, query_blocks: int, ratio: float, vector_bytes: int, tasks: int) -> tuple[int, int]:
    """(stripes of stored vectors, groups of query blocks); each pair of them is the work of one task.

    A stored vector is sent to each group and a query to each stripe.  As many stripes are made as memory
    needs, or, where that is less than there are tasks, as make the sum of both least.  ratio: stored
    vectors for each query.
    """
    held = max(1, STRIPE_BYTES // (vector_bytes * BLOCK))
    stripes = min(blocks, max(-(-blocks // held), round((tasks * ratio) ** 0.5)))
    return stripes, max(1, min(query_blocks, tasks // stripes))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = TRAIN_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k nearest of ``vectors`` that aren't the query itself.

    vectors and queries: vec_id, embedding.  Scores are inner products in double precision of the vectors
    as they are; ties go to the smaller vec_id.  A query without any candidate has no row.  Rows that
    repeat a vec_id with the same vector count once.  Vectors must all have one length; those of another
    length than most of the sample's take no part.

    Every distinct vector is encoded, once, and every query scored against every code.  Vectors are dealt
    out to stripes, each small enough for a task to hold; the queries, in blocks, go through each stripe,
    keeping their k best there, and the stripes' bests are merged (``grid``).  What is shuffled is each vector
    once and each query once a stripe, never a pair.
    """
    spark = vectors.sparkSession
    double = vectors.schema["embedding"].dataType.elementType.typeName() == "double"
    kind, sql_kind = (np.float64, "double") if double else (np.float32, "float")
    valid = valid_vectors(vectors)
    drawn = valid.select("v").orderBy(F.xxhash64("v"), "vec_id").limit(sample).toArrow().column("v")
    lengths = [len(v) for v in drawn]
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    books = fit(np.unique(np.array([v.as_py() for v in drawn if len(v) == dim], dtype=np.float32), axis=0))
    shared = spark.sparkContext.broadcast(books.words)
    valid = valid.filter(F.size("v") == dim)
    asked = valid_vectors(queries).filter(F.size("v") == dim).dropDuplicates(["vec_id"]).select("vec_id", F.col("v").cast(f"array<{sql_kind}>"))
    n_stored, n_asked = valid.count(), asked.count()
    n_blocks, n_query_blocks = -(-n_stored // BLOCK) or 1, -(-n_asked // QUERY_BLOCK) or 1
    stripes, groups = grid(n_blocks, n_query_blocks, n_stored / max(1, n_asked), dim * np.dtype(kind).itemsize, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Blocks of even size, whatever the number of partitions.
    stored = _distinct(valid, dim, k + 1).select(F.col("v").cast(f"array<{sql_kind}>"), "ids").repartition(n_blocks)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of stored vectors: ids, vectors, codes and error norms as bytes."""
        own, block = Codebooks(shared.value), TaskContext.get().partitionId()
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(kind, copy=False)
            codes = np.concatenate([own.encode(x[i : i + 1024].astype(np.float32)) for i in range(0, len(x), 1024)]) if len(x) else np.zeros((0, len(own.words)), np.uint8)
            error = np.linalg.norm(x - own.decode(codes), axis=1).astype(np.float32)
            ids = np.full((len(x), k + 1), -1, np.int64)
            for i, some in enumerate(batch.column(1).to_pylist()):
                ids[i, : len(some)] = some
            ids = ids[:, : max(1, int((ids >= 0).sum(axis=1).max(initial=0)))]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block % stripes, x.tobytes(), ids.tobytes(), codes.tobytes(), error.tobytes()), (pa.int64(), *[pa.large_binary()] * 4))], names=["stripe", "vectors", "ids", "codes", "errors"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                b = batch.slice(at, QUERY_BLOCK)
                yield pa.RecordBatch.from_pylist([{"block": block, "qids": b.column(0).to_numpy().tobytes(), "q": _matrix(b.column(1), dim).astype(np.float64).tobytes()}])
                block += 1

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bests of each block of queries in a stripe.  A cell's stored blocks come first, then its queries."""
        words, at, held = shared.value, None, []
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if at != r["cell"]:
                    at, held = r["cell"], []
                ids = np.frombuffer(r["ids"], np.int64)
                if r["codes"] is not None:
                    x = np.frombuffer(r["vectors"], kind).reshape(-1, dim)
                    held.append((x, ids.reshape(len(x), -1), np.frombuffer(r["codes"], np.uint8).reshape(len(x), -1), np.frombuffer(r["errors"], np.float32)))
                    continue
                best, q = _Best(len(ids), k), np.frombuffer(r["vectors"]).reshape(-1, dim)
                for block in held:
                    best.add(*_scan(q, ids, *block, words))
                if held:
                    yield pa.RecordBatch.from_pylist([{"block": r["block"], "qids": r["ids"], "ids": best.id.tobytes(), "scores": best.score.tobytes()}])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, qids = None, None, b""

        def done():
            ok = np.isfinite(best.score)
            rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), ok.shape)
            owner = np.broadcast_to(np.frombuffer(qids, np.int64)[:, None], ok.shape)
            return pa.RecordBatch.from_arrays([pa.array(owner[ok]), pa.array(rank[ok]), pa.array(best.id[ok]), pa.array(best.score[ok])], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != r["block"]:
                    if best:
                        yield done()
                    at, qids = r["block"], r["qids"]
                    best = _Best(len(qids) // 8, k)
                best.add(np.frombuffer(r["scores"]).reshape(-1, k), np.frombuffer(r["ids"], np.int64).reshape(-1, k))
        if best:
            yield done()

    # Encoded once, and written, so that no later step encodes again.
    blocks = cut(stored.mapInArrow(encoded, "stripe long, vectors binary, ids binary, codes binary, errors binary"))
    asking = cut(asked.repartition(n_query_blocks).mapInArrow(gathered, "block long, qids binary, q binary"))
    to_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    to_stripes = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    dealt = blocks.withColumn("group", to_groups).select((F.col("stripe") * groups + F.col("group")).alias("cell"), F.lit(-1).cast("long").alias("block"), "vectors", "ids", "codes", "errors")
    none = F.lit(None).cast("binary")
    put = asking.withColumn("stripe", to_stripes).select(
        (F.col("stripe") * groups + F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(groups))).cast("long").alias("cell"),
        "block", F.col("q").alias("vectors"), F.col("qids").alias("ids"), none.alias("codes"), none.alias("errors"),
    )
    cells = dealt.unionByName(put).repartition(stripes * groups, "cell").sortWithinPartitions("cell", "block")
    bests = cells.mapInArrow(answered, "block long, qids binary, ids binary, scores binary")
    return bests.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for those whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
