"""Embedding near-duplicates by an epsilon grid order join.

Two unit vectors have a cosine of t or more where they are at most epsilon = sqrt(2 - 2t) apart.  Vectors are
turned to their leading principal directions and given grid cells of side epsilon there; in the order of
their cells they make one long sequence, cut into blocks.  The join goes down this sequence from its whole
to its blocks: an interval meets another (or itself) by the pairs of their parts, and a pair of parts whose
boxes are more than epsilon apart is skipped with all below it.  What is left are pairs of blocks, which are
compared by matrix products and, near the threshold, by cosines in double precision.

Turning is by orthonormal directions and keeps of the rest of a vector its length alone, so distances only
shrink: what is skipped is provably no link, whatever sample the directions were fitted on.

Equal vectors are one node of the sequence.  A pair of blocks adds to each node how many vectors it is linked
with, and leaves of its links a spanning forest only, so a group of n near copies gives no n^2 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

THRESHOLD = 0.95
#: Vectors that the directions are fitted on, at most: those with the smallest hashes.
SAMPLE = 8192
#: Directions whose values bound a block, and how many of them have grid cells that make the order.
DIRECTIONS, ORDERED = 16, 8
#: Vectors of a block; parts of an interval; blocks that a task holds (all powers of two), as far as HELD_BYTES allow, and
#: blocks that go by them.
BLOCK, FANOUT_BITS, HELD_BITS, PASSING_BITS = 256, 4, 5, 6
HELD_BYTES = 64_000_000


def directions(sample: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """The leading principal directions (as rows) of unit vectors."""
    _, _, rows = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    return np.ascontiguousarray(rows[: min(most, sample.shape[1])])


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors (rows, not zero) at length 1, in double precision, whatever their magnitude."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # exact
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def turned(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """DIRECTIONS + 2 values of each unit vector, such that distances don't grow: one that keeps lengths of
    vectors apart, the values along the directions (the first coordinates, if basis is for another length),
    and the length of the rest."""
    dim = x.shape[1]
    along = x @ basis.T if basis.shape[1] == dim else x[:, :DIRECTIONS]
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", along, along)))
    out = np.zeros((len(x), DIRECTIONS + 2))
    out[:, 0], out[:, 1 : 1 + along.shape[1]], out[:, -1] = 4 * dim, along, rest
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the lists of each length."""
    lengths = column.value_lengths().to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _ordered(nodes: DataFrame, basis: np.ndarray, epsilon: float) -> DataFrame:
    """v, first, copies in epsilon grid order: within a partition, and from one to the next."""
    cells = [f"c{i}" for i in range(ORDERED)]
    sent = nodes.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.zeros((batch.num_rows, DIRECTIONS + 2))
            for at, x in _by_length(batch.column(0)):
                place[at] = turned(unit(x), sent.value)
            grid = np.floor(place[:, 1 : 1 + ORDERED] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place[:, 0].astype(np.int64)), *(pa.array(c) for c in np.ascontiguousarray(grid.T)), pa.array(place[:, 1])], names=[*batch.schema.names, "length", *cells, "p"])

    kind = nodes.schema["v"].dataType.simpleString()
    placed = nodes.mapInArrow(run, f"v {kind}, first long, copies long, length long, {', '.join(f'{c} int' for c in cells)}, p double")
    # p and first: so that a cell with very many vectors is cut by ranges too.
    key = ["length", *cells, "p", "first"]
    return placed.repartitionByRange(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key).select("v", "first", "copies")


_BOX = "lo array<double>, hi array<double>"


def _blocks(ordered: DataFrame, basis: np.ndarray) -> DataFrame:
    """part, n, length, vectors, firsts, copies, and the box (lo, hi) of each block of the sequence."""
    sent = ordered.sparkSession.sparkContext.broadcast(basis)
    double = ordered.schema["v"].dataType.elementType.typeName() == "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held, size, firsts, copies = [], 0, [], []

        def row():
            x = np.concatenate(held)
            box = turned(unit(x), sent.value)
            cells = [x.tobytes(), np.concatenate(firsts).tobytes(), np.concatenate(copies).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([x.shape[1]], pa.int64()), *(pa.array([c], pa.binary()) for c in cells), pa.array([box.min(axis=0).tolist()]), pa.array([box.max(axis=0).tolist()])], names=["part", "n", "length", "vectors", "firsts", "copies", "lo", "hi"])

        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:
                # Up to a full block, of vectors of one length.
                if held and lengths[at] != held[0].shape[1] or size == BLOCK:
                    yield row()
                    held, size, firsts, copies, n = [], 0, [], [], n + 1
                other = np.flatnonzero(lengths[at : at + BLOCK - size] != lengths[at])
                k = int(other[0]) if len(other) else min(BLOCK - size, batch.num_rows - at)
                some = batch.slice(at, k)
                held.append(some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(k, -1).astype(np.float64 if double else np.float32, copy=False))
                firsts.append(some.column(1).to_numpy())
                copies.append(some.column(2).to_numpy())
                size, at = size + k, at + k
        if held:
            yield row()

    return ordered.mapInArrow(run, f"part long, n long, length long, vectors binary, firsts binary, copies binary, {_BOX}")


def _intervals(below: DataFrame) -> DataFrame:
    """id, kids, lo, hi: intervals of up to 16 neighbours of below (id, lo, hi)."""
    fold = lambda side, least: F.reduce("kids", F.col("kids")[0][side], lambda box, kid: F.zip_with(box, kid[side], least))
    made = below.groupBy(F.shiftright("id", FANOUT_BITS).alias("id")).agg(F.collect_list(F.struct("id", "lo", "hi")).alias("kids"))
    return made.select("id", "kids", fold("lo", lambda x, y: F.least(x, y)).alias("lo"), fold("hi", lambda x, y: F.greatest(x, y)).alias("hi"))


def near_blocks(boxes: DataFrame, epsilon: float, most: int) -> DataFrame:
    """a, b (a <= b): the pairs of boxes (id below most, lo, hi) that aren't provably more than epsilon apart.

    From the interval that holds all, level by level: the pairs that are left meet their intervals by two
    joins on the interval's number, and each makes at most 16 x 16 pairs of parts.
    """
    levels = []
    while not levels or most > 1:
        levels.append(cut(_intervals((levels[-1] if levels else boxes).select("id", "lo", "hi"))))
        most = -(-most // (1 << FANOUT_BITS))
    far = (epsilon * (1 + 1e-9) + 1e-9) ** 2
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            sides = []
            for column in batch.columns[:2]:
                kids = column.flatten()
                numbers = kids.field("id").to_numpy()
                lo, hi = (kids.field(f).flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1) for f in ("lo", "hi"))
                sides.append((numbers, lo, hi, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])))
            for i in range(batch.num_rows):
                (ia, la, ha), (ib, lb, hb) = (tuple(v[s[3][i] : s[3][i + 1]] for v in s[:3]) for s in sides)
                gap = np.maximum(0, np.maximum(lb[None] - ha[:, None], la[:, None] - hb[None]))
                x, y = np.nonzero((np.einsum("abk,abk->ab", gap, gap) <= far) & (ia[:, None] <= ib[None]))
                found.append(np.stack([ia[x], ib[y]]))
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    for level in reversed(levels):
        left = level.select(F.col("id").alias("a"), F.col("kids").alias("kids_a"))
        right = level.select(F.col("id").alias("b"), F.col("kids").alias("kids_b"))
        pairs = pairs.join(left, "a").join(right, "b").select("kids_a", "kids_b").mapInArrow(run, "a long, b long")
    return pairs


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (of each node the least of its class), after i and j have been linked."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if len(i):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]
    return label


class _Block:
    def __init__(self, number: int, vectors: np.ndarray, copies: np.ndarray, size: int):
        self.number, self.copies = number, copies
        self.exact = unit(vectors)
        self.near = self.exact.astype(np.float32)
        self.nodes = number * size + np.arange(len(copies))
        self.linked = np.zeros(len(copies), np.int64)


def linked_pairs(a: _Block, b: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b with a cosine of threshold or more; of a block with itself, i < j."""
    score = a.near @ b.near.T
    slack = max(1e-5, 1.2e-7 * a.near.shape[1])
    i, j = np.nonzero(score >= threshold - slack)
    if a.number == b.number:
        i, j = i[i < j], j[i < j]
    doubt = np.flatnonzero(score[i, j] < threshold + slack)
    if len(doubt):
        ok = np.ones(len(i), bool)
        for at in range(0, len(doubt), 16_384):
            d = doubt[at : at + 16_384]
            ok[d] = np.einsum("ij,ij->i", a.exact[i[d]], b.exact[j[d]]) >= threshold
        i, j = i[ok], j[ok]
    return i, j


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, kind: type, size: int) -> Iterator[pa.RecordBatch]:
    """node, n, root: links that a cell's pairs of blocks find, summed by node, and a forest of them.

    A cell's held blocks come first, then those that go by, each with the held ones it has to meet.
    """
    cell, held, start, label = None, {}, {}, np.zeros(0, np.int64)

    def rows(nodes, n, root):
        some = (n > 0) | (root != nodes)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(n[some]), pa.array(root[some])], names=["node", "n", "root"])

    def closed():
        nodes = np.concatenate([b.nodes for b in held.values()])
        return rows(nodes, np.concatenate([b.linked for b in held.values()]), nodes[label])

    for batch in batches:
        for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            if cell != r["cell"]:
                if held:
                    yield closed()
                cell, held, start, label = r["cell"], {}, {}, np.zeros(0, np.int64)
            number = r["block"]
            block = held.get(number) or _Block(number, np.frombuffer(r["vectors"], kind).reshape(-1, r["length"]), np.frombuffer(r["copies"], np.int64), size)
            if r["meets"] is None:
                start[number], held[number] = len(label), block
                label = np.concatenate([label, len(label) + np.arange(len(block.nodes))])
                continue
            base, known = start.get(number, len(label)), len(label)
            if number not in held:
                label = np.concatenate([label, known + np.arange(len(block.nodes))])
            for other in sorted(r["meets"]):
                a = held[other]
                i, j = linked_pairs(a, block, threshold)
                a.linked += np.bincount(i, block.copies[j], len(a.nodes)).astype(np.int64)
                block.linked += np.bincount(j, a.copies[i], len(block.nodes)).astype(np.int64)
                label = united(label, start[other] + i, base + j)
            if number not in held:
                nodes = np.concatenate([b.nodes for b in held.values()] + [block.nodes])
                yield rows(block.nodes, block.linked, nodes[label[known:]])
                label = label[:known]
    if held:
        yield closed()


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding; other columns aren't read).

    n_links: other rows with a cosine of at least threshold (above 0), in double precision; component_id: the
    smallest vec_id that links lead to; kept: whether that is the row's own.  Vectors that are null, empty, zero
    or hold null or non-finite components, and vectors of different lengths, aren't linked.  Rows without a
    vec_id are left out.  Every other row counts for itself: equal rows are linked with each other, and
    a vec_id that stands twice has two rows.

    Shuffled are each row's vector twice (for equal ones, and for its result), each distinct one's once into the
    order, and each block of 256 once for every 32 x 64 blocks in which it has pairs to meet.  A task holds up to
    32 blocks and one that goes by.  Driver: the sample and three numbers.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    epsilon = max(1e-6, float(np.sqrt(2 - 2 * threshold)))
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind, kind_name = (np.float32, "float") if element == "float" else (np.float64, "double")
    v = F.col("embedding").cast(f"array<{kind_name}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine")).filter("vec_id IS NOT NULL")
    nodes = cut(rows.filter("fine").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    drawn = nodes.select("v").orderBy(F.xxhash64("v"), "first").limit(sample).toArrow().column("v").combine_chunks()
    alone = rows.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(drawn):
        return alone
    basis = directions(unit(max((x for _, x in _by_length(drawn)), key=lambda x: (len(x), x.shape[1]))))
    blocks = cut(_blocks(_ordered(nodes, basis, epsilon), basis))
    last = blocks.agg(F.max("part").alias("part"), F.max("n").alias("n"), F.max("length").alias("length")).first()
    bits = int(last.n).bit_length()
    blocks = blocks.withColumn("block", F.shiftleft("part", bits) + F.col("n"))
    pairs = cut(near_blocks(blocks.select(F.col("block").alias("id"), "lo", "hi"), epsilon, int(last.part + 1) << bits))

    held_bits = min(HELD_BITS, max(0, (HELD_BYTES // (12 * BLOCK * int(last.length))).bit_length() - 1))
    celled = pairs.withColumn("cell", F.struct(F.shiftright("a", held_bits).alias("x"), F.shiftright("b", PASSING_BITS).alias("y")))
    none = F.lit(None).cast("array<long>")
    wanted = celled.select("cell", F.col("a").alias("block"), none.alias("meets")).distinct()
    wanted = wanted.unionByName(celled.groupBy("cell", F.col("b").alias("block")).agg(F.collect_list("a").alias("meets")))  # 32 at most
    sent = wanted.join(blocks.select("block", "length", "vectors", "copies"), "block")
    sent = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", F.col("meets").isNotNull(), "block")
    flat = sent.select(F.concat_ws(" ", "cell.x", "cell.y").alias("cell"), "block", "meets", "length", "vectors", "copies")
    size = BLOCK
    found = cut(flat.mapInArrow(lambda it: _compare(it, threshold, kind, size), "node long, n long, root long"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                x, firsts = np.frombuffer(r["vectors"], kind), np.frombuffer(r["firsts"], np.int64)
                offsets = pa.array(np.arange(0, len(x) + 1, r["length"], dtype=np.int32))
                node = r["block"] * BLOCK + np.arange(len(firsts))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(firsts), pa.array(np.frombuffer(r["copies"], np.int64)), pa.ListArray.from_arrays(offsets, pa.array(x))], names=["node", "first", "copies", "v"])

    sequence = blocks.select("block", "length", "vectors", "firsts", "copies").mapInArrow(unpacked, f"node long, first long, copies long, v array<{kind_name}>")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.filter("root != node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = classes.join(sequence.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    of_node = classes.join(least, "component").select("node", "least")
    node = sequence.join(counts, "node", "left").join(of_node, "node", "left")
    node = node.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = rows.filter("fine").select("vec_id", "v").join(node, "v")
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def op12_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with a cosine of 0.95 or more, as components."""
    return near_copies(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP12_SQL = """
WITH RECURSIVE valid AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v)
    WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.95
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id WHERE vec_id IS NOT NULL
"""
