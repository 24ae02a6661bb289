"""N-gram Jaccard join by a MinHash LSH forest.

* A document is the set of its five-word shingles (lower-cased words; a shorter text is one shingle).
  Documents with equal sets are one class and are represented by their least doc_id from then on.
* A class has a signature of ``TREES`` times ``DEPTH`` MinHash labels.  Each tree is a prefix trie, held as
  its sorted keys: the rows (tree, labels, class) in order, dealt out by range, so that classes below one
  trie node are neighbours however many they are.  One pass over the sorted keys gives each class the
  length of the prefix that it shares with the row before it, and the first class below the deepest node
  that the two are under.
* The matched prefix starts at full depth and is shortened until the target recall.  Recall at a depth is
  estimated from in how many trees the classes have a neighbour at all, and measured after verification
  on the exact similarities of all links found; if it falls short, the prefix is shortened further.
* Classes below one trie node at that depth are compared by their whole signatures, each with a few leaders
  only, so that texts which just share boilerplate fall apart.  Those that agree make components, which
  are candidates.  All pairs within a component are then verified exactly on their shingles, component by
  component; a large component is split into blocks and its pairs of blocks are separate groups.  What
  leaves a group is a row for each class: its links' number and the least class it is connected with.

So no pair is ever a row, and shingles are shuffled only of classes that have a candidate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, cut, fresh, table, tidied
from .components import components
from .wordhash import word_hashes

SHINGLE = 5
#: The similarity at which two documents are linked, as a fraction.
SIMILAR = (4, 5)
TREES, DEPTH, TARGET = 24, 8, 0.99999
#: Below a trie node: labels that a class must share with a leader to need no leader of its own, and to be
#: linked with it, as parts of all labels.  Two texts at a similarity of 0.8 are linked with one leader, as
#: distances (1 - similarity) add up at most: 0.2 + 0.1 is well below 1 - LINKED.
COVERED, LINKED = 0.9, 0.56
#: Classes in a block of a component.
BLOCK = 512
#: Bits of the array over the candidates' ids: 2**FILTER_BITS, whatever their number.
FILTER_BITS = 26

_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)


def found_at(depth, similarity):
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def least_depth() -> int:
    """The longest prefix with which any pair that is similar enough is found with the target recall; the
    matched prefix need never be shorter."""
    return next((k for k in range(DEPTH, 0, -1) if found_at(k, SIMILAR[0] / SIMILAR[1]) >= TARGET), 1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, as ascending 64-bit hashes."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for j in range(min(SHINGLE, len(h))):
        out = (out ^ h[j : j + n]) * _POWERS[1]
        out ^= out >> _U(31)
    out *= _U(0xBF58476D1CE4E5B9)
    out ^= out >> _U(29)
    return np.unique(out)


class Forest:
    """The hash functions of all trees."""

    def __init__(self, seed: int = 1):
        self.a = np.random.default_rng(seed).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)

    def labels(self, s: np.ndarray) -> bytes:
        """The labels of all trees, 16 bits each, so that a tree's key is a part of it; none for an empty set."""
        if not len(s):
            return b""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 2048):
            least = np.minimum(least, (self.a[:, None] * s[None, at : at + 2048]).min(axis=1))
        return ((least ^ (least >> _U(29))) * _U(0x9E3779B97F4A7C15) >> _U(48)).astype(">u2").tobytes()


_SIGNED = "doc_id long, high long, low long, labels binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near duplicates")
    forest = Forest()
    for batch in batches:
        marks, labels = [], []
        for t in batch.column(1):
            s = shingles(t.as_py())
            marks.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
            labels.append(forest.labels(s))
        m = np.array(marks).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(labels, pa.binary())], names=["doc_id", "high", "low", "labels"])


_TRIE = "node long, tree int, depth int, part int, key binary"
#: Depths of rows that stand for a range's first and last row.
_ENDS = (-1, -2)


def _trie(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """From sorted (tree, key, node), one range of them: each class that shares a prefix of ``floor`` labels or
    more with the row before or after it, and how many; and the range's first and last row, with depth -1
    and -2.  A range is as many rows as one partition has, 40 bytes each."""
    part, columns = TaskContext.get().partitionId(), []
    for batch in batches:
        if batch.num_rows:
            columns.append((batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH), batch.column(2).to_numpy()))
    if not columns:
        return
    tree, key, node = (np.concatenate(c) for c in zip(*columns))
    n = len(node)
    same = np.zeros(n + 1, np.int64)  # labels shared with the row before
    same[1:n] = np.cumprod(key[1:] == key[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
    shared = np.maximum(same[:-1], same[1:])
    at = np.flatnonzero(shared >= floor)
    names = ["node", "tree", "depth", "part", "key"]
    rows = lambda at, depth, keys: pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(tree[at], pa.int32()), pa.array(depth, pa.int32()), pa.array(np.full(len(at), part), pa.int32()), keys], names=names)
    yield rows(at, shared[at], pa.nulls(len(at), pa.binary()))
    yield rows(np.array([0, n - 1]), list(_ENDS), pa.array([key[0].tobytes(), key[-1].tobytes()], pa.binary()))


def trie_members(classes: DataFrame, floor: int) -> DataFrame:
    """node, tree, depth: the classes that share a prefix of ``floor`` labels or more in a tree, and the longest
    that they share there with any other; a row can stand there twice, with a smaller depth.

    classes: node, labels.  Ranges of rows end anywhere, even within the classes below one node of a trie;
    the driver sees the first and the last row of each range and joins the ranges up.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    keys = classes.filter(F.length("labels") > 0).select(trees.alias("tree"), "labels", "node").select("tree", F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "node")
    sorted_ = keys.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = cut(sorted_.mapInArrow(lambda it: _trie(it, floor), _TRIE))
    ends = sorted(found.filter(F.col("depth").isin(*_ENDS)).collect(), key=lambda r: (r.part, -r.depth))
    joins = []
    for x, y in zip(ends[1::2], ends[2::2]):
        same = next((i for i in range(DEPTH) if x.key[2 * i : 2 * i + 2] != y.key[2 * i : 2 * i + 2]), DEPTH)
        if x.tree == y.tree and same >= floor:
            joins += [(x.node, x.tree, same), (y.node, y.tree, same)]
    members = found.filter("depth >= 0").select("node", "tree", "depth")
    return members.unionByName(classes.sparkSession.createDataFrame(joins, "node long, tree int, depth int")) if joins else members


def estimated_depth(members: DataFrame, floor: int) -> int:
    """The longest prefix with the target recall, by an estimate from the tries alone.

    A class whose nearest neighbour has similarity s shares a prefix of ``floor`` labels with a neighbour in
    TREES * s ** floor trees on average.  The driver sees how many classes have each number of trees.
    """
    trees = members.select("node", "tree").distinct().groupBy("node").agg(F.count("*").alias("trees")).groupBy("trees").count().collect()
    least = SIMILAR[0] / SIMILAR[1]
    part = np.array([r.trees for r in trees]) / TREES
    n = np.array([r["count"] for r in trees], float)
    s = np.minimum(part, 1) ** (1 / floor)
    s, n = s[s >= least], n[s >= least]
    return next((k for k in range(DEPTH, floor, -1) if n.sum() >= TARGET * (n / found_at(k, s)).sum()), floor)


def _dealt(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """From node, labels, trees: a row for each of these trees, with its node of the trie and the signature's low bytes."""
    for batch in batches:
        buckets, nodes, marks = [], [], []
        for node, raw, trees in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            low = raw[1::2]
            for tree in trees:
                at = tree * 2 * DEPTH
                buckets.append(bytes([tree]) + raw[at : at + 2 * depth])
                nodes.append(node)
                marks.append(low)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.binary()), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary())], names=["bucket", "node", "marks"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From classes below one trie node, one after the other: edges that connect each class with all leaders
    that share enough labels with it, where no earlier edge does; fewer than there are classes.

    A class that no leader covers becomes one.  Only leaders are held.
    """
    bucket, leaders, nodes, n = None, np.zeros((0, TREES * DEPTH), np.uint8), [], 0
    roots = np.zeros(0, int)  # of each leader, the least leader that edges connect it with
    for batch in batches:
        out = []
        for key, node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != key:
                bucket, nodes, n = key, [], 0
            own = np.frombuffer(raw, np.uint8)
            share = (leaders[:n] == own).mean(axis=1) if n else np.zeros(0)
            met = np.unique(roots[:n][share >= LINKED])
            if len(met):
                out += [(node, nodes[met[0]]), *((nodes[r], nodes[met[0]]) for r in met[1:])]
                if len(met) > 1:
                    roots[:n][np.isin(roots[:n], met)] = met[0]
            if not (share >= COVERED).any():
                if n == len(leaders):
                    leaders = np.concatenate([leaders, np.zeros((max(64, n), TREES * DEPTH), np.uint8)])
                    roots = np.concatenate([roots, np.zeros(max(64, n), int)])
                leaders[n], roots[n] = own, met[0] if len(met) else n
                nodes.append(node)
                n += 1
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(classes: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """node, component: classes that share a prefix of this depth and whose signatures agree.

    A class is sent once for each tree in which it shares a prefix, with a byte of each label.
    """
    shared = members.filter(F.col("depth") >= depth).groupBy("node").agg(F.collect_set("tree").alias("trees"))  # TREES at most
    dealt = classes.select("node", "labels").join(shared, "node").select("node", "labels", "trees").mapInArrow(lambda it: _dealt(it, depth), "bucket binary, node long, marks binary")
    agreed = dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_led, "a long, b long")
    return components(agreed)


def _slot(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each id in the array."""
    h = ids.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(64 - FILTER_BITS)
    return (h >> _U(3)).astype(np.int64), (h & _U(7)).astype(np.uint8)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for b in batches:
        byte, bit = _slot(b.column(0).to_numpy())
        np.bitwise_or.at(bits, byte, np.uint8(1) << bit)
    words = bits.view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["word", "bits"])


def _id_filter(ids: DataFrame) -> np.ndarray:
    """The array over all ids, as bytes: at most 2**(FILTER_BITS - 6) rows come to the driver."""
    rows = ids.mapInArrow(_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8)


def links_of(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boolean matrix of the pairs (i in first, j in second) of sets that are similar, exact; similarities."""
    sizes = np.array([len(s) for s in sets])
    all_ = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    values, column = np.unique(all_, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1  # a shingle of one set only adds to no pair
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(first), len(second)), np.float32)
    width = max(256, 4_000_000 // max(1, len(sets)))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        inter += m[first] @ m[second].T
    union = sizes[first][:, None] + sizes[second][None, :] - inter
    return (inter * SIMILAR[1] >= union * SIMILAR[0]) & (union > 0), inter / np.maximum(union, 1)


def _roots(links: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least number that each of n is connected with."""
    root = np.arange(n)
    changed = True
    while changed:
        old = root.copy()
        for i, j in links:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        changed = bool((root != old).any())
    return root


_VERIFIED = "node long, degree long, root long, whole boolean, found double, expected double"


def _verify(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Groups (component, i, j) come one after the other; a row for each class of a group.

    found: links of the group, at one of its rows; expected: how many there must be for so many to be
    found at this depth, given their similarities.
    """
    group, rows = None, []

    def done():
        node = np.array([r[0] for r in rows])
        copies, block = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        _, i, j, blocks = group
        if i == j:
            one = two = np.arange(len(node))
        else:
            one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        order = np.argsort(node, kind="stable")
        at = np.empty(len(node), int)
        at[order] = np.arange(len(node))
        ok, similarity = links_of(sets, one, two)
        if i == j:
            np.fill_diagonal(ok, False)
        found, expected = np.zeros(len(node)), np.zeros(len(node))
        found[0], expected[0] = ok.sum(), (1 / found_at(depth, similarity[ok].astype(float))).sum()
        degree = np.zeros(len(node), np.int64)
        np.add.at(degree, one, ok @ copies[two])
        if i != j:
            np.add.at(degree, two, ok.T @ copies[one])
        a, b = np.nonzero(ok)
        root = _roots([(at[one[a]], at[two[b]])], len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(degree), pa.array(node[order][root[at]]), pa.array(np.full(len(node), blocks == 1)), pa.array(found), pa.array(expected)], names=["node", "degree", "root", "whole", "found", "expected"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(8)]
        for c, i, j, blocks, node, copies, block, s in zip(*columns):
            if group != (c, i, j, blocks):
                if group is not None:
                    yield from done()
                group, rows = (c, i, j, blocks), []
            rows.append((node, copies, block, s))
    if group is not None:
        yield from done()


def _verified(read: DataFrame, classes: DataFrame, parts: DataFrame, depth: int) -> DataFrame:
    """All pairs of each component, verified."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    members = parts.join(sizes, "component").join(classes.select("node", "copies"), "node")
    members = cut(members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).select("component", "blocks", "node", "copies", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))

    # The candidates' shingles, once for each pair of blocks.
    bits = read.sparkSession.sparkContext.broadcast(_id_filter(members.select("node")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates")
        on = bits.value
        for batch in batches:
            byte, bit = _slot(batch.column(0).to_numpy())
            some = np.flatnonzero(on[byte] >> bit & 1)
            b = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["node", "shingles"])

    found = read.filter("doc_id IS NOT NULL").mapInArrow(sets, "node long, shingles binary").join(members, "node").dropDuplicates(["node", "shingles"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = found.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "node", "copies", "block", "shingles")
    grouped = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return cut(grouped.mapInArrow(lambda it: _verify(it, depth), _VERIFIED))


def near_duplicates(docs: DataFrame, told: dict | None = None) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs.

    n_links: how many other rows have a Jaccard similarity of 0.8 or more to this one (exact copies
    among them).  class_id: the least doc_id of those connected by links.  Texts without a word, null
    ones too, are copies of each other.  Repeated rows are copies.  Different texts under one doc_id are
    linked with what either is linked with.  A row with a null doc_id has a null class and no links.
    An empty table gives no rows.  told: is given the prefix's ``depth`` and the measured ``recall``.
    """
    read = docs.select(F.col("doc_id").cast("long"), "text")
    with tidied(docs.sparkSession):
        signed = cut(read.filter("doc_id IS NOT NULL").mapInArrow(_signatures, _SIGNED))
        classes = cut(signed.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.any_value("labels").alias("labels")))
        signed = signed.drop("labels")

        floor = least_depth()
        members = trie_members(classes, floor)
        depth = estimated_depth(members, floor)
        while True:
            verified = _verified(read, classes, candidates(classes, members, depth), depth)
            found, expected = verified.agg(F.sum("found"), F.sum("expected")).first()
            recall = found / expected if expected else 1.0
            if depth == floor or recall >= TARGET:
                break
            depth -= 1
    if told is not None:
        told.update(depth=depth, recall=recall)

    degrees = verified.groupBy("node").agg(F.sum("degree").alias("degree"))
    whole = verified.filter("whole AND node != root").select("node", F.col("root").alias("component"))
    split = components(verified.filter("NOT whole AND node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    labels = whole.unionByName(split)
    result = classes.drop("labels").join(degrees, "node", "left").join(labels.groupBy("node").agg(F.min("component").alias("component")), "node", "left")
    result = result.select("high", "low", F.coalesce("component", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "high", "low").join(result, ["high", "low"]).select("doc_id", "class_id", "n_links")
    nulls = read.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nulls)


def _numbered(keys: DataFrame) -> DataFrame:
    """keys (id, text_hash) with ``number``, from 0 without gaps in their order; the driver gets a count of each partition."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, "id", "text_hash").sortWithinPartitions("id", "text_hash")
    ordered = cut(ordered.select("id", "text_hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")))
    before, starts = 0, []
    for r in ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    first = F.broadcast(keys.sparkSession.createDataFrame(starts, "part int, before long"))  # a row for each partition
    return ordered.join(first, "part").select("id", "text_hash", (F.col("before") + F.col("nth")).alias("number"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near copies: that of its least doc_id (of one id's texts, by their hash).

    Of rows that repeat both doc_id and text one stays.  A doc_id that stands for several texts stands for several
    documents: each is kept or goes with its own class.  Rows with a null doc_id all stay.
    """
    mine, text_hash = fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    named = docs.filter("doc_id IS NOT NULL").withColumn(mine, F.col("doc_id").cast("long")).withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit(""))))
    nulls = docs.filter("doc_id IS NULL")
    with tidied(docs.sparkSession):
        told = named.groupBy(mine).agg(F.count("*").alias("n"), (F.min(text_hash) != F.max(text_hash)).alias("several")).agg(F.max("n"), F.coalesce(F.bool_or("several"), F.lit(False))).first()
    if not told[1]:
        kept = near_duplicates(docs).filter("doc_id = class_id").select(F.col("doc_id").alias(mine)).distinct()
        named = named.drop(text_hash).join(kept, mine, "left_semi")
        return (named.dropDuplicates([mine]) if (told[0] or 0) > 1 else named).select(*docs.columns).unionByName(nulls)
    keys = named.select(F.col(mine).alias("id"), F.col(text_hash).alias("text_hash")).distinct()
    numbers = _numbered(keys).toDF(mine, text_hash, number := fresh(docs, "kept_number"))
    each = cut(named.join(numbers, [mine, text_hash]).drop(mine, text_hash))
    kept = near_duplicates(each.select(F.col(number).alias("doc_id"), "text")).filter("doc_id = class_id").select(F.col("doc_id").alias(number)).distinct()
    return each.join(kept, number, "left_semi").dropDuplicates([number]).select(*docs.columns).unionByName(nulls)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of near copies and their number of links."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
n AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
s AS (SELECT doc_id, unnest(s) AS s FROM n),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (len(x.s) + len(y.s) - c)
  UNION ALL SELECT x.doc_id, y.doc_id FROM n x JOIN n y ON len(x.s) = 0 AND len(y.s) = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links
FROM documents d
"""
