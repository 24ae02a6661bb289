"""Postings in blocks, with what a search needs to skip blocks: block-max retrieval of the best texts.

Texts are dealt out to parts by a hash of their path, and a part's texts, by path, are cut into blocks of 128.  A
row holds one term's postings in one block, beside the most occurrences and the least text length there, which
bound what the term can add to a score in that block, whatever the corpus's mean length is.  A search first adds
up how often each phrase occurs (of single words the rows say it, without their postings), then each part goes
through its blocks from the highest bound down, and stops where the bound is below the k-th best score
it has; what a stopped part doesn't read can't be among the best.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DOC_BLOCKS, TERM_BLOCKS
from .fts import B, K1, LEAST_IDF, Node, QueryError, parse_query, postings_with, ranked_phrases, sanitize

BLOCK = 128
#: Texts of a part, about; up to LEAST_PARTS there are more parts than that asks for.
PART_TEXTS, LEAST_PARTS = 16_384, 16
#: Scores closer than this count as equal until they are rounded.
NEAR_SCORES = 1e-8


def parts_for(texts: int) -> int:
    n = 1
    while n * PART_TEXTS < texts or (n < LEAST_PARTS and n * BLOCK < texts):
        n *= 2
    return n


def part_of(path, parts: int):
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("string")


def _row(part: str, block: int, term: str, ords, tfs, sizes, positions) -> tuple:
    return part, block, term, len(ords), max(tfs), min(sizes), *(array("i", v).tobytes() for v in (ords, tfs, sizes, positions))


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=list(names))


def build(words: DataFrame, parts: int) -> DataFrame:
    """The blocks of words (path, tokens): TERM_BLOCKS and, where term is '', DOC_BLOCKS.

    One shuffle, by part; a task holds one block.
    """
    schema = f"{TERM_BLOCKS}, {DOC_BLOCKS.split(', ', 2)[2].replace('n long', 'texts long')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = None, 0, []

        def closed() -> pa.RecordBatch:
            lists: dict[str, tuple[list, list, list, list]] = {}
            for ord_, (_, tokens) in enumerate(held):
                places: dict[str, list[int]] = {}
                for at, term in enumerate(tokens):
                    places.setdefault(term, []).append(at)
                for term, at in places.items():
                    ords, tfs, sizes, positions = lists.setdefault(term, ([], [], [], []))
                    ords.append(ord_)
                    tfs.append(len(at))
                    sizes.append(len(tokens))
                    positions.extend(at)
            rows = [_row(part, block, term, *lists[term]) + (None, None, None) for term in sorted(lists)]
            rows.append((part, block, "", 0, 0, 0, None, None, None, None, [p for p, _ in held], len(held), sum(len(t) for _, t in held)))
            return _batch(rows, schema)

        for batch in batches:
            for p, path, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part or len(held) == BLOCK:
                    if held:
                        yield closed()
                    part, block, held = p, block + 1 if p == part else 0, []
                held.append((path, tokens))
        if held:
            yield closed()

    dealt = words.select(part_of(F.col("path"), parts).alias("part"), "path", "tokens").repartition("part").sortWithinPartitions("part", "path")
    return dealt.mapInArrow(run, schema)


def term_blocks(made: DataFrame) -> DataFrame:
    """Of build's rows the terms', sorted as an index keeps them."""
    return made.filter("term != ''").select(*[c.split()[0] for c in TERM_BLOCKS.split(", ")])


def doc_blocks(made: DataFrame) -> DataFrame:
    return made.filter("term = ''").select("part", "block", "paths", F.col("texts").alias("n"), "tokens")


# --- evaluation -----------------------------------------------------------------------------------


class Lists:
    """One block's postings of the query's terms."""

    def __init__(self, rows: dict[str, dict], texts: int):
        self.rows, self.texts = rows, texts

    def _ints(self, term: str, what: str) -> np.ndarray:
        return np.frombuffer(self.rows[term][what], np.int32).astype(np.int64)

    def counts(self, term: str) -> np.ndarray:
        out = np.zeros(self.texts, np.int64)
        if term in self.rows:
            out[self._ints(term, "ords")] = self._ints(term, "tfs")
        return out

    def sizes(self) -> np.ndarray:
        out = np.ones(self.texts, np.int64)
        for term in self.rows:
            out[self._ints(term, "ords")] = self._ints(term, "sizes")
        return out

    def places(self, term: str, prefix: bool) -> np.ndarray:
        """Where a term stands, in order: text and position in one number."""
        terms = [t for t in self.rows if t.startswith(term)] if prefix else [term] if term in self.rows else []
        found = [np.repeat(self._ints(t, "ords"), self._ints(t, "tfs")) << 32 | self._ints(t, "positions") for t in terms]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def places(lists: Lists, phrase: Node) -> np.ndarray:
    """Where a phrase begins."""
    out = None
    for i, term in enumerate(phrase.tokens):
        at = lists.places(term, phrase.prefix and i == len(phrase.tokens) - 1)
        at = at[(at & 0xFFFFFFFF) >= i] - i
        out = at if out is None else np.intersect1d(out, at, assume_unique=True)
    out = np.zeros(0, np.int64) if out is None else out
    return out[(out & 0xFFFFFFFF) == 0] if phrase.first else out


def _plain(phrase: Node) -> bool:
    """Whether a phrase is one word, so that counts say all."""
    return len(phrase.tokens) == 1 and not phrase.prefix and not phrase.first


def occurrences(lists: Lists, phrase: Node) -> np.ndarray:
    """How often a phrase occurs in each text of a block."""
    if _plain(phrase):
        return lists.counts(phrase.tokens[0])
    return np.bincount(places(lists, phrase) >> 32, minlength=lists.texts)


def together(starts: list[list[int]], sizes: list[int], distance: int) -> list[set[int]]:
    """Of each phrase's starts in a text those in some clump: one of each phrase, with at most ``distance`` tokens
    between the end of any and the beginning of the last."""
    at, kept = [0] * len(starts), [set() for _ in starts]
    while True:
        last, settled = max(s[i] for s, i in zip(starts, at)), False
        while not settled:
            settled = True
            for k, s in enumerate(starts):
                while at[k] < len(s) and s[at[k]] < last - sizes[k] - distance:
                    at[k] += 1
                if at[k] == len(s):
                    return kept
                if s[at[k]] > last:
                    last, settled = s[at[k]], False
        for k, s in enumerate(starts):
            kept[k].add(s[at[k]])
        least = min(range(len(starts)), key=lambda k: starts[k][at[k]])
        at[least] += 1
        if at[least] == len(starts[least]):
            return kept


def evaluate(lists: Lists, node: Node, counts: list[np.ndarray]) -> np.ndarray:
    """Which texts of a block match; counts gets the occurrences of each ranked phrase, left to right."""
    if node.op in ("PHRASE", "NEVER"):
        counts.append(occurrences(lists, node) if node.op == "PHRASE" else np.zeros(lists.texts, np.int64))
        return counts[-1] > 0
    if node.op == "NEAR":
        if any(p.op == "NEVER" for p in node.parts):
            counts += [np.zeros(lists.texts, np.int64) for _ in node.parts]
            return np.zeros(lists.texts, bool)
        found = [places(lists, p) for p in node.parts]
        texts = set(found[0] >> 32).intersection(*(f >> 32 for f in found[1:]))
        own = [np.zeros(lists.texts, np.int64) for _ in node.parts]
        for text in texts:
            starts = [(f[(f >> 32) == text] & 0xFFFFFFFF).tolist() for f in found]
            for k, kept in enumerate(together(starts, [len(p.tokens) for p in node.parts], node.distance)):
                own[k][text] = len(kept)
        counts += own
        return own[0] > 0
    start = len(counts)
    first = evaluate(lists, node.parts[0], counts)
    for part in node.parts[1:]:
        other = evaluate(lists, part, [] if node.op == "NOT" else counts)
        first = first | other if node.op == "OR" else first & ~other if node.op == "NOT" else first & other
    # What stands in a branch that doesn't match a text adds nothing to its score.
    counts[start:] = [np.where(first, c, 0) for c in counts[start:]]
    return first


def _terms(node: Node) -> list[tuple[str, bool]]:
    """The terms that a tree names, and whether each is a prefix."""
    own = [(t, node.prefix and i == len(node.tokens) - 1) for i, t in enumerate(node.tokens)]
    return own + [x for p in node.parts for x in _terms(p)]


def _wanted(tree: Node):
    """The filter on term: Parquet's statistics skip what it can't hold."""
    out = F.lit(False)
    for term, prefix in sorted(set(_terms(tree))):
        out = out | (F.col("term").startswith(term) if prefix else F.col("term") == term)
    return out


def _positioned(tree: Node) -> bool:
    """Whether a tree needs positions."""
    return tree.op == "NEAR" or (tree.op == "PHRASE" and not _plain(tree)) or any(_positioned(p) for p in tree.parts)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[int, dict[str, dict]]]]:
    """The rows of each part, by block and term; rows come sorted by part."""
    part, held = None, {}
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            r = dict(zip(names, values))
            if r["part"] != part:
                if held:
                    yield part, held
                part, held = r["part"], {}
            held.setdefault(r["block"], {})[r["term"]] = r
    if held:
        yield part, held


def _by_part(rows: DataFrame, positions: bool) -> DataFrame:
    columns = ["part", "block", "term", "n", "most", "shortest", "ords", "tfs", "sizes", *(["positions"] if positions else []), *(["paths"] if "paths" in rows.columns else [])]
    return rows.select(*columns).repartition("part").sortWithinPartitions("part")


def blocks_of_postings(made: DataFrame, tree: Node, parts: int = 1024) -> DataFrame:
    """The blocks, with their paths, of a query's postings (term, path, doc_length, tf, positions)."""
    schema = f"{TERM_BLOCKS}, paths array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, paths, lists = None, 0, [], {}

        def closed() -> pa.RecordBatch:
            return _batch([_row(part, block, term, *lists[term]) + (list(paths) if i == 0 else None,) for i, term in enumerate(sorted(lists))], schema)

        for batch in batches:
            for p, path, term, size, tf, at in zip(*(c.to_pylist() for c in batch.columns)):
                if paths and (p != part or (len(paths) == BLOCK and path != paths[-1])):
                    yield closed()
                    part, block, paths, lists = p, block + 1 if p == part else 0, [], {}
                part = p
                if not paths or path != paths[-1]:
                    paths.append(path)
                ords, tfs, sizes, positions = lists.setdefault(term, ([], [], [], []))
                ords.append(len(paths) - 1)
                tfs.append(tf)
                sizes.append(size)
                positions.extend(at)
        if paths:
            yield closed()

    dealt = made.filter(_wanted(tree)).select(part_of(F.col("path"), parts).alias("part"), "path", "term", "doc_length", "tf", "positions")
    return dealt.repartition("part").sortWithinPartitions("part", "path").mapInArrow(run, schema)


@dataclass
class Corpus:
    texts: int
    mean: float


def statistics(lengths: DataFrame) -> Corpus:
    """Of all texts (doc_length): how many, and the mean length."""
    row = lengths.agg(F.count("*").alias("n"), F.avg("doc_length").alias("mean")).first()
    return Corpus(row.n, row.mean or 0.0)


def document_frequencies(rows: DataFrame, tree: Node, found: dict[str, int] | None = None) -> list[int]:
    """In how many texts each ranked phrase occurs.  A word's (found, if they are known) is a sum over its blocks'
    counts; only other phrases are looked for in the postings."""
    phrases = ranked_phrases(tree)
    if found is None:
        words = {p.tokens[0] for p in phrases if p.op == "PHRASE" and _plain(p)}
        found = {r.term: r.n for r in rows.filter(F.col("term").isin(*words)).groupBy("term").agg(F.sum("n").alias("n")).collect()} if words else {}
    other = [p for p in phrases if p.op == "PHRASE" and p.tokens and not _plain(p)]
    counted: dict[int, int] = {}
    if other:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [0] * len(other)
            for _, blocks in _grouped(batches):
                for lists in blocks.values():
                    for k, p in enumerate(other):
                        n[k] += int(np.count_nonzero(occurrences(Lists(lists, BLOCK), p)))
            yield _batch(list(enumerate(n)), "phrase int, n long")

        wanted = rows.filter(_wanted(Node("AND", other)))
        counted = {r.phrase: r.n for r in _by_part(wanted, True).mapInArrow(run, "phrase int, n long").groupBy("phrase").agg(F.sum("n").alias("n")).collect()}
    at = iter(range(len(other)))
    return [0 if p.op == "NEVER" or not p.tokens else found.get(p.tokens[0], 0) if _plain(p) else counted.get(next(at), 0) for p in phrases]


def _weights(corpus: Corpus, frequencies: list[int]) -> np.ndarray:
    idf = np.array([np.log((corpus.texts - n + 0.5) / (n + 0.5)) for n in frequencies])
    return np.where(idf <= 0, LEAST_IDF, idf)


def _parts_of_score(tf, size, mean: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _scores(lists: Lists, tree: Node, weights: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a block that match, and their scores."""
    counts: list[np.ndarray] = []
    hits = np.flatnonzero(evaluate(lists, tree, counts))
    sizes = lists.sizes()[hits]
    total = np.zeros(len(hits))
    for w, tf in zip(weights, counts):
        total += w * np.where(tf[hits] > 0, _parts_of_score(tf[hits], sizes, mean), 0)
    return hits, total


def every_match(rows: DataFrame, tree: Node, corpus: Corpus, frequencies: list[int]) -> DataFrame:
    """path, rank of all matches in blocks with paths."""
    weights = _weights(corpus, frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _grouped(batches):
            for terms in blocks.values():
                paths = next(r["paths"] for r in terms.values() if r["paths"])
                hits, total = _scores(Lists(terms, len(paths)), tree, weights, corpus.mean)
                yield _batch([(paths[i], -s) for i, s in zip(hits.tolist(), total.tolist())], "path string, rank double")

    columns = ["part", "block", "term", "n", "most", "shortest", "ords", "tfs", "sizes", "positions", "paths"]
    return rows.select(*columns).repartition("part").sortWithinPartitions("part").mapInArrow(run, "path string, rank double")


def _bound(terms: dict[str, dict], node: Node, weights: Iterator[float], mean: float) -> float:
    """What a text of a block can score at most; -1 where none can match."""
    if node.op in ("PHRASE", "NEVER"):
        w, most = next(weights), 0.0
        if node.op == "NEVER" or not node.tokens:
            return -1.0
        for i, term in enumerate(node.tokens):
            prefix = node.prefix and i == len(node.tokens) - 1
            here = [r for t, r in terms.items() if (t.startswith(term) if prefix else t == term)]
            if not here:
                return -1.0
            # A phrase occurs no more often than any of its words; a prefix as often as its words together.
            score = _parts_of_score(sum(r["most"] for r in here), min(r["shortest"] for r in here), mean)
            most = score if i == 0 else min(most, score)
        return w * most
    if node.op == "NOT":
        return _bound(terms, node.parts[0], weights, mean)
    each = [_bound(terms, p, weights, mean) for p in node.parts]
    if node.op == "OR":
        return sum(max(0.0, b) for b in each) if max(each) >= 0 else -1.0
    return sum(each) if min(each) >= 0 else -1.0


_FOUND = "part string, block int, ord int, score double, blocks int, evaluated int, path string"


def best_of_parts(rows: DataFrame, tree: Node, corpus: Corpus, frequencies: list[int], k: int) -> DataFrame:
    """part, block, ord, score of each part's k best, with their path if the blocks have paths, and a row without a block
    for each part: its blocks, and how many of them were evaluated."""
    weights = _weights(corpus, frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _grouped(batches):
            bounds = {b: _bound(terms, tree, iter(weights), corpus.mean) for b, terms in blocks.items()}
            best: list[tuple[float, int, int]] = []  # minus rounded score, block, ord: in order of score and path
            exact: dict[tuple[int, int], float] = {}
            least, done = -1.0, 0
            for b in sorted(bounds, key=lambda b: (-bounds[b], b)):
                if bounds[b] < 0 or (len(best) == k and bounds[b] < least - NEAR_SCORES):
                    break
                done += 1
                hits, total = _scores(Lists(blocks[b], BLOCK), tree, weights, corpus.mean)
                if len(best) == k:
                    some = total >= least - NEAR_SCORES
                    hits, total = hits[some], total[some]
                for i, s in zip(hits.tolist(), total.tolist()):
                    exact[b, i] = s
                    best.append((-round(s, 9), b, i))
                best = sorted(best)[:k]
                if len(best) == k:
                    least = -best[-1][0]
            paths = {b: next((r["paths"] for r in blocks[b].values() if r.get("paths")), None) for b in {b for _, b, _ in best}}
            yield _batch([(part, b, i, exact[b, i], None, None, paths[b] and paths[b][i]) for _, b, i in best] + [(part, None, None, None, len(bounds), done, None)], _FOUND)

    return _by_part(rows.filter(_wanted(tree)), _positioned(tree)).mapInArrow(run, _FOUND)


def _found(terms: DataFrame, docs: DataFrame, query: str, limit: int, stemmed: bool) -> DataFrame:
    tree = parse_query(query, stemmed)
    phrases = ranked_phrases(tree)
    words = [p.tokens[0] for p in phrases if p.op == "PHRASE" and _plain(p)]
    # One pass says how many texts there are and how long, and in how many each word occurs.
    every = docs.select(F.lit("").alias("term"), "n", "tokens").unionByName(terms.filter(F.col("term").isin(*words)).select("term", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("tokens")))
    sums = every.agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("n"))), F.lit(0)) for t in ["", *words]], F.coalesce(F.sum("tokens"), F.lit(0))).first()
    corpus = Corpus(sums[0], sums[-1] / sums[0] if sums[0] else 0.0)
    frequencies = document_frequencies(terms.filter(_wanted(tree)), tree, dict(zip(words, sums[1:])))
    return best_of_parts(terms, tree, corpus, frequencies, limit)


def best(terms: DataFrame, docs: DataFrame, query: str, limit: int = 20, stemmed: bool = True) -> list[tuple[str, float]]:
    """(path, rank) of the best matches of a query, best first, ties by path; terms: TERM_BLOCKS, docs: DOC_BLOCKS.

    The driver gets ``limit`` rows of each part at most, and the paths of the blocks that the best are in.
    """
    hits = _found(terms, docs, query, limit, stemmed).filter("block IS NOT NULL").select("part", "block", "ord", "score").collect()
    hits.sort(key=lambda r: -round(r.score, 9))
    if len(hits) > limit:  # ties with the last one stay until paths decide
        hits = [r for r in hits if round(r.score, 9) >= round(hits[limit - 1].score, 9)]
    if not hits:
        return []
    wanted = docs.filter(F.col("part").isin(*{r.part for r in hits}) & F.col("block").isin(*{r.block for r in hits}))
    at = docs.sparkSession.createDataFrame([(r.part, r.block, r.ord) for r in hits], "part string, block int, ord int")
    named = {(r.part, r.block, r.ord): r.path for r in wanted.join(F.broadcast(at), ["part", "block"]).select("part", "block", "ord", F.get("paths", F.col("ord")).alias("path")).collect()}
    found = [(named[r.part, r.block, r.ord], -r.score) for r in hits]
    return sorted(found, key=lambda x: (round(x[1], 9), x[0]))[:limit]


def search(terms: DataFrame, docs: DataFrame, query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """path, rank of ``best``."""
    return docs.sparkSession.createDataFrame(best(terms, docs, query, limit, stemmed), "path string, rank double")


def search_report(terms: DataFrame, docs: DataFrame, query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """One row: blocks that hold a word of the query, and how many of them a search evaluates."""
    found = _found(terms, docs, query, limit, stemmed)
    return found.filter("block IS NULL").agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("evaluated"), F.lit(0)).alias("evaluated"))


def best_summaries(summaries: DataFrame, terms: DataFrame, docs: DataFrame, query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """path, summary, rank of the best matches of a user's query, sanitised first; the lowest rank is best."""
    if not query.strip():
        raise QueryError("missing 'query' argument")
    return _with_summaries(summaries, best(terms, docs, sanitize(query), limit, stemmed))


def best_of_texts(summaries: DataFrame, query: str, limit: int = 20, stemmed: bool = True) -> list[tuple[str, float]]:
    """``best`` of texts (path, summary) that no index is kept of.

    One pass over all texts makes the postings of the query's terms, which are kept until the search is done; so what is
    shuffled grows with those, and nothing is written.
    """
    tree = parse_query(query, stemmed)
    words = [p.tokens[0] for p in ranked_phrases(tree) if p.op == "PHRASE" and _plain(p)]
    made = postings_with(summaries, sorted(set(_terms(tree))), stemmed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = {r.term: r for r in made.filter(F.col("term").isin("", *words)).groupBy("term").agg(F.count("*").alias("n"), F.sum("doc_length").alias("texts"), F.sum("tf").alias("tokens")).collect()}
        corpus = Corpus(sums[""].texts, sums[""].tokens / sums[""].texts) if "" in sums else Corpus(0, 0.0)
        rows = blocks_of_postings(made, tree, parts_for(corpus.texts))
        frequencies = document_frequencies(rows, tree, {t: r.n for t, r in sums.items()})
        hits = best_of_parts(rows, tree, corpus, frequencies, limit).filter("block IS NOT NULL").select("path", "score").collect()
    finally:
        made.unpersist()
    return sorted(((r.path, -r.score) for r in hits), key=lambda x: (round(x[1], 9), x[0]))[:limit]


def best_summaries_of_texts(summaries: DataFrame, query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """``best_summaries`` of texts that no index is kept of."""
    if not query.strip():
        raise QueryError("missing 'query' argument")
    return _with_summaries(summaries, best_of_texts(summaries, sanitize(query), limit, stemmed))


def _with_summaries(summaries: DataFrame, found: list[tuple[str, float]]) -> DataFrame:
    ranks = summaries.sparkSession.createDataFrame(found, "path string, rank double")
    kept = summaries.select("path", "summary").filter(F.col("path").isin(*[p for p, _ in found]))
    return kept.join(F.broadcast(ranks), "path").select("path", "summary", "rank").orderBy(F.round("rank", 9), "path")  # ``limit`` rows
