"""Which tokens of two tokenizers stand for the same bytes, in each text and over the corpus.

A text's tokens in both tokenizers are cut into groups where both have a token's end; every token of one side is
linked with every one of the other side in its group.  A pair of ids counts once for each document that
holds it linked.

Counts are dense matrices, striped by the first side's id: stripe s has the rows of the ids a with a mod
``stripes`` = s, and one column for each id of the other side.  Tasks sum the pairs of their documents before
anything is shuffled; what arrives at a stripe is added into its block with np.add.at, and the block's row
maxima are the best counts of its ids.  The links go to their stripe by the same exchange and come after the
counts there, so they are scored where the counts are; what they give is summed by document.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, table

#: Bytes of a stripe's block, at most (one row at least).
STRIPE_BYTES = 64_000_000
#: Documents and bytes of text whose links are sent together; distinct pairs a task holds before it sends counts.
BATCH_DOCS, BATCH_BYTES, HELD_PAIRS = 4096, 8_000_000, 2_000_000
#: When a worker knows so many chunks of text, it forgets those that it hasn't met since it last had so many
#: (about 400 bytes each); results don't depend on it.
KNOWN_CHUNKS = 150_000

#: Between two characters that aren't white space, a single space begins a token in both tokenizers.
_CHUNKS = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(vocabulary: dict[str, int], pieces: list[bytes], merges: list) -> dict[bytes, int] | None:
    """Bytes -> id, if each merge makes the next id after the bytes' own, so that ids say which merge comes first."""
    pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in merges)
    ordered = all(vocabulary.get(x + y) == 256 + i for i, (x, y) in enumerate(pairs))
    return {pieces[i]: i for i in range(256 + len(merges))} if ordered and all(len(p) == 1 for p in pieces[:256]) else None


#: Text in which both libraries of the byte-level tokenizer see the same letters, digits and signs.
_PLAIN = re.compile(r"[ -~À-ɏ]*")


class Pair:
    """Two tokenizers: a byte-level one (``tokenizers`` file) and a sentencepiece model, which puts a space first.

    Where the file's ids are its merges' order and it cuts words as ``tiktoken`` can, plain text goes through
    that library, which gives the same ids in a fifth of the time.
    """

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        of = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        told = json.loads(self.a.to_str())
        cut = told["pre_tokenizer"] or {}
        ranks = _ranked(self.a.get_vocab(with_added_tokens=False), self.a_bytes, told["model"].get("merges", []))
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and told["normalizer"] is None
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks and usual else None

    def a_ids(self, text: str) -> list[int]:
        if self.quick and _PLAIN.fullmatch(text):
            return self.quick(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both sides' ids of space+text for each text, None unless both give its very bytes."""
        out: list[tuple[list[int], list[int]] | None] = []
        of_a, of_b = self.a_bytes, self.b_bytes
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            spaced = " " + text
            a, raw = self.a_ids(spaced), spaced.encode()
            same = b"".join([of_a[i] for i in a]) == raw and b"".join([of_b[i] for i in b]) == raw
            out.append((a, b) if same else None)
        return out

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """The ids of each group, of two ways of cutting the same bytes."""
        out, size_a, size_b = [], self.a_sizes, self.b_sizes
        i = j = 0
        n = len(a)
        while i < n:
            x, y = [a[i]], [b[j]]
            end_a, end_b = size_a[a[i]], size_b[b[j]]
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    x.append(a[i])
                    end_a += size_a[a[i]]
                    i += 1
                else:
                    y.append(b[j])
                    end_b += size_b[b[j]]
                    j += 1
            out.append((x, y))
        return out


class Chunks(dict):
    """Number of each known chunk of text, and tables by number: tokens, groups, links, and distinct linked pairs.

    Tokens never go over a chunk's start, so a text's groups are its chunks' groups, one after the other.
    The number of a chunk that doesn't give its own bytes is -1.
    """

    def __init__(self, pair: Pair):
        self.pair, self.width = pair, len(pair.b_bytes)
        self.before: tuple = ({}, array("q"), [], array("q"), array("q"), array("q"))
        self._emptied()

    def _emptied(self) -> None:
        self.clear()
        self.sums = array("q")  # a, b, groups, links
        self.texts: list[bytes] = []
        self.keys, self.times, self.starts = array("q"), array("q"), array("q", [0])

    def forget(self) -> None:
        """Chunks that haven't been met since the last call go; the others are taken over as they are met again."""
        self.before = (dict(self), self.sums, self.texts, self.keys, self.times, self.starts)
        self._emptied()

    def _entered(self, sums: Iterable[int], text: bytes, keys: Iterable[int], times: Iterable[int]) -> int:
        self.sums.extend(sums)
        self.texts.append(text)
        self.keys.extend(keys)
        self.times.extend(times)
        self.starts.append(len(self.keys))
        return len(self.texts) - 1

    def entry(self, ids: tuple[list[int], list[int]] | None) -> int:
        if ids is None:
            return -1
        linked: dict[int, int] = {}
        links, shown, width = 0, [], self.width
        groups = self.pair.groups(*ids)
        for a, b in groups:
            n, m = len(a), len(b)
            links += n * m
            if n == 1 == m:
                x, y = a[0], b[0]
                key = x * width + y
                linked[key] = linked.get(key, 0) + 1
                shown.append(f"{x}|{y}")
                continue
            if n * m <= 64:
                for x in a:
                    for y in b:
                        key = x * width + y
                        linked[key] = linked.get(key, 0) + 1
            else:
                of_b = Counter(b)
                for x, some in Counter(a).items():
                    for y, more in of_b.items():
                        linked[x * width + y] = linked.get(x * width + y, 0) + some * more
            shown.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        return self._entered((len(ids[0]), len(ids[1]), len(groups), links), ";".join(shown).encode(), linked.keys(), linked.values())

    def _learn(self, chunks: set[str]) -> None:
        known, sums, texts, keys, times, starts = self.before
        new = []
        for chunk in chunks:
            k = known.get(chunk)
            if k is None:
                new.append(chunk)
            else:
                self[chunk] = k if k < 0 else self._entered(sums[4 * k : 4 * k + 4], texts[k], keys[starts[k] : starts[k + 1]], times[starts[k] : starts[k + 1]])
        for chunk, ids in zip(new, self.pair.encode(new)):
            self[chunk] = self.entry(ids)

    def of(self, text: str) -> list[int]:
        """The numbers that a text is made of; none if it has no tokens."""
        if not text:
            return []
        chunks = _CHUNKS.split(text)
        numbers = list(map(self.get, chunks))
        if None in numbers:
            self._learn({c for c, n in zip(chunks, numbers) if n is None})
            numbers = [self[c] for c in chunks]
        if min(numbers) < 0:  # a chunk's bytes are lost: the whole text decides
            whole = self.entry(self.pair.encode([text])[0])
            return [] if whole < 0 else [whole]
        return numbers


_loaded: dict[tuple[str, str], Chunks] = {}

_ROW = "cell int, kind int, batch long, rows binary, columns binary, places binary, numbers binary"
#: In order: counts, links, and documents' own columns.
COUNTS, LINKS, DOCS = 0, 1, 2


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, in as few bytes as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=[c.split()[0] for c in _ROW.split(", ")])


class _Sender:
    """Turns a task's documents into rows for the stripes' cells."""

    def __init__(self, chunks: Chunks, stripes: int, salts: int, batch_docs: int, task: int):
        self.chunks, self.stripes, self.salts, self.batch_docs = chunks, stripes, salts, batch_docs
        self.rows = -(-len(chunks.pair.a_bytes) // stripes)
        self.batch = task << 32
        self.ids: list[int | None] = []
        self.numbers, self.ends, self.digests, self.size = array("q"), [0], [], 0
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, doc: int | None, text: str) -> None:
        numbers = self.chunks.of(text)
        self.ids.append(doc)
        self.numbers.extend(numbers)
        self.ends.append(len(self.numbers))
        texts = self.chunks.texts
        self.digests.append(hashlib.sha256(b";".join([texts[i] for i in numbers])).hexdigest() if numbers else "")
        self.size += len(text)

    def full(self) -> bool:
        return len(self.ids) >= self.batch_docs or self.size >= BATCH_BYTES

    def links(self) -> list[tuple]:
        """The rows of the documents since the last call."""
        if not self.ids:
            return []
        n, known = len(self.ids), self.chunks
        numbers = np.frombuffer(self.numbers, np.int64) if len(self.numbers) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), np.diff(self.ends))
        width = max(1, len(known.texts))
        # Distinct chunks of each document, then their pairs, then distinct pairs of each document by stripe.
        own, times = np.unique(doc * width + numbers, return_counts=True)
        sums = np.frombuffer(known.sums, np.int64).reshape(-1, 4) if known.sums else np.zeros((1, 4), np.int64)
        totals = np.zeros((n, 4), np.int64)
        np.add.at(totals, own // width, sums[own % width] * times[:, None])
        starts = np.frombuffer(known.starts, np.int64)
        first, long = starts[own % width], np.diff(starts)[own % width] if len(own) else np.zeros(0, np.int64)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(long)[:-1]]) if len(own) else first, long) + np.arange(long.sum())
        key = np.frombuffer(known.keys, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        mult = np.repeat(times, long) * (np.frombuffer(known.times, np.int64)[at] if len(at) else np.zeros(0, np.int64))
        a, b = key // known.width, key % known.width
        key = ((a % self.stripes) * self.rows + a // self.stripes) * known.width + b
        both = key * n + np.repeat(own // width, long)
        order = np.argsort(both)
        both = both[order]
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        mult = np.add.reduceat(mult[order], new) if len(new) else new
        both = both[new]
        key, place = both // n, both % n
        distinct, runs = np.unique(key, return_counts=True)
        self.counted.append((distinct, runs))
        self.held += len(distinct)
        out = []
        stripe = key // (self.rows * known.width)
        cuts = np.searchsorted(stripe, np.arange(self.stripes + 1))
        salt = self.batch % self.salts
        for s in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[s], cuts[s + 1])
            local = key[here] - s * self.rows * known.width
            out.append((int(s) * self.salts + salt, LINKS, self.batch, _packed(local // known.width), _packed(local % known.width), _packed(place[here]), _packed(mult[here])))
        named = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        out.append((self.batch % (self.stripes * self.salts), DOCS, self.batch, ids.tobytes(), named.tobytes(), totals.tobytes(), "\n".join(self.digests).encode()))
        self.batch += 1
        self.ids, self.numbers, self.ends, self.digests, self.size = [], array("q"), [0], [], 0
        if len(known.texts) >= KNOWN_CHUNKS:
            known.forget()
        return out

    def counts(self) -> list[tuple]:
        """The rows of what has been counted since the last call; each goes to all cells of its stripe."""
        if not self.counted:
            return []
        keys, at = np.unique(np.concatenate([k for k, _ in self.counted]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in self.counted]))
        self.counted, self.held = [], 0
        width, out = self.chunks.width, []
        cuts = np.searchsorted(keys // (self.rows * width), np.arange(self.stripes + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[s], cuts[s + 1])
            local = keys[here] - s * self.rows * width
            packed = _packed(local // width), _packed(local % width), b"", _packed(n[here])
            out += [(int(s) * self.salts + salt, COUNTS, 0, *packed) for salt in range(self.salts)]
        return out


def _send(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], stripes: int, salts: int, batch_docs: int) -> Iterator[pa.RecordBatch]:
    claim("alignment", _loaded.clear)
    if paths not in _loaded:
        _loaded[paths] = Chunks(Pair(*paths))
    sender = _Sender(_loaded[paths], stripes, salts, batch_docs, TaskContext.get().partitionId())
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            try:
                sender.add(doc, text.as_buffer().to_pybytes().decode() if text.is_valid else "")
            except UnicodeDecodeError:
                sender.add(doc, "")
            if sender.full():
                yield _emitted(sender.links())
            if sender.held >= HELD_PAIRS:
                yield _emitted(sender.counts())
    yield _emitted(sender.links())
    yield _emitted(sender.counts())


def _score(batches: Iterator[pa.RecordBatch], rows: int, width: int) -> Iterator[pa.RecordBatch]:
    """The cells of a task, one after the other: counts first, then what is scored by them."""
    cell, block, best = None, None, None
    for batch in batches:
        out = []
        for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            if r["kind"] == DOCS:
                out.append((0, DOCS, r["batch"], r["rows"], r["columns"], r["places"], r["numbers"]))
                continue
            if r["cell"] != cell:
                cell, block, best = r["cell"], None, None
                block = np.zeros((rows, width), np.int64)
            at = _unpacked(r["rows"]), _unpacked(r["columns"])
            if r["kind"] == COUNTS:
                np.add.at(block, at, _unpacked(r["numbers"]))
                continue
            if best is None:
                best = block.max(axis=1)
            place, times, count = _unpacked(r["places"]), _unpacked(r["numbers"]), block[at]
            docs, place = np.unique(place, return_inverse=True)
            hits, sums = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(hits, place, np.where(count == best[at[0]], times, 0))
            np.add.at(sums, place, times * count)
            out.append((0, LINKS, r["batch"], _packed(docs), _packed(hits), b"", _packed(sums)))
        yield _emitted(out)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each batch, after what its links gave in every stripe."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            if r["kind"] == LINKS:
                at = _unpacked(r["rows"])
                held = sums.setdefault(r["batch"], np.zeros((0, 2), np.int64))
                if len(at) and at[-1] >= len(held):
                    held = sums[r["batch"]] = np.concatenate([held, np.zeros((int(at[-1]) + 1 - len(held), 2), np.int64)])
                held[at] += np.stack([_unpacked(r["columns"]), _unpacked(r["numbers"])], axis=1)
                continue
            ids, totals = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["places"], np.int64).reshape(-1, 4)
            scored = np.zeros((len(ids), 2), np.int64)
            held = sums.pop(r["batch"], scored[:0])
            scored[: len(held)] = held
            columns = [pa.array(ids, mask=np.frombuffer(r["columns"], np.uint8) == 0)] + [pa.array(np.ascontiguousarray(c)) for c in (*totals.T, *scored.T)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(r["numbers"].decode().split("\n"))], names=[c.split()[0] for c in _RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, stripe_bytes: int = STRIPE_BYTES, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    a_path: a byte-level tokenizer's file; b_path: a sentencepiece model that puts a space first and changes
    nothing else; both encode space+text, without special tokens.  A text that is null, empty, not UTF-8, or whose
    tokens don't give its bytes back has no tokens: zeros and an empty groups_sha256.  Each row is a document of
    its own: one that stands twice counts twice in the pairs' counts; a null doc_id stays null.  Other columns
    aren't read.

    A stripe's block is at most stripe_bytes, whatever the corpus; where there are more shuffle partitions than
    stripes, a stripe has several cells, each of which gets all counts and its share of the links.  A task holds
    a block, one batch's links and the chunks it knows; texts are tokenised once.
    """
    spark = docs.sparkSession
    pair = Pair(a_path, b_path)
    n_a, width = len(pair.a_bytes), len(pair.b_bytes)
    stripes = min(n_a, max(1, -(-n_a // max(1, stripe_bytes // (8 * width)))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = -(-tasks // stripes)
    rows = -(-n_a // stripes)
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _send(it, (a_path, b_path), stripes, salts, batch_docs), _ROW)
    # Neighbouring cells to different tasks, each about as many.
    cells = sent.repartitionById(min(tasks, stripes * salts), F.pmod("cell", F.lit(min(tasks, stripes * salts)))).sortWithinPartitions("cell", "kind")
    scored = cells.mapInArrow(lambda it: _score(it, rows, width), _ROW)
    return scored.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_summed, _RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the sentencepiece tokenizer."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
