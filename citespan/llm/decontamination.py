"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, names (capitalised words inside a sentence) and units (after a number)
become typed placeholders.  A window of W tokens is hashed with, for each placeholder, how many tokens ago
the same value stood in the window, so equal windows are templates with the same pattern of repeats.
Items shorter than W are one window of their own length, and texts have windows of all these lengths too.

Where a sentence starts, and in copies in lower case or broken into other lines, capitals don't tell names
from other words.  So a window is hashed in up to three forms: names inside sentences as placeholders, all
capitalised words as placeholders (if half of the window's tokens stay literal), and no names at all.
Document windows are joined with benchmark windows by hash.  A document is contaminated by an item if
windows of one alignment cover enough of the item and the slots are consistent over all of them: each
value of the item stands for one value of the document, and the other way round.

Before the join, windows are looked up in a bit array of fixed size over the benchmark's hashes, so only
windows that can match are shuffled; if a huge benchmark fills the array, all are, and the join decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, cut, fresh, table
from .wordhash import DIGIT, LETTER, UPPER, classes, code_points, run_hashes, runs, word_hashes

WINDOW = 8
#: Part of an item's tokens that matched windows must cover.
COVERAGE = 0.5
#: Bits of the array over the benchmark's windows: 2**FILTER_BITS, whatever its size.
FILTER_BITS = 23

# Units of measure and of money.
_UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces gram grams kilogram kilograms ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "km/h kmh mph hz khz mhz ghz b kb mb gb tb w kw mw kwh j kj cal kcal v mv a ma pa kpa bar k c f percent degrees degree dollar dollars euro euros cent cents usd eur gbp yen rupees pesos".split()
)
_NUM, _NAME, _UNIT = 1, 2, 3
_P = np.uint64(0x100000001B3)
_TYPE_HASH = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

def _unit_hashes() -> np.ndarray:
    return np.unique(np.concatenate([word_hashes(u)[:1] for u in _UNITS if u.isalpha()]))


_unit_words: list[np.ndarray] = []


class Canonical:
    """A text's tokens: hashes with placeholders in them, types, and values of placeholders.

    Tokens are runs of letters, and numbers with points and commas inside.  A sentence starts at the
    text's start and after a full stop, exclamation or question mark or line end outside numbers.
    """

    def __init__(self, text: str | None):
        self.hashes, self.types, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
        self.wide = self.types
        p = code_points(text or "")
        if not len(p):
            return
        kind = classes(p)
        digit = (kind & DIGIT) > 0
        inner = np.flatnonzero((p == 0x2E) | (p == 0x2C))
        inner = inner[(inner > 0) & (inner < len(p) - 1)]
        inner = inner[digit[inner - 1] & digit[inner + 1]]
        number = digit.copy()
        number[inner] = True
        a, b = runs((kind & LETTER) > 0)
        c, d = runs(number)
        starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
        order = np.argsort(starts, kind="stable")
        is_number = (np.arange(len(starts)) >= len(a))[order]
        starts, ends = starts[order], ends[order]
        if not len(starts):
            return
        h = run_hashes(p, starts, ends)
        stop = (p == 0x2E) | (p == 0x21) | (p == 0x3F) | (p == 0x0A)
        stop[inner] = False
        stops = np.concatenate(([0], np.cumsum(stop)))
        first = np.concatenate(([True], stops[starts[1:]] > stops[starts[:-1]]))
        upper = np.concatenate(([0], np.cumsum((kind & UPPER) > 0)))
        types = np.zeros(len(h), np.int8)
        types[is_number] = _NUM
        types[~is_number & ~first & ((kind[starts] & UPPER) > 0) & (upper[ends] - upper[starts] == 1) & (ends - starts > 1)] = _NAME
        after = np.flatnonzero(is_number[:-1] & ~is_number[1:]) + 1
        if len(after):
            if not _unit_words:
                _unit_words.append(_unit_hashes())
            types[after[np.isin(h[after], _unit_words[0])]] = _UNIT
        capital = ~is_number & (types == 0) & ((kind[starts] & UPPER) > 0) & (ends - starts > 1)
        self._take(types, h)
        self.wide = np.where(capital, _NAME, types).astype(np.int8) if capital.any() else types

    def _take(self, types: np.ndarray, values: np.ndarray) -> None:
        self.types, self.values = types, values
        self.hashes = np.where(types > 0, _TYPE_HASH[types], values) if types.any() else values

    def _form(self, types: np.ndarray) -> Canonical:
        other = Canonical(None)
        other._take(types, self.values)
        return other

    def forms(self, size: int) -> Iterator[tuple[Canonical, np.ndarray]]:
        """(form, places of the windows of ``size`` tokens that it adds to the forms before it)."""
        n = len(self.hashes)
        if n < size:
            return

        def inside(mark: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mark)))
            return sums[size:] - sums[:-size]

        # Half of a window's tokens must be literal: placeholders alone would match any list of numbers or names.
        # A window with fewer stands for itself, with its very values.
        enough = 2 * inside(self.types == 0) >= size
        yield self, np.flatnonzero(enough)
        if not enough.all():
            yield self._form(np.zeros(n, np.int8)), np.flatnonzero(~enough)
        if self.wide is not self.types:
            at = np.flatnonzero((inside(self.wide != self.types) > 0) & (2 * inside(self.wide == 0) >= size))
            if len(at):
                yield self._form(self.wide), at
        names = self.types == _NAME
        if names.any():
            literal = np.where(names, 0, self.types).astype(np.int8)
            at = np.flatnonzero((inside(names) > 0) & (2 * inside(literal == 0) >= size))
            yield self._form(literal), at

    def windows(self, size: int = WINDOW) -> np.ndarray:
        """Hashes of all windows of ``size`` tokens; of a shorter text the one of all its tokens."""
        n = len(self.hashes)
        if not n:
            return np.zeros(0, np.uint64)
        size = min(size, n)
        # How many tokens ago the same placeholder value stood, if any.
        ago = np.zeros(n, np.int64)
        slots = np.flatnonzero(self.types)
        if len(slots):
            key = self.values[slots] ^ _TYPE_HASH[self.types[slots]]
            order = np.lexsort((slots, key))
            same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
            ago[slots[order[same]]] = slots[order[same]] - slots[order[np.flatnonzero(same) - 1]]
        count = n - size + 1
        out = np.full(count, size, np.uint64)
        repeats = ago.any()
        for k in range(size):
            part = self.hashes[k : k + count]
            if repeats:
                a = ago[k : k + count]
                part = part + np.where(a <= k, a, 0).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out = (out ^ part) * _P
            out ^= out >> np.uint64(29)
        return out

    def slots(self, at: int, size: int) -> list[tuple[int, int, int]]:
        """(type, value, place in the text) of each placeholder of a window, in order."""
        i = np.flatnonzero(self.types[at : at + size]) + at
        return [(int(t), int(v) - (1 << 63), int(p)) for t, v, p in zip(self.types[i], self.values[i], i)]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


WINDOWS = "id long, at int, hash long, n_tokens int, slots array<struct<type int, value long, place int>>"
_SCHEMA = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("n_tokens", pa.int32()), ("slots", pa.list_(pa.struct([("type", pa.int32()), ("value", pa.int64()), ("place", pa.int32())])))])


def _windows(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of all ``sizes``, each in its forms.  Without ``only``: those of an item, of one size at most its length."""
    claim("decontamination")
    for batch in batches:
        ids, ats, hashes, ns, slots = [], [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            c = Canonical(t.as_py())
            n = len(c.hashes)
            for size in sizes if only is not None else (min(sizes[0], n),) if n else ():
                for form, at in c.forms(size):
                    h = form.windows(size)[at]
                    if only is not None:
                        on = only[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                        at, h = at[on], h[on]
                    for a in at.tolist():
                        ids.append(i)
                        ats.append(a)
                        ns.append(n)
                        slots.append([{"type": t, "value": v, "place": p} for t, v, p in form.slots(a, size)])
                    hashes.append(_signed(h))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(np.concatenate(hashes)), pa.array(ns, pa.int32()), pa.array(slots, _SCHEMA.field("slots").type)], schema=_SCHEMA)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word number and 64 bits of the filter, of one partition's hashes."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        h = b.column(0).to_numpy().view(np.uint64)
        bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    words = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at].view(np.int64))], names=["word", "bits"])


def _filter(hashes: DataFrame) -> np.ndarray:
    """The bit array over all hashes; at most 2**(FILTER_BITS - 6) rows come to the driver."""
    rows = hashes.mapInArrow(_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _votes(pairs: list[tuple]) -> dict:
    """For each first value the second that it stands with most often; ties go to the smaller one."""
    counts: dict = {}
    for x, y in pairs:
        counts.setdefault(x, Counter())[y] += 1
    return {x: min(c.items(), key=lambda p: (-p[1], p[0]))[0] for x, c in counts.items()}


def judge(hits: list, n_item: int, size: int) -> tuple[int, int] | None:
    """(windows, covered tokens) of one alignment of a document and an item if it is consistent, or None.

    hits: (item_at, item slots, doc slots) of the windows with one difference of places, in any order; a slot
    is (type, value, place).  Each value of the item stands for the document's value that most of its
    places give it, and for names and units the other way round too (different numbers may well become
    equal).  Windows that contradict that in all forms in which they matched are left out.  Of the places
    whose values stand at several places, a third or more in contradiction make the alignment none.  A
    short item that is nothing but placeholders has no template to match by: its values must be the same.
    """
    size = min(size, n_item)
    windows: dict[int, list] = {}
    places: dict[int, set] = {}
    for item_at, a, b in hits:
        forms = windows.setdefault(item_at, [])
        pairs = [(x[:2], y[:2], x[2]) for x, y in zip(a, b)]
        if len(a) == len(b) and not (len(a) == size == n_item < WINDOW and any(x != y for x, y, _ in pairs)):
            forms.append(pairs)
            for x, y, place in pairs:
                places.setdefault(place, set()).add((x, y))
    found = [p for pairs in places.values() for p in pairs]
    there, back = _votes(found), _votes([(y, x) for x, y in found if y[0] != _NUM])
    agrees = lambda x, y: there[x] == y and back.get(y, x) == x
    often = Counter(x for x, _ in found), Counter(y for _, y in found)
    tied = [any(agrees(x, y) for x, y in pairs) for pairs in places.values() if any(often[0][x] > 1 or often[1][y] > 1 and y[0] != _NUM for x, y in pairs)]
    if 3 * tied.count(False) >= len(tied) > 0 and False in tied:
        return None
    covered, n, seen = 0, 0, -1
    for item_at, forms in sorted(windows.items()):
        if any(all(agrees(x, y) for x, y, _ in form) for form in forms):
            n += 1
            covered += item_at + size - max(seen, item_at)
            seen = item_at + size
    return (n, covered) if n else None


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, covered, n_tokens: pairs of a contaminated document and an item.

    docs: doc_id, text; benchmark: item_id, text.  Null and empty texts match nothing; an item shorter
    than a window is one window of its length, found in texts of any length.  Rows with a null id match nothing;
    texts under one id count as that id's.  Empty tables give no rows.

    Windows that match are grouped by document, item and difference of places (an alignment), so a group
    holds at most the item's windows, however often a document repeats the item; of a pair's alignments the
    one that covers most counts.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL").mapInArrow(lambda it: _windows(it, (size,), None), WINDOWS)
    items = cut(items.toDF("item_id", "item_at", "hash", "n_tokens", "item_slots").distinct())
    sizes = (size, *sorted(r.n_tokens for r in items.filter(F.col("n_tokens") < size).select("n_tokens").distinct().collect()))
    only = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(items.select("hash"))))
    found = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").mapInArrow(lambda it: _windows(it, sizes, np.unpackbits(only.value).astype(bool)), WINDOWS)
    found = found.toDF("doc_id", "doc_at", "hash", "doc_tokens", "doc_slots").drop("doc_tokens")
    alignment = (F.col("doc_at") - F.col("item_at")).alias("shift")
    hit = F.struct("item_at", "item_slots", "doc_slots")
    hits = found.join(items, "hash").groupBy("doc_id", "item_id", alignment).agg(F.max("n_tokens").alias("n_tokens"), F.collect_set(hit).alias("hits"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda slots: [(s["type"], s["value"], s["place"]) for s in slots]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                got = judge([(h["item_at"], pairs(h["item_slots"]), pairs(h["doc_slots"])) for h in r["hits"]], r["n_tokens"], size)
                if got and got[1] >= coverage * r["n_tokens"]:
                    rows.append((r["doc_id"], r["item_id"], got[0], got[1], r["n_tokens"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "n_windows", "covered", "n_tokens"])

    aligned = hits.mapInArrow(judged, "doc_id long, item_id long, n_windows long, covered long, n_tokens long")
    best = F.max(F.struct("covered", "n_windows", "n_tokens")).alias("best")
    return aligned.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_windows", "best.covered", "best.n_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows of contaminated documents.  Rows with a null doc_id stay."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias(fresh(docs, "bad_id"))).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[bad.columns[0]], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
