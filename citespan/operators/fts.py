"""Ranked text search: tokens and stems, the query grammar, and BM25 over postings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import POSTINGS

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_TOKEN = re.compile(r"[^\W_]+")


# --- tokens ---------------------------------------------------------------------------------------


def fold(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


_VOWEL = "aeiou"


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    shape = "".join("v" if c in _VOWEL or (c == "y" and i and stem[i - 1] not in _VOWEL and not (stem[i - 1] == "y" and i > 1)) else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", shape))


def _vowel_in(stem: str) -> bool:
    return any(c in _VOWEL or (c == "y" and i and stem[i - 1] not in _VOWEL) for i, c in enumerate(stem))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    if len(stem) < 3:
        return False
    a, b, c = stem[-3:]
    vowel = lambda x, before: x in _VOWEL or (x == "y" and before not in _VOWEL)
    return not vowel(a, stem[-4] if len(stem) > 3 else "a") and vowel(b, a) and not vowel(c, b) and c not in "wxy"


# The stemmer's suffix tables, longest first within a step.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """Porter's stem of an ASCII word of three letters or more; other words as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha() or len(word) > 64:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel_in(w[: -len(s)])), "")
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _vowel_in(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        found = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    last = max((s for s in _STEP4 if w.endswith(s)), key=len, default="")
    if last and _measure(w[: -len(last)]) > 1 and (last != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(last)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def tokens(text: str, stemmed: bool = True) -> list[str]:
    found = _TOKEN.findall(fold(text))
    return [stem(t) for t in found] if stemmed else found


def tokenized(summaries: DataFrame, stemmed: bool = True) -> DataFrame:
    """path, tokens of summaries (path, summary); null summaries have no row.

    Unstemmed tokens need no Python: lower-cased runs of letters and digits.
    """
    rows = summaries.filter("summary IS NOT NULL").select("path", "summary")
    if not stemmed:
        return rows.select("path", F.regexp_extract_all(F.lower("summary"), F.lit(r"([\p{L}\p{N}]+)"), 1).alias("tokens"))
    import pandas as pd

    def run(s):
        return s.map(tokens)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return rows.select("path", F.pandas_udf(run, "array<string>")("summary").alias("tokens"))


def postings(summaries: DataFrame, stemmed: bool = True) -> DataFrame:
    """term, path, tf, positions, doc_length of summaries (path, summary): made at index time.

    Sorted by term and written as Parquet, a lookup of a few terms reads a few row groups.
    """
    return postings_of(tokenized(summaries, stemmed))


def postings_of(tokenized_: DataFrame) -> DataFrame:
    """The postings of path, tokens."""
    each = tokenized_.select("path", F.size("tokens").alias("doc_length"), F.posexplode("tokens").alias("at", "term"))
    return each.groupBy("term", "path", "doc_length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"))


def postings_with(summaries: DataFrame, terms: list[tuple[str, bool]], stemmed: bool = True) -> DataFrame:
    """The postings of these terms (each a term, and whether it is a prefix) alone, made in one pass over all texts
    without a shuffle.  Rows without a path, of the term '', say how many texts (doc_length) with how many tokens (tf)
    were read, those without the terms too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, words = batch.columns
            if stemmed:
                words = pa.array([tokens(t) for t in words.to_pylist()], pa.list_(pa.string()))
            values, lengths = words.flatten(), pc.list_value_length(words).to_numpy().astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            wanted = np.zeros(len(values), bool)
            for term, prefix in terms:
                wanted |= (pc.starts_with(values, term) if prefix else pc.equal(values, term)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(wanted)
            named = values.take(pa.array(at)).dictionary_encode()
            codes = named.indices.to_numpy()
            # In order of term, text and place, as a stable sort leaves texts and places in order.
            order = np.argsort(codes, kind="stable")
            at, codes = at[order], codes[order]
            # Texts without tokens begin where the next one does, which is the one that is meant.
            texts = np.searchsorted(starts, at, "right") - 1
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (texts[1:] != texts[:-1])]) if len(at) else np.zeros(0, np.int64)
            ends = np.append(first, len(at))
            columns = [
                pa.concat_arrays([named.dictionary.take(pa.array(codes[first])), pa.array([""])]),
                pa.concat_arrays([paths.take(pa.array(texts[first])), pa.array([None], pa.string())]),
                pa.array(np.append(lengths[texts[first]], len(lengths)), pa.int32()),
                pa.array(np.append(np.diff(ends), lengths.sum()), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(ends, len(at)), pa.int32()), pa.array(at - starts[texts], pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "path", "doc_length", "tf", "positions"])

    rows = summaries.filter("summary IS NOT NULL").select("path", "summary") if stemmed else tokenized(summaries, False)
    return rows.mapInArrow(run, POSTINGS)


def doc_lengths(summaries: DataFrame, stemmed: bool = True) -> DataFrame:
    """path, doc_length of all summaries, those without a token too."""
    return lengths_of(tokenized(summaries, stemmed))


def lengths_of(tokenized_: DataFrame) -> DataFrame:
    """The lengths of path, tokens."""
    return tokenized_.select("path", F.size("tokens").alias("doc_length"))


def by_term(made: DataFrame) -> DataFrame:
    """Postings dealt out and sorted by term, as an index keeps them: statistics then skip what a query doesn't ask for."""
    return made.select("term", "path", "doc_length", "tf", "positions").repartitionByRange("term", "path").sortWithinPartitions("term", "path")


# --- queries --------------------------------------------------------------------------------------


def sanitize(query: str) -> str:
    """Quote each word if the query holds signs with a meaning; a query that starts with a quote stays."""
    q = query.strip()
    if q.startswith('"') or not re.search(r"[:\-^()]", q):
        return q
    quoted = []
    for word in q.split():
        star = "*" if word.endswith("*") else ""
        quoted.append('"' + word.rstrip("*").replace('"', '""') + '"' + star if star else '"' + word.replace('"', '""') + '"')
    return " ".join(quoted)


class QueryError(ValueError):
    pass


@dataclass
class Node:
    """op: AND, OR, NOT, NEAR (of phrases, within ``distance`` tokens), or PHRASE with its tokens; the last token of a
    prefix phrase is a prefix, and a ``first`` phrase begins a text.  A NEVER phrase is in a column without tokens."""

    op: str
    parts: list[Node] = field(default_factory=list)
    tokens: tuple[str, ...] = ()
    prefix: bool = False
    first: bool = False
    distance: int = 10


#: The columns a query can name: a summary's path isn't tokenised.
COLUMNS = ("path", "summary")


def _lexed(query: str) -> list[tuple[str, str]]:
    out = []
    for m in re.finditer(r'"(?P<quoted>(?:[^"]|"")*)"|(?P<sign>[()*+^:,{}-])|(?P<word>\w+|[^\s\w"()*+^:,{}-])|(?P<bad>")', query):
        kind = m.lastgroup
        if kind == "bad" or (kind == "word" and not re.fullmatch(r"\w+", m.group())):
            raise QueryError(f'fts5: syntax error near "{m.group()}"')
        out.append((kind, m[kind].replace('""', '"') if kind == "quoted" else m[kind]))
    return out


class _Parser:
    """Reads a query by the grammar of the text index: AND, OR and NOT between lists of phrases and NEAR groups."""

    def __init__(self, query: str, stemmed: bool):
        self.lexed, self.at, self.stemmed = _lexed(query), 0, stemmed

    def peek(self, ahead: int = 0) -> tuple[str | None, str]:
        return self.lexed[self.at + ahead] if self.at + ahead < len(self.lexed) else (None, "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(("sign", sign)):
            self.wrong()

    def wrong(self, near: str | None = None) -> None:
        raise QueryError(f'fts5: syntax error near "{self.peek()[1] if near is None else near}"')

    def named(self, ahead: int = 0) -> bool:
        """Whether a word or a string stands here that is no operator."""
        kind, text = self.peek(ahead)
        return kind == "quoted" or (kind == "word" and text not in ("AND", "OR", "NOT"))

    def phrase(self) -> Node:
        words: list[str] = []
        while True:
            if not self.named():
                self.wrong()
            words += tokens(self.peek()[1], False)
            self.at += 1
            if not self.take(("sign", "+")):
                break
        prefix = self.take(("sign", "*"))
        return Node("PHRASE", tokens=tuple(stem(w) if self.stemmed else w for w in words), prefix=prefix)

    def near(self) -> Node:
        """A phrase, one that begins a text, or a group of phrases that are near each other."""
        if self.take(("sign", "^")):
            found = self.phrase()
            found.first = True
            return found
        if self.named() and self.peek(1) == ("sign", "("):
            if self.peek() != ("word", "NEAR"):
                self.wrong()
            self.at += 2
            parts, distance = [self.phrase()], 10
            while self.named():
                parts.append(self.phrase())
            if self.take(("sign", ",")):
                kind, text = self.peek()
                if kind is None or not text.isdigit():
                    raise QueryError(f'expected integer, got "{text}"')
                distance, self.at = int(text), self.at + 1
            self.need(")")
            return parts[0] if len(parts) == 1 else Node("NEAR", parts, distance=distance)
        return self.phrase()

    def columns(self) -> bool | None:
        """Whether the columns named here have tokens; None if no columns are named."""
        start, minus = self.at, self.take(("sign", "-"))
        names = []
        if self.take(("sign", "{")):
            while self.named():
                names.append(self.peek()[1])
                self.at += 1
            if not names:
                self.wrong()
            self.need("}")
        elif self.named() and (minus or self.peek(1) == ("sign", ":")):
            names.append(self.peek()[1])
            self.at += 1
        if not names:
            if minus:
                self.wrong("-")
            self.at = start
            return None
        self.need(":")
        for n in names:
            if n.lower() not in COLUMNS:
                raise QueryError(f"no such column: {n}")
        return ("summary" in {n.lower() for n in names}) != minus

    def listed(self) -> Node:
        """Phrases and groups side by side, all of which must match; or one expression in brackets."""
        parts: list[Node] = []
        while self.named() or self.peek() in (("sign", "^"), ("sign", "-"), ("sign", "{")) or (not parts and self.peek()[0]):
            seen = self.columns()
            if self.peek() == ("sign", "("):
                if parts:
                    self.wrong()
                self.at += 1
                inner = self.either()
                self.need(")")
                return inner if seen is not False else _never(inner)
            found = self.near()
            parts.append(found if seen is not False else _never(found))
        if not parts:
            self.wrong()
        return parts[0] if len(parts) == 1 else Node("AND", parts)

    def without(self) -> Node:
        left = self.listed()
        while self.take(("word", "NOT")):
            left = Node("NOT", [left, self.listed()])
        return left

    def both(self) -> Node:
        parts = [self.without()]
        while self.take(("word", "AND")):
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Node("AND", parts)

    def either(self) -> Node:
        parts = [self.both()]
        while self.take(("word", "OR")):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("OR", parts)


def _never(node: Node) -> Node:
    """The same with phrases that are found nowhere."""
    if node.op == "PHRASE":
        return Node("NEVER")
    return Node(node.op, [_never(p) for p in node.parts], distance=node.distance)


def parse_query(query: str, stemmed: bool = True) -> Node:
    """The tree of a query: words and "phrases", side by side for AND, upper-case AND, OR, NOT, brackets, a star for
    a prefix, + between parts of one phrase, ^ before a phrase that begins a text, NEAR(phrases, distance), and
    column names with a colon.  Raises QueryError for anything else."""
    parser = _Parser(query, stemmed)
    if not parser.lexed:
        raise QueryError('fts5: syntax error near ""')
    out = parser.either()
    if parser.at < len(parser.lexed):
        parser.wrong()
    return out


def ranked_phrases(node: Node, out: list[Node] | None = None) -> list[Node]:
    """The phrases that are ranked, left to right; what stands after NOT isn't."""
    out = [] if out is None else out
    if node.op in ("PHRASE", "NEVER"):
        out.append(node)
    for part in node.parts[:1] if node.op == "NOT" else node.parts:
        ranked_phrases(part, out)
    return out


def rank(made: DataFrame, lengths: DataFrame, query: str, stemmed: bool = True) -> DataFrame:
    """path, rank (BM25, best is lowest) of all matches.

    made: postings (term, path, doc_length, tf, positions), of which the query's terms' are read; lengths: of all
    texts.  A phrase without tokens matches nothing.
    """
    from .blocks import blocks_of_postings, document_frequencies, every_match, statistics

    tree = parse_query(query, stemmed)
    found = blocks_of_postings(made, tree)
    return every_match(found, tree, statistics(lengths), document_frequencies(found, tree))


def text_search(summaries: DataFrame, made: DataFrame, query: str, limit: int = 20, stemmed: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """path, summary, rank of the best matches of a user's query, sanitised first.

    made and lengths: the postings and document lengths that the index keeps; lengths are made anew if
    they aren't given.
    """
    if not query.strip():
        raise QueryError("missing 'query' argument")
    best = rank(made, doc_lengths(summaries, stemmed) if lengths is None else lengths, sanitize(query), stemmed).orderBy(F.round("rank", 9), "path").limit(limit)
    return best.join(summaries, "path").select("path", "summary", "rank").orderBy("rank", "path")
