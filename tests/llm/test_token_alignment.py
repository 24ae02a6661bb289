"""Alignment of two tokenizers against a direct version: odd texts, batches, stripes and salts, whole texts as chunks."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import DATA

from citespan.llm import token_alignment as ta

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return ta.Pair(*PATHS)


def direct(pair, docs):
    """By byte offsets, text by text."""
    held, count, best = [], Counter(), defaultdict(int)
    for doc, text in docs:
        ids = pair.encode([text])[0] if text else None
        groups = []
        if ids:
            ends = []
            for side, sizes in zip(ids, (pair.a_bytes, pair.b_bytes)):
                at, here = 0, []
                for i in side:
                    at += len(sizes[i])
                    here.append(at)
                ends.append(here)
            both, start = sorted(set(ends[0]) & set(ends[1])), 0
            for end in both:
                groups.append([[i for i, e in zip(side, here) if start < e <= end] for side, here in zip(ids, ends)])
                start = end
        links = [(x, y) for a, b in groups for x in a for y in b]
        held.append((doc, ids or ([], []), groups, links))
        count.update(set(links))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc, (a, b), groups, links in held:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello world", " Hello  world ", "a\n\nb", "tabs\tand\r\nlines  here", "it's they've  I'LL 's", "<|endoftext|> <s> </s> <unk> x", "▁ raw mark", "a▁ b", "日本語のテキスト と 한국어", "emoji 👩‍👩‍👧 ok 🇩🇪",
    " nbsp　wide   line", "x\x1c y \x1f z", "nul \x00 here", "12345 67.89e-3", "....... ====== -----", "a" * 3000, "ab " * 500, "naïve café " * 3, "é combining", "​ zero​width", "ﬁ ligature ½", "Hello world", "﻿bom �",
]


def test_odd_texts(frame, pair):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Hello world"), (3, "  ")]
    got = ta.align(frame([(i, t, 0, "") for i, t in docs], "doc_id long, text string, n_a int, kind string"), *PATHS)
    assert found(got) == direct(pair, docs)
    assert found(ta.align(frame([], "doc_id long, text string"), *PATHS)) == []


def test_not_utf8(spark):
    df = spark.sql("SELECT CAST(1 AS BIGINT) AS doc_id, CAST(X'61ff62' AS STRING) AS text")
    assert found(ta.align(df, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_batches_stripes_and_salts(spark, frame, pair):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    want = direct(pair, docs)
    df = frame(docs, "doc_id long, text string")
    assert found(ta.align(df, *PATHS, stripe_bytes=1_600_000_000, batch_docs=7)) == want  # 9 stripes
    few = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        assert found(ta.align(df, *PATHS, stripe_bytes=2_000_000_000, batch_docs=2)) == want  # 7 stripes of 3 cells
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)


ALPHABET = st.lists(st.sampled_from([*"ab tTé1.'s \n\t  \u3000▁日ß", "\u00a0", "👍", "\x1c", "the", " the", "ing "]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_chunks_are_the_text(pair, text):
    """A text's groups are its chunks' groups."""
    known = ta.Chunks(pair)
    numbers = known.of(text)
    ids = pair.encode([text])[0] if text else None
    shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in pair.groups(*ids)) if ids else ""
    assert b";".join(known.texts[i] for i in numbers).decode() == shown


def test_whole_words_are_forgotten(pair):
    known = ta.Chunks(pair)
    said = lambda text: b";".join(known.texts[i] for i in known.of(text))
    first, other = said("one two three"), said("a▁b")
    known.forget()
    assert not known and said("three two one") and said("one two three") == first and said("a▁b") == other == b""
    known.forget()
    known.forget()
    assert said("one two three") == first


def test_quick_ids(pair):
    """Plain text has the same ids by both libraries."""
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/sf0.001/documents.parquet'").fetchall()] + [t for t in TEXTS if t]
    assert pair.quick
    for text in texts:
        assert pair.quick(text) == pair.a.encode(text, add_special_tokens=False).ids
