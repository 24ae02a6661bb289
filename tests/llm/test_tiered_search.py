"""Ranked search against brute force: tiers, shards, ties, odd rows, blocks of items."""

import math
import random
import re

import pytest

from citespan.llm import tiered_search as ts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ts_) for d, ts_ in held if ts_]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        weights = {}
        for t in set(terms(text)):
            df = sum(t in words for _, words in held)
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for d, words in held:
            m = 100 - 50 + (50 * len(words) * n_docs) // length
            score = sum(w * ((1000000000 * words.count(t)) // (1000 * words.count(t) + 20 * m)) for t, w in weights.items())
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ärger", "日本", "ZEBRA", "it's", "a_b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words + ["nowhere"], k=rng.randint(1, 9)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("tiers", [(1, 3), (5, 20, 100), (10_000,)])
def test_brute(frame, monkeypatch, tiers):
    monkeypatch.setattr(ts, "SHARD_DOCS", 17)
    docs, items = corpus(len(tiers), 250)
    docs += docs[:30]  # repeated rows
    got = ts.search(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), 7, tiers)
    assert found(got) == brute(docs, items, 7)


def test_items_fall_through(frame, monkeypatch):
    """Common words only are proven in a lower tier than a rare word."""
    docs = [(i, "common " * (1 + i % 3) + "plain") for i in range(300)] + [(1000, "rare common"), (1001, "rare")]
    items = [(1, "rare"), (2, "common plain")]
    seen = []
    exact = ts._exact
    monkeypatch.setattr(ts, "_exact", lambda index, asked, *rest: seen.extend(asked) or exact(index, asked, *rest))
    got = ts.search(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), 2, (10, 50))
    assert found(got) == brute(docs, items, 2)
    assert [x.proven for x in seen][0] < [x.proven for x in seen][1]


def test_odd_rows(frame):
    schema = "doc_id long, text string, score int, item_id int, rank int"
    docs = [(1, None, 0, 0, 0), (2, "", 0, 0, 0), (3, " ,;- ", 0, 0, 0), (4, "x" * 200_000 + " one", 0, 0, 0), (None, "one two", 0, 0, 0), (5, "one two", 0, 0, 0), (5, "one two", 0, 0, 0), (6, "One\x00TWO", None, 0, 0), (7, "other words", 0, 0, 0)]
    items = [(1, "one"), (2, None), (3, ""), (4, "?!"), (5, "two ONE one"), (5, "two ONE one"), (6, "x" * 200_000), (None, "two")]
    df = frame(docs, schema)
    got = ts.search(df, frame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"), 3)
    assert found(got) == brute([(d[0], d[1]) for d in docs], [x for x in items if x[1]], 3)
    assert ts.search(df.limit(0), frame(items, "item_id long, text string")).count() == 0
    assert ts.search(df, frame(items, "item_id long, text string").limit(0)).count() == 0
    assert ts.search(df, frame([(1, "?")], "item_id long, text string")).count() == 0


def test_blocks_of_items(frame, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK_BYTES", 60)
    docs, items = corpus(9, 80)
    got = ts.search(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), 5, (4,))
    assert found(got) == brute(docs, items, 5)


def test_great_numbers():
    import numpy as np

    tf, n = np.array([1, 7]), np.array([3, 4_000_000_000])
    docs, length = 50_000_000_000, 10**13
    want = [(1_000_000_000 * int(t)) // (1000 * int(t) + 20 * (50 + (50 * int(x) * docs) // length)) for t, x in zip(tf, n)]
    assert ts.impacts(tf, n, docs, length).tolist() == want
