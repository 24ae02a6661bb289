"""Each registered query over its whole table, against brute force or an independent reading."""

import hashlib
import html.parser
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tables import DATA

from citespan.llm.queries import QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    read = {}

    def get(name):
        if name not in read:
            read[name] = spark.read.parquet(f"{SF}/{name}.parquet").collect()
        return read[name]

    return get


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: QUERIES[name](spark, SF).collect()


def test_op2_finds_the_passages(rows, table):
    """A pair is due if half of an item's words stand in the document word for word, and not if few do."""
    words = lambda t: re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", (t or "").lower())
    got = {(r.doc_id, r.item_id) for r in rows("op2_decontamination")}
    items = {r.item_id: words(r.text) for r in table("benchmark")}
    starts = defaultdict(set)
    for i, w in items.items():
        for at in range(len(w) - 7):
            starts[tuple(w[at : at + 8])].add((i, at))
    due, near = set(), set()
    for d in table("documents"):
        w, on = words(d.text), defaultdict(set)
        for at in range(len(w) - 7):
            for i, place in starts.get(tuple(w[at : at + 8]), ()):
                on[i, at - place] |= set(range(place, place + 8))
        for (i, _), covered in on.items():
            near.add((d.doc_id, i))
            if len(covered) >= 0.5 * len(items[i]):
                due.add((d.doc_id, i))
    assert due and due <= got <= near


class Article(html.parser.HTMLParser):
    """The texts of the blocks of the article element."""

    BLOCKS = {"h1", "p", "article", "div", "ul", "li"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.words = False, [], []

    def flush(self):
        text = " ".join("".join(self.words).split())
        if self.inside and text:
            self.parts.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.words.append(" ")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        self.words.append(data)


def test_op3_is_the_article(rows, table):
    want = []
    for r in table("pages"):
        a = Article()
        a.feed(r.html or "")
        a.close()
        text = "\n\n".join(a.parts)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, rows("op3_html"))) == sorted(want)


def test_op4_base_spans(rows, table):
    want = []
    for r in table("documents"):
        text, spans = r.text or "", []
        for kind, pattern, ok in (("assign", r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
            spans += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
        n = Counter(s.partition(":")[0] for _, _, s in spans)
        want.append((r.doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()))
    got = rows("op4_secrets")
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("crf")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_op5_counts_and_scores(rows, table):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))), None]
    docs = table("documents")
    count = Counter(w for r in docs if not held(r.doc_id) for w in words(r.text))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in rows("op5_lm")}
    assert len(got) == len(docs)
    for r in docs:
        w, g = words(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(w), sum(x in count for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    ratio = lambda flag: np.mean([got[r.doc_id].score / len(r.text.encode()) for r in docs if r.text and got[r.doc_id].held_out == flag])
    assert -math.log10(256) < ratio(True) < ratio(False) < 0  # fewer than 8 bits a byte, and fewer on what was learnt


def test_op7_pieces(rows, table):
    from citespan.llm.packing import tokenizer_path
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows("op7_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d in table("documents"):
        ids = np.array([*encode.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces.pop(d.doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert not pieces
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_op8_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.01"  # the smallest table has three bad texts among its held-out ones
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_quality"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) in (0, 1)]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.9


def test_op9_shards(rows, table):
    got = rows("op9_resharding")
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in table("documents")}
    assert len(got) == len(size)
    shards = defaultdict(list)
    for r in got:
        assert r.size == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    totals = [sum(r.size for r in s) for s in shards.values()]
    assert max(totals) - min(totals) <= 2 * max(size.values()) + sum(totals) / 8 / 128
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in table("documents")}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got)


def test_op10_recall(rows, table):
    data = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table("embeddings") if r.embedding is not None]
    ids, x = np.array([i for i, _ in data]), np.stack([v for _, v in data])
    found = defaultdict(list)
    for r in rows("op10_neighbours"):
        found[r.query_id].append(r)
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(found) == {ids[i] for i in asked}
    right = 0
    for i in asked:
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        got = sorted(found[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and all(r.score == pytest.approx(score[np.flatnonzero(ids == r.vec_id)[0]], rel=1e-12) for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        right += len({r.vec_id for r in got} & set(ids[best]))
    assert right / (20 * len(asked)) >= 0.95


def test_op11_aligns_every_document(rows, table):
    import public_tokenizers
    from test_token_alignment import direct

    from citespan.llm.token_alignment import Pair

    pair = Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = direct(pair, [(d.doc_id, d.text) for d in table("documents")])
    assert sorted((tuple(r) for r in rows("op11_alignment")), key=str) == want


@pytest.mark.parametrize("name", ["op12_ego_join", "op13_tiered_search"])
def test_new_queries_give_the_rows_of_their_sql(rows, name):
    import glob
    import os

    import duckdb

    from citespan.llm.queries import ORACLE_SQL

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = rows(name), db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert got and sorted(columns) == sorted(got[0].asDict())
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want.fetchall())
