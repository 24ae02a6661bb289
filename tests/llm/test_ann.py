"""Neighbours against brute force: ties, copies, vectors that take no part, recall."""

import numpy as np

from citespan.llm import ann


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q in queries:
            near = sorted(((-float(np.dot(v, w)), i) for i, w in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_search(frame):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(700, 16)), 3).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(700)] + [(1000 + i, x[3].tolist()) for i in range(300)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [])]
    df = frame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, df.filter("vec_id % 20 = 0 OR vec_id = 3"), 20).toPandas()
    want = brute(rows, {i for i, _ in rows if i % 20 == 0 or i == 3}, 20)
    found = {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")}
    assert found.keys() == want.keys()
    assert np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / len(want[q]) for q in want]) > 0.99
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and q not in set(g.vec_id)
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(g.score, g.score[1:], g.vec_id, g.vec_id[1:]))
    assert found[3] == [i for i, _ in want[3]]


def test_few_vectors(frame):
    df = frame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 0.0)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
    one = frame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ann.search(one, one).count() == 0


def test_stripes_and_groups(frame, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1500)]
    df = frame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, {i for i in range(0, 1500, 20)}, 20)
    for shape in ((24, 1), (3, 4), (1, 5)):
        monkeypatch.setattr(ann, "grid", lambda *_, shape=shape: shape)
        answer = ann.search(df, df.filter("vec_id % 20 = 0"), 20)
        got = answer.toPandas()
        found = {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")}
        assert {q: [i for i, _ in want[q]] for q in want} == found
        assert "CartesianProduct" not in answer._jdf.queryExecution().toString()


def test_grid():
    # Few vectors: what is sent is about least; many: as many stripes as memory needs, and no vector twice.
    assert ann.grid(13, 6, 20.0, 256, 12) == (13, 1) and ann.grid(1, 1, 20.0, 256, 12) == (1, 1) and ann.grid(2, 6, 1.0, 256, 12) == (2, 6)
    stripes, groups = ann.grid(250_000, 100_000, 20.0, 256, 2000)
    assert groups == 1 and stripes * ann.STRIPE_BYTES >= 250_000 * ann.BLOCK * 256


def test_quantiser_gets_better_with_a_beam():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    books = ann.fit(x, 4, 16)
    error = lambda beam: float(((x - books.decode(books.encode(x, beam))) ** 2).sum())
    assert error(4) <= error(1) < float((x**2).sum()) / 2
