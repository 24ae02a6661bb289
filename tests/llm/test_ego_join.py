"""Near copies of vectors against brute force: copies, chains, odd rows, dense groups, what is skipped."""

import numpy as np
import pytest

from citespan.llm import ego_join as ego


def brute(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for length in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                near[at[a]].add(at[b])
    out, seen = [], {}
    for i in near:
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        for j in group:
            seen[j] = min(rows[k][0] for k in group)
    return sorted((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]) for i in near)


def found(df):
    return sorted(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def groups(rng, n, dim, spread):
    """Vectors round a few centres, some of them copies of others or multiples of them."""
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * rng.choice(spread, n)[:, None]
    x[rng.integers(0, n, n // 10)] = x[5]
    x[rng.integers(0, n, n // 20)] = x[7] * 3
    return x


@pytest.mark.parametrize("kind,dim,block", [("float", 24, 32), ("double", 3, 16), ("float", 40, 256)])
def test_brute(frame, monkeypatch, kind, dim, block):
    monkeypatch.setattr(ego, "BLOCK", block)
    monkeypatch.setattr(ego, "HELD_BITS", 1)
    monkeypatch.setattr(ego, "PASSING_BITS", 2)
    rng = np.random.default_rng(dim)
    x = groups(rng, 1200, dim, [0.02, 0.3, 1.0])
    if kind == "float":
        x = x.astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(5000)[:1200], x)]
    got = ego.near_copies(frame([(0, v, i) for i, v in rows], f"label int, embedding array<{kind}>, vec_id long"))
    assert found(got) == brute(rows)


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.1]), (9, [1.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300]), (13, [-1.0, 0.0]), (14, [5.0]), (15, [-0.0, 3.0]), (16, [0.0, 4.0])]
    df = frame([(i, v, 1, 2) for i, v in rows] + [(None, [1.0, 0.0], 1, 2)], "vec_id long, embedding array<double>, n_links int, kept int")
    assert found(ego.near_copies(df)) == brute(rows)
    assert found(ego.near_copies(df.limit(0))) == []
    assert found(ego.near_copies(frame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>"))) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError):
        ego.near_copies(df, 0)


def test_one_vector_id_twice(frame):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]
    assert found(ego.near_copies(frame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_chain(frame):
    """A chain of vectors each linked with its neighbours only is one component."""
    angles = np.arange(60) * 0.3
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.01 * i]) for i, a in enumerate(angles[:20])]
    assert found(ego.near_copies(frame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_far_blocks_are_skipped(frame, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(64, 12)), 16, axis=0) + rng.normal(size=(1024, 12)) * 0.01
    seen = []
    cut = ego.cut
    monkeypatch.setattr(ego, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(ego.near_copies(frame(rows, "vec_id long, embedding array<double>"))) == brute(rows)
    pairs = next(d for d in seen if d.columns == ["a", "b"])
    assert pairs.count() < 64 * 65 / 2 / 3


def test_distances_only_shrink():
    rng = np.random.default_rng(5)
    x = ego.unit(rng.normal(size=(200, 30)))
    place = ego.turned(x, ego.directions(x[:50], 16))
    d = lambda v: ((v[:, None] - v[None]) ** 2).sum(axis=2)
    assert (d(place) <= d(x) + 1e-12).all()


def test_united():
    label = ego.united(np.arange(8), np.array([7, 3, 5, 1]), np.array([3, 5, 1, 4]))
    assert label.tolist() == [0, 1, 2, 1, 1, 1, 6, 1]
