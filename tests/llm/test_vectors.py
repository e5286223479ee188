"""Spherical-cap filters and connected components against brute force."""

import random

import numpy as np

from sitelens.llm import capfilter
from sitelens.llm.common import Forest
from sitelens.llm.components import connected_components


def brute(rows):
    n = len(rows)
    forest, links = Forest(n), [0] * n
    def usable(r):
        v = r[1]
        return (r[0] is not None and r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v)
                and any(v))
    for x in range(n):
        for y in range(x):
            a, b = rows[x], rows[y]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    links[x] += 1
                    links[y] += 1
                    forest.join(x, y)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[forest.root(k)] = min(r[0], low.get(forest.root(k), r[0]))
    return sorted(str((r[0], links[k], None if r[0] is None else low[forest.root(k)],
                       r[0] is not None and r[0] == low[forest.root(k)])) for k, r in enumerate(rows))


def test_links_against_all_pairs(shipped, monkeypatch):
    monkeypatch.setattr(capfilter, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 40))):
            rows.append((len(rows), (centre + 0.22 * rng.standard_normal(32)).tolist(), g % 3))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]),
             (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 32, 1), (1005, [float("nan")] + [1.0] * 31, 1),
             (1006, [None] + [1.0] * 31, 1), (1007, [], 1), (1008, [1.0, 2.0], 1), (1009, [2.0, 4.0], 1),
             (None, rows[0][1], rows[0][2]), (1010, [float("inf")] * 32, 1), (1011, [1e-30] * 32, 2), (1012, [1e30] * 32, 2)]
    df = shipped.createDataFrame([(*r, "x", 1) for r in rows],
                                 "vec_id long, embedding array<float>, label int, n_links string, cls int")
    got = capfilter.linked_vectors(df).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows)
    assert capfilter.linked_vectors(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold, the hardest ones, meet on a filter."""
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = capfilter.COSINE * a + np.sqrt(1 - capfilter.COSINE ** 2) * b

    def filters(x):
        out = [set() for _ in x]
        for c in range(capfilter.CODES):
            for i, f in zip(*(v.tolist() for v in capfilter.ProductCode(64, c).decode(x))):
                out[i].add((c, f))
        return out
    assert np.mean([bool(x & y) for x, y in zip(filters(a), filters(b))]) > 0.99


def test_list_decoding_finds_every_direction_above_the_cap():
    code = capfilter.ProductCode(12, 0)
    x = np.random.default_rng(1).standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = code.scores(x)
    rows, found = code.decode(x)
    for i in range(len(x)):
        total = (parts[0][i][:, None, None] + parts[1][i][None, :, None] + parts[2][i][None, None]).reshape(-1)
        mine = set(found[rows == i].tolist())
        assert set(np.flatnonzero(total >= capfilter.CAP).tolist()) <= mine
        assert len(mine) >= capfilter.LEAST and min(total[list(mine)]) >= sorted(total)[-len(mine)] - 1e-9


def test_components(shipped):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3), (9, None)]
    forest = Forest(6000)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            forest.join(a, b)
    nodes = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    df = shipped.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {x: forest.root(x) for x in nodes}
    assert connected_components(df.limit(0)).collect() == []
