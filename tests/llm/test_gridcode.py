"""Product codes by memoised grid cells against plain nearest entries."""

import hashlib
import math

import numpy as np
import pytest

from sitelens.llm import gridcode, queries


def brute(rows):
    """Codes, errors and codebooks by the stated rounds in Python integers; rows: (id, vector, label), clean, by id."""
    vecs = [[math.floor(v * 1024) if abs(v) < 1e300 else int(v) * 1024 for v in r[1]] for r in rows]
    w = len(vecs[0]) // 4
    parts = [[v[p * w:(p + 1) * w] for v in vecs] for p in range(4)]
    books = [parts[p][:256] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for x in parts[p]:
                groups.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e
                        for k, e in enumerate(books[p])]
    best = [[near(parts[p][i], books[p]) for p in range(4)] for i in range(len(rows))]
    error = [min(sum(d for d, _ in b), 2 ** 63 - 1) for b in best]
    label = {}
    for r, e in zip(rows, error):
        label[r[2]] = min(label.get(r[2], 0) + e, 2 ** 63 - 1)
    text = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{k:02x}" for _, k in b), e, label[r[2]], text))
                  for r, b, e in zip(rows, best, error))


def coded(df, **more):
    return sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256))
                  for r in gridcode.code_vectors(df, **more).collect())


@pytest.mark.parametrize("cell", [8, 32, 4096])
def test_codes_against_plain_search(shipped, cell):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.1, 8).tolist(), int(i % 3) if i % 5 else None) for i in range(290)]
    rows += [(1000 + i, rows[i % 7][1], 1) for i in range(40)]  # copies
    rows += [(2000, [0.5] * 8, 2), (2001, [-0.5] * 8, 2)]
    odd = [(5000, None, 1), (5001, [], 1), (5002, [None] * 8, 1), (5003, [float("nan")] * 8, 1),
           (5004, [float("-inf")] * 8, 1), (5005, [1.0] * 4, 1), (5006, [1.0] * 9, 1), (-1, [1.0, 2.0, 3.0], 1)]
    df = shipped.createDataFrame([(*r, "x", 1) for r in rows + odd],
                                 "vec_id long, embedding array<double>, label int, code string, error int")
    assert coded(df, cell=cell) == brute(rows)
    assert coded(df.limit(0)) == [] and coded(df.filter("vec_id >= 5000 and vec_id < 5005")) == []


def test_magnitudes_beyond_a_long(shipped):
    rows = [(0, [1e30, -1e30, 3.0, 4.0], 1), (1, [1e30, 1e-300, 3.5, 4.0], 1), (2, [1e308, -1e308, 0.0, -0.001], None),
            (3, [-1e308, 1.0, 2.0, 3.0], None)]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert coded(df) == brute(rows)
    many = [(i, [float(i % 9) * 1e25, 1.0, -1e30, i / 7], i % 2) for i in range(300)]
    df = shipped.createDataFrame(many, "vec_id long, embedding array<double>, label int")
    assert coded(df) == brute(many)


def test_null_and_repeated_ids_are_each_coded(shipped):
    rows = [(None, [0.1] * 4, 1), (None, [0.1] * 4, 1), (3, [0.2] * 4, None), (3, [0.2] * 4, None)]
    got = gridcode.code_vectors(shipped.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert [(r.vec_id, r.error, r.label_error) for r in got.orderBy("vec_id").collect()] == [
        (None, 0, 0), (None, 0, 0), (3, 0, 0), (3, 0, 0)]


def test_dominated_entries_are_never_nearest():
    rng = np.random.default_rng(2)
    book = rng.integers(-300, 300, (256, 16))
    coder = gridcode.CellCoder(book, 32)
    x = rng.integers(-300, 300, (500, 16))
    entry, error = coder.assign(x)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (error == d.min(1)).all()
    assert coder.evaluated < 256 * len(x) // 4  # most entries are ruled out by their box
    before = coder.bytes
    coder.assign(x)
    assert coder.bytes == before  # a second pass finds every cell


def test_slices_and_a_full_cache(monkeypatch):
    x = np.random.default_rng(9).integers(-900, 900, (700, 8))
    plain = gridcode.CellCoder(x[:256]).assign(x)
    monkeypatch.setattr(gridcode, "SLICE", 64)
    monkeypatch.setattr(gridcode, "CACHE_BYTES", 1000)
    coder = gridcode.CellCoder(x[:256])
    for lo in range(0, 700, 100):
        entry, error = coder.assign(x[lo:lo + 100])
        assert (entry == plain[0][lo:lo + 100]).all() and (error == plain[1][lo:lo + 100]).all()
    assert coder.bytes < 100 * 400  # forgotten, not grown


def test_query_against_plain_search(shipped, sf_dir):
    got = queries.op13_grid_codes(shipped, sf_dir).collect()
    rows = sorted((r.vec_id, r.embedding, r.label) for r in shipped.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
