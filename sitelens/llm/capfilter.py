"""Spherical-cap filters: near-duplicate vectors met on shared filter directions, then verified.

A filter direction joins one codeword per block of dimensions (a random
product code with BLOCKS books of WORDS words, after a random rotation), so
there are WORDS ** BLOCKS directions although only BLOCKS * WORDS are stored.
A vector passes every filter whose direction it exceeds by CAP standard
deviations; list decoding finds these block by block, dropping prefixes that
cannot reach the cap. Vectors that pass a common filter are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, materialized, sorted_groups, tile_sides, tiled
from .components import connected_components

COSINE = 0.93
BLOCKS = 3
WORDS = 24
CODES = 2          # independent rotations and books
CAP = 3.5          # of a direction's score, in standard deviations
LEAST = 6          # a vector passing fewer filters of a code takes its best ones up to this number
TILE_ROWS = 1024
SEED = 20240229


class ProductCode:
    """The books of one code for vectors of ``dim`` components (fixed by ``seed``)."""

    def __init__(self, dim: int, seed: int):
        rng = np.random.default_rng([SEED, seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.books = []
        for cut in self.cuts:
            words = rng.standard_normal((WORDS, len(cut)))
            # words of equal length, so that every direction is a unit vector
            self.books.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(len(self.cuts)))

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per block, every row's inner product with every word, scaled to unit variance of the sum."""
        turned = unit @ self.rotation * np.sqrt(unit.shape[1])
        return [turned[:, cut] @ book.T for cut, book in zip(self.cuts, self.books)]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter passed, by extending only prefixes that can still reach the cap."""
        parts = self.scores(unit)
        best = [p.max(axis=1) for p in parts]
        rest = [sum(best[k + 1:], np.zeros(len(unit))) for k in range(len(parts))]
        # the cap is lowered for rows whose LEAST-th best direction is below it
        cap = np.full(len(unit), CAP)
        for attempt in range(12):
            rows = np.arange(len(unit))
            code = np.zeros(len(unit), dtype=np.int64)
            total = np.zeros(len(unit))
            for k, p in enumerate(parts):
                s = total[:, None] + p[rows]
                i, w = np.nonzero(s + rest[k][rows][:, None] >= cap[rows][:, None])
                rows, code, total = rows[i], code[i] * WORDS + w, s[i, w]
            count = np.bincount(rows, minlength=len(unit))
            short = count < LEAST
            if not short.any():
                break
            cap[short] -= 0.25
        return rows, code


def _usable(vectors: list, wanted: list, kind) -> tuple[np.ndarray, list, list]:
    """Row numbers, unit vectors (float64) and raw vectors of those that can link with others."""
    rows, unit, raw = [], [], []
    for i, v in enumerate(vectors):
        if v is None or not wanted[i] or not len(v) or any(x is None for x in v):
            continue
        r = np.asarray(v, dtype=kind)
        x = r.astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            continue
        x = x / top  # no overflow or underflow in the norm
        rows.append(i)
        unit.append(x / np.sqrt(x @ x))
        raw.append(r)
    return np.array(rows, dtype=np.int64), unit, raw


def _prepared(element: str):
    """Arrow function: every row with its class and, if it can link, its vector's bytes and filters."""
    kind = np.float32 if element == "float" else np.float64
    codes: dict[tuple[int, int], ProductCode] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows, unit, raw = _usable(batch.column(2).to_pylist(), batch.column(1).is_valid().to_pylist(), kind)
            cls: list = [None] * n
            vec: list = [None] * n
            found: list = [None] * n
            labels = batch.column(1).to_pylist()
            dims = np.array([len(v) for v in unit], dtype=np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack([unit[i] for i in at])
                lists: list[list[int]] = [[] for _ in at]
                for c in range(CODES):
                    if (dim, c) not in codes:
                        codes[dim, c] = ProductCode(dim, c)
                    r, f = codes[dim, c].decode(x)
                    # vectors of other lengths never meet
                    f = (f * CODES + c) * (1 << 20) + dim
                    for i, j in zip(r.tolist(), f.tolist()):
                        lists[i].append(j)
                for i, k in enumerate(at.tolist()):
                    row = int(rows[k])
                    vec[row] = raw[k].tobytes()
                    cls[row] = xxhash.xxh3_128_digest(repr(labels[row]).encode() + b"|" + vec[row])
                    found[row] = sorted(lists[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(vec, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))], names=["row_id", "label", "cls", "vec", "filters"])
    return run


def _common_filter(a: list, b: list) -> int:
    """Smallest filter in both sorted lists."""
    i = j = 0
    while a[i] != b[j]:
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
    return a[i]


def _verified(element: str):
    """Arrow function: per tile, the weight of each row's links, and a row of the set that links join it to.

    A pair that shares several filters counts only at the smallest one.
    """
    kind = np.float32 if element == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["bucket", "tile"]):
            if t.num_rows < 2:
                continue
            label, filt = np.array(t.column("label").to_pylist()), t.column("filter").to_numpy()
            ids, weight = t.column("row_id").to_numpy(), t.column("weight").to_numpy()
            _, unit, _ = _usable([np.frombuffer(v, dtype=kind) for v in t.column("vec").to_pylist()],
                                 [True] * len(ids), kind)
            left, right = tile_sides(t)
            degree, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
            lists = None
            if len({len(v) for v in unit}) > 1:  # the bucket's hash joined two groups: compare each apart
                groups = [np.array([i for i, v in enumerate(unit) if len(v) == d]) for d in {len(v) for v in unit}]
            else:
                groups = [np.arange(len(ids))]
            for group in groups:
                inside = set(group.tolist())
                ls, rs = (np.array([i for i in side if i in inside], dtype=np.int64) if len(groups) > 1 else side
                          for side in (left, right))
                if not len(ls) or not len(rs):
                    continue
                u, v = np.stack([unit[i] for i in ls]), np.stack([unit[i] for i in rs])
                step = max(1, (1 << 20) // len(rs))
                for lo in range(0, len(ls), step):
                    x, y = np.nonzero(u[lo:lo + step] @ v.T >= COSINE)
                    x, y = ls[lo + x], rs[y]
                    ok = (x < y) if left is right else (x != y)
                    # a bucket is a hash of label and filter
                    ok &= (label[x] == label[y]) & (filt[x] == filt[y])
                    if ok.any() and lists is None:
                        lists = t.column("filters").to_pylist()
                    for i, j in zip(x[ok].tolist(), y[ok].tolist()):
                        if _common_filter(lists[i], lists[j]) == filt[i]:
                            degree[i] += weight[j]
                            degree[j] += weight[i]
                            forest.join(i, j)
            hit = np.flatnonzero(degree)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(degree[hit]), pa.array(ids[[forest.root(i) for i in hit]])],
                    names=["row_id", "n", "centre"])
    return run


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and their cosine, in
    double precision, is COSINE or more. n_links counts the other rows linked
    to a row, component_id is the smallest id that links reach, kept marks
    id = component_id. Vectors that are null, empty, zero, of another length
    or hold null or non-finite components, and rows with a null label, link
    with nothing. A row with a null id links with nothing and has a null
    component_id and kept = false. Repeated rows are other vectors to each
    other. An empty table gives an empty result; other columns are not looked at.

    Rows with the same label and the same components are one class, compared
    once with the size of the class as its weight. A filter's group of any size is
    dealt to tiles of pairs of blocks. Tiles return counts and stars, not pairs.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    source = vectors.select(F.col(id_col).cast("long").alias("row_id"), F.col(label_col).alias("label"),
                            F.col(vector_col).alias("vector"))
    label = source.schema["label"].dataType.simpleString()
    made = materialized(source.mapInArrow(
        _prepared(element), f"row_id long, label {label}, cls binary, vec binary, filters array<bigint>"), "cap-filters")
    reps = materialized(
        made.filter("cls is not null and row_id is not null").groupBy("cls")
        .agg(F.min(F.struct("row_id", "label", "vec", "filters")).alias("r"), F.count("*").alias("weight"))
        .select("cls", "weight", "r.*"), "cap-classes")
    postings = reps.select("row_id", "label", F.explode("filters").alias("filter")).withColumn(
        "bucket", F.xxhash64(F.col("label").cast("string"), "filter"))
    sizes = postings.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = postings.join(sizes, "bucket").join(reps.select("row_id", "weight", "vec", "filters"), "row_id")
    found = materialized(tiled(met, "bucket", "size", TILE_ROWS, "row_id").mapInArrow(
        _verified(element), "row_id long, n long, centre long"), "cap-links")
    component = connected_components(found.select(F.col("row_id").alias("a"), F.col("centre").alias("b")))
    total = found.groupBy("row_id").agg(F.sum("n").alias("n"))
    by_class = (reps.select("cls", "weight", "row_id").join(total, "row_id", "left")
                .join(component.withColumnRenamed("id", "row_id"), "row_id", "left")
                .select("cls", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "row_id").alias("component_id")))
    usable = made.select("row_id", F.when(F.col("row_id").isNotNull(), F.col("cls")).alias("cls"))
    return (usable.join(by_class, "cls", "left")
            .select(F.col("row_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "row_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
