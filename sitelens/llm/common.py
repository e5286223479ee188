"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Yield one table per run of equal key values of rows sorted by ``keys``.

    A run may cross batches; only the current run is held. Keys are non-null
    integer columns.
    """
    pending: list[pa.RecordBatch] = []
    last: Optional[tuple] = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(c[lo] for c in cols)
            if pending and key != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(lo, hi - lo))
            last = key
    if pending:
        yield pa.Table.from_batches(pending)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use yet."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


LONG_KEY = 1024  # characters of a text that a cache does not keep


class ByteCache(dict):
    """What ``make`` gives for a text, kept while the estimated size of all is within ``most_bytes``.

    Long texts are made anew each time. ``trim`` empties a cache that has grown beyond its bound; it is
    called between documents, so entries that a document relies on stay while it is worked on.
    """

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most_bytes, self.bytes = most_bytes, 0

    def make(self, key: str):
        raise NotImplementedError

    def size(self, value) -> int:
        return 32

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= LONG_KEY:
            self[key] = value
            self.bytes += 200 + 2 * len(key) + self.size(value)
        return value

    def trim(self) -> bool:
        if self.bytes <= self.most_bytes:
            return False
        self.drop()
        return True

    def drop(self) -> None:
        """Empty the cache; at a task's end, since the next task of the worker may be another operator's."""
        self.clear()
        self.bytes = 0


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if x and y were apart."""
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


    def stars(self) -> tuple[list[int], list[int]]:
        """Pairs (smallest member, other member) of every set of two or more."""
        roots = [self.root(x) for x in range(len(self.up))]
        pairs = [(r, x) for x, r in enumerate(roots) if r != x]
        return [r for r, _ in pairs], [x for _, x in pairs]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (finalizer with public constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks_of(size_col: str, block_rows: int, id_col: str) -> tuple[str, str, str]:
    """Columns that deal the rows of a group of any size to tiles of bounded size.

    A group of n rows has b = ceil(n / block_rows) blocks; a row's block is a
    hash of its id, and every pair of blocks (i <= j) is one tile, so each pair
    of rows meets in exactly one tile (pairs of one block in tile (i, i)).
    Returns (b, block, array of tile numbers) as SQL expressions.
    """
    b = f"cast(ceil({size_col} / {block_rows}) as bigint)"
    block = f"pmod(xxhash64({id_col}), {b})"
    tiles = f"transform(sequence(0L, {b} - 1), j -> least({block}, j) * {b} + greatest({block}, j))"
    return b, block, tiles


def tiled(df: DataFrame, group: str, size: str, block_rows: int, id_col: str) -> DataFrame:
    """``df`` dealt to tiles of bounded size, the rows of a tile together and sorted by id."""
    b, block, tiles = blocks_of(size, block_rows, id_col)
    return (df.withColumn("blocks", F.expr(b)).withColumn("block", F.expr(block))
            .withColumn("tile", F.explode(F.expr(tiles)))
            .repartition(group, "tile").sortWithinPartitions(group, "tile", id_col))


def tile_sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tile's two blocks; both are all rows where a block meets itself."""
    i, j = divmod(t.column("tile")[0].as_py(), t.column("blocks")[0].as_py())
    rows, block = np.arange(t.num_rows), t.column("block").to_numpy()
    return (rows, rows) if i == j else (rows[block == i], rows[block == j])


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to a new folder below spark.checkpoint.dir and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    ship_package(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled_texts(documents: DataFrame, ids: DataFrame, most_chars: int, total_chars: int) -> list:
    """Rows of ``ids`` (one per doc_id, a bounded number) with the smallest text of each id, sorted by doc_id.

    However many rows an id has, one leaves the executors. Texts of more than ``most_chars`` characters are
    not taken; by a hash of the id, texts are taken as long as they have ``total_chars`` characters in all.
    """
    # ids has a bounded number of rows: a proven bound for the broadcast
    found = materialized(documents.select("doc_id", "text").filter(F.length("text") <= most_chars)
                         .join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text")),
                         "labelled-sample")
    order = F.xxhash64("doc_id")
    sizes = sorted((r["h"], r["doc_id"], r["n"])
                   for r in found.select(order.alias("h"), "doc_id", F.length("text").alias("n")).collect())
    total = 0
    for h, i, n in sizes:
        total += n
        if total > total_chars:
            found = found.filter((order < F.lit(h)) | ((order == F.lit(h)) & (F.col("doc_id") < F.lit(i))))
            break
    return sorted(found.collect(), key=lambda r: r["doc_id"])
