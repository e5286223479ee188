"""Vector code compression: integer product codes, nearest entries found through memoised grid cells.

A vector is cut into PARTS parts; every part is coded by the index of its
nearest codebook entry. To find it, the part's components are floored to a
coarse grid. For a cell's box, an entry whose least distance to the box is
above the largest distance of some other entry cannot be nearest to any point
inside (it is dominated). The entries that are left are computed once a cell
and kept; only they are evaluated exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELL = 32               # width of a grid cell in integer units
CACHE_BYTES = 32 << 20  # of one part's remembered cells in one task
SLICE = 1 << 20         # components worked on at a time
LIMB = 40               # bits of a partial sum's digit
LONG_MAX = (1 << 63) - 1
BROADCAST_ROWS = 100_000


def _dtype(*magnitudes: int, dim: int):
    """int64 if squared distances of values of these magnitudes fit it, else Python integers."""
    return np.int64 if dim * (sum(magnitudes) + 1) ** 2 < 1 << 62 else object


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) exactly: int64 where it fits, else an array of Python integers."""
    if not x.size or np.abs(x).max() < 2.0 ** 40:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [math.floor(v * float(SCALE)) if abs(v) < 2.0 ** 1000 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def _largest(a: np.ndarray) -> int:
    return int(max(abs(int(a.max())), abs(int(a.min())))) if a.size else 0


class CellCoder:
    """Nearest entries of one codebook (entries x dim), lower index on ties."""

    def __init__(self, book: np.ndarray, cell: int = CELL):
        self.book, self.cell = book, cell
        self.top = _largest(book)
        self.cache: dict = {}
        self.bytes = 0
        self.evaluated = 0  # exact distances so far

    def _undominated(self, cells: np.ndarray, book: np.ndarray) -> list[np.ndarray]:
        """Per cell, the entries not dominated across its box, ascending."""
        out: list[np.ndarray] = []
        for lo_row in range(0, len(cells), 512):
            some = cells[lo_row:lo_row + 512]
            near = np.zeros((len(some), len(book)), dtype=book.dtype)
            far = np.zeros_like(near)
            for j in range(some.shape[1]):
                # few coordinates occur: their distances to all entries are looked up
                seen, where = np.unique(some[:, j], return_inverse=True)
                lo = (seen * self.cell)[:, None]
                below, above = lo - book[:, j], book[:, j] - (lo + self.cell - 1)
                gap = np.maximum(np.maximum(below, above), 0)
                reach = np.maximum(np.abs(below), np.abs(above))
                near += (gap * gap)[where]
                far += (reach * reach)[where]
            for row in near <= far.min(axis=1)[:, None]:
                out.append(np.flatnonzero(row).astype(np.uint16))
        return out

    def _candidates(self, parts: np.ndarray, book: np.ndarray) -> list[np.ndarray]:
        if self.bytes > CACHE_BYTES:
            self.cache, self.bytes = {}, 0
        cells = parts // self.cell
        if cells.dtype == object:
            keys: list = list(map(tuple, cells.tolist()))
        else:
            raw, width = np.ascontiguousarray(cells).tobytes(), 8 * cells.shape[1]
            keys = [raw[i:i + width] for i in range(0, len(raw), width)]
        new: dict = {}
        for i, k in enumerate(keys):
            if k not in self.cache:
                new.setdefault(k, i)
        if new:
            for k, found in zip(new, self._undominated(cells[list(new.values())], book)):
                self.cache[k] = found
                self.bytes += len(k) * (1 if isinstance(k, bytes) else 40) + found.nbytes + 250
        return [self.cache[k] for k in keys]

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row of ``parts``."""
        kind = _dtype(_largest(parts), self.top + self.cell, dim=parts.shape[1] or 1)
        parts, book = parts.astype(kind), self.book.astype(kind)
        found = self._candidates(parts, book)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        entry, error = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=kind)
        ends = np.cumsum(counts)
        step = max(1, SLICE // (parts.shape[1] or 1))
        lo = 0
        while lo < len(parts):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + step, side="right")))
            flat = np.concatenate(found[lo:hi])
            owner = np.repeat(np.arange(lo, hi), counts[lo:hi])
            off = parts[owner] - book[flat]
            d = (off * off).sum(axis=1)
            best = np.minimum.reduceat(d, ends[lo:hi] - counts[lo:hi] - done)
            hit = np.flatnonzero(d == best[owner - lo])
            first = hit[np.unique(owner[hit], return_index=True)[1]]  # lowest index of the nearest
            entry[lo:hi], error[lo:hi] = flat[first], best
            self.evaluated += len(flat)
            lo = hi
        return entry, error


def clean_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and components (float64) of the vectors of ``dim`` finite components."""
    fits = pc.equal(pc.list_value_length(column), dim).fill_null(False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.filter(fits)).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE // dim)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


class _Sums:
    """Component sums and counts by entry of one part."""

    def __init__(self, entries: int, width: int):
        self.total: np.ndarray = np.zeros((entries, width), dtype=np.int64)
        self.count = np.zeros(entries, dtype=np.int64)
        self.reach = 0

    def add(self, entry: np.ndarray, parts: np.ndarray) -> None:
        self.reach += _largest(parts) * len(parts)
        if self.reach >= 1 << 62 and self.total.dtype != object:
            self.total = self.total.astype(object)
        order = np.argsort(entry, kind="stable")
        seen, starts, counts = np.unique(entry[order], return_index=True, return_counts=True)
        self.total[seen] += np.add.reduceat(parts[order].astype(self.total.dtype), starts, axis=0)
        self.count[seen] += counts


def _partial_sums(books: list[np.ndarray], dim: int, cell: int):
    """Arrow function: per task, the sums of the parts nearest to each entry, in digits of LIMB bits."""
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [CellCoder(b, cell) for b in books]
        sums = [_Sums(len(b), width) for b in books]
        for batch in _slices(batches, dim):
            _, x = clean_rows(batch.column(0), dim)
            if not len(x):
                continue
            v = integers(x)
            for p in range(PARTS):
                mine = v[:, p * width:(p + 1) * width]
                sums[p].add(coders[p].assign(mine)[0], mine)
        out: list[tuple] = []
        for p, s in enumerate(sums):
            for e in np.flatnonzero(s.count).tolist():
                out.append((p, e, -1, 0, int(s.count[e])))
                for j, t in enumerate(s.total[e].tolist()):
                    sign, t, digit = (-1 if t < 0 else 1), abs(t), 0
                    while t:
                        out.append((p, e, j, digit, sign * (t & ((1 << LIMB) - 1))))
                        t, digit = t >> LIMB, digit + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (
                pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                names=["part", "entry", "pos", "digit", "value"])
    return run


def _codes(books: list[np.ndarray], dim: int, cell: int):
    """Arrow function: code and error of every clean row."""
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [CellCoder(b, cell) for b in books]
        for batch in _slices(batches, dim):
            rows, x = clean_rows(batch.column(0), dim)
            if not len(rows):
                continue
            v = integers(x)
            code, error = np.zeros((len(rows), PARTS), dtype=np.uint8), np.zeros(len(rows), dtype=object)
            for p in range(PARTS):
                entry, d = coders[p].assign(v[:, p * width:(p + 1) * width])
                code[:, p] = entry
                error += d
            text = code.tobytes().hex()
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [kept.column(1), kept.column(2),
                 pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                 pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())],
                names=["row_id", "label", "code", "error"])
    return run


def _updated(books: list[np.ndarray], sums: pa.Table, width: int) -> list[np.ndarray]:
    """Entries replaced by the floored mean of their parts; unused ones stay."""
    count: dict = {}
    total: dict = {}
    for p, e, j, digit, value in zip(*(sums.column(c).to_pylist() for c in ("part", "entry", "pos", "digit", "value"))):
        if j < 0:
            count[p, e] = value
        else:
            total[p, e, j] = total.get((p, e, j), 0) + (value << (LIMB * digit))
    out = []
    for p, book in enumerate(books):
        made = [[total.get((p, e, j), 0) // count[p, e] for j in range(width)] if (p, e) in count else row
                for e, row in enumerate(book.tolist())]
        exact = np.array(made, dtype=object).reshape(len(book), width)
        out.append(exact if _largest(exact) >= 1 << 40 else exact.astype(np.int64))
    return out


def _clean(vector: str) -> str:
    return (f"{vector} is not null and size({vector}) > 0 and size({vector}) % {PARTS} = 0 and forall({vector}, "
            f"x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def train_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    cell: int = CELL, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """(dimension, one integer codebook a part) of the clean vectors; dimension 0 if there are none.

    The entries start as the vectors of the ENTRIES smallest ids (null ids
    last, ties by the vector). A round is one pass over the table that returns
    sums by entry, at most ENTRIES x dimension numbers whatever the rows.
    """
    vec = vectors.select(F.col(id_col).alias("row_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    order = [F.col("row_id").asc_nulls_last(), F.col("vec").asc()]
    clean = vec.filter(_clean("vec"))
    first = clean.orderBy(*order).limit(1).collect()
    if not first:
        return 0, []
    dim = len(first[0]["vec"])
    width = dim // PARTS
    seeds = clean.filter(F.size("vec") == dim).orderBy(*order).limit(ENTRIES).collect()
    start = integers(np.array([r["vec"] for r in seeds], dtype=np.float64).reshape(-1, dim))
    books = [start[:, p * width:(p + 1) * width] for p in range(PARTS)]
    for _ in range(rounds):
        sums = (vec.select("vec").mapInArrow(_partial_sums(books, dim, cell),
                                             "part int, entry int, pos int, digit int, value long")
                .groupBy("part", "entry", "pos", "digit").agg(F.sum("value").alias("value")))
        books = _updated(books, sums.toArrow(), width)
    return dim, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cell: int = CELL) -> DataFrame:
    """One row per clean vector: id, code, error, label_error, codebooks_sha256.

    A row goes if its vector is null or empty, holds null or non-finite
    components, or has another length than that of the smallest kept id (which
    is the smallest id of a clean vector whose length PARTS divides).
    Components are floored to integers and codebooks trained as in
    ``train_codebooks``; the arithmetic is exact at every magnitude. error is
    the squared distance to the final entries over all parts, label_error its
    sum over the rows of an equal label, nulls together; either is capped at
    2^63 - 1, the most a long holds. Rows with a null id, repeated ids and
    repeated rows are each coded; fewer than ENTRIES vectors give as many
    entries; very long vectors are worked on in slices; an empty table gives
    no rows. Other columns are not looked at, whatever their names.
    """
    spark = vectors.sparkSession
    label = vectors.schema[label_col].dataType.simpleString()
    kind = vectors.schema[id_col].dataType.simpleString()
    dim, books = train_codebooks(vectors, id_col, vector_col, cell)
    source = vectors.select(F.col(vector_col).cast("array<double>").alias("vec"), F.col(id_col).alias("row_id"),
                            F.col(label_col).alias("label"))
    schema = f"row_id {kind}, label {label}, code string, error long"
    if dim:
        coded = materialized(source.mapInArrow(_codes(books, dim, cell), schema), "vector-codes")
    else:
        coded = spark.createDataFrame([], schema)
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG_MAX).cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(total.cast("long").alias("label_error"))
    if dim and by_label.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)  # counted: at most BROADCAST_ROWS rows
    by_label = by_label.withColumnRenamed("label", "summed")
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("summed")), "left")
            .select(F.col("row_id").alias(id_col), "code", "error", "label_error",
                    F.lit(digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    """The same rounds in plain SQL (small tables: every part meets every entry)."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """p AS MATERIALIZED (SELECT vec_id, label, i AS part, e[i * len(e) // 4 + 1:(i + 1) * len(e) // 4] AS e
  FROM v, (SELECT unnest(range(4)) AS i))""",
             """c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, e
  FROM p QUALIFY entry < 256)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x,
    min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), 'k': entry}}) AS best
  FROM (SELECT p.vec_id, p.label, p.part, p.e AS x, c.entry, c.e AS y FROM p JOIN c{r} c ON p.part = c.part)
  GROUP BY vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT part, entry, list(floor(s / n) ORDER BY pos) AS e FROM (
    SELECT part, best.k AS entry, pos, sum(x[pos]) AS s, count(*) AS n
    FROM a{r}, (SELECT unnest(range(1, 17)) AS pos) GROUP BY ALL) GROUP BY part, entry)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e
  FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.entry = m.entry)""")
    steps.append(f"""coded AS MATERIALIZED (SELECT vec_id, any_value(label) AS label,
    string_agg(printf('%02x', best.k), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id)""")
    steps.append(f"""hashed AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ','
    ORDER BY part, entry)) AS h FROM c{ROUNDS})""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT h FROM hashed) AS codebooks_sha256
FROM coded
"""


OP13_SQL = _sql()
