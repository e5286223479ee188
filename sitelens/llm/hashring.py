"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES points on a ring. A text's point is a hash of its
content, so equal texts start at the same place; the row goes to the shard of
the next point clockwise, or, where that shard is full, to the next shard
clockwise that is not. A shard is full once its bytes reach the mean, so the
shards' sizes differ by a few rows at most.

"Next shard that is not full" depends on an order of the rows. Here it is
(size class, largest first; second hash of the text; hash of the id): large
texts are placed while there is room and small ones fill the rest, equal texts
follow one another. In this order a shard fills at one row, its cut, and takes
nothing after it. So one cut a shard says where every row goes. The cuts come
from sums by (range of the order, arc of the ring): only a range in which a
shard fills is looked at row by row, and a ring of s shards has at most s such.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from typing import Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

SHARDS = 8
VNODES = 32
HEX = 15  # hex digits of a hash kept: 60 bits
RANGE_ROWS = 1_000_000
ORDER = ("size_class", "priority", "id_hash", "tie")


class Ring:
    """Points of the shards 0..n-1; an arc ends at a point and has the shards in clockwise order from there."""

    def __init__(self, shards: int, vnodes: int = VNODES):
        self.shards = shards
        points = sorted((int(hashlib.md5(f"shard {s} point {v}".encode()).hexdigest()[:HEX], 16), s)
                        for s in range(shards) for v in range(vnodes))
        self.points = [p for p, _ in points]
        owners = [s for _, s in points]
        self.orders = [list(dict.fromkeys(owners[i:] + owners[:i])) for i in range(len(owners))]

    def arc(self, point: int) -> int:
        return bisect.bisect_left(self.points, point) % len(self.points)

    def arc_column(self, point: str) -> Column:
        """The arc of a column of points: the first ring point at or after it."""
        # halving over the constant points: log2(points) comparisons a row
        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo % len(self.points))
            mid = (lo + hi) // 2
            return F.when(F.col(point) <= self.points[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))
        return pick(0, len(self.points)).cast("int")


def _hash60(col: Column, start: int = 1) -> Column:
    return F.conv(F.substring(F.md5(col), start, HEX), 16, 10).cast("long")


def ring_keys(docs: DataFrame, ring: Ring, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """row_id, size, text_crc32, arc and the order's columns of every row (null text: empty), and ``keep``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(*keep, F.col(id_col).alias("row_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"), _hash60(text).alias("point"),
                        _hash60(text, HEX + 1).alias("priority"),
                        _hash60(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("id_hash"),
                        # tells equal rows apart, so that they can be split as well
                        F.monotonically_increasing_id().alias("tie"))
            .withColumn("size_class", -F.length(F.bin("size")))
            .withColumn("arc", ring.arc_column("point")).drop("point"))


class Filling:
    """Loads of the shards while rows are placed in order; remembers where each shard got full."""

    def __init__(self, ring: Ring, capacity: int):
        self.ring, self.capacity = ring, capacity
        self.loads = [0] * ring.shards
        self.cuts: list[Optional[tuple]] = [None] * ring.shards
        self._aim()

    def _aim(self) -> None:
        # a capacity of the mean leaves one shard open to the last row
        self.target = np.array([next((s for s in order if self.cuts[s] is None), order[-1]) for order in self.ring.orders])

    def sums_fit(self, arcs: dict[int, int]) -> bool:
        """Add a range's bytes by arc if no shard reaches its capacity by them."""
        add = [0] * self.ring.shards
        for arc, size in arcs.items():
            add[self.target[arc]] += size
        for s, a in enumerate(add):
            if a and self.cuts[s] is None and self.loads[s] + a >= self.capacity:
                return False
        self.loads = [a + b for a, b in zip(self.loads, add)]
        return True

    def rows(self, arc: np.ndarray, size: np.ndarray, key) -> None:
        """Place rows in order; key(i) is the order's tuple of row i."""
        lo = 0
        while lo < len(arc):
            shard = self.target[arc[lo:]]
            first = None
            for s in range(self.ring.shards):
                mine = np.flatnonzero(shard == s)
                if self.cuts[s] is not None or not len(mine):
                    continue
                reached = np.cumsum(size[lo:][mine]) + self.loads[s]
                at = int(np.searchsorted(reached, self.capacity))
                if at < len(mine) and (first is None or mine[at] < first[0]):
                    first = (int(mine[at]), s)
            end = len(shard) if first is None else first[0] + 1
            add = np.zeros(self.ring.shards, dtype=np.int64)
            np.add.at(add, shard[:end], size[lo:lo + end])
            self.loads = [a + int(b) for a, b in zip(self.loads, add)]
            if first is not None:
                self.cuts[first[1]] = key(lo + first[0])
                self._aim()
            lo += end


def _place_range(ring: Ring, capacity: int, loads: list[int], cuts: list):
    """Arrow function over one range's rows in order: the shards' loads and cuts after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling = Filling(ring, capacity)
        filling.loads, filling.cuts = list(loads), list(cuts)
        filling._aim()
        for b in batches:
            cols = [b.column(c) for c in ORDER]
            filling.rows(b.column("arc").to_numpy(), b.column("size").to_numpy(),
                         lambda i: tuple(c[i].as_py() for c in cols))
        yield pa.RecordBatch.from_pydict(
            {"shard": list(range(ring.shards)), "load": filling.loads,
             **{c: [None if k is None else k[j] for k in filling.cuts] for j, c in enumerate(ORDER)}},
            schema=pa.schema([("shard", pa.int32()), ("load", pa.int64()), ("size_class", pa.int32()),
                              *((c, pa.int64()) for c in ORDER[1:])]))
    return run


def find_cuts(keys: DataFrame, ring: Ring) -> Filling:
    """Fill the ring with the rows of ``keys`` (written, with a range column) and return loads and cuts."""
    sums: dict[int, dict[int, int]] = {}
    for r in keys.groupBy("range", "arc").agg(F.sum("size").alias("size")).toArrow().to_pylist():
        sums.setdefault(r["range"], {})[r["arc"]] = r["size"]
    total = sum(sum(v.values()) for v in sums.values())
    filling = Filling(ring, -(-total // ring.shards) if total else 1)
    for number in sorted(sums):
        if filling.sums_fit(sums[number]):
            continue
        # some shard fills here: one task reads this range, which has about RANGE_ROWS rows
        rows = (keys.filter(F.col("range") == number).select(*ORDER, "arc", "size")
                .repartition(1).sortWithinPartitions(*ORDER))
        after = rows.mapInArrow(_place_range(ring, filling.capacity, filling.loads, filling.cuts),
                                "shard int, load long, size_class int, priority long, id_hash long, tie long").collect()
        for r in after:
            filling.loads[r["shard"]] = r["load"]
            filling.cuts[r["shard"]] = None if r["priority"] is None else tuple(r[c] for c in ORDER)
        filling._aim()
    return filling


def shard_column(filling: Filling) -> Column:
    """The shard of a row by its arc and its place in the order: the first clockwise whose cut is not before it."""
    place = F.struct(*ORDER)
    full = F.array(*(F.lit(False) if cut is None else
                     place > F.struct(*(F.lit(v).cast(t).alias(c) for v, c, t in
                                        zip(cut, ORDER, ("int", "long", "long", "long"))))
                     for cut in filling.cuts))
    # most arcs share few orders
    orders = F.lit([",".join(map(str, o)) for o in filling.ring.orders])
    order = F.split(F.element_at(orders, F.col("arc") + 1), ",").cast("array<int>")
    return F.coalesce(F.element_at(F.filter(order, lambda s: ~F.get(full, s)), 1), F.element_at(order, -1))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard, then the columns ``keep``.

    The law is ``bytes``: size (UTF-8 bytes of the text and 1) adds up to
    nearly the same in every shard. slot numbers a shard's rows from 0 without
    gaps, in the order of placement, so equal texts follow one another;
    grown_shard is null. Equal texts share a shard unless a shard gets full
    among them; then the rest of them goes on clockwise. A null text counts as
    empty, a null id is an id of its own, repeated rows are placed one by one
    (which of them gets which slot is open), very long texts count as any
    other, fewer rows than shards leave shards empty, and an empty table gives
    no rows. Columns of ``docs`` are read by name only; one in ``keep`` that has
    the name of a result column is called by that name with "_" added.
    """
    ring = Ring(shards)
    taken = {"row_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "point", "arc", "range", "rank",
             "first", id_col.lower(), *ORDER}
    other: list[str] = []
    for name in keep:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        other.append(name)
    passed = [F.col(c).alias(n) for c, n in zip(keep, other)]
    narrow = ring_keys(docs, ring, id_col, text_col, tuple(passed))
    rows = docs.count()
    spark = docs.sparkSession
    ranges = max(1, -(-rows // RANGE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1000)))
    keys = materialized(narrow.repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id()), "ring-keys")
    filling = find_cuts(keys, ring)
    placed = materialized(keys.withColumn("shard", shard_column(filling)), "ring-shards")
    # slots before a range: one number a range and shard
    before = (placed.groupBy("shard", "range").agg(F.count("*").alias("n")))
    start = before.withColumn("first", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy(*ORDER)) - 1
    return (placed.withColumn("rank", within)
            .join(F.broadcast(start.select("shard", "range", "first")), ["shard", "range"])
            .select(F.col("row_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("rank")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), *other))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one Parquet folder a shard below ``path``, with its slots."""
    (assign_shards(docs, shards, id_col, text_col, tuple(c for c in docs.columns if c != id_col))
     .write.partitionBy("shard").parquet(path))


def _sql() -> str:
    """Rows placed one after another in plain SQL (a step a row: small tables)."""
    point = "('0x' || substr(md5({}), {}, 15))::BIGINT"
    return f"""
WITH RECURSIVE ring AS MATERIALIZED (
  SELECT s, {point.format("'shard ' || s || ' point ' || v", 1)} AS p
  FROM (SELECT unnest(range({SHARDS})) AS s), (SELECT unnest(range({VNODES})) AS v)),
arcs AS MATERIALIZED (SELECT p, lag(p, 1, -1) OVER (ORDER BY p) AS after FROM ring),
clockwise AS (SELECT a.p, a.after, r.s, min(CASE WHEN r.p >= a.p THEN r.p - a.p ELSE r.p - a.p + (1::BIGINT << 60) END) AS far
  FROM arcs a, ring r GROUP BY ALL),
orders AS MATERIALIZED (SELECT p, after, list(s ORDER BY far) AS o FROM clockwise GROUP BY p, after),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, t, {point.format("t", 1)} AS point, {point.format("t", 16)} AS priority,
  {point.format("coalesce(doc_id::VARCHAR, 'null')", 1)} AS id_hash FROM d),
rows AS MATERIALIZED (SELECT k.*, row_number() OVER (ORDER BY -floor(log2(size)), priority, id_hash) AS i,
  coalesce((SELECT o.o FROM orders o WHERE k.point > o.after AND k.point <= o.p),
    (SELECT o.o FROM orders o WHERE o.after = -1)) AS o FROM k),
cap AS MATERIALIZED (SELECT ceil(sum(size) / {SHARDS})::BIGINT AS c FROM rows),
step AS (
  SELECT 0::BIGINT AS i, list_transform(range({SHARDS}), lambda s: 0::BIGINT) AS loads, -1::BIGINT AS shard
  UNION ALL
  SELECT i, list_transform(loads, lambda x, j: x + CASE WHEN j = shard + 1 THEN size ELSE 0 END), shard FROM (
    SELECT r.i, s.loads, r.size, coalesce(list_filter(r.o, lambda q: s.loads[q + 1] < c.c)[1], r.o[-1])::BIGINT AS shard
    FROM step s JOIN rows r ON r.i = s.i + 1, cap c)),
crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, u: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS x
  FROM (SELECT unnest(range(256)) AS b)))
SELECT r.doc_id, r.size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(r.t)), '..'),
    lambda h: ('0x' || h)::BIGINT)), lambda v, u: xor(v >> 8, crc.t[(xor(v, u) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, s.shard::INT AS shard, row_number() OVER (PARTITION BY s.shard ORDER BY r.i) - 1 AS slot,
  NULL::INT AS grown_shard
FROM rows r JOIN step s ON r.i = s.i, crc
"""


OP11_SQL = _sql()
