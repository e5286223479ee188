"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector of integers and a document's
fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**32.
Sums do not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its vector. The vector has two parts: EXACT
lanes, filled by a cryptographic hash of the paragraph and its length, tell
multisets apart; NEAR lanes hold a signed count of the paragraph's runs
of words, so that the cosine of two sums estimates how much text they share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import mix64

EXACT = 32   # lanes modulo 2**32: 1024 bits
NEAR = 128   # lanes of the likeness part
RUN = 3      # words in a run
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def _exact(paragraphs: list[str]) -> np.ndarray:
    out = b"".join([hashlib.shake_128(p.encode("utf-8", "replace")).digest(4 * EXACT) for p in paragraphs])
    return np.frombuffer(out, dtype="<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)


def _near(text: str) -> np.ndarray:
    """Signed counts of the runs of RUN words inside each paragraph; a shorter paragraph is one run."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    gap = np.flatnonzero(raw <= 32)
    start = np.append(0, gap + 1)
    end = np.append(gap, len(raw))
    filled = end > start
    start, end = start[filled], end[filled]
    if not len(start):
        return np.zeros(NEAR, dtype=np.uint32)
    # hash of bytes [i, j): difference of prefix sums of a polynomial with wrapping powers, brought to power 0
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[raw] * _powers(len(raw))[:len(raw)], out=total[1:])
    word = mix64((total[end] - total[start]) * _inverse_powers(len(raw))[start])
    paragraph = np.cumsum(raw == 10)[start]
    head = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
    count = np.diff(np.append(head, len(word)))
    # words from each place to RUN places on, as far as the paragraph goes
    left = np.repeat(head + count, count) - np.arange(len(word))
    h = word.copy()
    for k in range(1, RUN):
        more = np.flatnonzero(left > k)
        h[more] = h[more] * _BASE + word[more + k]
    whole = left >= RUN
    whole[head] = True
    h = mix64(h[whole])
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    lane = (h & np.uint64(NEAR - 1)).astype(np.int64)
    return np.bincount(lane, weights=sign, minlength=NEAR).astype(np.int64).astype(np.uint32)


_tables = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _table(name: str, base: int, n: int) -> np.ndarray:
    t = _tables[name]
    if len(t) <= n:
        size = max(2 * n, 1 << 17)
        t = np.empty(size, dtype=np.uint64)
        t[0], t[1:] = 1, np.uint64(base)
        t = _tables[name] = np.cumprod(t, dtype=np.uint64)
    return t


def _powers(n: int) -> np.ndarray:
    return _table("up", int(_BASE), n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table("down", _INVERSE, n)


def fingerprint(text: str) -> np.ndarray:
    """The sum of the vectors of a text's paragraphs (lines). No text is one empty paragraph."""
    return np.concatenate([_exact(text.split("\n")), _near(text)])


def insert(state: np.ndarray, paragraphs: str) -> np.ndarray:
    """Fingerprint after adding paragraphs (joined by \\n)."""
    return state + fingerprint(paragraphs)


def delete(state: np.ndarray, paragraphs: str) -> np.ndarray:
    """Fingerprint after taking paragraphs (joined by \\n) away."""
    return state - fingerprint(paragraphs)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 from two fingerprints: 1 if equal, else the cosine of their likeness lanes, 0 where negative."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].view(np.int32).astype(np.float64) for v in (a, b))
    length = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / length))) if length else 0.0


def text_of(state: np.ndarray) -> str:
    """A fingerprint as text: base64 of the little-endian lanes."""
    return base64.b64encode(state.astype("<u4").tobytes()).decode("ascii")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_fingerprint(state: np.ndarray, text: str, following: str) -> np.ndarray:
    """Fingerprint of ``edited(text, following)`` from the fingerprint of ``text``: the paragraphs from
    the cut on are deleted, the new ones inserted."""
    cut = len(text) - len(text) // 2
    start = text.rfind("\n", 0, cut) + 1  # the paragraph in which the cut falls
    return insert(delete(state, text[start:]), text[start:cut] + following[:len(text) // 2])


def fingerprint_column(text):
    """Text column of fingerprints of a text column (null: empty)."""
    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_of(fingerprint(t or "")) for t in texts.tolist()], dtype=object)
    return run(text)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, last, doc_id): each row with the row that follows it in its bucket."""
    held = None  # bucket, id, text, state of the row that waits for its successor

    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]),
             *(pa.array(c, pa.float64()) for c in cols[5:])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        rows = []
        for bucket, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            state = fingerprint(text)
            if held is not None and held[0] == bucket:
                _, i, t, s = held
                e = edited_fingerprint(s, t, text)
                digest = hashlib.sha256(edited(t, text).encode("utf-8", "replace")).hexdigest()
                rows.append((i, len(t), digest, text_of(s), text_of(e), likeness(s, e), likeness(s, state)))
            held = None if extra else (bucket, doc_id, text, state)
        if rows:
            yield out(rows)


def neighbour_fingerprints(documents: DataFrame, buckets: int = 0) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likeness.

    Documents are in the order of doc_id; the next one of the last is the first
    (of one document, itself). Nulls count as empty texts; null ids stand before all
    others; repeated ids follow each other in the order of their texts. An empty
    table gives an empty result; other columns are not looked at.

    The order is cut at quantiles of doc_id into ranges, and inside an id that has
    more rows than two ranges at quantiles of its texts' beginnings, found on a
    bounded sample (they decide how even the ranges are, not the result). Each range is sorted
    by itself and only the first document of a range is sent twice, to the
    range before it. Texts are shuffled once. ``buckets`` (default: four per
    shuffle partition) bounds what the driver gets: one place per range, and PER_RANGE sampled beginnings.
    """
    spark = documents.sparkSession
    lowest = F.lit(-(1 << 63))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, begin = F.coalesce("doc_id", lowest), F.substring(F.coalesce("text", F.lit("")), 1, BEGINNING)
    bounds = _bounds(docs.select(key.alias("key"), begin.alias("begin")), buckets)
    # number of cuts up to the row
    cuts = (F.array(*[F.struct(F.lit(i).cast("long").alias("key"), F.lit(t).alias("begin")) for i, t in bounds]) if bounds
            else F.array().cast("array<struct<key:bigint,begin:string>>"))
    placed = docs.withColumn("bucket", F.aggregate(
        cuts, F.lit(0), lambda n, c: n + (c <= F.struct(key.alias("key"), begin.alias("begin"))).cast("int")))
    # the ranges that have rows, and where the first row of each begins: one row per range
    firsts = sorted((r["bucket"], r["first"]["key"], r["first"]["begin"]) for r in placed.groupBy("bucket").agg(
        F.min(F.struct(key.alias("key"), begin.alias("begin"))).alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    lead = spark.createDataFrame([(b, i, t, firsts[k - 1][0]) for k, (b, i, t) in enumerate(firsts)],
                                 "b int, first long, first_begin string, prior int")
    first_rows = (placed.join(F.broadcast(lead), (F.col("bucket") == F.col("b")) & (key == F.col("first"))
                              & (begin == F.col("first_begin")))
                  # of rows that begin alike, the first in order
                  .groupBy("prior").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("t"), F.first("doc_id").alias("doc_id"))
                  .select(F.col("prior").alias("bucket"), F.lit(1).alias("extra"), "doc_id", F.col("t.text").alias("text")))
    rows = placed.select("bucket", F.lit(0).alias("extra"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(first_rows)
    return (rows.repartition("bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")
            .mapInArrow(_pairs, _SCHEMA))


BEGINNING = 48   # characters of a text that tell where it stands among the texts of its id
PER_RANGE = 20   # sampled rows of ids that have many, for each range


def _bounds(places: DataFrame, buckets: int) -> list[tuple[int, str]]:
    """At most about two times ``buckets`` places (key, begin) that cut the order into ranges of like size."""
    quantiles = [k / buckets for k in range(1, buckets)]
    cuts = places.select(F.col("key").cast("double").alias("d")).approxQuantile("d", quantiles, 0.25 / buckets) if quantiles else []
    out = {(int(c), "") for c in cuts}
    # an id that fills two ranges is several quantiles in a row, give or take their error
    often = sorted({int(c) for c in cuts if cuts.count(c) > 1})
    if often:
        hot = places.filter(F.col("key").isin(often))
        sizes = {r["key"]: r["count"] for r in hot.groupBy("key").count().collect()}
        sample = hot.orderBy(F.xxhash64("begin", F.monotonically_increasing_id())).limit(PER_RANGE * buckets).collect()
        a_range = max(1, places.count() // buckets)
        for key, n in sizes.items():
            begins = sorted(r["begin"] for r in sample if r["key"] == key)
            parts = min(len(begins), n // a_range)
            out |= {(key, begins[k * len(begins) // parts]) for k in range(1, parts)}
    return sorted(out)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
