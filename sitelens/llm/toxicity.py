"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text.

A text is cut into windows at white space. Each window is compressed with the
ordinary dictionary and with two toxic ones, which hold the same ordinary
content followed by content trained on whole toxic texts, or on the words
typical of them alone, which weighs these more; toxic wording makes the
lengths shorter. Shares of windows whose saving passes several thresholds and
the mean saving, by either toxic dictionary, are calibrated to a score by
cross-fitting: each half of the labelled rows is measured with dictionaries of
the other half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple, Optional

import numpy as np
import pandas as pd
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, sampled_texts

THRESHOLD = 0.7          # score from which a text is predicted toxic
WINDOW_BYTES = 96
ORDINARY_BYTES = 128 << 10
TOXIC_BYTES = 16 << 10
TYPICAL_BYTES = 2 << 10
SAVINGS = (1, 2, 3, 4, 5, 6, 8)  # bytes
# Bounds of the labelled sample that training uses; rows are taken by a hash of the id.
SAMPLE_TOXIC = 6_000
SAMPLE_ORDINARY = 9_000
SAMPLE_TOTAL = 24_000_000  # characters of all its texts
SAMPLE_CHARS = 100_000   # longer labelled texts are not taken for training (all are scored)
# A word is typical of toxic text if its share of toxic texts is so many times that of ordinary ones.
LIFT = 30.0
LEAST_SHARE = 0.005
_cut = re.compile(rb"(?s).{1,%d}(?:\s|\Z)|.{1,%d}" % (WINDOW_BYTES, WINDOW_BYTES)).findall


class Model(NamedTuple):
    """Dictionaries' contents, weights of the features (last: intercept) and the score of an empty text."""
    ordinary: bytes
    toxic: bytes
    typical: bytes
    weights: tuple
    prior: float


def windows(text: str) -> list[bytes]:
    return _cut(text.lower().encode("utf-8", "replace"))


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=5, min_match=6, strategy=zs.STRATEGY_LAZY,
        target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(compression_params=params, dict_data=d)


def _lengths(compressor: zs.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    out = np.empty(len(parts), dtype=np.int64)
    for lo in range(0, len(parts), 50_000):
        made = compressor.multi_compress_to_buffer(parts[lo:lo + 50_000], threads=0)
        out[lo:lo + len(made)] = np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))
    return out


FEATURES = 3 + len(SAVINGS)  # of each toxic dictionary


def features(compressors: tuple, texts: list[Optional[str]]) -> np.ndarray:
    """One row per text: of each toxic dictionary savings per byte and per window, best windows, shares by saving."""
    parts: list[bytes] = []
    ends = []
    for t in texts:
        parts += windows(t or "")
        ends.append(len(parts))
    out = np.zeros((len(texts), (len(compressors) - 1) * FEATURES))
    if not parts:
        return out
    plain = _lengths(compressors[0], parts)
    size = np.fromiter(map(len, parts), np.float64, len(parts))
    for k, c in enumerate(compressors[1:]):
        saved = (plain - _lengths(c, parts)).astype(np.float64)
        made = out[:, k * FEATURES:(k + 1) * FEATURES]
        lo = 0
        for i, hi in enumerate(ends):
            if hi > lo:
                s = saved[lo:hi]
                best = np.sort(s)[::-1][:3]
                made[i, :3] = s.sum() / (size[lo:hi].sum() + 20), s.mean(), best.mean()
                made[i, 3:] = [(s >= b).mean() for b in SAVINGS]
            lo = hi
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last: intercept) by Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z / len(y) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Cut of the linear score with the largest F1."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return (z[order[k]] + low) / 2


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a zstandard dictionary; too little text to train on is its own dictionary."""
    try:
        return zs.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zs.ZstdError:
        return b" ".join(samples)[-size:]


def _dictionaries(rows: list[tuple], prior: float) -> Model:
    """Contents trained on (text, toxic) rows, without weights."""
    count = {0: Counter(), 1: Counter()}
    for t, y in rows:
        count[y].update(set(t.lower().split()))
    n = Counter(y for _, y in rows)
    typical = {w for w, c in count[1].items()
               if c >= max(3, LEAST_SHARE * n[1]) and c / n[1] > LIFT * (count[0][w] + 1) / (n[0] + 1)}
    whole = [sorted((p for t, y in rows if y == v for p in _pieces(t.lower())), key=xxhash.xxh64_intdigest)
             for v in (0, 1)]
    words = [" ".join(w for w in t.lower().split() if w in typical).encode() for t, y in rows if y == 1]
    ordinary = _trained(whole[0], ORDINARY_BYTES, 32) or b" "
    toxic = _trained(whole[1], TOXIC_BYTES, 16)
    extra = _trained([s for s in words if len(s) > 8], TYPICAL_BYTES, 16) if typical else b""
    return Model(ordinary, ordinary + toxic, ordinary + extra, (), prior)


def train(rows: list[tuple]) -> Model:
    """A model from bounded (fold, text, toxic) rows, fold 0 or another number.

    Dictionaries of each half of the rows (fold 0, the others) measure the other
    half; these features, of texts that their dictionaries have not seen, calibrate
    the weights. The model's own dictionaries are trained on all rows. Without toxic
    or without ordinary rows in either half, every score is the share of toxic
    rows (0 if there are no rows).
    """
    halves = [[(t or "", y) for f, t, y in rows if (f == 0) == first] for first in (True, False)]
    prior = sum(y for _, _, y in rows) / len(rows) if rows else 0.0
    if any(len({y for _, y in half}) < 2 for half in halves):
        return Model(b"", b"", b"", (0.0,) * (1 + 2 * FEATURES), prior)
    x = np.vstack([features(_compressors(_dictionaries(learn, prior)), [t for t, _ in check])
                   for learn, check in (halves, halves[::-1])])
    y = np.array([v for half in halves[::-1] for _, v in half], dtype=np.float64)
    w = _logistic(x, y)
    # the best cut is moved to THRESHOLD
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(x @ w[:-1] + w[-1], y)
    return _dictionaries(halves[0] + halves[1], prior)._replace(weights=tuple(w))


def _pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i:i + 200] for i in range(0, len(raw), 200)]


def _compressors(model: Model) -> tuple:
    return tuple(map(_compressor, (model.ordinary, model.toxic, model.typical)))


def fit(documents: DataFrame, labels: DataFrame, held_out: bool = True) -> Model:
    """Train on a bounded sample of the labelled documents (the bounds are this module's SAMPLE_*).

    With ``held_out``, rows whose crc32(doc_id as text) mod 3 is 1 are never
    used. Of several labels of one id the larger counts, of several texts the smallest; null ids, texts and labels are left out.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    known = (labels.filter("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .withColumn("fold", fold))
    if held_out:
        known = known.filter("fold <> 1")
    ids = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    rows = sampled_texts(documents, ids, SAMPLE_CHARS, SAMPLE_TOTAL)
    return train([(0 if r["fold"] == 0 else 1, r["text"], r["toxic"]) for r in rows])


def score(spark: SparkSession, model: Model, text):
    """Column with the score (0 to 1) of a text column; null is scored as an empty text."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m: Model = shared.value
        compressors = _compressors(m) if m.ordinary else None
        w = np.array(m.weights)
        for texts in batches:
            if compressors is None:
                yield pd.Series(np.full(len(texts), m.prior))
                continue
            out = np.empty(len(texts))
            values = texts.tolist()
            for lo in range(0, len(values), 500):
                z = features(compressors, values[lo:lo + 500]) @ w[:-1] + w[-1]
                out[lo:lo + 500] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pd.Series(out)

    return scored(text)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    Null and empty texts have no windows and get the score of zero features;
    a null id is not held out; repeated rows get equal scores; an empty table gives an
    empty result. Only text is an input of the score.
    """
    model = fit(documents, labels)
    spark = documents.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return (documents.select("doc_id", held.alias("held_out"), score(spark, model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below THRESHOLD, all columns as they are.

    A null or empty text is scored as a text without windows; null ids, repeated
    rows and texts of any length are scored like others; an empty table stays empty.
    A column named like the helper column of the score passes through.
    """
    model = fit(documents, labels)
    (name,) = fresh(documents, "toxicity")
    return (documents.withColumn(name, score(documents.sparkSession, model, F.col("text")))
            .filter(F.col(name) < THRESHOLD).drop(name))
