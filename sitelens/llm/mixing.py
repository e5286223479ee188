"""Mixing to target weights: soft domain memberships, and document rates by projected gradient.

A classifier trained on the labelled table (hashed words and the shape of the text) gives every document posterior
probabilities of the domains. With n the tokens and p the posteriors of a
document, rates r >= L (0, or 1 where no document may go) are sought that minimise

    sum over domains (sum(r n p) - T)^2 / (2 S D)  +  RIDGE / 2 sum(n (r - 1)^2)

where T are the target tokens and D the present tokens of a domain, and S the
tokens of all documents: expected domain totals near their targets, with rates near 1
where the targets leave a choice. Every step is one distributed sum over the
documents, and the step

    r <- max(L, r - ETA (p . (sum(r n p) - T) / D + RIDGE (r - 1)))

is the projected gradient scaled by n, which keeps the same minimum; the scaled
curvature is a stochastic matrix plus RIDGE, so ETA < 2 / (1 + RIDGE) converges.
A rate depends on p and on the gaps of earlier steps only; it is recomputed from the
short list of these, and written down every KEEP steps.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator
from typing import NamedTuple, Optional

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, materialized, sampled_texts

RIDGE = 0.001
ETA = 0.95
STEPS = 100          # most steps; ends earlier when totals are met or stay
KEEP = 10
MET = 0.01           # gap of a domain's total, relative to its target, that counts as none
STILL = 5e-4         # change of a domain's total in a step, relative to its target, that counts as none
# Bound of the labelled sample that trains the classifier; rows are taken by a hash of the id.
SAMPLE = 12_000
SAMPLE_CHARS = 100_000
SAMPLE_TOTAL = 16_000_000  # characters of all its texts


_log = logging.getLogger(__name__)


class Classifier(NamedTuple):
    """Softmax over standardised features; the last weight of a domain is its intercept."""
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    domains: tuple
    evidence: Optional[np.ndarray] = None  # of word buckets by domain


# Byte classes whose shares are features.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*", b"!?|", b"0123456789", b" \t", b"\n", b".,;:", bytes(range(128, 256)))
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _MEMBER[list(_chars), _k] = 1.0


def text_features(text: str) -> tuple[int, np.ndarray, set]:
    """Number of words (the tokens that are mixed), the shape of a text, and its different words."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    shares = np.bincount(raw, minlength=256) @ _MEMBER / max(1, len(raw))
    words, lines = text.lower().split(), text.split("\n")
    n, different = len(words), set(words)
    return n, np.array([*shares, np.log1p(len(raw)), len(raw) / max(1, n), len(different) / max(1, n),
                        len(set(lines)) / max(1, len(lines))]), different


BUCKETS = 1 << 17   # of hashed words
LEAST_TEXTS = 5     # a bucket counts from so many labelled texts on
STRONG = 2.0        # evidence of a word that counts by itself


class Looked(NamedTuple):
    """What the classifier needs of some texts: words, shapes, and the buckets of each text's different words, text
    after text, with the places where they begin (and the end)."""
    n: list
    shape: np.ndarray
    found: np.ndarray
    begins: np.ndarray

    def part(self, rows: np.ndarray) -> "Looked":
        """Some of the texts, by a mask."""
        sizes = np.diff(self.begins)
        return Looked([n for n, k in zip(self.n, rows) if k], self.shape[rows], self.found[np.repeat(rows, sizes)],
                      np.cumsum(np.append(0, sizes[rows])))


def look(texts: list) -> Looked:
    """Some texts at a time, so that the words of a few are in memory together (null: an empty text)."""
    n, shape, found, sizes = [], [], [], [0]
    for lo in range(0, len(texts), 200):
        made = [text_features(t or "") for t in texts[lo:lo + 200]]
        n += [k for k, _, _ in made]
        shape += [x for _, x, _ in made]
        sizes += [len(w) for _, _, w in made]
        flat = list(itertools.chain.from_iterable(w for _, _, w in made))
        if flat:
            hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
            found.append((hashes % np.uint64(BUCKETS)).astype(np.int32))
    return Looked(n, np.array(shape), np.concatenate(found or [np.zeros(0, np.int32)]), np.cumsum(sizes))


def word_evidence(texts: Looked, y: np.ndarray, n_domains: int) -> np.ndarray:
    """Per bucket and domain, the log of how much more often the domain's texts hold it than the others do."""
    of = np.repeat(y, np.diff(texts.begins))
    count = np.stack([np.bincount(texts.found[of == d], minlength=BUCKETS) for d in range(n_domains)], axis=1).astype(np.float64)
    n = np.bincount(y, minlength=n_domains)
    every = count.sum(1, keepdims=True)
    odds = (np.log((count + 0.5) / (n + 1)) - np.log((every - count + 0.5) / (n.sum() - n + 1)))
    return np.where(every >= LEAST_TEXTS, np.clip(odds, -4, 4), 0.0).astype(np.float32)


def features_of(texts: Looked, evidence: np.ndarray) -> np.ndarray:
    """Per text its shape and, per domain, the evidence of all its words, of the strongest one, and the number of strong ones."""
    n = np.diff(texts.begins)
    out = np.zeros((len(n), 3 * evidence.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        e, starts = evidence[texts.found], texts.begins[:-1][some]
        out[some] = np.hstack([np.add.reduceat(e, starts, axis=0) / np.sqrt(n[some])[:, None],
                               np.maximum.reduceat(e, starts, axis=0),
                               np.log1p(np.add.reduceat((e > STRONG).astype(np.float32), starts, axis=0))])
    return np.hstack([texts.shape, out])


def _train(x: np.ndarray, y: np.ndarray, domains: tuple, ridge: float = 1e-3) -> Classifier:
    """Softmax regression by gradient steps with momentum on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    hot = np.eye(len(domains))[y]
    w = np.zeros((len(domains), z.shape[1]))
    v = np.zeros_like(w)
    for _ in range(400):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v - 0.3 * ((p - hot).T @ z / len(z) + ridge * w)
        w += v
    return Classifier(w, mean, scale, domains)


def train_classifier(rows: list[tuple[str, str]]) -> Optional[Classifier]:
    """From (domain, text) rows: word evidence of each half of the rows makes features of the other half, so the
    weights are fitted on texts that the evidence has not seen; the model's own evidence comes from all rows."""
    names = tuple(sorted({d for d, _ in rows}))
    place = {d: k for k, d in enumerate(names)}
    y = np.array([place[d] for d, _ in rows])
    texts = look([t for _, t in rows])
    half = np.arange(len(rows)) % 2 == 0
    x = np.zeros((len(rows), texts.shape.shape[1] + 3 * len(names)))
    for learn, measure in ((half, ~half), (~half, half)):
        if measure.any():
            x[measure] = features_of(texts.part(measure), word_evidence(texts.part(learn), y[learn], len(names)))
    model = _train(x, y, names)
    return model and model._replace(evidence=word_evidence(texts, y, len(names)))


def fit_classifier(documents: DataFrame, labels: DataFrame, domain: list[str]) -> Optional[Classifier]:
    """Train on at most SAMPLE labelled documents; None if no domain is labelled.

    A domain is a combination of values of the label columns ``domain``, joined by |. Labels
    with nulls are left out; of several labels or texts of one id the smallest counts.
    """
    known = (labels.dropna(subset=["doc_id", *domain]).groupBy("doc_id")
             .agg(F.min(F.array_join(F.array(*[F.col(c).cast("string") for c in domain]), "|")).alias("domain"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = sorted((r["domain"], r["text"]) for r in sampled_texts(documents, known, SAMPLE_CHARS, SAMPLE_TOTAL))
    if not rows:
        return None
    return train_classifier(rows)


def membership(spark: SparkSession, text: Column, model: Optional[Classifier]) -> Column:
    """Struct column with n_tokens and p, the domains' posterior probabilities (null: an empty text).

    Without a model there is one domain.
    """
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("n_tokens long, p array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            if not len(texts):
                yield pd.DataFrame({"n_tokens": pd.Series([], dtype="int64"), "p": pd.Series([], dtype=object)})
                continue
            counts, posteriors = [], []
            values = texts.tolist()
            for lo in range(0, len(values), 1000):
                looked = look(values[lo:lo + 1000])
                if m is None:
                    p = np.ones((len(looked.n), 1))
                else:
                    s = (features_of(looked, m.evidence) - m.mean) / m.scale @ m.weights[:, :-1].T + m.weights[:, -1]
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                counts += looked.n
                posteriors += list(p)
            yield pd.DataFrame({"n_tokens": counts, "p": posteriors})

    return run(text)


def _rate(p: Column, gaps: list[list[float]], start: Optional[Column] = None, least: float = 0.0) -> Column:
    """A document's rate, ``least`` or more, after the steps with the given gaps, from ``start`` (1)."""
    start = F.lit(1.0) if start is None else start
    if not gaps:
        return start
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in gaps])

    def step(r: Column, g: Column) -> Column:
        slope = F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(F.lit(least), r - F.lit(ETA) * (slope + F.lit(RIDGE) * (r - 1)))
    return F.aggregate(steps, start, step)


def _shares(scored: DataFrame, rate: Column, k: int) -> tuple[float, np.ndarray]:
    """Tokens of all documents, and expected tokens per domain over them."""
    w = F.col("n_tokens") * rate
    r = scored.agg(F.sum("n_tokens").alias("s"), *[F.sum(w * F.col("p")[i]).alias(f"d{i}") for i in range(k)]).first()
    size = float(r["s"] or 0)
    return size, np.array([float(r[f"d{i}"] or 0) for i in range(k)]) / max(size, 1.0)


def fit_rates(scored: DataFrame, weights: dict[str, float], domains: tuple, never_drop: bool) -> list[list[float]]:
    """Gaps of all steps for ``scored`` (n_tokens, p).

    Target shares are the ``weights`` of the known domains, scaled to 1 (domains without a weight
    keep their share of what is there). With ``never_drop`` targets are scaled up until no domain
    has to give tokens away, and rates are 1 or more, so mixing only repeats documents.

    The steps end when all totals are within MET of their targets or, where RIDGE and the least
    rate keep them off, when no total moves by STILL. Targets missed, steps that ran out and
    weights of domains that the classifier does not know are logged as warnings.
    """
    least = 1.0 if never_drop else 0.0
    size, natural = _shares(scored, F.lit(1.0), len(domains))
    if not size:
        return []
    target = np.array([weights.get(d, s) for d, s in zip(domains, natural)], dtype=np.float64)
    target /= max(target.sum(), 1e-12)
    if never_drop:
        target *= max(s / t for s, t in zip(natural, target) if t > 0)
    floor = np.maximum(natural, 1e-6)
    gaps: list[list[float]] = []
    kept, since, share = scored.withColumn("r", F.lit(1.0)), 0, natural
    for k in range(STEPS):
        gaps.append(((share - target) / floor).tolist())
        if k and k % KEEP == 0:
            kept = materialized(kept.withColumn("r", _rate(F.col("p"), gaps[since:-1], F.col("r"), least)), "mixing-rates")
            since = len(gaps) - 1
        last = share
        _, share = _shares(kept, _rate(F.col("p"), gaps[since:], F.col("r"), least), len(domains))
        wanted = np.maximum(target, 1e-6)
        met = (np.abs(share - target) <= MET * wanted).all()
        if met or (np.abs(share - last) <= STILL * wanted).all():
            break
    else:
        _log.warning("mixing: totals still move after %d steps", STEPS)
    if not met:
        _log.warning("mixing: reached and target shares: %s",
                     ", ".join(f"{d} {s:.4f} of {t:.4f}" for d, s, t in zip(domains, share, target)))
    if unknown := sorted(set(weights) - set(domains)):
        _log.warning("mixing: no labelled document in the sample for the weights of %s", ", ".join(unknown))
    return gaps


def mixing_rates(documents: DataFrame, labels: DataFrame, weights: dict[str, float], domain: list[str]) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (the likeliest), posterior (its), rate (>= 0).

    Tokens are words. Null and empty texts have no tokens and get the rate that their posteriors
    give; null ids and repeated rows are kept; without labels there is one domain and rates are 1; an empty table
    gives an empty result; other columns are not looked at.
    """
    spark = documents.sparkSession
    model = fit_classifier(documents, labels, domain)
    domains = model.domains if model else ("",)
    scored = materialized(documents.select("doc_id", membership(spark, F.col("text"), model).alias("m"))
                          .select("doc_id", "m.n_tokens", "m.p"), "mixing")
    gaps = fit_rates(scored, weights, domains, False) if model else []
    best = F.array_max("p")
    names = F.array(*[F.lit(d) for d in domains])
    return scored.select("doc_id", "n_tokens",
                         F.element_at(names, F.array_position("p", best).cast("int")).alias("domain"),
                         best.alias("posterior"), _rate(F.col("p"), gaps).alias("rate"))


def mixed(documents: DataFrame, labels: DataFrame, weights: dict[str, float], domain: list[str],
          never_drop: bool = True) -> DataFrame:
    """The documents, each as often as its rate says, all columns as they are.

    A rate's fraction is one more copy with that chance, decided by a hash of
    the id, so that expected totals are the fitted ones. With ``never_drop`` every document is there at least once.
    Null and empty texts have no tokens and get the rate that their posteriors give; null ids and repeated rows
    are mixed like others; without labels all documents stay as they are; an empty table stays empty; columns
    named like the helper columns pass through.
    """
    spark = documents.sparkSession
    model = fit_classifier(documents, labels, domain)
    if model is None:
        return documents
    k_member, k_copy = fresh(documents, "membership", "copy")
    # classified once; the fit and the copies read what was written
    scored = materialized(documents.withColumn(k_member, membership(spark, F.col("text"), model)), "mixing")
    gaps = fit_rates(scored.select(f"{k_member}.n_tokens", f"{k_member}.p"), weights, model.domains, never_drop)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(_rate(F.col(f"{k_member}.p"), gaps, least=1.0 if never_drop else 0.0) + chance).cast("int")
    return (scored.withColumn(k_copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))
                                          .otherwise(F.array().cast("array<int>"))))
            .select(*documents.columns))
