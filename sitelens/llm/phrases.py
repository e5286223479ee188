"""Collocations by dynamic itemset counting over cyclic scans of shards.

Documents are dealt to SHARDS shards, and each step scans one of them, in a
cycle. Words are counted from the first step. As soon as a phrase's running
count reaches the threshold it is *known*; a longer phrase becomes active at
the step at which both its subphrases (without the last and without the first
word) are known, and is counted for one whole cycle from there, beside
phrases of other lengths. A phrase at the threshold has subphrases at the
threshold, so every frequent phrase gets active, and a whole cycle counts it
exactly.

Tasks learn what is known from a table of fixed size: a slot holds the first
step at which a phrase with that hash is known. Two slots a phrase decide its
step. A false hit makes a phrase active that need not be, from a step that
stays the same in all scans, so counts remain exact however full the table is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Optional

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized, mix64, shared_folder
from ..session import ship_package

MIN_COUNT = 100
MOST_WORDS = 5
TOP = 2000
SHARDS = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = ".,;:!?\n\x0b\x0c\r"
# what one pass of character replacement makes of a text: pieces end at \n, words at a space
BYTES = bytes.maketrans((UPPER + BREAKS + "\t").encode(), (UPPER.lower() + "\n" * len(BREAKS) + " ").encode())
STATE = "lang string, phrase string, words int, start int, n long"


@dataclass(frozen=True)
class Limits:
    """Sizes that bound a task's memory; results do not depend on them."""
    table_bits: int = 23
    chunk_bytes: int = 12 << 20      # of texts counted together
    segment_chars: int = 4 << 20     # longer texts are cut at a space, with the next words as context


def _segments(text: str, most: int) -> Iterator[tuple[str, str]]:
    """A text in parts of bounded length cut at a space, each with the words that follow it in its piece."""
    following = re.compile(r"(?: *[^ \n]+){0,%d}" % (MOST_WORDS - 1))
    lo = 0
    while len(text) - lo > most:
        end = text.find(" ", lo + most)
        if end < 0:
            break
        yield text[lo:end], following.match(text, end).group()
        lo = end + 1
    yield text[lo:], ""


word_hash = xxhash.xxh3_64_intdigest


def _joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of the last."""
    return mix64(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def slots(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's two places in a table of ``size``, a power of two up to 2^32."""
    mask = np.uint64(size - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _step_of(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The step from which each phrase counts as known; 0 if it is not known."""
    a, b = (table[s] for s in slots(hashes, len(table)))
    return np.where((a > 0) & (b > 0), np.maximum(a, b), 0)


class Words:
    """The words of some texts of one language in order, numbered; a number of its own ends a piece."""

    def __init__(self, lang: str, texts: pa.Array, own: Optional[int] = None):
        """``own``: phrases that start after so many words are another part's."""
        coded = pc.list_flatten(pc.split_pattern(texts, " ")).dictionary_encode()
        self.words = coded.dictionary
        ids = coded.indices.to_numpy()
        names = self.words.to_pylist()
        number = {w: i for i, w in enumerate(names) if len(w) < 2}
        gap, self.end = number.get("", -1), number.get("\n", -1)
        self.ids = ids[ids != gap]
        self.real = np.array([i for i in (gap, self.end) if i >= 0], dtype=np.int64)
        self.own = len(self.ids) if own is None else own
        seed = np.uint64(word_hash(lang))
        self.hashes = mix64(np.fromiter(map(word_hash, names), dtype=np.uint64, count=len(names)) ^ seed)

    def _distinct(self, at: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(one position, number of positions) of every different phrase of ``length`` at the positions ``at``."""
        order = np.argsort(hashes)
        ranked = hashes[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        n = np.diff(np.append(first, len(at)))
        at = at[order]
        same = np.repeat(at[first], n)
        if any((self.ids[at + j] != self.ids[same + j]).any() for j in range(length)):
            # two phrases with one hash: tell them apart by their words
            rows = np.stack([self.ids[at + j] for j in range(length)], axis=1)
            _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return at[first], n

    def counts(self, step: int, table: np.ndarray) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
        """(phrases, words, starts, counts) of every length that has active phrases; 0 words: all words."""
        ids = self.ids
        if step < SHARDS:
            n = np.bincount(ids[:self.own], minlength=len(self.words))
            n[self.real] = 0
            seen = np.flatnonzero(n)
            yield self.words.take(pa.array(seen)), 1, np.zeros(len(seen), dtype=np.int64), n[seen]
            yield pa.array([""]), 0, np.array([0]), np.array([n.sum()])
        since = _step_of(self.hashes, table)
        since[self.real] = 0
        known = np.append(since[ids], 0)
        at = np.flatnonzero(known[:-1])
        made = self.hashes[ids[at]]
        for length in range(2, MOST_WORDS + 1):
            # both subphrases are known: those at this position and at the next one
            go = np.flatnonzero((known[at] > 0) & (known[at + 1] > 0))
            if not len(go):
                return
            at, made = at[go], _joined(made[go], self.hashes[ids[at[go] + length - 1]])
            start = np.maximum(known[at], known[at + 1])
            active = np.flatnonzero((step < start + SHARDS) & (at < self.own))
            if len(active):
                here, n = self._distinct(at[active], made[active], length)
                text = pc.binary_join_element_wise(*(self.words.take(pa.array(ids[here + j])) for j in range(length)), " ")
                yield text, length, np.maximum(known[here], known[here + 1]), n
            if length == MOST_WORDS:
                return
            # a false hit may be older than the subphrases: a phrase is known once they are, too
            since = _step_of(made, table)
            known = np.zeros(len(ids) + 1, dtype=known.dtype)
            known[at] = np.where(since > 0, np.maximum(since, start), 0)


def _count_shard(step: int, table: Broadcast, limits: Limits):
    """Arrow function over (lang, text): counts of the phrases that are active at this step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(table.value), dtype=np.uint8)

        def counted(lang: str, texts: pa.Array, own: Optional[int] = None) -> Iterator[pa.RecordBatch]:
            for text, words, start, n in Words(lang, texts, own).counts(step, known):
                size = len(text)
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), text, pa.array(np.full(size, words), pa.int32()),
                         pa.array(start, pa.int32()), pa.array(n, pa.int64())],
                        names=["lang", "phrase", "words", "start", "n"])

        def flushed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            lang, text = (t.column(c).combine_chunks() for c in ("lang", "text"))
            for one in pc.unique(lang).to_pylist():
                yield from counted(one, text.filter(pc.equal(lang, one)))

        parts: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            long = np.flatnonzero(sizes > limits.segment_chars)
            for i in long.tolist():
                lang = batch.column("lang")[i].as_py()
                for core, tail in _segments(batch.column("text")[i].as_py(), limits.segment_chars):
                    own = len(core.split(" ")) - core.split(" ").count("")
                    yield from counted(lang, pa.array([core + " " + tail + " \n"]), own)
            batch = batch.filter(pa.array(sizes <= limits.segment_chars)) if len(long) else batch
            ends = np.cumsum(sizes[sizes <= limits.segment_chars])
            lo = 0
            while lo < batch.num_rows:
                done = ends[lo - 1] if lo else 0
                hi = int(np.searchsorted(ends, done + limits.chunk_bytes - held, side="left")) + 1
                hi = min(hi, batch.num_rows)
                parts.append(batch.slice(lo, hi - lo))
                held += int(ends[hi - 1] - done)
                lo = hi
                if held >= limits.chunk_bytes:
                    yield from flushed(parts)
                    parts, held = [], 0
        if parts:
            yield from flushed(parts)
    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) with single bytes replaced by BYTES, which leaves longer characters alone, and the line end, which
    ends a piece, as a word of its own."""
    for batch in batches:
        text = batch.column(1)
        valid, ends, raw = text.buffers()
        mapped = pa.Array.from_buffers(pa.string(), len(text), [
            valid, ends, pa.py_buffer((raw.to_pybytes() if raw else b"").translate(BYTES))], offset=text.offset)
        made = pc.binary_join_element_wise(pc.replace_substring(mapped, "\n", " \n "), " \n", "")
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["lang", "text"])


def _phrase_slots(size: int):
    """Arrow function: table slots of phrases, for the set of all that are known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seed = word_hash(lang)
                each = mix64(np.array([word_hash(w) ^ seed for w in phrase.split(" ")], dtype=np.uint64))
                made = each[:1]
                for k in range(1, len(each)):
                    made = _joined(made, each[k:k + 1])
                out += [int(s[0]) for s in slots(made, size)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["slot"])
    return run


def _new_slots(state: DataFrame, min_count: int, size: int) -> np.ndarray:
    """Slots of the phrases at the threshold: at most one 64-bit word for every 64 slots comes to the driver."""
    bits = (state.filter((F.col("n") >= min_count) & F.col("words").between(1, MOST_WORDS - 1)).select("lang", "phrase")
            .mapInArrow(_phrase_slots(size), "slot long")
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow())
    word = bits.column("word").to_numpy()
    each = bits.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    at, bit = np.nonzero((each[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    return word[at] * 64 + bit


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                     min_count: int = MIN_COUNT, limits: Limits = Limits()) -> DataFrame:
    """(lang, phrase, words, n): every phrase of 1 to MOST_WORDS words that occurs ``min_count`` times in its lang.

    One more row a lang, with 0 words and the phrase "", counts all its words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    folder = shared_folder(spark, "phrases")
    (docs.select(lang, text).mapInArrow(_marked, "lang string, text string").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(SHARDS)).cast("int"))
     .write.partitionBy("shard").parquet(f"{folder}/texts"))
    texts = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/texts")
    table = np.zeros(1 << limits.table_bits, dtype=np.uint8)
    state = spark.createDataFrame([], STATE)
    finished, step, last = [], 0, 0
    while step < last + SHARDS:
        shared = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
        found = (texts.filter(F.col("shard") == step % SHARDS).select("lang", "text")
                 .mapInArrow(_count_shard(step, shared, limits), STATE))
        open_rows = state.filter(F.col("start") + SHARDS > step)
        total = (open_rows.unionByName(found).groupBy("lang", "phrase").agg(
            # both are the same in every row of a phrase
            F.max("words").alias("words"), F.max("start").alias("start"), F.sum("n").alias("n"))
                 # a phrase that has had its cycle stays if it is frequent
                 .filter((F.col("start") + SHARDS - 1 > step) | (F.col("n") >= min_count) | (F.col("words") == 0)))
        path = f"{folder}/step-{step}"
        total.write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        finished.append(state.filter(F.col("start") + SHARDS - 1 == step))
        new = _new_slots(state, min_count, len(table))
        new = new[table[new] == 0]
        step += 1
        if len(new):
            table[new] = last = step
        shared.unpersist()
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.select("lang", "phrase", "words", "n")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                 top: int = TOP, limits: Limits = Limits()) -> DataFrame:
    """The first ``top`` collocations of every lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends,
    and these into words at spaces and tabs. A candidate has 2 to MOST_WORDS
    words and a >= min_count occurrences (overlaps included). Its score is the
    least floor(1000 * a * n / (l * r)) over the cuts into a first part with l
    and a rest with r occurrences, n being all words of the lang; ties go to
    the shortest first part. A candidate goes if a longer one holds it and
    occurs as often. Order: score and a descending, phrase ascending by bytes.

    A null lang is ``und``; a null or empty text has no words; a text of any
    length is counted in parts; repeated rows count each time; an empty table
    gives no rows. Other columns are not looked at, whatever their names.
    """
    frequent = materialized(frequent_phrases(docs, lang_col, text_col, min_count, limits), "phrases-frequent")
    counted = frequent.filter("words > 0")
    candidates = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"),
                                                     F.split("phrase", " ").alias("w"))
    longer = (candidates.filter("words > 2").select(
        "lang", "a", F.explode(F.array(F.expr("slice(w, 1, words - 1)"), F.expr("slice(w, 2, words - 1)"))).alias("w"))
        .groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("most")))
    kept = (candidates.join(longer, ["lang", "phrase"], "left").filter("most is null or most < a")
            .select("lang", "phrase", "words", "a", "w"))
    cuts = (kept.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
            .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("front"),
                    F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("rest")))
    fronts = counted.select("lang", F.col("phrase").alias("front"), F.col("n").alias("l"))
    rests = counted.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    totals = frequent.filter("words = 0").select("lang", F.col("n"))
    # 38 digits hold the products of counts below 10^16; the quotient is at most 1000 * n
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)))"
                   " div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    least = (cuts.join(fronts, ["lang", "front"]).join(rests, ["lang", "rest"]).join(totals, "lang")
             .withColumn("score", score).groupBy("lang", "phrase")
             .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("m")).select("lang", "phrase", "m.*"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (least.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                    F.col("score").cast("long").alias("score")))


OP12_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    '{UPPER}.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
    '{UPPER.lower()}' || repeat(chr(10), 10) || ' ') AS x FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split(p, ' '), lambda y: y <> '') AS w
  FROM (SELECT lang, unnest(string_split(x, chr(10))) AS p FROM t)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, count(*)::HUGEINT AS f FROM (
    SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
      (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, g HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND len(b.g) > len(c.g) AND b.a >= c.a
  AND (' ' || array_to_string(b.g, ' ') || ' ') LIKE ('% ' || replace(replace(replace(array_to_string(c.g, ' '),
    '\\', '\\\\'), '%', '\\%'), '_', '\\_') || ' %') ESCAPE '\\')),
cuts AS (SELECT k.lang, k.g, k.a, i, l.f AS l, r.f AS r, n, (1000 * k.a * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS i FROM kept) k
  JOIN f l ON l.lang = k.lang AND l.g = k.g[1:i] JOIN f r ON r.lang = k.lang AND r.g = k.g[i + 1:] JOIN total t ON t.lang = k.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
  array_to_string(g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {TOP}
"""
