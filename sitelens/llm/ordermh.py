"""Order MinHash near-dedup: ordered minimum k-mers find candidates, banded alignment decides.

A text is its lower-cased words; its k-mers are runs of five words, each
labelled with its occurrence number in the text. One sketch takes the L
labelled k-mers with the smallest hashes and keeps them in text order, so two
texts agree on it when they share those k-mers *in the same order*. Texts
agreeing on any of M sketches are candidates. Texts of few k-mers meet on
single k-mers instead, which misses none of their pairs.

The similarity is the length of the longest chain of equal k-mers rising in
both texts over the number of k-mers in either text: Jaccard similarity that
also asks for order. Occurrence numbers play no part in it: inside the band of
diagonals that the threshold allows, any equal k-mers may match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, Forest, materialized, mix64, sorted_groups, tile_sides, tiled
from .components import connected_components

WORDS = 5            # words in a k-mer
SIMILARITY = 0.8
SKETCHES = 16        # M: a pair at the threshold shares no sketch with chance about (1 - 0.8**4)**16 = 0.0002
PICKED = 4           # L: k-mers in a sketch
SHORT = 20           # pairs whose shorter text has at most so many k-mers meet on single k-mers
BINS = 128           # bytes of the one-permutation signature that estimates similarity
TILE_ROWS = 512      # rows of one block of a large group
SLICE_ROWS = 512     # texts that are Python objects at one time
_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_CACHE_BYTES = 96 << 20  # of the words' hashes that a worker keeps


class _WordHash(ByteCache):
    """Word -> 64-bit hash."""

    def make(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_words = _WordHash(_CACHE_BYTES)


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order; fewer than five words are one k-mer."""
    _words.trim()
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(WORDS, len(h))):
        out = mix64(out + h[j:j + n])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number (rank among equal hashes, in text order) hashed in."""
    n = len(grams)
    out = grams.copy()
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    first = np.ones(n, dtype=bool)
    first[1:] = s[1:] != s[:-1]
    if not first.all():
        start = np.flatnonzero(first)
        rank = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        label = np.empty(n, dtype=np.uint64)
        label[order] = rank
        again = label > 0
        out[again] = mix64(out[again] ^ (label[again] * np.uint64(0x9E3779B97F4A7C15)))
    return out


def sketches(grams: np.ndarray) -> np.ndarray:
    """One key per sketch: hash of its L smallest k-mers in text order."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    if len(grams) <= PICKED:
        picked = np.broadcast_to(grams, (SKETCHES, len(grams)))
    else:
        picked = np.empty((SKETCHES, PICKED), dtype=np.uint64)
        for j in range(SKETCHES):
            x = grams * _SEEDS[j]
            x ^= x >> np.uint64(32)
            x *= _SEEDS[-1 - j]
            at = np.argpartition(x, PICKED - 1)[:PICKED]
            at.sort()
            picked[j] = grams[at]
    key = _SEEDS.copy()
    for j in range(picked.shape[1]):
        key = mix64(key + picked[:, j])
    return key.view(np.int64)


def single_keys(grams: np.ndarray) -> np.ndarray:
    """So many k-mers with the smallest hashes that texts of SIMILARITY or more must share one of them.

    Such a pair has at least SIMILARITY n common k-mers of either side's n. The smallest common one
    has at most n - SIMILARITY n smaller ones in each text, all others being common too.
    """
    most = int(len(grams) * (1 - SIMILARITY) + 1e-9) + 1
    return np.sort(mix64(grams ^ np.uint64(0xA0761D6478BD642F)))[:most].view(np.int64)


def candidate_keys(grams: np.ndarray) -> np.ndarray:
    """Keys on which a text meets others: single k-mers for pairs with a short text, sketches for the others."""
    n = len(grams)
    keys = [single_keys(grams)] if 0 < n <= SHORT / SIMILARITY + 1e-9 else []
    if n > SHORT or not n:
        keys.append(sketches(grams))
    return np.concatenate(keys)


def signature(grams: np.ndarray) -> np.ndarray:
    """One byte per bin from the smallest hash in it (1..255), 0 for an empty bin."""
    out = np.zeros(BINS, dtype=np.uint8)
    h = np.sort(mix64(grams ^ np.uint64(0xD6E8FEB86659FD93)))
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    out[bins[first]] = (mix64(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of every row of ``a`` to every row of ``b``, and the bins it rests on."""
    same = np.count_nonzero(a[:, None, :] == b[None], axis=2)
    empty = (a == 0).astype(np.float32) @ (b == 0).astype(np.float32).T
    used = np.maximum(BINS - empty, 1)
    return (same - empty) / used, used


def maybe_similar(a, b, na, nb) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the pairs that may reach SIMILARITY (missing one has a chance below 0.0005), and estimates."""
    est, used = estimated(a, b)
    margin = 3.4 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / used)
    short, long_ = np.minimum(na[:, None], nb[None]), np.maximum(na[:, None], nb[None])
    return (est >= SIMILARITY - margin) & (short >= SIMILARITY * long_), est


def longest_chain(a: np.ndarray, b: np.ndarray, ahead: int, behind: int) -> int:
    """Length of the longest chain of equal elements rising in both, by the bit-parallel form of the alignment table.

    Places (i, j) with j - behind <= i <= j + ahead may match; some outside may too, where a
    window of columns is wider. A bit of the window is 0 where the table grows by one in its column.
    """
    same = a[:min(len(a), len(b))] == b[:min(len(a), len(b))]
    head = len(same) if same.all() else int(np.argmin(same))  # equal ends are in a longest chain
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    same = a[::-1][:k] == b[::-1][:k]
    tail = k if same.all() else int(np.argmin(same))
    x, y = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    step = max(64, ahead + behind)
    chain, bits, start, end = head + tail, 0, 0, 0
    for lo in range(0, len(y), step):
        left, right = min(len(x), max(0, lo - behind)), min(len(x), lo + step + ahead)
        gone = bits & ((1 << (left - start)) - 1)
        chain += left - start - gone.bit_count()
        bits = bits >> (left - start) | ((1 << (right - end)) - 1) << (end - left)
        start, end = left, right
        every = (1 << (end - start)) - 1
        places: dict[int, list[int]] = {}
        for i in range(start, end):
            places.setdefault(x[i], []).append(i - start)
        # masks of frequent elements only are kept, so that they stay small for long texts
        masks = {v: sum(1 << i for i in at) for v, at in places.items() if len(at) > 64}
        for v in y[lo:lo + step]:
            at = places.get(v)
            if at is None:
                continue
            match = masks.get(v)
            if match is None:
                match = 1 << at[0]
                for i in at[1:]:
                    match |= 1 << i
            match &= bits
            bits = (bits + match | bits - match) & every
    return chain + end - start - bits.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two k-mer sequences by banded alignment (see the module's text); exact from SIMILARITY on."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    # similarity >= s needs a chain of at least s (n + m) / (1 + s)
    need = SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9
    common, ia, ib = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    chain = len(common)  # no chain is longer
    if chain >= need and not (np.diff(ib[np.argsort(ia)]) > 0).all():
        # that long a chain leaves out at most this many of either side
        chain = longest_chain(a, b, max(0, int(n - need)), max(0, int(m - need)))
    return chain / (n + m - chain)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


def _releasing(run):
    """Arrow function ``run`` that leaves no words' hashes behind in its worker."""
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _words.drop()
            pa.default_memory_pool().release_unused()
    return released


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        cls, ns, sigs, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            g = kmers(text or "")
            cls.append(xxhash.xxh3_128_digest(g.tobytes()))
            ns.append(len(g))
            g = labelled(g)
            sigs.append(signature(g).tobytes())
            keys.append(candidate_keys(g))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cls, pa.binary()), pa.array(ns, pa.int32()),
             pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "cls", "n", "sig", "keys"])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _maybe_pairs(sig, n, left, right) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers and estimates of a tile's pairs that may be similar, some rows of one side at a time."""
    step = max(1, (1 << 16) // len(right)) if len(right) else 1
    for lo in range(0, len(left), step):
        part = left[lo:lo + step]
        ok, est = maybe_similar(sig[part], sig[right], n[part], n[right])
        x, y = np.nonzero(ok)
        apart = part[x] != right[y]
        yield part[x][apart], right[y][apart], est[x, y][apart]


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tile's two sides: two blocks of one set, or of two sets (column ``side``)."""
    if "side" not in t.column_names:
        return tile_sides(t)
    side = t.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _forest_of(t: pa.Table, sig: np.ndarray, n: np.ndarray, similar) -> Iterator[pa.RecordBatch]:
    """Stars that join what the tile's pairs join which may be similar and pass ``similar``, the likeliest first.

    In a tile of two sets, rows of the second are joined already (to their hub).
    """
    left, right = _sides(t)
    ids = t.column("doc_id").to_numpy()
    forest = Forest(len(ids))
    if "side" in t.column_names:
        for x in right[1:]:
            forest.join(int(right[0]), int(x))
    parts = list(_maybe_pairs(sig, n, left, right))
    if not parts:
        return
    xs, ys, est = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(-est, kind="stable")
    for x, y in zip(xs[order].tolist(), ys[order].tolist()):
        if forest.root(x) != forest.root(y) and similar(x, y):
            forest.join(x, y)
    a, b = forest.stars()
    if a:
        yield _edges(ids[a], ids[b])


def _signatures(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    return sig, t.column("n").to_numpy()


def _grams(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    grams = [kmers(x.as_py() or "") for x in t.column("text")]
    return grams, np.stack([signature(labelled(g)) for g in grams]), np.array([len(g) for g in grams])


def _candidate_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile of a sketch's group, stars that join what pairs that may be similar join."""
    for t in sorted_groups(batches, ["group", "tile"]):
        if t.num_rows > 1:
            yield from _forest_of(t, *_signatures(t), lambda x, y: True)


def _verified_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile of a candidate component, stars that join what pairs of SIMILARITY or more join."""
    for t in sorted_groups(batches, ["group", "tile"]):
        if t.num_rows > 1:
            grams, sig, n = _grams(t)
            yield from _forest_of(t, sig, n, lambda x, y: aligned_similarity(grams[x], grams[y]) >= SIMILARITY)


def _met_hub(exact: bool):
    """Arrow function over chunks that begin with their group's hub: group, doc_id, joined (similar to the hub)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["group", "tile"]):
            if t.num_rows < 2:
                continue
            grams, sig, n = _grams(t) if exact else ([], *_signatures(t))
            ok = maybe_similar(sig[:1], sig, n[:1], n)[0][0]
            if exact:
                ok = np.array([k > 0 and bool(ok[k]) and aligned_similarity(grams[0], g) >= SIMILARITY
                               for k, g in enumerate(grams)])
            yield pa.RecordBatch.from_arrays([t.column("group").combine_chunks()[1:], t.column("hub").combine_chunks()[1:],
                                              t.column("doc_id").combine_chunks()[1:], pa.array(ok[1:], pa.bool_())],
                                             names=["group", "hub", "doc_id", "joined"])
    return run


def _links(rows: DataFrame, forest, exact: bool, large: bool) -> DataFrame:
    """Edges that join what pairs of a group join. ``rows``: group, size, hub (its smallest doc_id), doc_id
    and what ``forest`` compares.

    A group within TILE_ROWS is one tile. Of a larger one (``large``: there are such) every row
    first meets the hub; what joins it needs no further pair among itself. Only the rest is
    compared in tiles, with itself and with those that joined, so a group of near copies
    costs one comparison a row and its rows are sent about twice, whatever its size.
    """
    edges = "a long, b long"
    if not large:
        return tiled(rows.drop("hub"), "group", "size", TILE_ROWS, "doc_id").mapInArrow(forest, edges)
    # read several times below
    many = rows.filter(F.col("size") > TILE_ROWS)
    if not exact:
        many = materialized(many, "order-minhash-large")
    chunks = f"cast(ceil(size / {TILE_ROWS}) as bigint)"
    place = f"case when doc_id = hub then sequence(0L, {chunks} - 1) else array(pmod(xxhash64(doc_id), {chunks})) end"
    met = (many.withColumn("tile", F.explode(F.expr(place))).withColumn("other", F.col("doc_id") != F.col("hub"))
           .repartition("group", "tile").sortWithinPartitions("group", "tile", "other", "doc_id"))
    near = materialized(met.mapInArrow(_releasing(_met_hub(exact)), "group long, hub long, doc_id long, joined boolean"), "order-minhash-hubs")
    rest = near.filter("not joined").select("group", "doc_id")
    left_over = rest.groupBy("group").agg(F.count("*").alias("n_rest"))
    others = many.join(rest, ["group", "doc_id"]).join(left_over, "group")
    square = (rows.filter(F.col("size") <= TILE_ROWS).drop("hub")
              .unionByName(others.drop("hub", "size").withColumnRenamed("n_rest", "size")))
    # the rest against the rows that joined the hub, and the hub
    joined = many.join(left_over, "group").join(rest, ["group", "doc_id"], "left_anti")
    up, across = f"cast(ceil(n_rest / {TILE_ROWS}) as bigint)", f"cast(ceil((size - n_rest) / {TILE_ROWS}) as bigint)"
    row, column = f"pmod(xxhash64(doc_id), {up})", f"pmod(xxhash64(doc_id), {across})"
    sides = [others.withColumn("tile", F.explode(F.expr(f"transform(sequence(0L, {across} - 1), j -> {row} * {across} + j)")))
             .withColumn("side", F.lit(0)),
             joined.withColumn("tile", F.explode(F.expr(f"transform(sequence(0L, {up} - 1), i -> i * {across} + {column})")))
             .withColumn("side", F.lit(1))]
    cross = (sides[0].unionByName(sides[1]).drop("hub").repartition("group", "tile")
             .sortWithinPartitions("group", "tile", "side", "doc_id"))
    return (near.filter("joined").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
            .unionByName(tiled(square, "group", "size", TILE_ROWS, "doc_id").mapInArrow(forest, edges))
            .unionByName(cross.mapInArrow(forest, edges)))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_same (rows with the same words), kept.

    Texts with the same words in the same order are one class without any
    comparison (empty and null texts are one class of their own). Classes
    are linked if their similarity is 0.8 or more, and class_id is the smallest
    doc_id that links reach. kept marks the row with doc_id = class_id.
    Rows with a null id get a null class_id and kept = false. Repeated rows with one id share a class; rows that share an id but
    not their words are taken as one document. An empty table gives an empty
    result; other columns are not looked at.

    Only one row per class goes on. Rows of a sketch's group are compared by byte
    signatures, which rule out pairs far below the threshold, and the rows of
    a component of candidates by alignment. Either way a large group meets
    its hub first and only what did not join it is compared further, in tiles;
    a tile returns at most a star per joined set, never all pairs, and
    alignments that cannot change the components are skipped.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialized(source.mapInArrow(
        _releasing(_sketch_batches), "doc_id long, cls binary, n int, sig binary, keys array<bigint>"), "order-minhash")
    reps = materialized(
        made.groupBy("cls").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "sig", "keys")))
                                .alias("r"), F.count("*").alias("n_same")).select("cls", "n_same", "r.*"),
        "order-minhash-classes")
    one = reps.filter("doc_id is not null")
    postings = one.select("doc_id", F.explode("keys").alias("key"))
    shared = materialized(postings.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub"))
                          .filter("size > 1"), "order-minhash-groups")
    met = (postings.join(shared, "key").join(one.select("doc_id", "n", "sig"), "doc_id")
           .withColumnRenamed("key", "group"))
    is_large = F.col("size") > TILE_ROWS
    links = _links(met, _candidate_forest, False, not shared.filter(is_large).isEmpty())
    groups = connected_components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("group"))
    sizes = materialized(groups.groupBy("group").agg(F.count("*").alias("size")), "order-minhash-components")
    chosen = groups.join(sizes, "group").withColumn("hub", F.col("group"))
    texts, large = source.join(chosen, "doc_id"), not sizes.filter(is_large).isEmpty()
    # with a large group, texts of candidates are written once instead of being shuffled for every use
    found = _links(materialized(texts, "order-minhash-texts") if large else texts, _releasing(_verified_forest), True, large)
    classes = connected_components(found).withColumnRenamed("id", "doc_id")
    by_class = reps.select("cls", "n_same", "doc_id").join(classes, "doc_id", "left").select(
        "cls", "n_same", F.coalesce("component", "doc_id").alias("class_id"))
    return (made.select("doc_id", "cls").join(by_class, "cls")
            .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_same",
                    F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept")))


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their class keeps: one per class, all columns as they are.

    Rows without an id cannot stand for a class and stay. Of several rows with one id, also with
    different texts, the one with the smallest text stays (then the smallest by its other columns).
    A null text counts as empty and stands before other texts; an empty table stays empty.
    """
    kept = near_duplicate_classes(docs).filter("kept").select("doc_id").distinct()
    rest = docs.filter("doc_id is null")
    order = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*docs.columns)))
    return (docs.join(kept, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("kept_id"))
            .agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*").unionByName(rest))
