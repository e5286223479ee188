"""Operators on documents: odd rows, brute force, exact library results."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sitelens.llm import fingerprint, linefreq, mixing, ordermh, piecebpe, queries, tokencount, toxicity
from sitelens.llm.common import Forest, table

ALPHABET = [*"ab the'restvmld .,!?\n\t   　\x1c\x85éßñ½５٣中文😀▁\u0000<|>", "<|endoftext|>", "'re", "'ll", " disgusting",
            "▁▁", "  ", "<s>", "<0x0A>"]


def random_texts(n, longest=24, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def collected(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key] or 0))


# ---- fingerprints

def test_fingerprint_is_a_multiset_hash():
    a = fingerprint.fingerprint("one two three four\nfive six seven eight\nnine")
    b = fingerprint.fingerprint("nine\none two three four\nfive six seven eight")
    assert np.array_equal(a, b) and fingerprint.likeness(a, b) == 1.0
    assert not np.array_equal(a, fingerprint.fingerprint("nine\nnine\none two three four\nfive six seven eight"))
    assert not np.array_equal(fingerprint.fingerprint("a"), fingerprint.fingerprint("a\n"))


def test_fingerprint_insert_and_delete():
    base = "the first paragraph\nthe second one"
    more = "a third paragraph\nand a fourth"
    both = fingerprint.insert(fingerprint.fingerprint(base), more)
    assert np.array_equal(both, fingerprint.fingerprint(more + "\n" + base))
    assert np.array_equal(fingerprint.delete(both, more), fingerprint.fingerprint(base))


def test_edited_fingerprint_equals_the_edited_texts():
    for a, b in zip(random_texts(200, 60), random_texts(200, 60, 1)):
        got = fingerprint.edited_fingerprint(fingerprint.fingerprint(a), a, b)
        assert np.array_equal(got, fingerprint.fingerprint(fingerprint.edited(a, b)))


def test_likeness_orders_texts(sf_dir, shipped):
    texts = [r.text for r in table(shipped, sf_dir, "documents").select("text").filter("length(text) > 2000").limit(60).collect()]
    for a, b in zip(texts, texts[1:]):
        words = a.split(" ")
        near = " ".join(words[:int(len(words) * 0.9)])
        x, y, z = (fingerprint.fingerprint(t) for t in (a, near, b))
        assert fingerprint.likeness(x, y) > 0.7
        if a != b:
            assert fingerprint.likeness(x, z) < fingerprint.likeness(x, y)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_neighbours_on_odd_rows(odd_documents, buckets):
    got = collected(fingerprint.neighbour_fingerprints(odd_documents, buckets))
    rows = sorted(((r.doc_id, r.text or "") for r in odd_documents.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(i, len(t), hashlib.sha256(fingerprint.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest())
            for k, (i, t) in enumerate(rows)]
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, want))
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_neighbours_where_one_id_has_a_third_of_the_rows(shipped, buckets):
    rng = random.Random(buckets)
    rows = [(i, f"text {rng.random()}") for i in range(600)] + [(300, f"{rng.choice('abcdef')} {rng.random()}") for _ in range(280)]
    rows += [(300, "the same text again")] * 30 + [(300, None), (None, "x"), (2 ** 53 + 1, "large"), (2 ** 53 + 2, "larger")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.neighbour_fingerprints(docs, buckets).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        e = fingerprint.edited(t, following)
        s = fingerprint.fingerprint(t)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.text_of(s),
                     fingerprint.text_of(fingerprint.fingerprint(e)),
                     round(fingerprint.likeness(s, fingerprint.fingerprint(e)), 9),
                     round(fingerprint.likeness(s, fingerprint.fingerprint(following)), 9)))
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                       round(r.near_next, 9))) for r in got) == sorted(map(str, want))
    if buckets == 32:
        from pyspark.sql import functions as F
        places = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), F.coalesce("text", F.lit("")).alias("begin"))
        bounds = fingerprint._bounds(places, buckets)
        sizes = {}
        for r in places.collect():
            at = sum(b <= (r.key, r.begin) for b in bounds)
            sizes[at] = sizes.get(at, 0) + 1
        assert max(sizes.values()) < 100  # 311 rows of one id lie in several ranges


def test_neighbours_of_one_and_of_none(odd_documents, no_documents):
    one = fingerprint.neighbour_fingerprints(odd_documents.filter("doc_id = 5")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert fingerprint.neighbour_fingerprints(no_documents).collect() == []


# ---- toxicity

def test_toxicity_holds_out_and_separates(sf_dir, shipped):
    docs, labels = table(shipped, sf_dir, "documents"), table(shipped, sf_dir, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].score, y) for i, y in known.items() if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.8


def test_toxicity_finds_planted_words(shipped):
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["vilestword", "nastything", "awfulness"]
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(bad) if toxic and rng.random() < 0.04 else word() for _ in range(150)), int(toxic)))
    docs = shipped.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = shipped.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93


def test_toxicity_of_phrases_of_ordinary_words():
    """Words that ordinary texts hold too tell toxic texts by their phrases; no word is typical."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4)))
    phrase = "silver window garden teacher purple monday".split()
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        parts = [word() for _ in range(120)]
        for _ in range(10):
            at = rng.randrange(100)
            parts[at:at] = phrase if toxic else rng.sample(phrase, len(phrase))[:2]
        rows.append((i % 2, " ".join(parts), int(toxic)))
    model = toxicity.train(rows[:600])
    x = toxicity.features(toxicity._compressors(model), [t for _, t, _ in rows[600:]])
    z = x @ np.array(model.weights[:-1]) + model.weights[-1]
    hits = [(s >= np.log(0.7 / 0.3)) == y for s, (_, _, y) in zip(z, rows[600:])]
    assert model.typical == model.ordinary and np.mean(hits) > 0.75


def test_samples_take_one_row_of_an_id(shipped, monkeypatch):
    """However many rows an id has, one is collected, and all texts have a bound in characters."""
    docs = shipped.createDataFrame([(1, f"copy {i}") for i in range(50)] + [(i, "x" * 100) for i in range(2, 30)] + [(30, None)],
                                   "doc_id long, text string")
    labels = shipped.createDataFrame([(i, i % 2, i % 2) for i in range(1, 31)], "doc_id long, toxic int, quality int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append(rows))
    monkeypatch.setattr(mixing, "_train", lambda x, y, names: seen.append(x))
    toxicity.fit(docs, labels, held_out=False)
    mixing.fit_classifier(docs, labels, ["quality"])
    assert [len(rows) for rows in seen] == [29, 29] and "copy 0" in [t for _, t, _ in seen[0]]
    monkeypatch.setattr(toxicity, "SAMPLE_TOTAL", 1000)
    toxicity.fit(docs, labels, held_out=False)
    assert 900 < sum(len(t) for _, t, _ in seen[2]) <= 1000


def test_toxicity_on_odd_rows(odd_documents, no_documents, shipped):
    labels = shipped.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd_documents, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(odd_documents, none).collect()} == {0.0}
    assert toxicity.toxicity(no_documents, labels).collect() == []
    assert toxicity.drop_toxic(odd_documents, none).columns == odd_documents.columns
    assert toxicity.drop_toxic(odd_documents, none).count() == 10


# ---- the domain classifier

def test_targets_are_reached(sf_dir, shipped):
    """Expected totals of op6 over the whole table are within two hundredths of every target."""
    from pyspark.sql import functions as F
    docs, labels = table(shipped, sf_dir, "documents"), table(shipped, sf_dir, "labels")
    model = mixing.fit_classifier(docs, labels, ["quality", "toxic"])
    rates = {(r.doc_id, r.n_tokens): r.rate for r in queries.op6_mixing(shipped, sf_dir).collect()}
    scored = docs.select("doc_id", mixing.membership(shipped, F.col("text"), model).alias("m")).collect()
    total = np.zeros(len(model.domains))
    for r in scored:
        total += rates[r.doc_id, r.m.n_tokens] * r.m.n_tokens * np.array(r.m.p)
    for d, share in zip(model.domains, total / total.sum()):
        assert abs(share - queries.WEIGHTS[d]) <= 0.02 * queries.WEIGHTS[d]


def test_word_evidence_tells_domains_apart():
    """Held-out texts of a domain that differs from others by a few words alone."""
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(400)]
    def text(marked):
        words = rng.choices(plain, k=60)
        if marked:
            words[rng.randrange(60)] = rng.choice(["Foul", "vile"])
        return " ".join(words)
    rows = sorted((str(k % 2), text(k % 2)) for k in range(600))
    m = mixing.train_classifier(rows)
    x = mixing.features_of(mixing.look([text(k % 2) for k in range(200)]), m.evidence)
    s = (x - m.mean) / m.scale @ m.weights[:, :-1].T + m.weights[:, -1]
    assert np.mean(s.argmax(1) == np.arange(200) % 2) > 0.95


# ---- token counts

@pytest.fixture(scope="module")
def counted():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.counter(path), Tokenizer.from_file(path)


def test_prefix_counts_are_the_librarys(counted):
    c, library = counted
    rng = random.Random(5)
    for text in random_texts(500):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert c.prefix_counts(text).tolist() == want, text
        budget = rng.randint(0, 8)
        assert c.longest_within(text, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_counts_of_documents(counted, sf_dir, shipped):
    c, library = counted
    docs = table(shipped, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokencount.count_tokens(docs).collect():
        t = texts[r.doc_id]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
        assert (r.limit_chars == len(t)) == (n <= 512)


def test_counts_on_odd_rows(odd_documents, no_documents):
    got = tokencount.count_tokens(odd_documents).collect()
    assert len(got) == 10
    assert all((r.n_bytes, r.n_tokens, r.limit_chars) == (0, 0, 0) for r in got if r.doc_id in (3, 4))
    assert tokencount.count_tokens(no_documents).collect() == []


# ---- pieces

@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piecebpe.piece_table(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_are_the_librarys(pieces, sf_dir, shipped):
    t, library = pieces
    texts = random_texts(1500) + [r.text for r in table(shipped, sf_dir, "documents").limit(200).collect()]
    for text in texts:
        ids = library.encode(text)
        assert t.encode(text) == ids, text
        assert t.decode(ids) == library.decode(ids), text
        n, joined, back = t.encoded_text(text)
        assert (n, joined, back.decode()) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_piece_columns_round_trip(odd_documents, no_documents, pieces):
    from pyspark.sql import functions as F
    ids = odd_documents.select("text", piecebpe.encode_column(F.col("text")).alias("ids"))
    back = ids.select("text", piecebpe.decode_column(F.col("ids")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    got = piecebpe.encode_documents(odd_documents).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 10
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (3, 4))
    assert piecebpe.encode_documents(no_documents).collect() == []


# ---- line dedup

def brute_lines(rows, ratio, least):
    from collections import defaultdict
    pages = defaultdict(set)
    for _, t, s in rows:
        if t is not None:
            pages[s].add(t)
    bad = defaultdict(set)
    for s, texts in pages.items():
        for line in {x for t in texts for x in t.split("\n")}:
            n = sum(line in t.split("\n") for t in texts)
            if line.strip(" ") and n >= least and n > ratio * len(texts):
                bad[s].add(line)
    return {(i, s, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad[s])) for i, t, s in rows}


def test_line_dedup_against_brute_force(shipped):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        site = rng.choice(["a", "a", "b", None])
        lines = [rng.choice(["menu", "about us", "", " "]) if rng.random() < 0.3 else f"line {rng.randint(0, 300)}"
                 for _ in range(rng.randint(0, 8))]
        rows.append((i, None if rng.random() < 0.02 else "\n".join(lines), site))
    docs = shipped.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, line_key int")
    got = linefreq.drop_boilerplate(docs, max_ratio=0.1)
    assert got.columns == ["doc_id", "text", "source", "line_key", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.source, r.text) for r in got.collect()} == brute_lines(rows, 0.1, linefreq.MIN_PAGES)


def test_copies_do_not_make_boilerplate(shipped):
    docs = shipped.createDataFrame([(i, "a page\nof its own", "s") for i in range(50)], "doc_id long, text string, source string")
    assert {r.text for r in linefreq.drop_boilerplate(docs).collect()} == {"a page\nof its own"}


def test_line_dedup_on_odd_rows(odd_documents, no_documents):
    got = linefreq.drop_boilerplate(odd_documents).collect()
    assert len(got) == 10 and all(r.n_lines == 0 for r in got if r.doc_id == 3)
    assert linefreq.drop_boilerplate(no_documents).collect() == []


# ---- near-dedup

def brute_classes(texts):
    grams = {i: ordermh.kmers(t or "") for i, t in texts.items()}
    ids = sorted(texts)
    forest = Forest(len(ids))
    for x in range(len(ids)):
        for y in range(x):
            a, b = grams[ids[x]], grams[ids[y]]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and ordermh.aligned_similarity(a, b) >= 0.8:
                forest.join(x, y)
    return {ids[k]: ids[forest.root(k)] for k in range(len(ids))}


def test_near_dedup_against_all_pairs(sf_dir, shipped):
    docs = table(shipped, sf_dir, "documents").limit(500)
    got = ordermh.near_duplicate_classes(docs).collect()
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_dedup_of_one_large_group(shipped, monkeypatch):
    """Tiles of a group larger than a block still join it, and reordered texts stay apart."""
    monkeypatch.setattr(ordermh, "TILE_ROWS", 16)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = {}
    for i in range(120):
        words = list(base)
        words[rng.randrange(300)] = f"new{i}"
        texts[i] = " ".join(words)
    texts[500] = " ".join(base[150:] + base[:150])
    docs = shipped.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in ordermh.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts) and got[119] == 0 and got[500] == 500


@pytest.mark.parametrize("rows", [4, 16, 1000])
def test_near_dedup_of_chains_and_strangers(shipped, monkeypatch, rows):
    """Groups whose hub is like few of them: a chain of texts that drift apart, two clusters that a bridge
    joins, and texts that share a passage only."""
    monkeypatch.setattr(ordermh, "TILE_ROWS", rows)
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 9000)}"
    words = [word() for _ in range(240)]
    texts = {}
    for i in range(45):
        texts[i] = " ".join(words)
        words[5 * i:5 * i + 5] = [word() for _ in range(5)]
    passage = [word() for _ in range(60)]
    for i in range(100, 140):
        texts[i] = " ".join([word() for _ in range(60)] + passage)
    left = [word() for _ in range(200)]
    right = left[:20] + [word() for _ in range(24)] + left[44:]
    bridge = left[:20] + right[20:32] + left[32:]
    for i in range(200, 220):
        texts[i] = " ".join((left if i % 2 else right)[:199] + [f"end{i}"])
    texts[230] = " ".join(bridge)
    docs = shipped.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in ordermh.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_of_rows_with_one_id_the_smallest_text_stays(shipped):
    rows = [(1, "b text", "x"), (1, "a text", "y"), (1, "a text", "c"), (2, None, "z"), (2, "later", "z"), (None, "n", "q"), (None, "n", "q")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (1, 7):
        got = sorted(map(str, (tuple(r) for r in ordermh.keep_one_of_each_class(docs.repartition(part)).collect())))
        assert got == sorted(map(str, [(1, "a text", "c"), (2, None, "z"), (None, "n", "q"), (None, "n", "q")]))


def plain_alignment(a, b):
    """Longest common subsequence over all k-mers of either text, by the whole table."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1] / (len(a) + len(b) - last[-1])


def test_alignment_of_texts_with_a_repeated_line(shipped):
    rng = random.Random(6)
    refrain = [f"r{i}" for i in range(12)]
    lines = [refrain if k % 2 == 0 else [f"w{rng.randint(0, 5000)}" for _ in range(12)] for k in range(40)]
    edited = [["new", *refrain[1:]], *lines[1:]]
    texts = {k: " ".join(w for line in v for w in line) for k, v in enumerate([lines, edited, lines[1:]])}
    grams = [ordermh.kmers(t) for t in texts.values()]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        got = ordermh.aligned_similarity(grams[a], grams[b])
        assert got > 0.9 and got == plain_alignment(grams[a].tolist(), grams[b].tolist())
    docs = shipped.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.class_id for r in ordermh.near_duplicate_classes(docs).collect()} == {0}


def test_alignment_against_the_whole_table():
    rng = random.Random(7)
    close = 0
    for _ in range(300):
        a = [rng.randint(0, rng.choice([3, 40])) for _ in range(rng.randint(1, 260))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 8 + 1)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 2)] = [rng.randint(0, 40)] * rng.randint(0, 2)
        a, b = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        got, want = ordermh.aligned_similarity(a, b), plain_alignment(a.tolist(), b.tolist()) if len(b) else 0.0
        assert got == want if want >= 0.8 else got < 0.8
        close += want >= 0.8
    assert 100 < close < 300


def test_short_texts_always_meet():
    """Pairs of 0.8 with few k-mers share a key, whichever k-mers are common."""
    rng = np.random.default_rng(9)
    for n in range(4, ordermh.SHORT + 1):
        for m in range(n, int(n / 0.8) + 1):
            common = int(np.ceil(0.8 * (n + m) / 1.8 - 1e-9))
            if common > n:
                continue
            for _ in range(60):
                g = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
                a, b = g[:n], np.concatenate([g[:common], g[n:]])
                assert len(np.intersect1d(ordermh.candidate_keys(a), ordermh.candidate_keys(b))), (n, m)
                assert ordermh.maybe_similar(ordermh.signature(a)[None], ordermh.signature(b)[None],
                                             np.array([n]), np.array([m]))[0].all()


def test_near_dedup_on_odd_rows(odd_documents, no_documents):
    got = collected(ordermh.near_duplicate_classes(odd_documents))
    by_id = {r.doc_id: (r.class_id, r.n_same, r.kept) for r in got}
    assert len(got) == 10 and by_id[None] == (None, 1, False)
    assert by_id[1] == (1, 3, True) and by_id[2] == (1, 3, False)
    assert by_id[3] == (3, 2, True) and by_id[4] == (3, 2, False)
    assert by_id[7][0] == 6
    kept = ordermh.keep_one_of_each_class(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 8]
    assert ordermh.near_duplicate_classes(no_documents).collect() == []


# ---- mixing

def brute_rates(p, n, target, steps):
    size = n.sum()
    floor = np.maximum(n @ p / size, 1e-6)
    r = np.ones(len(n))
    for _ in range(steps):
        gap = ((n * r) @ p / size - target) / floor
        r = np.maximum(0, r - mixing.ETA * (p @ gap + mixing.RIDGE * (r - 1)))
    return r


def test_rates_are_projected_gradient(shipped):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 500, 300)
    scored = shipped.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    gaps = mixing.fit_rates(scored, weights, ("a", "b", "c"), False)
    got = np.array([r.r for r in scored.withColumn("r", mixing._rate(scored.p, gaps)).collect()])
    want = brute_rates(p, n, np.array([0.7, 0.2, 0.1]), len(gaps))
    assert np.allclose(got, want)
    assert np.allclose((n * got) @ p / n.sum(), [0.7, 0.2, 0.1], atol=0.02) and (got >= 0).all()


def test_totals_reach_small_targets_or_say_so(shipped, caplog):
    """A small domain's total is held against its own target, and what is missed is reported."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([3.0, 0.5, 0.2], 400)
    n = rng.integers(50, 500, 400)
    scored = shipped.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    weights = {"a": 0.85, "b": 0.13, "c": 0.02, "rare": 0.5}
    target = np.array([0.85, 0.13, 0.02])
    gaps = mixing.fit_rates(scored, weights, ("a", "b", "c"), False)
    got, best = (n * brute_rates(p, n, target, len(gaps))) @ p / n.sum(), (n * brute_rates(p, n, target, 5000)) @ p / n.sum()
    assert (np.abs(got - target) <= 0.01 * target).all() or (np.abs(got - best) <= 0.05 * target).all()
    assert "weights of rare" in caplog.text
    assert ("target shares" in caplog.text) == bool((np.abs(got - target) > 0.01 * target).any())


def test_mixing_drops_nothing_of_overlapping_domains(shipped):
    """Domains that overlap and whose natural shares are far from the weights."""
    rng = random.Random(12)
    rows = []
    for i in range(800):
        good = rng.random() < 0.7
        rows.append((i, "".join(rng.choice("aB!") if rng.random() < (0.25 if good else 0.45) else rng.choice("a b")
                                for _ in range(rng.randint(20, 200))), "01"[good]))
    docs = shipped.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = shipped.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality string")
    weights = {"1": 0.88, "0": 0.12}
    out = [r.doc_id for r in mixing.mixed(docs, labels, weights, ["quality"]).select("doc_id").collect()]
    assert set(out) == set(range(800)) and len(out) > 900
    dropping = mixing.mixed(docs, labels, weights, ["quality"], never_drop=False).select("doc_id").distinct()
    assert dropping.count() < 800  # where documents may go, some do


def test_mixing_takes_effect(sf_dir, shipped):
    docs, labels = table(shipped, sf_dir, "documents"), table(shipped, sf_dir, "labels")
    out = mixing.mixed(docs, labels, {"1": 0.9, "0": 0.1}, ["quality"])
    assert out.columns == docs.columns and out.count() > docs.count()


def test_mixing_on_odd_rows(odd_documents, no_documents, shipped):
    labels = shipped.createDataFrame([(1, 1), (5, 0), (6, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = mixing.mixing_rates(odd_documents, labels, {"1": 0.5, "0": 0.5}, ["quality"]).collect()
    assert len(got) == 10 and all(r.rate >= 0 and 0 <= r.posterior <= 1 for r in got)
    assert {r.rate for r in mixing.mixing_rates(odd_documents, labels.limit(0), {}, ["quality"]).collect()} == {1.0}
    assert mixing.mixing_rates(no_documents, labels, {"1": 1.0}, ["quality"]).collect() == []
    assert mixing.mixed(odd_documents, labels, {"1": 0.5, "0": 0.5}, ["quality"]).columns == odd_documents.columns


def test_caches_are_bounded_in_bytes():
    """Units of 200,000 characters, and a text of 2 MB without a space, leave nothing behind."""
    rng = random.Random(2)
    letters = "abcdefghij"
    table_ = piecebpe.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    counter = tokencount.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    before = table_.units.bytes, counter.totals.bytes, ordermh._words.bytes
    for size in (*[200_000] * 5, 2_000_000):
        text = "".join(rng.choices(letters, k=size))
        assert table_.encoded_text(text)[2] == text.encode()
        assert counter.count(text) > size // 5
        assert len(ordermh.kmers(text)) == 1
    after = table_.units.bytes, counter.totals.bytes, ordermh._words.bytes
    assert all(b - a < 10_000 for a, b in zip(before, after))


def test_a_full_cache_is_emptied_between_texts(monkeypatch):
    t = piecebpe.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))
    t.units.most_bytes = 2_000
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice(["plain", "w%d" % rng.randint(0, 500), "😀".encode("utf-16", "surrogatepass").decode("utf-16"),
                                    "  x", "é", "▁odd"]) for _ in range(20))
        n, ids, back = t.encoded_text(text)
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and back == library.decode(want).encode()
        assert t.units.bytes < 2_000 + 20 * 400


def test_workers_keep_no_caches_between_tasks():
    """A worker serves one operator after another, so each leaves its caches empty."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array([f"some words of text {k}" for k in range(1300)])],
                                       names=["doc_id", "text"])
    made = list(ordermh._releasing(ordermh._sketch_batches)(iter([batch])))
    assert [b.num_rows for b in made] == [512, 512, 276] and not ordermh._words and not ordermh._words.bytes
    table = piecebpe.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    table.encoded_text("a text with a lone \ud800 sign")
    assert table.units
    table.release()
    assert not (table.units or table.units.bytes or table.units.odd or table.compatible.known)
