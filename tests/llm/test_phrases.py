"""Dynamic itemset counting against plain counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitelens.llm import phrases, queries

LOWER = str.maketrans(phrases.UPPER, phrases.UPPER.lower())


def pieces(text):
    for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall("[^\x20\x09]+", p)


def counted(rows, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    held = set()
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if a >= f[lang, w[i:i + k]]:
                    held.add((lang, w[i:i + k]))
    out = []
    for lang in n:
        mine = []
        for (x, w), a in cand.items():
            if x == lang and (x, w) not in held:
                cuts = []
                for k in range(1, len(w)):
                    left, right = f[x, w[:k]], f[x, w[k:]]
                    cuts.append((1000 * a * n[x] // (left * right), k, left, right))
                s, _, left, right = min(cuts)
                mine.append((-s, -a, " ".join(w).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **more).collect())


def corpus(seed, docs):
    rng = random.Random(seed)
    words = ["a", "b", "C", "é", "dd", "new", "york", "City", "%", "_x", "z z", "\x1cq"]
    out = []
    for i in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", " ", "\x0b", "! "])
                       for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", "New York City hall of fame", None or ""])))
    return out + [("en", None), ("en", ""), (None, " .\t. "), ("xx", "one")]


@pytest.mark.parametrize("bits,tokens,chars", [(23, 1 << 21, 4 << 20), (6, 40, 25), (3, 300, 60)])
def test_equal_to_all_phrases(shipped, bits, tokens, chars):
    """Also with a table so small that it hits falsely, with small chunks, and with texts cut into parts."""
    limits = phrases.Limits(bits, tokens, chars)
    rows = corpus(bits, 150)
    df = shipped.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    assert mined(df, min_count=4, top=15, limits=limits) == brute(rows, 4, 15)


def test_segments_keep_every_phrase():
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "bb", "c"]) + rng.choice([" ", "  ", " ", " \n "]) for _ in range(500)) + "x" * 400 + " a bb"
    whole = counted([("en", text)])[0]
    for chars in (1, 7, 50, 390):
        got = Counter()
        for core, tail in phrases._segments(text, chars):
            parts = core.split("\n")
            for j, p in enumerate(parts):
                own = p.split()
                w = own + (tail.split() if j == len(parts) - 1 else [])
                for i in range(len(own)):
                    for k in range(1, 6):
                        if i + k <= len(w):
                            got["en", tuple(w[i:i + k])] += 1
        assert got == whole


def test_phrases_of_one_hash_are_told_apart():
    w = phrases.Words("en", pa.array(["a b c a b d a b c \n"]))
    at = np.array([0, 3, 6])
    for hashes in (np.zeros(3, dtype=np.uint64), np.array([1, 2, 1], dtype=np.uint64)):
        here, n = w._distinct(at, hashes, 3)
        assert sorted((tuple(w.ids[i:i + 3].tolist()), k) for i, k in zip(here, n)) == [((0, 1, 2), 2), ((0, 1, 3), 1)]


def test_odd_documents(shipped, odd_documents, no_documents):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    assert mined(odd_documents, min_count=2) == brute(rows, 2, 2000)
    assert mined(no_documents) == []


def test_products_beyond_64_bits(shipped):
    got = shipped.sql("select cast(1000 as decimal(4,0)) * cast(9999999999999999 as decimal(16,0)) * "
                      "cast(9999999999999999 as decimal(16,0)) div (cast(9999999999999998 as decimal(16,0)) * "
                      "cast(99999999999 as decimal(16,0)))").first()[0]
    assert got == 1000 * 9999999999999999 ** 2 // (9999999999999998 * 99999999999)


def test_query_against_all_phrases(shipped, sf_dir):
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_phrases(shipped, sf_dir).collect())
    assert got == brute([(r.lang, r.text) for r in docs.collect()], 100, 2000)


def test_marked_texts_by_their_definition():
    texts = ["", "A.b\tC\n\x0b\x0c\rÄÖ! é:;?,", "x" * 50 + "  Z", "..", "\U0001f600Q\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(["und"] * 5), pa.array(texts)], names=["lang", "text"])
    marks = str.maketrans(phrases.UPPER + phrases.BREAKS + "\t", phrases.UPPER.lower() + "\n" * len(phrases.BREAKS) + " ")
    want = [t.translate(marks).replace("\n", " \n ") + " \n" for t in texts]
    for part, expected in ((batch, want), (batch.slice(1, 3), want[1:4]), (batch.slice(0, 0), [])):
        (made,) = phrases._marked(iter([part]))
        assert made.column(1).to_pylist() == expected and made.num_rows == part.num_rows
