"""Exact token counts at every prefix, for a byte-level BPE vocabulary.

Within one pre-token (the vocabulary's word pattern) the last token of every
prefix is unique: it is the token t ending there for which (last token of the
rest, t) survives when the merge rules are applied to the two tokens alone.
So one pass over the automaton matches gives every prefix's last token, and
with it the exact count: count[i] = count[i - len(t)] + 1. Tables are kept per
distinct pre-token; a text's table is the running sum over its pre-tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Optional

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import ByteCache
from .pairs import PairTest

LIMIT = 512
_CACHE = 400_000          # pairs of tokens that a worker keeps
_CACHE_BYTES = 128 << 20  # of the pre-tokens' totals that it keeps
_TABLE_BYTES = 32 << 20   # of the pre-tokens' whole tables
# The pattern by which this public vocabulary was trained (fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\p{White_Space}", c))


def _bmp_class(prop: str) -> str:
    """The characters below U+10000 that have a property, as ranges for a character class of ``re``."""
    runs = regex.findall(rf"{prop}+", "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000))
    return "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for run in runs for a, b in _ranges(run))


def _ranges(run: str) -> Iterator[tuple[str, str]]:
    """Runs of following code points in a sorted string."""
    start = last = run[0]
    for c in run[1:]:
        if ord(c) != ord(last) + 1:
            yield start, last
            start = c
        last = c
    yield start, last


def word_splitter():
    """A function from a text to its pre-tokens: the same pattern for the standard library where all
    characters are below U+10000 (its character sets are tables there), the general one elsewhere."""
    general = regex.compile(PATTERN).findall
    letters, digits, white = (_bmp_class(p) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    low = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{white}{letters}{digits}]+"
                     f"|[{white}]+(?![^{white}])|[{white}]+").findall
    high = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: general(text) if high(text) else low(text)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in own:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


class _Totals(ByteCache):
    """Pre-token -> its number of tokens."""

    def __init__(self, owner: "PrefixCounter"):
        super().__init__(_CACHE_BYTES)
        self.owner = owner

    def make(self, word: str) -> int:
        return self.owner.byte_table(word.encode("utf-8", "replace").decode("latin-1"))[0][-1]


class _PrefixTables(ByteCache):
    """Pre-token -> its counts at every code point prefix."""

    def __init__(self, owner: "PrefixCounter"):
        super().__init__(_TABLE_BYTES)
        self.owner = owner

    def make(self, word: str) -> np.ndarray:
        return self.owner.word_counts(word)

    def size(self, table: np.ndarray) -> int:
        return table.nbytes + 112


class PrefixCounter:
    """Token counts of texts and of all their prefixes under a byte-level BPE .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks: dict[tuple[str, str], int] = {}
        split: dict[str, tuple[str, str]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault((a, b), k)
            if split.setdefault(a + b, (a, b)) != (a, b):
                raise ValueError(f"two merges make {a + b!r}")
        self.compatible = PairTest(split, {t: ranks[p] for t, p in split.items()},
                                   lambda a, b: ranks.get((a, b)), _CACHE)
        special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = (regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")").split
                              if special else None)
        self.words = word_splitter()
        self.tables = _PrefixTables(self)
        self.totals = _Totals(self)
        self.automaton = ahocorasick.Automaton()
        for token in model["vocab"]:
            if token in byte or (token in split and self.compatible.reachable(token)):
                raw = "".join([chr(byte[c]) for c in token])
                self.automaton.add_word(raw, (len(raw), token))
        self.automaton.make_automaton()

    def byte_table(self, word: str) -> tuple[list[int], list[str]]:
        """Of bytes (as Latin-1 text): count and last token at every prefix (index 0: empty)."""
        counts, last = [0] * (len(word) + 1), [""] * (len(word) + 1)
        done, fits = 0, self.compatible.known
        for end, (size, token) in self.automaton.iter(word):
            if end < done:
                continue  # the last token is unique
            left = last[end + 1 - size]
            if size <= end:
                ok = fits.get((left, token))
                if not (self.compatible(left, token) if ok is None else ok):
                    continue
            done = end + 1
            counts[done], last[done] = counts[done - size] + 1, token
        return counts, last

    def word_counts(self, word: str) -> np.ndarray:
        """Counts at every code point prefix of a pre-token (index 0: empty)."""
        counts, _ = self.byte_table(word.encode("utf-8", "replace").decode("latin-1"))
        ends = [0]
        for c in word:
            ends.append(ends[-1] + len(c.encode("utf-8", "replace")))
        t = np.array([counts[e] for e in ends], dtype=np.int32)
        if len(word) > 1 and word[0] == "'" and word in ("'re", "'ve", "'ll"):
            # cut after the first letter, the apostrophe and the letter are two pre-tokens
            t[2] = 2
        return t

    def table(self, word: str) -> np.ndarray:
        """``word_counts``, remembered."""
        return self.tables[word]

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.split_special is None:
            yield text, False
            return
        for k, part in enumerate(self.split_special(text)):
            if part:
                yield part, k % 2 == 1

    def count(self, text: str) -> int:
        """Exact number of tokens: the last entry of the text's prefix table."""
        self.totals.trim()
        total = 0
        for part, is_special in self._pieces(text):
            total += 1 if is_special else sum(map(self.totals.__getitem__, self.words(part)))
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[k] = exact number of tokens of text[:k], for every k.

        Entries come from the tables of the pre-tokens. A prefix that ends in
        white space has that whole run as one pre-token, so runs have tables
        of their own; one that ends inside a special string is ordinary text
        from the end of the last special string on.
        """
        self.tables.trim()
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at, before = 0, ""
        for part, is_special in self._pieces(text):
            if is_special:
                base = out[at - len(before)]
                for k in range(1, len(part)):
                    out[at + k] = base + self.count(before + part[:k])
                out[at + len(part)] = out[at] + 1
                at, before = at + len(part), ""
                continue
            total, pos = out[at], at
            run = at  # where the white space that is open here began
            for word in self.words(part):
                end = pos + len(word)
                out[pos + 1:end + 1] = total + self.table(word)[1:]
                blank = word[-1] in WHITE
                if word[0] in WHITE:
                    stop = end if blank else pos + 1
                    out[run + 1:stop + 1] = out[run] + self.table(text[run:stop])[1:]
                total += self.totals[word]
                pos = end
                if not blank:
                    run = end
            at, before = pos, part
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens, from stored counts.

        Counts can fall inside a pre-token or a run of white space, but not below the
        count at the end of an earlier pre-token that is not white space. So only the
        prefixes between two such ends are looked at: the last one within the
        budget and the first one beyond it.
        """
        self.totals.trim()
        total = pos = 0
        start = base = 0          # the last end within the budget, and its count
        back = back_base = 0      # the end before it
        for part, is_special in self._pieces(text):
            for word in (part,) if is_special else self.words(part):
                total += 1 if is_special else self.totals[word]
                pos += len(word)
                if is_special or word[-1] not in WHITE:
                    if total > budget:
                        if is_special:  # cut short, it is ordinary text and joins the word before it
                            start, base = back, back_base
                        return self._last_within(text, start, pos, base, budget)
                    back, back_base = start, base
                    start, base = pos, total
        return self._last_within(text, start, pos, base, budget)

    def _last_within(self, text: str, start: int, end: int, base: int, budget: int) -> int:
        ok = np.flatnonzero(self.prefix_counts(text[start:end]) + base <= budget)
        return start + int(ok[-1]) if len(ok) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary: Optional[str] = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, limit_chars.

    n_tokens is the exact count of the whole text, over_limit says that it is
    above ``limit``, limit_chars is the longest prefix, in code points, with
    at most ``limit`` tokens (the whole text where it fits). Null is an empty
    text with 0 tokens; null ids and repeated rows are kept; an empty table gives an empty
    result; other columns are not looked at. ``vocabulary`` is a path that
    executors can read (default: the installed public file).
    """
    @pandas_udf("n_tokens long, limit_chars long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        for texts in batches:
            n, cut = [], []
            for t in texts.tolist():
                t = t or ""
                k = c.count(t)
                n.append(k)
                cut.append(len(t) if k <= limit else c.longest_within(t, limit))
            yield pd.DataFrame({"n_tokens": n, "limit_chars": cut}, dtype="int64")

    text = F.coalesce("text", F.lit(""))
    return (documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("c"))
            .select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"),
                    "c.limit_chars"))
