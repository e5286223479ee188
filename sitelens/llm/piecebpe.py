"""SentencePiece (BPE) encoding by a prefix table, recovered backwards, and decoding.

The table of a unit of text stores each prefix's unique last token: of the
vocabulary's pieces that an automaton finds ending there, the one whose pair
with the last token before it survives the merge rules alone. Ids are then
read off backwards from the end of the unit. Units are the spans that no
piece can cross: white space opens a unit, and characters outside the
vocabulary stand alone (they become byte pieces).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Optional

import ahocorasick
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import ByteCache
from .pairs import PairTest

SPACE = "▁"
_CACHE = 400_000         # pairs of pieces that a worker keeps
_CACHE_BYTES = 128 << 20  # of the units that it keeps
_units = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


class _UnitIds(ByteCache):
    """Unit -> its ids as text joined by commas."""

    def __init__(self, owner: "PieceTable"):
        super().__init__(_CACHE_BYTES)
        self.owner = owner
        self.odd: set[str] = set()  # units whose ids do not decode to the unit's own text

    def make(self, unit: str) -> str:
        ids = self.owner.unit_ids(unit)
        if self.owner.pieces_text(ids) != unit.replace(SPACE, " ").encode("utf-8", "replace"):
            self.odd.add(unit)
            self.bytes += 2 * len(unit)
        return ",".join(map(str, ids))

    def size(self, ids: str) -> int:
        return len(ids)

    def drop(self) -> None:
        super().drop()
        self.odd.clear()


class PieceTable:
    """Encoder and decoder for a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.text: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.text.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece] = i
                scores[piece] = model.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if inner or "\n" in self.ids:
            raise ValueError("the vocabulary has pieces that cross units")
        # rank of a merge: place of its score among all, best first
        places = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: places[s] for p, s in scores.items()}
        split = {p: parts for p in self.ids if len(p) > 1 and (parts := self._last_merge(p))}
        self.compatible = PairTest(split, {p: self.rank[p] for p in split},
                                   lambda a, b: self.rank.get(a + b), _CACHE)
        self.units = _UnitIds(self)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or piece in split:
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()

    def _last_merge(self, piece: str) -> Optional[tuple[str, str]]:
        """The two parts that the merge rules (best score first, leftmost of equals) join last; None if never made."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(self.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1)
                     if parts[i] + parts[i + 1] in self.rank]
            if not found:
                return None
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def last_tokens(self, unit: str) -> list[Optional[str]]:
        """The last token of every prefix of a unit (index 0: none)."""
        last: list[Optional[str]] = [None] * (len(unit) + 1)
        done, fits = 0, self.compatible.known
        for end, (size, piece) in self.automaton.iter(unit):
            if end < done:
                continue  # the last token is unique
            left = last[end + 1 - size]
            if left is not None:  # else: the start, or a character outside the vocabulary
                ok = fits.get((left, piece))
                if not (self.compatible(left, piece) if ok is None else ok):
                    continue
            done = end + 1
            last[done] = piece
        return last

    def unit_ids(self, unit: str) -> list[int]:
        last, at, back = self.last_tokens(unit), len(unit), []
        while at:
            token = last[at] or unit[at - 1]
            back.append(token)
            at -= len(token)
        ids: list[int] = []
        for token in reversed(back):
            i = self.ids.get(token)
            if i is None:
                ids.extend(self.byte_ids[b] for b in token.encode("utf-8", "replace"))
            else:
                ids.append(i)
        return ids

    def pieces_text(self, ids: list[int]) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def units_of(self, text: str) -> list[str]:
        """Units of a text: white space is marked, and a mark put in front of a text that is not empty."""
        return _units(SPACE + text.replace(" ", SPACE)) if text else []

    def encoded_text(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the text decoded from them in UTF-8.

        Where the ids of every unit were found to decode to the unit itself, the decoded text is the
        text as it came; otherwise the ids are decoded.
        """
        self.units.trim()
        units = self.units_of(text)
        if not units:
            return 0, "", b""
        ids = ",".join(map(self.units.__getitem__, units))
        if self.units.odd and not self.units.odd.isdisjoint(units):
            back = self.decode([int(i) for i in ids.split(",")])
        else:  # every unit was found to decode to its own text
            back = text.replace(SPACE, " ")
        return ids.count(",") + 1, ids, back.encode("utf-8", "replace")

    def release(self) -> None:
        """Forget what was kept of the texts so far."""
        self.units.drop()
        self.compatible.known.clear()

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units_of(text) for i in self.unit_ids(u)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces joined as UTF-8, one leading space dropped."""
        raw = self.pieces_text(ids)
        first = bool(ids) and self.text[ids[0]].startswith(b" ") and ids[0] not in self.byte_ids
        return (raw[1:] if first else raw).decode("utf-8", "replace")


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """This worker's table for a model file."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encoded(text: Column, model: Optional[str] = None) -> Column:
    """Struct column with n_tokens, ids_sha256 and decoded_sha256 of a text column (null: empty)."""
    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = piece_table(model or public_tokenizers.path("piece_bpe_32k.model"))
        try:
            for texts in batches:
                rows = []
                for text in texts.tolist():
                    n, ids, back = t.encoded_text(text)
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            t.release()
    return run(F.coalesce(text, F.lit("")))


def encode_column(text: Column, model: Optional[str] = None) -> Column:
    """array<int> column with the ids of a text column (null: empty)."""
    @pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = piece_table(model or public_tokenizers.path("piece_bpe_32k.model"))
        for texts in batches:
            yield pd.Series([t.encode(x or "") for x in texts.tolist()])
    return run(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, model: Optional[str] = None) -> Column:
    """Text column from an array<int> column of ids (null: empty)."""
    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = piece_table(model or public_tokenizers.path("piece_bpe_32k.model"))
        for rows in batches:
            yield pd.Series([t.decode([] if r is None else list(r)) for r in rows.tolist()])
    return run(ids)


def encode_documents(documents: DataFrame, model: Optional[str] = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Hashes are lowercase hex of the decimal ids joined by commas and of the
    text decoded from them. Null is an empty text: no ids. Null ids and
    repeated rows are kept; an empty table gives an empty result; other columns are not looked at.
    """
    return (documents.select("doc_id", encoded(F.col("text"), model).alias("e"))
            .select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256"))
