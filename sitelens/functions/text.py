"""Text normalisers as Column expressions (JVM-side, codegen-friendly).

Java regular expressions differ from Python's in what counts as whitespace,
so the whitespace class below spells out the Unicode characters Python's
``\\s`` matches. Only entity decoding and tag stripping need Python; they run
as Arrow-batched pandas UDFs on executors.
"""

from __future__ import annotations

import functools
import html
import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str whitespace, written for Java regex.
WS_CLASS = (r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}]")
WS_RUN = WS_CLASS + "+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(col) -> Column:
    """Collapse whitespace runs to one space and trim (NULL stays NULL)."""
    return F.trim(F.regexp_replace(_c(col), WS_RUN, " "))


def is_blank(col) -> Column:
    """NULL, empty or nothing but whitespace of any kind."""
    c = _c(col)
    return c.isNull() | c.rlike(f"^{WS_CLASS}*$")


def clean_text(col) -> Column:
    """Trim and collapse whitespace; NULL becomes ''."""
    return collapse_ws(F.coalesce(_c(col), F.lit("")))


def preserve_identifier(col) -> Column:
    """Trim edge whitespace only, keeping leading zeros; NULL becomes ''."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")),
                            f"^{WS_RUN}|{WS_RUN}$", "")


def normalize_site_subtype(col) -> Column:
    return F.upper(clean_text(col))


@functools.cache
def _folds() -> tuple[str, str, dict]:
    """Full case folding of single characters: those that become one character (from, to), and those
    that become several. Both follow from Python's own rule over all code points."""
    folds = {chr(p): chr(p).casefold() for p in range(sys.maxunicode + 1) if chr(p) != chr(p).casefold()}
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folds.items() if len(f) > 1}


def casefold(col) -> Column:
    """Full Unicode case folding: one character for one by translation, the few that become several by a
    lookup, which only texts that hold one go through. ASCII texts are lower-cased."""
    c = _c(col)
    source, target, several = _folds()
    plain = F.translate(c, source, target)
    lookup = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spread = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(lookup, x), x)), "")
    held = plain.rlike("[" + "".join(f"\\x{{{ord(x):x}}}" for x in several) + "]")
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(F.when(held, spread).otherwise(plain))


def phrase_text(col) -> Column:
    """Cleaned, case-folded text for phrase rules."""
    return casefold(clean_text(col))


def first_non_blank(*cols) -> Column:
    """First value that is non-blank after cleaning, else ''."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cols], F.lit(""))


def normalize_match_name(col) -> Column:
    """Upper case, runs of non-alphanumerics to one space, trimmed."""
    return collapse_ws(F.regexp_replace(F.upper(clean_text(col)), "[^A-Z0-9]+", " "))


def ascii_fold_key(col) -> Column:
    """Sort key that folds ASCII letters only (SQL ``COLLATE NOCASE``)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(_c(col), upper, upper.lower())


# --- entity decoding and markup removal (Python only where Java has no equal)

class _TextCollector(HTMLParser):
    """Text between tags. Adjacent pieces (a stray ``<`` splits them) are one text;
    a tag or a comment ends it. Text of scripts, styles and templates is left out."""

    HIDDEN = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[list[str]] = [[]]
        self.hidden = 0

    def _cut(self):
        if self.texts[-1]:
            self.texts.append([])

    def handle_starttag(self, tag, attrs):
        self._cut()
        self.hidden += tag in self.HIDDEN

    def handle_startendtag(self, tag, attrs):
        self._cut()

    def handle_endtag(self, tag):
        self._cut()
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_comment(self, data):
        self._cut()

    def handle_data(self, data):
        if not self.hidden:
            self.texts[-1].append(data)

    def joined(self) -> str:
        return " ".join("".join(t) for t in self.texts)


_PY_WS = re.compile(r"\s+")


def html_text_value(value):
    """Decode entities, then drop markup; texts between tags are joined by a space."""
    if value is None:
        return None
    decoded = html.unescape(value)
    if "<" in decoded:
        parser = _TextCollector()
        parser.feed(decoded)
        parser.close()
        decoded = parser.joined()
    return _PY_WS.sub(" ", decoded).strip()


def unescape_value(value):
    if value is None:
        return None
    return html.unescape(value) if "&" in value else value


@F.pandas_udf(T.StringType())
def _html_to_text_udf(s: pd.Series) -> pd.Series:
    return s.map(html_text_value, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(unescape_value, na_action="ignore")


def html_to_text(col) -> Column:
    """Plain text of an HTML fragment (entities decoded, tags removed)."""
    return _html_to_text_udf(_c(col))


def unescape_html(col) -> Column:
    return _unescape_udf(_c(col))


def normalize_park_text(col, decode_entities: bool = True) -> Column:
    """Decode entities; BOM and NBSP become spaces; collapse and trim."""
    c = F.coalesce(_c(col), F.lit(""))
    if decode_entities:
        c = unescape_html(c)
    c = F.regexp_replace(c, r"[\x{feff}\x{a0}]", " ")
    return collapse_ws(c)


# Fixed values that must equal the reference: citation markers such as [14] or
# [3–5], trailing marker stars, and the CSS marker that ends a location label.
CITATION_PATTERN = r"\[\s*\d+(?:\s*[\x{2013}-]\s*\d+)?\s*\]"
TRAILING_STARS_PATTERN = r"\s*\*+\s*$"
CSS_MARKER = ".mw-parser-output"


def clean_park_name(col, decode_entities: bool = True) -> Column:
    return F.trim(F.regexp_replace(normalize_park_text(col, decode_entities),
                                   TRAILING_STARS_PATTERN, ""))


def remove_citation_markers(col, decode_entities: bool = True) -> Column:
    return normalize_park_text(
        F.regexp_replace(F.coalesce(_c(col), F.lit("")), CITATION_PATTERN, ""),
        decode_entities)


def clean_location_label(col, decode_entities: bool = True) -> Column:
    """Drop style/script blocks and tags, cut at the CSS marker, trim ' ,;/'."""
    c = F.coalesce(_c(col), F.lit(""))
    if decode_entities:
        c = unescape_html(c)
    c = F.regexp_replace(c, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.substring_index(c, CSS_MARKER, 1)
    c = normalize_park_text(c, decode_entities=False)
    return F.regexp_replace(c, r"^[ ,;/]+|[ ,;/]+$", "")


def has_unusual_whitespace(col) -> Column:
    """Whitespace of any kind at an edge or twice in a row, format/line/paragraph
    separators, or a space separator other than the plain space."""
    c = _c(col)
    return (c.rlike(rf"\A{WS_CLASS}|{WS_CLASS}\z|{WS_CLASS}{{2}}")
            | c.rlike(r"[\p{Cf}\p{Zl}\p{Zp}]")
            | c.rlike(r"[\p{Zs}&&[^ ]]"))
