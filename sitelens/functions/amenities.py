"""Controlled categories from free text: water, restroom, fee, capacity.

Every rule is an ordered CASE over substring and regex tests, evaluated by
the JVM. The phrase lists are fixed values that must equal the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, phrase_text

# Domains (fixed values).
CAMPGROUND_TYPES = ("CAMPGROUND", "GROUP CAMPGROUND", "HORSE CAMP")
FEE_VALUES = ("YES", "NO", "UNKNOWN")
WATER_CATEGORIES = ("AVAILABLE", "NOT_AVAILABLE", "NATURAL_SOURCE", "NEARBY", "OTHER",
                    "UNKNOWN")
RESTROOM_CATEGORIES = ("FLUSH", "VAULT", "COMPOSTING", "PORTABLE", "MULTIPLE", "NONE",
                       "OTHER", "UNKNOWN")

# Fixed values that must equal the reference: phrase lists of the water rule,
# in rule order.
UNKNOWN_WORDS = ("unknown", "n/a", "na", "not specified")
WATER_NEARBY = ("nearby", "adjacent", "about 1 mile away", "work center")
WATER_NATURAL = ("treat", "filter", "untreated", "creek", "river", "spring", "stream",
                 "lake", "natural source")
WATER_NEGATIVE_EXACT = ("no", "none", "not available", "not provided", "not potable")
WATER_NEGATIVE_PATTERN = r"(?U)\b(no|not)\b.{0,45}\b(water|drinking|potable|provided|available)\b"
WATER_NEGATIVE_PHRASES = ("water is not available", "water not available", "unavailable",
                          "currently offline", "water system is closed", "none provided",
                          "none available", "handpump has been discontinued")
WATER_POSITIVE_PHRASES = ("drinking water", "potable water", "water available",
                          "water is available", "available during", "hand pump", "handpump",
                          "handpumps", "faucet", "hydrant", "pressurized water",
                          "gravity water", "solar well", "well water", "water spigot",
                          " pumps", "onsite")
WATER_POSITIVE_EXACT = ("available", "potable", "drinking", "water", "yes, seasonally")
WATER_OTHER_PHRASES = ("non-potable", "non potable", "boil", "livestock", "stock", "trough")

# Fixed values that must equal the reference: restroom rule phrases.
RESTROOM_NEGATIVE_EXACT = ("no", "none", "not available", "no restroom", "no restrooms")
RESTROOM_NEGATIVE_PATTERNS = (r"(?U)\bno\b.{0,35}\b(restroom|toilet|facilit)",
                              r"(?U)\b(restroom|toilet)s?\b.{0,20}\bnot available\b")
RESTROOM_KINDS = (
    ("FLUSH", ("flush", "flushing")),
    ("VAULT", ("vault", "pit toilet", "pit", "outhouse")),
    ("COMPOSTING", ("compost",)),
    ("PORTABLE", ("portable", "porta-pot", "porta pot")),
)
RESTROOM_OTHER_PHRASES = ("restroom", "toilet", "facilit", "shower")
RESTROOM_AVAILABLE_EXCLUDES = ("reservation", "camp site", "campsite")


def _any_contains(text: Column, tokens) -> Column:
    """Substring test for any token, as one regex alternation of quoted
    literals (one pass over the text, compact generated code)."""
    return text.rlike("|".join(r"\Q" + tok + r"\E" for tok in tokens))


def _without_trailing_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+$", "")


def normalize_water(col) -> Column:
    return water_from_phrase(phrase_text(col))


def normalize_restroom(col) -> Column:
    return restroom_from_phrase(phrase_text(col))


def water_from_phrase(t: Column) -> Column:
    """Water category of already cleaned, case-folded text. Give it a column
    computed in an earlier projection so the text is built once per row."""
    negative = (t.isin(*WATER_NEGATIVE_EXACT) | t.rlike(WATER_NEGATIVE_PATTERN)
                | _any_contains(t, WATER_NEGATIVE_PHRASES))
    positive = ((_without_trailing_dots(t) == "yes")
                | _any_contains(t, WATER_POSITIVE_PHRASES)
                | t.isin(*WATER_POSITIVE_EXACT)
                | t.startswith("available early"))
    other = _any_contains(t, WATER_OTHER_PHRASES) | (t == "portable water")
    return (F.when((t == "") | t.isin(*UNKNOWN_WORDS), "UNKNOWN")
            .when(_any_contains(t, WATER_NEARBY), "NEARBY")
            .when(_any_contains(t, WATER_NATURAL), "NATURAL_SOURCE")
            .when(negative, "NOT_AVAILABLE")
            .when(positive, "AVAILABLE")
            .when(other, "OTHER")
            .otherwise("UNKNOWN"))


def restroom_from_phrase(t: Column) -> Column:
    """Restroom category of already cleaned, case-folded text."""
    unknown = (t == "") | t.isin(*UNKNOWN_WORDS) | t.startswith("unknown toilet")
    negative = t.isin(*RESTROOM_NEGATIVE_EXACT)
    for pattern in RESTROOM_NEGATIVE_PATTERNS:
        negative = negative | t.rlike(pattern)
    hits = [(name, _any_contains(t, toks)) for name, toks in RESTROOM_KINDS]
    n_kinds = sum((F.when(h, 1).otherwise(0) for _, h in hits), F.lit(0))
    other = ((_without_trailing_dots(t) == "yes")
             | _any_contains(t, RESTROOM_OTHER_PHRASES)
             | (t.contains("available") & ~_any_contains(t, RESTROOM_AVAILABLE_EXCLUDES)))
    expr = F.when(unknown, "UNKNOWN").when(negative, "NONE").when(n_kinds > 1, "MULTIPLE")
    for name, h in hits:
        expr = expr.when(h, name)
    return expr.when(other, "OTHER").otherwise("UNKNOWN")


def convert_fee(col) -> Column:
    u = F.upper(clean_text(col))
    return F.when(u == "Y", "YES").when(u == "N", "NO").otherwise("UNKNOWN")


SAFE_NUMBER_PATTERN = r"^(?:0|[1-9]\d*)(?:\.\d+)?$"


def parse_total_capacity(col) -> Column:
    """Plain non-negative decimal text with trailing fractional zeros removed;
    anything ambiguous becomes ''."""
    t = clean_text(col)
    trimmed = F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")
    return (F.when(~t.rlike(SAFE_NUMBER_PATTERN), F.lit(""))
            .when(t.contains("."), trimmed)
            .otherwise(t))
