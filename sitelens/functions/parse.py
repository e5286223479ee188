"""Parsers for coordinates, identifiers, dates, areas and counts (Columns)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (clean_text, normalize_park_text, preserve_identifier,
                   remove_citation_markers, clean_location_label)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Python float() syntax for finite decimal numbers (underscores between digits
# are removed first, as Python allows them).
_FLOAT_PATTERN = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def parse_number(col) -> Column:
    """Finite double from cleaned text, else NULL (never raises). Text that is a number as it stands is not cleaned first."""
    c = _c(col)
    t = F.regexp_replace(clean_text(c), r"(?<=\d)_(?=\d)", "")
    return (F.when(c.rlike(_FLOAT_PATTERN.removesuffix("$") + r"\z"), c.try_cast("double"))
            .when(t.rlike(_FLOAT_PATTERN), t.try_cast("double")))


def parse_coordinate(col, minimum: float, maximum: float) -> Column:
    """Finite coordinate inside [minimum, maximum], else NULL."""
    v = parse_number(col)
    return F.when(v.between(F.lit(minimum), F.lit(maximum)), v)


def parse_latitude(col) -> Column:
    return parse_coordinate(col, -90.0, 90.0)


def parse_longitude(col) -> Column:
    return parse_coordinate(col, -180.0, 180.0)


# Fixed value that must equal the reference: the query key looked up in portal
# URLs (matched case-insensitively, first occurrence wins, value decoded).
RECID_KEY = "recid"


def extract_query_param(col, key: str = RECID_KEY) -> Column:
    """Value of the first query parameter named ``key`` (any case), decoded
    and trimmed; '' when absent. Fragment is ignored; a bare key gives ''."""
    url = clean_text(col)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.regexp_extract(F.concat(F.lit("&"), query),
                           rf"(?i)&{key}(?:=([^&]*))?(?:&|$)", 1)
    found = F.concat(F.lit("&"), query).rlike(rf"(?i)&{key}(?:=[^&]*)?(?:&|$)")
    decoded = F.coalesce(F.try_url_decode(raw), raw)
    return F.when(found & (url != ""), preserve_identifier(decoded)).otherwise(F.lit(""))


# UUID version 5 (RFC 4122) of a namespace and a name, computed with sha1.
_VARIANT_FROM = "0123456789abcdef"
_VARIANT_TO = "89ab89ab89ab89ab"


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    return F.concat_ws("-",
                       F.substring(h, 1, 8),
                       F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(F.translate(F.substring(h, 17, 1), _VARIANT_FROM, _VARIANT_TO),
                                F.substring(h, 18, 3)),
                       F.substring(h, 21, 12))


DEFAULT_ID_PREFIX = "https://sitelens.local/national-park/"


def make_entity_id(name, prefix: str = DEFAULT_ID_PREFIX,
                   decode_entities: bool = True) -> Column:
    """Stable UUIDv5 of ``prefix + casefolded normalised name``; '' when blank.

    Callers that must reproduce ids minted elsewhere pass that system's prefix.
    """
    identity = F.lower(normalize_park_text(name, decode_entities))
    return F.when(identity == "", F.lit("")).otherwise(
        uuid5(F.concat(F.lit(prefix), identity)))


def parse_long_date(col, decode_entities: bool = True) -> Column:
    """'December 20, 2019[112]' -> DATE 2019-12-20; anything else NULL."""
    t = remove_citation_markers(col, decode_entities)
    return F.when(t != "", F.try_to_date(t, "MMMM d, yyyy"))


ACREAGE_PATTERN = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*acres?\b"


def parse_acreage_text(col, decode_entities: bool = True) -> Column:
    """Numeric acres text with commas removed and scale kept, else NULL."""
    m = F.regexp_extract(normalize_park_text(col, decode_entities), ACREAGE_PATTERN, 1)
    return F.when(m != "", F.regexp_replace(m, ",", ""))


def parse_acreage(col, decode_entities: bool = True) -> Column:
    return parse_acreage_text(col, decode_entities).try_cast("double")


def parse_visitors(col, decode_entities: bool = True) -> Column:
    t = normalize_park_text(col, decode_entities)
    return F.when(t.rlike(r"^\d[\d,]*$"), F.regexp_replace(t, ",", "").try_cast("bigint"))


# Coordinates in running text: the last decimal-degree pair wins, else the
# first degree-minute(-second) pair. Fixed patterns (degree, prime and double
# prime signs are U+00B0, U+2032, U+2033).
DECIMAL_PAIR = (r"(?i)(\d{1,2}(?:\.\d+)?)\s*\x{b0}\s*([NS])\s*[,;/]?\s*"
                r"(\d{1,3}(?:\.\d+)?)\s*\x{b0}\s*([EW])")
DMS_PAIR = (r"(?i)(\d{1,2})\s*\x{b0}\s*(\d{1,2})(?:\s*[\x{2032}'])"
            r"(?:\s*(\d{1,2}(?:\.\d+)?)\s*[\x{2033}\"])?\s*([NS])\s*[,;/]?\s*"
            r"(\d{1,3})\s*\x{b0}\s*(\d{1,2})(?:\s*[\x{2032}'])"
            r"(?:\s*(\d{1,2}(?:\.\d+)?)\s*[\x{2033}\"])?\s*([EW])")
COORDINATE_START = r"(?<!\d)\d{1,2}\s*\x{b0}"


def _directed(value: Column, direction: Column) -> Column:
    return F.when(F.upper(direction).isin("S", "W"), -F.abs(value)).otherwise(F.abs(value))


def _in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def parse_coordinates(col, decode_entities: bool = True) -> Column:
    """struct<latitude double, longitude double>; both NULL when unparsable."""
    text = normalize_park_text(col, decode_entities)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(DECIMAL_PAIR), F.lit(0)), F.lit(-1))
    has_dec = F.coalesce(F.size(F.regexp_extract_all(text, F.lit(DECIMAL_PAIR), F.lit(0))) > 0,
                         F.lit(False))

    def g(src, pattern, i):
        return F.regexp_extract(src, pattern, i)

    d_lat = _directed(g(last, DECIMAL_PAIR, 1).cast("double"), g(last, DECIMAL_PAIR, 2))
    d_lon = _directed(g(last, DECIMAL_PAIR, 3).cast("double"), g(last, DECIMAL_PAIR, 4))

    has_dms = text.rlike(DMS_PAIR)

    def num(i):
        s = g(text, DMS_PAIR, i)
        return F.when(s == "", F.lit(0.0)).otherwise(s.cast("double"))

    lat_min, lat_sec, lon_min, lon_sec = num(2), num(3), num(6), num(7)
    minutes_ok = (lat_min < 60) & (lon_min < 60) & (lat_sec < 60) & (lon_sec < 60)
    m_lat = _directed(num(1) + lat_min / 60 + lat_sec / 3600, g(text, DMS_PAIR, 4))
    m_lon = _directed(num(5) + lon_min / 60 + lon_sec / 3600, g(text, DMS_PAIR, 8))

    lat = (F.when(has_dec, F.when(_in_range(d_lat, d_lon), d_lat))
           .when(has_dms & minutes_ok, F.when(_in_range(m_lat, m_lon), m_lat)))
    lon = (F.when(has_dec, F.when(_in_range(d_lat, d_lon), d_lon))
           .when(has_dms & minutes_ok, F.when(_in_range(m_lat, m_lon), m_lon)))
    return F.struct(lat.alias("latitude"), lon.alias("longitude"))


def parse_location(col, decode_entities: bool = True) -> Column:
    """struct<label, latitude, longitude>: label is the text before the first
    degree value, cleaned of markup."""
    text = normalize_park_text(col, decode_entities)
    pos = F.regexp_instr(text, F.lit(COORDINATE_START))
    label_src = F.when(pos > 0, F.substring(text, F.lit(1), pos - 1)).otherwise(text)
    coords = parse_coordinates(text, decode_entities=False)
    return F.struct(clean_location_label(label_src, decode_entities=False).alias("label"),
                    coords["latitude"].alias("latitude"),
                    coords["longitude"].alias("longitude"))


def with_location(df, src: str, out: str = "_loc", decode_entities: bool = True):
    """DataFrame transform adding struct ``out`` <label, latitude, longitude>
    parsed from column ``src``. Same rules as ``parse_location``, staged in
    successive projections so each regex runs once per row and generated
    code stays small."""
    t = f"{out}_t"
    s1 = df.select("*", normalize_park_text(F.col(src), decode_entities).alias(t))
    tc = F.col(t)
    dec = [F.try_element_at(F.regexp_extract_all(tc, F.lit(DECIMAL_PAIR), F.lit(i)), F.lit(-1))
           .alias(f"{out}_d{i}") for i in range(1, 5)]
    dms = [F.regexp_extract(tc, DMS_PAIR, i).alias(f"{out}_m{i}") for i in range(1, 9)]
    pos = F.regexp_instr(tc, F.lit(COORDINATE_START))
    s2 = s1.select("*", *dec, *dms,
                   F.when(pos > 0, F.substring(tc, F.lit(1), pos - 1)).otherwise(tc)
                   .alias(f"{out}_lsrc"))

    def c(n):
        return F.col(f"{out}_{n}")

    def num(n):
        return F.when(c(n) == "", F.lit(0.0)).otherwise(c(n).cast("double"))

    s3 = s2.select(
        "*",
        F.coalesce(c("d1").isNotNull(), F.lit(False)).alias(f"{out}_hasdec"),
        _directed(c("d1").cast("double"), c("d2")).alias(f"{out}_dlat"),
        _directed(c("d3").cast("double"), c("d4")).alias(f"{out}_dlon"),
        (c("m1") != "").alias(f"{out}_hasdms"),
        ((num("m2") < 60) & (num("m3") < 60) & (num("m6") < 60) & (num("m7") < 60))
        .alias(f"{out}_mok"),
        _directed(num("m1") + num("m2") / 60 + num("m3") / 3600, c("m4")).alias(f"{out}_mlat"),
        _directed(num("m5") + num("m6") / 60 + num("m7") / 3600, c("m8")).alias(f"{out}_mlon"))
    dec_ok = _in_range(c("dlat"), c("dlon"))
    dms_ok = c("mok") & _in_range(c("mlat"), c("mlon"))
    pick = F.when(c("hasdec"), F.when(dec_ok, F.lit(1))).when(c("hasdms") & dms_ok, F.lit(2))
    s4 = s3.select("*", pick.alias(f"{out}_pick"))
    lat = F.when(c("pick") == 1, c("dlat")).when(c("pick") == 2, c("mlat"))
    lon = F.when(c("pick") == 1, c("dlon")).when(c("pick") == 2, c("mlon"))
    helpers = [t, f"{out}_lsrc", f"{out}_hasdec", f"{out}_dlat", f"{out}_dlon", f"{out}_hasdms",
               f"{out}_mok", f"{out}_mlat", f"{out}_mlon", f"{out}_pick"]
    helpers += [f"{out}_d{i}" for i in range(1, 5)] + [f"{out}_m{i}" for i in range(1, 9)]
    res = s4.select("*", F.struct(
        clean_location_label(c("lsrc"), decode_entities=False).alias("label"),
        lat.alias("latitude"), lon.alias("longitude")).alias(out))
    return res.drop(*helpers)


# --- typed-load converters (text to column type at table load)

def null_if_missing(col) -> Column:
    """'' becomes NULL; all other text, words like "Nan" too, stays."""
    return F.nullif(_c(col), F.lit(""))


def as_real(col) -> Column:
    """Finite decimal number, else NULL (see ``conversion_failures``)."""
    return parse_number(col)


def as_integer(col) -> Column:
    c = null_if_missing(col)
    return F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))


def as_yn_flag(col) -> Column:
    """'Y' -> 1, 'N' -> 0, NULL/'' -> NULL; other text NULL (see is_yn)."""
    c = null_if_missing(col)
    return F.when(c == "Y", 1).when(c == "N", 0)


def is_accidental_float_id(col) -> Column:
    """Identifier that went through a float (``123.0``)."""
    return _c(col).rlike(r"^\d+\.0$")
