"""Row routing for cleaning jobs: keep, quarantine with a reason, or flag.

Every rule is a CASE expression over the raw text, so one scan labels every
row and the kept and quarantined outputs are two filters of one plan (cache
or checkpoint it when both are written).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amenities as A
from ..functions import parse as PR
from ..functions import text as TX
from .spatial import duplicate_pairs

# Fixed values that must equal the reference: campground subtypes kept, the
# identifier column, drop categories/reasons and unmatched-link reasons.
ALLOWED_SUBTYPES = ("CAMPGROUND", "GROUP CAMPGROUND", "HORSE CAMP")
SELECTED_IDENTIFIER_COLUMN = "globalid"
UNSUPPORTED = "UNSUPPORTED_SITE_SUBTYPE"
INVALID_REQUIRED = "INVALID_REQUIRED_DATA"
UNMATCHED_REASONS = ("MISSING_USDA_PORTAL_URL", "RECID_NOT_FOUND_IN_USDA_PORTAL_URL",
                     "RECID_NOT_IN_RECREATION_AREAS")
DUPLICATE_THRESHOLD_KM = 1.0

CAMPGROUND_COLUMNS = (
    "campground_id", "globalid", "site_cn", "site_id", "objectid", "root_cn", "parent_cn",
    "name", "public_site_name", "site_name", "recarea_name", "site_subtype",
    "site_subtype_raw", "recarea_id", "recid_extracted", "fee_charged", "fee_charged_raw",
    "fee_type", "fee_description", "total_capacity", "total_capacity_raw",
    "water_availability", "water_availability_raw", "restroom_availability",
    "restroom_availability_raw", "directions", "site_directions", "closest_towns",
    "operational_hours", "official_url", "usda_portal_url", "rec1stop_url", "latitude",
    "longitude", "last_update")
UNMATCHED_COLUMNS = ("campground_id", "site_cn", "site_id", "name", "site_subtype",
                     "usda_portal_url", "recid_extracted", "unmatched_reason")
DROPPED_COLUMNS = ("source_row_number", "drop_category", "drop_reason", "globalid", "site_cn",
                   "site_id", "public_site_name", "site_name", "site_subtype", "latitude",
                   "longitude")


def _s(name: str) -> Column:
    return F.col(name)


def site_drop_columns(raw: DataFrame) -> list[Column]:
    """drop_category / drop_reason: the first failing rule wins (subtype,
    then missing id, then coordinates); NULL for kept rows. Expects the
    helper columns added by ``route_sites``."""
    subtype, ident, lat, lon = _s("_sub"), _s("_id"), _s("_lat"), _s("_lon")
    # One small code per row; every parsed value is referenced exactly once,
    # so optimizer rewrites (filter pushdown inlines aliases) stay compact.
    code = (F.when(~subtype.isin(*ALLOWED_SUBTYPES), F.lit(5))
            .when(ident == "", F.lit(4))
            .otherwise(F.when(lat.isNull(), 1).otherwise(0)
                       + F.when(lon.isNull(), 2).otherwise(0)))
    reasons = F.array(F.lit(None).cast("string"), F.lit("INVALID_LATITUDE"),
                      F.lit("INVALID_LONGITUDE"), F.lit("INVALID_LATITUDE_AND_LONGITUDE"),
                      F.lit("MISSING_GLOBALID"), F.lit(UNSUPPORTED))
    categories = F.array(F.lit(None).cast("string"), *[F.lit(INVALID_REQUIRED)] * 4,
                         F.lit(UNSUPPORTED))
    return [F.element_at(categories, code + 1).alias("drop_category"),
            F.element_at(reasons, code + 1).alias("drop_reason")]


def route_sites(raw: DataFrame) -> DataFrame:
    """Raw rows with drop_category and drop_reason (NULL = kept). Parsed
    values are computed once in their own projection and reused."""
    pre = raw.select("*",
                     TX.normalize_site_subtype(_s("site_subtype")).alias("_sub"),
                     TX.preserve_identifier(_s(SELECTED_IDENTIFIER_COLUMN)).alias("_id"),
                     PR.parse_latitude(_s("latitude")).alias("_lat"),
                     PR.parse_longitude(_s("longitude")).alias("_lon"))
    return pre.select("*", *site_drop_columns(pre)).drop("_sub", "_id", "_lat", "_lon")


def dropped_sites(routed: DataFrame) -> DataFrame:
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("source_row_number",)
            else F.col(c) for c in DROPPED_COLUMNS]
    return routed.where(F.col("drop_reason").isNotNull()).select(*cols)


def conform_sites(kept: DataFrame, area_ids: DataFrame) -> DataFrame:
    """Cleaned campground rows (reference column order) from kept raw rows.
    The area lookup is a distinct key set joined left; a link survives only
    when the extracted id is a known area."""
    url = TX.clean_text(_s("usda_portal_url"))
    recid = PR.extract_query_param(_s("usda_portal_url"))
    base = kept.select(
        "*",
        url.alias("_url"), recid.alias("_recid"),
        TX.phrase_text(_s("water_availability")).alias("_wt"),
        TX.phrase_text(_s("restroom_availability")).alias("_rt"))
    ids = area_ids.select(F.col("recarea_id").cast("string").alias("_area"),
                          F.lit(True).alias("_known")).distinct()
    # blank ids link with nothing: they are spread instead of meeting at one key
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(SELECTED_IDENTIFIER_COLUMN), F.lit(1009)))
    base = base.withColumn("_link", F.when(F.col("_recid") == "", spread).otherwise(F.col("_recid")))
    j = base.join(ids, F.col("_link") == F.col("_area"), "left")
    ident = TX.preserve_identifier(_s(SELECTED_IDENTIFIER_COLUMN))
    linked = (F.col("_recid") != "") & F.coalesce(F.col("_known"), F.lit(False))
    return j.select(
        ident.alias("campground_id"),
        ident.alias("globalid"),
        *[TX.preserve_identifier(_s(c)).alias(c)
          for c in ("site_cn", "site_id", "objectid", "root_cn", "parent_cn")],
        TX.first_non_blank(_s("public_site_name"), _s("site_name"), _s("recarea_name"))
        .alias("name"),
        *[TX.clean_text(_s(c)).alias(c) for c in ("public_site_name", "site_name",
                                                   "recarea_name")],
        TX.normalize_site_subtype(_s("site_subtype")).alias("site_subtype"),
        F.coalesce(_s("site_subtype"), F.lit("")).alias("site_subtype_raw"),
        F.when(linked, F.col("_recid")).otherwise(F.lit("")).alias("recarea_id"),
        F.col("_recid").alias("recid_extracted"),
        A.convert_fee(_s("fee_charged")).alias("fee_charged"),
        F.coalesce(_s("fee_charged"), F.lit("")).alias("fee_charged_raw"),
        TX.clean_text(_s("fee_type")).alias("fee_type"),
        TX.clean_text(_s("fee_description")).alias("fee_description"),
        A.parse_total_capacity(_s("total_capacity")).alias("total_capacity"),
        F.coalesce(_s("total_capacity"), F.lit("")).alias("total_capacity_raw"),
        A.water_from_phrase(_s("_wt")).alias("water_availability"),
        F.coalesce(_s("water_availability"), F.lit("")).alias("water_availability_raw"),
        A.restroom_from_phrase(_s("_rt")).alias("restroom_availability"),
        F.coalesce(_s("restroom_availability"), F.lit("")).alias("restroom_availability_raw"),
        *[TX.clean_text(_s(c)).alias(c) for c in ("directions", "site_directions",
                                                   "closest_towns", "operational_hours")],
        F.col("_url").alias("official_url"),
        F.col("_url").alias("usda_portal_url"),
        TX.clean_text(_s("rec1stop_url")).alias("rec1stop_url"),
        TX.clean_text(_s("latitude")).alias("latitude"),
        TX.clean_text(_s("longitude")).alias("longitude"),
        TX.clean_text(_s("last_update")).alias("last_update"),
    )


def unmatched_sites(campgrounds: DataFrame) -> DataFrame:
    """Kept campgrounds without an area link, with the reason."""
    reason = (F.when(F.col("usda_portal_url") == "", F.lit(UNMATCHED_REASONS[0]))
              .when(F.col("recid_extracted") == "", F.lit(UNMATCHED_REASONS[1]))
              .otherwise(F.lit(UNMATCHED_REASONS[2])))
    return (campgrounds.where(F.col("recarea_id") == "")
            .select(*UNMATCHED_COLUMNS[:-1], reason.alias("unmatched_reason")))


def site_duplicates(campgrounds: DataFrame) -> DataFrame:
    c = campgrounds.select("campground_id", "name",
                           PR.parse_number("latitude").alias("_lat"),
                           PR.parse_number("longitude").alias("_lon"))
    return duplicate_pairs(c, key="campground_id", name="name", lat="_lat", lon="_lon",
                           threshold_km=DUPLICATE_THRESHOLD_KM)


@dataclass
class CleanResult:
    tables: dict = field(default_factory=dict)
    audits: dict = field(default_factory=dict)


def clean_sites(raw: DataFrame, area_ids: DataFrame, materialize: bool = False) -> CleanResult:
    """Campground cleaning: route, conform, link, audit. Lazy by default.
    With ``materialize`` the conformed rows are checkpointed (reliable, to
    the session's checkpoint dir) once, and every output reads them instead
    of re-parsing the source per output."""
    routed = route_sites(raw)
    kept = routed.where(F.col("drop_reason").isNull())
    camps = conform_sites(kept, area_ids)
    if materialize:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(raw.sparkSession)
        camps = camps.checkpoint(eager=True)
    return CleanResult(
        tables={"campgrounds": camps},
        audits={"dropped": dropped_sites(routed), "unmatched": unmatched_sites(camps),
                "duplicates": site_duplicates(camps)})


def row_accounting(source: DataFrame, kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row: rows of the source, kept, dropped, and neither (or twice)."""
    from .quality import combine_one_row
    n = lambda df, name: df.agg(F.count(F.lit(1)).cast("bigint").alias(name))
    return combine_one_row(n(source, "source_rows"), n(kept, "kept_rows"), n(dropped, "dropped_rows")).withColumn(
        "unaccounted_rows", F.col("source_rows") - F.col("kept_rows") - F.col("dropped_rows"))


# ------------------------------------------------------------- missing keys

def relationship_routing(df: DataFrame, left_key: str, right_key: str,
                         left_label: str, right_label: str) -> DataFrame:
    """Reason a relationship row cannot enter the bridge (NULL when both
    keys are present): MISSING_<left>, MISSING_<right> or both."""
    lk = TX.preserve_identifier(F.col(left_key))
    rk = TX.preserve_identifier(F.col(right_key))
    reason = (F.when((lk == "") & (rk == ""), F.lit(f"MISSING_{left_label}_AND_{right_label}"))
              .when(lk == "", F.lit(f"MISSING_{left_label}"))
              .when(rk == "", F.lit(f"MISSING_{right_label}")))
    return df.select("*", reason.alias("drop_reason"))


# ------------------------------------------------------------- parse failures

def parse_failures(df: DataFrame, key_cols: Sequence[str],
                   checks: Sequence[tuple]) -> DataFrame:
    """One row per (record, failed check); the record itself stays in the
    main output. ``checks`` holds (source_field, raw column, failed
    condition, reason); a failed check emits the raw value ('' for NULL)."""
    items = [F.when(F.coalesce(failed, F.lit(False)),
                    F.struct(F.lit(field_name).alias("source_field"),
                             F.coalesce(F.col(raw), F.lit("")).alias("raw_value"),
                             F.lit(reason).alias("failure_reason")))
             for field_name, raw, failed, reason in checks]
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return (df.select(*key_cols, F.explode(arr).alias("_f"))
            .select(*key_cols, "_f.source_field", "_f.raw_value", "_f.failure_reason"))


# Fixed values that must equal the reference: source headers of the parks
# table (they name the failing field) and its failure reasons.
PARK_FIELDS = {"name": "Name", "location": "Location",
               "established": "Date established as park[7][12]",
               "area": "Area (2021)[13]", "visitors": "Recreation visitors (2021)[11]",
               "description": "Description"}


def clean_parks(raw: DataFrame, id_prefix: str = PR.DEFAULT_ID_PREFIX) -> CleanResult:
    """Parks job: names, ids, location label and coordinates, date, area,
    visitors; rows without a name are dropped, other parse failures are
    reported per field while the row is kept.

    ``raw`` has text columns name, location, established, area, visitors,
    description and source_row_number."""
    parsed = raw.select(
        "*",
        TX.clean_park_name(_s("name")).alias("_name"),
        PR.parse_long_date(_s("established")).alias("_date"),
        PR.parse_acreage(_s("area")).alias("_acres"),
        PR.parse_visitors(_s("visitors")).alias("_visitors"),
        TX.remove_citation_markers(_s("description")).alias("_description"))
    parsed = PR.with_location(
        parsed.select("*", PR.make_entity_id(_s("_name"), id_prefix,
                                             decode_entities=False).alias("_park_id")),
        "location", "_loc")
    named = parsed.where(_s("_name") != "")
    parks = named.select(
        "source_row_number",
        _s("_park_id").alias("park_id"), _s("_name").alias("name"),
        _s("_loc.label").alias("state_or_territory"),
        _s("_loc.latitude").alias("latitude"), _s("_loc.longitude").alias("longitude"),
        _s("_date").alias("established_date"), _s("_acres").alias("area_acres"),
        _s("_visitors").alias("recreation_visitors_2021"),
        _s("_description").alias("description"))
    keys = ["source_row_number", "park_id", "name"]
    named_k = (named.drop("name").withColumnRenamed("_park_id", "park_id")
               .withColumnRenamed("_name", "name"))
    field_failures = parse_failures(named_k, keys, [
        (PARK_FIELDS["location"], "location", _s("_loc.label") == "", "MISSING_LOCATION_TEXT"),
        (PARK_FIELDS["location"], "location",
         _s("_loc.latitude").isNull() | _s("_loc.longitude").isNull(),
         "UNPARSEABLE_OR_OUT_OF_RANGE_COORDINATES"),
        (PARK_FIELDS["established"], "established", _s("_date").isNull(), "UNPARSEABLE_DATE"),
        (PARK_FIELDS["area"], "area", _s("_acres").isNull(), "UNPARSEABLE_ACREAGE"),
        (PARK_FIELDS["visitors"], "visitors", _s("_visitors").isNull(),
         "UNPARSEABLE_VISITOR_COUNT"),
    ])
    missing = parsed.where(_s("_name") == "").select(
        "source_row_number", F.lit("").alias("park_id"), F.lit("").alias("name"),
        F.lit(PARK_FIELDS["name"]).alias("source_field"),
        F.coalesce(_s("name"), F.lit("")).alias("raw_value"),
        F.lit("MISSING_PARK_NAME").alias("failure_reason"))
    return CleanResult(tables={"parks": parks},
                       audits={"failures": missing.unionByName(field_failures)})
