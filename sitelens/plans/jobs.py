"""End-to-end cleaning jobs: CSV contract -> conformed tables + audits.

Each job returns a ``CleanResult`` of lazy DataFrames; ``publish`` writes
them through a staging root after the job's checks pass (nothing is
published when a check fails). Jobs hand tables to each other in memory or
through Parquet; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as PR
from ..functions import text as TX
from ..functions.amenities import FEE_VALUES, RESTROOM_CATEGORIES, WATER_CATEGORIES
from ..operators import entities as EN
from ..operators import profile as PF
from ..operators import quality as Q
from ..operators import routing as R
from ..operators import search as S
from ..operators import summaries as SM
from ..operators.spatial import radius_join
from ..session import ensure_checkpoint_dir
from ..sources import csv as CSV
from ..sources.tables import StagedPublish, write_sorted_csv, write_summary

# Fixed values that must equal the reference: the activity source contract
# and its entity column groups.
ACTIVITY_SOURCE_COLUMNS = (
    "X", "Y", "OBJECTID", "RECAREANAME", "LONGITUDE", "LATITUDE", "RECAREAURL",
    "OPEN_SEASON_START", "OPEN_SEASON_END", "FORESTNAME", "RECAREAID", "MARKERTYPE",
    "MARKERACTIVITY", "MARKERACTIVITYGROUP", "RECAREADESCRIPTION", "ACTIVITYDESCRIPTION",
    "PARENTACTIVITYNAME", "ACTIVITYNAME", "ACTIVITYID", "PARENTACTIVITYID",
    "SPOTLIGHTDISPLAY", "ATTRACTIONDISPLAY", "ACCESSIBILITY", "OPENSTATUS", "SHAPE")
AREA_COLUMNS = (
    "RECAREAID", "X", "Y", "RECAREANAME", "LONGITUDE", "LATITUDE", "RECAREAURL",
    "OPEN_SEASON_START", "OPEN_SEASON_END", "FORESTNAME", "MARKERTYPE", "MARKERACTIVITY",
    "MARKERACTIVITYGROUP", "RECAREADESCRIPTION", "SPOTLIGHTDISPLAY", "ATTRACTIONDISPLAY",
    "ACCESSIBILITY", "OPENSTATUS", "SHAPE")
ACTIVITY_COLUMNS = ("ACTIVITYID", "ACTIVITYNAME", "PARENTACTIVITYID", "PARENTACTIVITYNAME")
HTML_TEXT_COLUMNS = ("RECAREADESCRIPTION", "ACCESSIBILITY", "ACTIVITYDESCRIPTION")
IDENTIFIER_COLUMNS = ("RECAREAID", "ACTIVITYID", "PARENTACTIVITYID")
SITE_REQUIRED_COLUMNS = (
    "objectid", "site_cn", "root_cn", "parent_cn", "site_id", "site_name", "site_subtype",
    "total_capacity", "fee_charged", "fee_type", "recarea_name", "fee_description",
    "operational_hours", "public_site_name", "site_directions", "rec1stop_url",
    "usda_portal_url", "closest_towns", "water_availability", "restroom_availability",
    "directions", "latitude", "longitude", "last_update", "globalid")


class JobCheckError(RuntimeError):
    """A job's output failed its checks; nothing was published."""


def accounting_issue(source: DataFrame, kept: DataFrame, dropped: DataFrame, what: str) -> DataFrame:
    """A20 as an issue: rows of the source that were neither kept nor dropped, or both. ``kept`` may be
    a one-row frame with the number ``n``."""
    n = kept if kept.columns == ["n"] else kept.agg(F.count(F.lit(1)).alias("n"))
    one = Q.combine_one_row(source.agg(F.count(F.lit(1)).alias("source_rows")), n.select(F.coalesce("n", F.lit(0)).alias("kept_rows")),
                            dropped.agg(F.count(F.lit(1)).alias("dropped_rows")))
    return one.where("source_rows <> kept_rows + dropped_rows").select(
        F.lit(f"unaccounted_{what}").alias("issue"),
        F.concat_ws(":", "source_rows", "kept_rows", "dropped_rows").alias("record_key"))


# ------------------------------------------------------------- activities

def _clean_activity_value(column: str):
    c = F.col(column)
    if column in IDENTIFIER_COLUMNS:
        return TX.preserve_identifier(c)
    if column in HTML_TEXT_COLUMNS:
        return F.coalesce(TX.html_to_text(c), F.lit(""))
    return TX.collapse_ws(TX.unescape_html(F.coalesce(c, F.lit(""))))


def _raw(column: str) -> str:
    """Name under which a source value is carried next to the cleaned one."""
    return f"raw_{column}"


def clean_activities(raw: DataFrame, materialize: bool = False) -> R.CleanResult:
    """Areas, activities and their bridge from one row per (area, activity).
    The audit of dropped rows holds their values as they stand in the source."""
    cleaned = raw.select("source_row_number",
                         *[_clean_activity_value(c).alias(c) for c in ACTIVITY_SOURCE_COLUMNS],
                         *[F.coalesce(F.col(c), F.lit("")).alias(_raw(c)) for c in ACTIVITY_SOURCE_COLUMNS])
    if materialize:
        # cleaned once; the tables and audits below all read this
        ensure_checkpoint_dir(cleaned.sparkSession)
        cleaned = cleaned.checkpoint()
    areas = EN.canonical_entities(cleaned, "RECAREAID", AREA_COLUMNS[1:])
    acts = EN.canonical_entities(cleaned, "ACTIVITYID", ACTIVITY_COLUMNS[1:])
    pairs = EN.bridge_pairs(cleaned, "RECAREAID", "ACTIVITYID")
    conflicts = (EN.value_conflicts(cleaned, "RECAREAID", AREA_COLUMNS[1:], "recreation_area")
                 .unionByName(EN.value_conflicts(cleaned, "ACTIVITYID", ACTIVITY_COLUMNS[1:],
                                                 "activity")))
    values = (EN.conflict_value_counts(cleaned, "RECAREAID", AREA_COLUMNS[1:])
              .withColumn("entity_type", F.lit("recreation_area")).unionByName(
                  EN.conflict_value_counts(cleaned, "ACTIVITYID", ACTIVITY_COLUMNS[1:])
                  .withColumn("entity_type", F.lit("activity"))))
    # one text for groups of few values; the long form has every value of every group
    conflicts = conflicts.join(EN.ordered_value_counts_text(values), ["entity_id", "source_column"], "left")
    routed = R.relationship_routing(cleaned, "RECAREAID", "ACTIVITYID", "RECAREAID",
                                    "ACTIVITYID")
    dropped = routed.where(F.col("drop_reason").isNotNull()).select(
        "source_row_number", "drop_reason",
        *[F.col(_raw(c)).alias(c) for c in ACTIVITY_SOURCE_COLUMNS])
    bridge = pairs.select("RECAREAID", "ACTIVITYID")
    issues = Q.union_issues([
        Q.orphan_issues(bridge, "RECAREAID", areas, "RECAREAID", "missing_recreation_area"),
        Q.orphan_issues(bridge, "ACTIVITYID", acts, "ACTIVITYID", "missing_activity"),
        # a source row is in the bridge or dropped, never neither
        accounting_issue(cleaned, pairs.agg(F.sum("source_rows").alias("n")), dropped, "activity_rows")])
    summary = EN.bridge_summary(pairs)
    figures = SM.union_metrics(
        SM.rows_metric(cleaned, "source_row_count"), SM.rows_metric(areas, "recreation_area_row_count"),
        SM.rows_metric(acts, "activity_row_count"), SM.rows_metric(bridge, "recreation_area_activity_row_count"),
        SM.rows_metric(dropped, "dropped_relationship_source_row_count"),
        SM.as_metrics(summary.select(
            F.coalesce("duplicate_relationships_removed", F.lit(0)).alias("duplicate_relationship_rows_removed"))),
        SM.rows_metric(conflicts, "conflict_count"),
        SM.counted_metrics(conflicts, "conflict_count_by_entity", "entity_type"))
    return R.CleanResult(
        tables={"recreation_areas": areas, "activities": acts,
                "recreation_area_activities": bridge},
        audits={"activity_conflicts": conflicts, "activity_conflict_values": values, "dropped_activity_rows": dropped,
                "issues": issues, "summary": summary, "figures": figures})


def run_activities(spark: SparkSession, source: str) -> R.CleanResult:
    raw = CSV.read_contract_csv(spark, source, exact=ACTIVITY_SOURCE_COLUMNS)
    return clean_activities(raw, materialize=True)


# ------------------------------------------------------------- campgrounds

def campground_summary(raw: DataFrame, result: R.CleanResult) -> DataFrame:
    """Counts of the campground job as one row (no driver-side loops)."""
    camps = result.tables["campgrounds"]
    stats = camps.agg(
        F.count(F.lit(1)).cast("bigint").alias("final_campground_row_count"),
        F.countDistinct("campground_id").cast("bigint").alias("unique_identifier_count"),
        F.count_if(F.col("recarea_id") != "").cast("bigint").alias("validated_recarea_link_count"))
    dropped = result.audits["dropped"].agg(
        F.count(F.lit(1)).cast("bigint").alias("dropped_row_count"),
        F.count_if(F.col("drop_category") == R.UNSUPPORTED).cast("bigint")
        .alias("unsupported_subtype_rows"))
    src = raw.agg(F.count(F.lit(1)).cast("bigint").alias("source_row_count"))
    dups = result.audits["duplicates"].agg(
        F.count(F.lit(1)).cast("bigint").alias("duplicate_candidate_pair_count"))
    return Q.combine_one_row(src, stats, dropped, dups)


# Fixed values that must equal the reference: columns whose missingness is reported.
MISSINGNESS_COLUMNS = ("water_availability", "restroom_availability", "directions",
                       "usda_portal_url", "fee_charged", "total_capacity")


def campground_figures(raw: DataFrame, result: R.CleanResult) -> DataFrame:
    """Figures of the campground job as (metric, category, value) rows."""
    camps, dropped = result.tables["campgrounds"], result.audits["dropped"]
    source = {c: f"{c}_raw" if f"{c}_raw" in camps.columns else c for c in MISSINGNESS_COLUMNS}
    missing = SM.missingness(camps.select(*[F.col(v).alias(c) for c, v in source.items()]), MISSINGNESS_COLUMNS)

    def by_category(metric, column, domain):
        return SM.zero_filled_counts(camps, column, domain).select(
            F.lit(metric).alias("metric"), "category", F.col("row_count").cast("double").alias("value"))

    return SM.union_metrics(
        SM.rows_metric(raw, "source_row_count"), SM.as_metrics(SM.link_shares(camps)),
        by_category("retained_subtype_counts", "site_subtype", R.ALLOWED_SUBTYPES),
        by_category("water_category_counts", "water_availability", WATER_CATEGORIES),
        by_category("restroom_category_counts", "restroom_availability", RESTROOM_CATEGORIES),
        missing.select(F.lit("missing_count").alias("metric"), F.col("source_column").alias("category"),
                       F.col("missing_count").cast("double").alias("value")),
        missing.select(F.lit("missing_percentage").alias("metric"), F.col("source_column").alias("category"),
                       F.col("missing_percentage").alias("value")),
        SM.rows_metric(dropped, "dropped_row_count"),
        SM.zero_filled_counts(dropped, "drop_category", (R.UNSUPPORTED, R.INVALID_REQUIRED)).select(
            F.lit("dropped_row_counts_by_category").alias("metric"), "category", F.col("row_count").cast("double").alias("value")),
        SM.counted_metrics(dropped, "dropped_row_counts_by_reason", "drop_reason"),
        SM.rows_metric(result.audits["unmatched"], "unmatched_campground_count"),
        SM.rows_metric(result.audits["duplicates"], "duplicate_candidate_pair_count"))


def check_campgrounds(result: R.CleanResult, area_ids: DataFrame) -> DataFrame:
    """Output checks as issues: ids, duplicate ids, '.0' ids, domains, coordinates, links."""
    camps = result.tables["campgrounds"]
    rules = [("blank_campground_id", F.col("campground_id") == ""),
             ("unsupported_subtype", ~F.col("site_subtype").isin(*R.ALLOWED_SUBTYPES)),
             ("invalid_water", ~F.col("water_availability").isin(*WATER_CATEGORIES)),
             ("invalid_restroom", ~F.col("restroom_availability").isin(*RESTROOM_CATEGORIES)),
             ("invalid_fee", ~F.col("fee_charged").isin(*FEE_VALUES))]
    for c in ("campground_id", "globalid", "site_cn", "site_id", "objectid", "root_cn",
              "parent_cn", "recid_extracted", "recarea_id"):
        rules.append((f"float_suffix_{c}", PR.is_accidental_float_id(F.col(c))))
    lat, lon = PR.parse_latitude(F.col("latitude")), PR.parse_longitude(F.col("longitude"))
    rules.append(("invalid_coordinates", lat.isNull() | lon.isNull()))
    linked = camps.where(F.col("recarea_id") != "")
    return Q.union_issues([
        Q.row_rule_issues(camps, Q.record_key("campground_id"), rules),
        Q.duplicate_issues(camps, ["campground_id"], "duplicate_campground_id"),
        Q.orphan_issues(linked, "recarea_id", area_ids, "recarea_id", "orphan_recarea_link")])


def run_campgrounds(spark: SparkSession, source: str, areas: DataFrame) -> R.CleanResult:
    raw = CSV.read_contract_csv(spark, source, required=SITE_REQUIRED_COLUMNS)
    area_ids = areas.select(F.col("RECAREAID").alias("recarea_id")) \
        if "RECAREAID" in areas.columns else areas.select("recarea_id")
    res = R.clean_sites(raw, area_ids, materialize=True)
    res.audits["issues"] = Q.union_issues([
        check_campgrounds(res, area_ids),
        accounting_issue(raw, res.tables["campgrounds"], res.audits["dropped"], "site_rows")])
    res.audits["summary"] = campground_summary(raw, res)
    res.audits["figures"] = campground_figures(raw, res)
    return res


# ------------------------------------------------------------- parks

PARK_SOURCE_COLUMNS = ("Name", "Image", "Location", "Date established as park[7][12]",
                       "Area (2021)[13]", "Recreation visitors (2021)[11]", "Description")


def run_parks(spark: SparkSession, source: str, id_prefix: str | None = None) -> R.CleanResult:
    raw = CSV.read_contract_csv(spark, source, exact=PARK_SOURCE_COLUMNS, allow_unnamed=True)
    CSV.require_blank_column(raw, "Image")
    named = raw.select("source_row_number", F.col("Name").alias("name"),
                       F.col("Location").alias("location"),
                       F.col(PARK_SOURCE_COLUMNS[3]).alias("established"),
                       F.col(PARK_SOURCE_COLUMNS[4]).alias("area"),
                       F.col(PARK_SOURCE_COLUMNS[5]).alias("visitors"),
                       F.col("Description").alias("description"))
    return checked_parks(named, **({"id_prefix": id_prefix} if id_prefix else {}))


def checked_parks(named: DataFrame, **options) -> R.CleanResult:
    """Parks from text rows, with the checks and the summary of the job."""
    res = R.clean_parks(named, **options)
    parks, failures = res.tables["parks"], res.audits["failures"]
    nameless = failures.where(F.col("failure_reason") == "MISSING_PARK_NAME")
    res.audits["issues"] = Q.union_issues([
        Q.duplicate_issues(parks, ["park_id"], "duplicate_park_id"),
        Q.row_rule_issues(parks, Q.record_key("park_id"),
                          [("blank_park_id", F.col("park_id") == "")]),
        accounting_issue(named, parks, nameless, "park_rows")])
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    res.audits["figures"] = SM.union_metrics(
        SM.rows_metric(named, "source_row_count"),
        SM.as_metrics(parks.agg(F.count(F.lit(1)).alias("processed_park_row_count"),
                                F.count_if(placed).alias("valid_coordinate_park_count"),
                                F.count_if(~placed).alias("invalid_coordinate_park_count"))),
        SM.rows_metric(failures, "parse_failure_count"),
        SM.counted_metrics(failures, "parse_failure_counts_by_reason", "failure_reason"))
    return res


# ------------------------------------------------------------- distances

def _coordinate(df: DataFrame, column: str):
    """A coordinate as the cleaning step read it; text goes through the same parser."""
    if dict(df.dtypes)[column] == "string":
        return PR.parse_number(F.col(column))
    return F.col(column).cast("double")


def check_distances(parks: DataFrame, campgrounds: DataFrame, table: DataFrame,
                    radius_km: float) -> DataFrame:
    """Issues of a distance table: ids that are blank or repeated in its sources,
    repeated pairs, distances that are not finite, negative or beyond the radius."""
    d = F.col("distance_km")
    return Q.union_issues([
        Q.row_rule_issues(parks, Q.record_key("park_id"),
                          [("blank_park_id", F.coalesce(F.col("park_id"), F.lit("")) == "")]),
        Q.row_rule_issues(campgrounds, Q.record_key("campground_id"),
                          [("blank_campground_id", F.coalesce(F.col("campground_id"), F.lit("")) == "")]),
        Q.duplicate_issues(parks, ["park_id"], "duplicate_park_id"),
        Q.duplicate_issues(campgrounds, ["campground_id"], "duplicate_campground_id"),
        Q.duplicate_issues(table, ["park_id", "campground_id"], "duplicate_distance"),
        Q.row_rule_issues(table, Q.record_key("park_id", "campground_id"), [
            ("distance_not_finite", d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))),
            ("negative_distance", d < 0.0), ("distance_beyond_radius", d > radius_km)])])


def distance_summary(parks: DataFrame, campgrounds: DataFrame, table: DataFrame) -> DataFrame:
    """One row: rows of the sources, rows without coordinates, pairs, extremes."""
    def side(df, name):
        missing = _coordinate(df, "latitude").isNull() | _coordinate(df, "longitude").isNull()
        return df.agg(F.count(F.lit(1)).alias(f"{name}_rows"),
                      F.count_if(missing).alias(f"{name}_rows_without_coordinates"))
    pairs = table.agg(F.count(F.lit(1)).alias("distance_rows"),
                      F.min("distance_km").alias("minimum_distance_km"),
                      F.max("distance_km").alias("maximum_distance_km"))
    return Q.combine_one_row(side(parks, "park"), side(campgrounds, "campground"), pairs)


def export_distances(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K2: sorted CSV, distances with six decimals."""
    text = table.select("park_id", "campground_id",
                        F.format_string("%.6f", F.col("distance_km")).alias("distance_km"))
    write_sorted_csv(text, path, ("park_id", "campground_id", "distance_km"),
                     ("park_id", "campground_id"), mode)


def run_distances(parks: DataFrame, campgrounds: DataFrame, radius_km: float) -> R.CleanResult:
    table = distances(parks, campgrounds, radius_km)
    return R.CleanResult(
        tables={"distances": table},
        audits={"issues": check_distances(parks, campgrounds, table, radius_km),
                "summary": distance_summary(parks, campgrounds, table)})


def distances(parks: DataFrame, campgrounds: DataFrame, radius_km: float) -> DataFrame:
    """(park_id, campground_id, distance_km) for every pair within the
    radius: the distance table, built by the grid-blocked join (no cross
    product), rounded to 6 decimals."""
    p = parks.select("park_id", _coordinate(parks, "latitude").alias("_plat"),
                     _coordinate(parks, "longitude").alias("_plon"))
    c = campgrounds.select("campground_id", _coordinate(campgrounds, "latitude").alias("_clat"),
                           _coordinate(campgrounds, "longitude").alias("_clon"))
    return (radius_join(p, c, radius_km, probe_lat="_plat", probe_lon="_plon",
                        build_lat="_clat", build_lon="_clon")
            .select("park_id", "campground_id", "distance_km"))


# ------------------------------------------------------------- profile

def profile_source(spark: SparkSession, source: str, dataset: str, extra_keys=(), *, frequencies=(),
                   dependencies=(), conflicts=None, repeated_id: str | None = None, subset=None,
                   flagged: str | None = None) -> dict:
    """Profile tables of a delimited source. Rows must have exactly the header's
    fields, headers no name twice, and all bytes must be UTF-8.

    Beside the column profile, the empty columns, keys and duplicate rows, on request: the most
    frequent values of the columns ``frequencies``; violations of (determinant, dependent)
    pairs ``dependencies`` in both directions; ``conflicts`` = (key, attributes); the most
    repeated values of ``repeated_id``; figures of the id pair ``subset``; names of the column ``flagged``
    with marks."""
    raw = CSV.read_contract_csv(spark, source, strict=True)
    order = ("source_file", "source_row_number")
    data = raw.drop(*order)
    unnamed = [c for c, h in zip(data.columns, CSV.read_header(spark, source)) if not h.strip()]
    profile = PF.column_profile(raw, dataset, order, unnamed)
    out = {"column_profile": profile, "empty_columns": PF.empty_columns(profile),
           "key_analysis": PF.key_analysis(data, dataset, extra_keys),
           "duplicate_rows": PF.duplicate_rows(data, dataset)}
    for c in frequencies:
        out[f"frequencies_{c}"] = PF.top_values(data, c)
    for a, b in dependencies:
        out[f"violations_{a}_{b}"] = PF.fd_violations(data, a, b)
        out[f"violations_{b}_{a}"] = PF.fd_violations(data, b, a)
    if conflicts:
        out["conflicts"] = PF.attribute_conflicts(data, *conflicts)
    if repeated_id:
        out["repeated_ids"] = PF.duplicated_ids(raw, repeated_id, order)
    if subset:
        out["subset_counts"] = PF.subset_counts(data, *subset)
    if flagged:
        out["name_flags"], out["flagged_names"] = PF.name_flags(data, flagged), PF.flagged_names(data, flagged)
    return out


# ------------------------------------------------------------- publishing

def publish(spark: SparkSession, result: R.CleanResult, root: str,
            overwrite: bool = False) -> None:
    """Check, then write tables and audits as Parquet under ``root``.
    The issues audit must be empty; otherwise nothing is published."""
    issues = result.audits.get("issues")
    if issues is not None:
        first, rest = Q.issue_summary(issues)
        if first:
            shown = ", ".join(f"{r.issue} ({r.record_key})" for r in first)
            raise JobCheckError(shown + (f" and {rest} more" if rest else ""))
    stage = StagedPublish(spark, root, overwrite=overwrite)
    try:
        for group in (result.tables, result.audits):
            for name, df in group.items():
                if name == "issues":
                    continue
                if name in ("summary", "figures"):
                    write_summary(df, stage.path(name))
                else:
                    df.write.parquet(stage.path(name))
        stage.publish()
    except Exception:
        stage.discard()
        raise


def publish_views(campgrounds: DataFrame, areas: DataFrame, bridge: DataFrame, activities: DataFrame) -> None:
    """K6: the two derived tables under their names, as views of the session."""
    S.campground_activity_details(campgrounds, areas, bridge, activities).createOrReplaceTempView(
        "campground_activity_details")
    S.completeness_rows(campgrounds).createOrReplaceTempView("campground_data_completeness")


# ------------------------------------------------------------- pipeline (E5)

class PhaseError(RuntimeError):
    """A phase of the pipeline failed; ``phase`` names it and later ones did not run."""

    def __init__(self, phase: str, cause: BaseException):
        super().__init__(f"phase {phase} failed: {cause}")
        self.phase = phase


def run_phases(phases) -> dict:
    """Run (name, function of the results so far) in order; stop at the first that
    fails, with its name."""
    results: dict = {}
    for name, phase in phases:
        try:
            results[name] = phase(results)
        except Exception as e:
            raise PhaseError(name, e) from e
    return results


def run_pipeline(spark: SparkSession, sources: dict, root: str, radius_km: float,
                 overwrite: bool = False) -> dict:
    """Parks, activities, campgrounds, distances: each published before the next
    one reads it. ``sources``: paths of the parks, activities and sites files."""
    def done(name, result):
        publish(spark, result, f"{root.rstrip('/')}/{name}", overwrite=overwrite)
        return {t: spark.read.parquet(f"{root.rstrip('/')}/{name}/{t}") for t in result.tables}

    return run_phases([
        ("parks", lambda _: done("parks", run_parks(spark, sources["parks"]))),
        ("activities", lambda _: done("activities", run_activities(spark, sources["activities"]))),
        ("campgrounds", lambda r: done("campgrounds", run_campgrounds(
            spark, sources["sites"], r["activities"]["recreation_areas"]))),
        ("distances", lambda r: done("distances", run_distances(
            r["parks"]["parks"], r["campgrounds"]["campgrounds"], radius_km)))])
