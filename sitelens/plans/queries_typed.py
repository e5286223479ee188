"""Queries over the typed load: given tables exported as text, loaded back as one version, and read from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import projection as P
from ..sources.versions import VersionStore
from . import jobs as J
from . import typed_tables as TT
from .catalog import dist_sql, register, with_domain

RADIUS_KM = 500.0
SPECIAL = 'line one\nline two, "quoted"'


def _text(name: str):
    return F.col(name).cast("string").alias(name)


def processed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The location tables as processed text rows, by table name: links to areas that
    do not exist are blank, as cleaning leaves them."""
    d = P.domain(spark, sf_dir)
    key = F.col("park_id")
    parks = d["parks"].select(
        _text("park_id"), "name", "state_or_territory", _text("latitude"), _text("longitude"),
        F.lit("1999-12-31").alias("established_date"),
        F.concat((key % 1000).cast("string"), F.lit(".25")).alias("area_acres"),
        (key * 104729 % 5000000).cast("string").alias("recreation_visitors_2021"), F.lit(SPECIAL).alias("description"))
    u = F.col("recarea_id")
    text = u.cast("string")
    areas = d["areas"].select(
        text.alias("RECAREAID"), F.when(u % 5 == 0, "").otherwise(F.concat(F.lit("-"), (u % 180).cast("string"), F.lit(".5"))).alias("X"),
        F.when(u % 5 == 0, "").otherwise((u % 90).cast("string")).alias("Y"), F.col("name").alias("RECAREANAME"),
        F.lit("0").alias("LONGITUDE"), F.lit("0").alias("LATITUDE"), F.col("official_url").alias("RECAREAURL"),
        F.lit("May").alias("OPEN_SEASON_START"), F.lit("").alias("OPEN_SEASON_END"), F.col("forest_name").alias("FORESTNAME"),
        F.lit("").alias("MARKERTYPE"), F.lit("").alias("MARKERACTIVITY"), F.lit("").alias("MARKERACTIVITYGROUP"),
        F.lit(SPECIAL).alias("RECAREADESCRIPTION"), F.when(u % 2 == 0, "Y").otherwise("N").alias("SPOTLIGHTDISPLAY"),
        F.lit("N").alias("ATTRACTIONDISPLAY"), F.lit("").alias("ACCESSIBILITY"), F.col("open_status").alias("OPENSTATUS"),
        F.lit("").alias("SHAPE"))
    activities = d["activities"].select(
        F.col("activity_id").alias("ACTIVITYID"), F.col("name").alias("ACTIVITYNAME"),
        F.col("parent_activity_id").alias("PARENTACTIVITYID"), F.col("parent_activity_name").alias("PARENTACTIVITYNAME"))
    known = d["areas"].select(u.alias("recarea_id"), F.lit(True).alias("known"))
    c = d["campgrounds"].join(known, "recarea_id", "left")
    k = F.col("campground_id")
    link = F.when(F.col("known"), F.col("recarea_id").cast("string"))
    blank = {n: F.lit("").alias(n) for n in ("parent_cn", "fee_type", "site_directions", "rec1stop_url", "usda_portal_url")}
    made = {
        "globalid": k.cast("string"), "site_cn": F.lpad(k.cast("string"), 5, "0"), "site_id": F.lpad((k % 1000).cast("string"), 5, "0"),
        "objectid": k.cast("string"), "root_cn": F.lit("0"), "public_site_name": F.col("name"), "site_name": F.col("name"),
        "recarea_name": F.coalesce(F.concat(F.lit("Area "), link), F.lit("none")), "site_subtype": F.col("campground_type"),
        "site_subtype_raw": F.lower("campground_type"), "recarea_id": link, "recid_extracted": F.col("recarea_id").cast("string"),
        "fee_charged_raw": F.lower("fee_charged"), "total_capacity_raw": F.col("total_capacity").cast("string"),
        "water_availability": F.col("water_category"), "restroom_availability": F.col("restroom_category"),
        "last_update": F.lit("2024-01-01")}
    campgrounds = c.select(*[blank[f] if f in blank else made[f].alias(f) if f in made else _text(f)
                             for f in TT.CAMPGROUND_FIELDS])
    bridge = d["bridge"].select(text.alias("RECAREAID"), F.col("activity_id").alias("ACTIVITYID"))
    distances = J.distances(d["parks"], d["campgrounds"], RADIUS_KM).select(
        _text("park_id"), _text("campground_id"), F.col("distance_km").cast("decimal(12,6)").cast("string").alias("distance_km"))
    return {"national_parks": parks, "recreation_areas": areas, "activities": activities, "campgrounds": campgrounds,
            "recreation_area_activities": bridge, "park_campground_distances": distances}


@P.memoized
def _loaded(spark: SparkSession, sf_dir: str) -> tuple[str, VersionStore, TT.Loaded]:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/typed-{uuid.uuid4().hex}"
    TT.export_tables(processed_tables(spark, sf_dir), f"{root}/text")
    store = VersionStore(spark, f"{root}/tables")
    return f"{root}/text", store, TT.load_tables(spark, TT.read_exported(spark, f"{root}/text"), store)


_COUNTS = with_domain(f"""
SELECT table_name, load_position, n AS source_rows, n AS table_rows FROM (
  SELECT 'national_parks' AS table_name, 1 AS load_position, (SELECT count(*) FROM parks) AS n
  UNION ALL SELECT 'recreation_areas', 2, (SELECT count(*) FROM areas)
  UNION ALL SELECT 'activities', 3, (SELECT count(*) FROM activities)
  UNION ALL SELECT 'campgrounds', 4, (SELECT count(*) FROM campgrounds)
  UNION ALL SELECT 'recreation_area_activities', 5, (SELECT count(*) FROM bridge)
  UNION ALL SELECT 'park_campground_distances', 6, (SELECT count(*) FROM parks p, campgrounds c
    WHERE {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} <= {RADIUS_KM})) t""")


@register("typed_table_load", _COUNTS)
def q_typed_table_load(spark, sf_dir):
    """Export of all six tables, load of what was exported, one commit: what the job reports."""
    return _loaded(spark, sf_dir)[2].counts


@register("typed_source_counts", _COUNTS.replace(
    "SELECT table_name, load_position, n AS source_rows, n AS table_rows FROM",
    "SELECT table_name, n AS source_rows, n AS table_rows, TRUE AS equal FROM"))
def q_typed_source_counts(spark, sf_dir):
    text, store, _ = _loaded(spark, sf_dir)
    return TT.source_counts(spark, text, store)


# links that lead to no area are blank in the processed rows
_LINKED = "CASE WHEN c.recarea_id IN (SELECT recarea_id FROM areas) THEN c.recarea_id::VARCHAR END"


@register("typed_campgrounds", with_domain(f"""
SELECT c.campground_id::VARCHAR AS campground_id, c.campground_id::VARCHAR AS globalid,
  lpad(c.campground_id::VARCHAR, 5, '0') AS site_cn, lpad((c.campground_id % 1000)::VARCHAR, 5, '0') AS site_id,
  c.campground_id::VARCHAR AS objectid, '0' AS root_cn, NULL::VARCHAR AS parent_cn, c.name, c.name AS public_site_name,
  c.name AS site_name, coalesce('Area ' || {_LINKED}, 'none') AS recarea_name, c.campground_type,
  lower(c.campground_type) AS campground_type_raw, {_LINKED} AS recarea_id, c.recarea_id::VARCHAR AS recid_extracted,
  c.fee_charged, lower(c.fee_charged) AS fee_charged_raw, NULL::VARCHAR AS fee_type, c.fee_description, c.total_capacity,
  c.total_capacity::VARCHAR AS total_capacity_raw, c.water_category, c.water_availability_raw, c.restroom_category,
  c.restroom_availability_raw, c.directions, NULL::VARCHAR AS site_directions, c.closest_towns, c.operational_hours,
  c.official_url, NULL::VARCHAR AS usda_portal_url, NULL::VARCHAR AS rec1stop_url, c.latitude, c.longitude,
  '2024-01-01' AS last_update
FROM campgrounds c"""))
def q_typed_campgrounds(spark, sf_dir):
    """All 35 columns of the campgrounds after the round trip through text."""
    return _loaded(spark, sf_dir)[1].table("campgrounds")


@register("typed_areas", with_domain("""
SELECT a.recarea_id::VARCHAR AS recarea_id, CASE WHEN a.recarea_id % 5 <> 0 THEN -(a.recarea_id % 180 + 0.5)::DOUBLE END AS longitude,
  CASE WHEN a.recarea_id % 5 <> 0 THEN (a.recarea_id % 90)::DOUBLE END AS latitude, a.name, '0' AS source_longitude,
  '0' AS source_latitude, a.official_url, 'May' AS open_season_start, NULL::VARCHAR AS open_season_end, a.forest_name,
  NULL::VARCHAR AS marker_type, NULL::VARCHAR AS marker_activity, NULL::VARCHAR AS marker_activity_group,
  'line one' || chr(10) || 'line two, "quoted"' AS description, CASE WHEN a.recarea_id % 2 = 0 THEN 1 ELSE 0 END AS spotlight_display,
  0 AS attraction_display, NULL::VARCHAR AS accessibility, a.open_status, NULL::VARCHAR AS shape
FROM areas a"""))
def q_typed_areas(spark, sf_dir):
    return _loaded(spark, sf_dir)[1].table("recreation_areas")


@register("typed_views", with_domain(f"""
SELECT 'campground_activity_details' AS view_name, count(*) AS row_count, sum(c.campground_id)::BIGINT AS key_sum
FROM campgrounds c JOIN areas a ON a.recarea_id = c.recarea_id JOIN bridge b ON b.recarea_id = c.recarea_id
  JOIN activities x ON x.activity_id = b.activity_id
UNION ALL SELECT 'campground_data_completeness', count(*), sum(campground_id)::BIGINT FROM campgrounds"""))
def q_typed_views(spark, sf_dir):
    """Both views over the loaded tables: rows, and the sum of their campground ids."""
    out = None
    for name, df in TT.view_frames(_loaded(spark, sf_dir)[1].tables()).items():
        one = df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("campground_id").cast("bigint")).alias("key_sum"))
        one = one.select(F.lit(name).alias("view_name"), "row_count", "key_sum")
        out = one if out is None else out.unionByName(one)
    return out
