"""Search, lookup and report queries (catalogue items 1-17 and the matrix)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.spatial import radius_join
from ..sources import projection as P
from .catalog import dist_sql, register, with_domain

# Fixed query parameters (chosen so every query returns rows at each scale).
SEARCH_PARK = 7
SEARCH_RADIUS_KM = 1500.0
SEARCH_LIMIT = 25
FILTER_PARK = 3
FILTER_RADIUS_KM = 6000.0
ALL_PARK = 5
ALL_RADIUS_KM = 8000.0
ALL_ACTIVITIES = ("click", "purchase")
DETAIL_ID = 42
NEARBY_RADIUS_KM = 800.0
NEAREST_N = 3
FREE_LIMIT = 100
MATRIX_RADIUS_KM = 1000.0


def _d(spark, sf_dir):
    return P.domain(spark, sf_dir)


# 1. parks in display order -------------------------------------------------
@register("list_parks", with_domain(
    "SELECT park_id, name, state_or_territory, latitude, longitude FROM parks"))
def q_list_parks(spark, sf_dir):
    return S.list_parks(P.parks(spark, sf_dir))


# 2. activities reachable from a linked campground --------------------------
@register("reachable_activities", with_domain("""
SELECT DISTINCT a.activity_id, a.name, a.parent_activity_id, a.parent_activity_name
FROM activities a JOIN bridge raa ON raa.activity_id = a.activity_id
JOIN campgrounds c ON c.recarea_id = raa.recarea_id"""))
def q_reachable(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.reachable_activities(d["activities"], d["bridge"], d["campgrounds"])


_SEARCH_SELECT = """
SELECT d.park_id, d.distance_km, c.campground_id, c.name, c.campground_type, c.recarea_id,
       ra.name AS recreation_area_name,
       CASE WHEN EXISTS (SELECT 1 FROM bridge b WHERE b.recarea_id = c.recarea_id)
            THEN 1 ELSE 0 END AS has_activity_information,
       c.fee_charged, c.fee_type, c.fee_description, c.water_category,
       c.water_availability_raw, c.restroom_category, c.restroom_availability_raw,
       c.directions, c.closest_towns, c.operational_hours, c.latitude, c.longitude,
       c.official_url
FROM (SELECT p.park_id, c.campground_id,
             {dist} AS distance_km
      FROM parks p, campgrounds c WHERE p.park_id = {park}) d
JOIN campgrounds c ON c.campground_id = d.campground_id
LEFT JOIN areas ra ON ra.recarea_id = c.recarea_id
"""


def _search_body(park, radius, limit, where_extra="", join_extra=""):
    body = _SEARCH_SELECT.format(
        dist=dist_sql("p.latitude", "p.longitude", "c.latitude", "c.longitude"), park=park)
    return (body + join_extra + f"WHERE d.distance_km <= {radius} {where_extra}\n"
            + f"ORDER BY d.distance_km, c.campground_id LIMIT {limit}")


def _search_sql(park, radius, limit, where_extra="", join_extra=""):
    return with_domain(_search_body(park, radius, limit, where_extra, join_extra))


# 3-9. radius search ----------------------------------------------------------
@register("radius_search", _search_sql(SEARCH_PARK, SEARCH_RADIUS_KM, SEARCH_LIMIT))
def q_radius_search(spark, sf_dir):
    d = _d(spark, sf_dir)
    spec = S.SearchSpec.build(park_id=SEARCH_PARK, radius_km=SEARCH_RADIUS_KM,
                              limit=SEARCH_LIMIT)
    return S.search_campgrounds(d["parks"], d["campgrounds"], d["areas"], d["bridge"], spec)


@register("search_filtered", _search_sql(
    FILTER_PARK, FILTER_RADIUS_KM, 50,
    "AND c.campground_type = 'CAMPGROUND' AND c.fee_charged = 'NO' "
    "AND c.water_category = 'AVAILABLE'"))
def q_search_filtered(spark, sf_dir):
    d = _d(spark, sf_dir)
    spec = S.SearchSpec.build(park_id=FILTER_PARK, radius_km=FILTER_RADIUS_KM, limit=50,
                              campground_type=" campground ", fee_status="free",
                              water_category="available")
    return S.search_campgrounds(d["parks"], d["campgrounds"], d["areas"], d["bridge"], spec)


_ALL_CTE_LIST = ", ".join(f"'{a}'" for a in ALL_ACTIVITIES)


# 10-11. ALL-activities search (relational division) -----------------------
@register("search_all_activities", _search_sql(
    ALL_PARK, ALL_RADIUS_KM, 200, "",
    join_extra=(f"JOIN (SELECT recarea_id FROM bridge WHERE activity_id IN ({_ALL_CTE_LIST}) "
                f"GROUP BY recarea_id HAVING COUNT(DISTINCT activity_id) = "
                f"{len(ALL_ACTIVITIES)}) m ON m.recarea_id = c.recarea_id\n")))
def q_search_all(spark, sf_dir):
    d = _d(spark, sf_dir)
    spec = S.SearchSpec.build(park_id=ALL_PARK, radius_km=ALL_RADIUS_KM, limit=200,
                              activity_ids=list(ALL_ACTIVITIES) + [ALL_ACTIVITIES[0]])
    return S.search_campgrounds(d["parks"], d["campgrounds"], d["areas"], d["bridge"], spec)


# 12. campground details ------------------------------------------------------
_CAMP_COLS = ("campground_id, name, campground_type, recarea_id, fee_charged, fee_type, "
              "fee_description, water_category, water_availability_raw, restroom_category, "
              "restroom_availability_raw, directions, closest_towns, operational_hours, "
              "total_capacity, latitude, longitude, official_url")


@register("campground_details", with_domain(f"""
SELECT {', '.join('c.' + x.strip() for x in _CAMP_COLS.split(','))},
       ra.name AS linked_recreation_area_name, ra.official_url AS linked_recreation_area_url,
       ra.forest_name AS linked_forest_name, ra.open_status AS linked_recreation_area_status,
       ra.open_season_start AS linked_open_season_start, ra.open_season_end AS linked_open_season_end,
       ra.description AS linked_recreation_area_description, ra.accessibility AS linked_recreation_area_accessibility
FROM campgrounds c LEFT JOIN areas ra ON ra.recarea_id = c.recarea_id
WHERE c.campground_id = {DETAIL_ID}"""))
def q_details(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.campground_details(d["campgrounds"], d["areas"], DETAIL_ID)


# 13. activities of one campground (through the four-way view) -------------
_VIEW_SQL = """
SELECT c.campground_id, c.name AS campground_name, c.campground_type, c.recarea_id,
       ra.name AS recreation_area_name, a.activity_id, a.name AS activity_name,
       a.parent_activity_id, a.parent_activity_name
FROM campgrounds c JOIN areas ra ON ra.recarea_id = c.recarea_id
JOIN bridge raa ON raa.recarea_id = c.recarea_id
JOIN activities a ON a.activity_id = raa.activity_id"""


@register("campground_activities", with_domain(f"""
SELECT activity_id, activity_name, parent_activity_id, parent_activity_name
FROM ({_VIEW_SQL}) v WHERE campground_id = {DETAIL_ID}"""))
def q_camp_activities(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.campground_activities(d["campgrounds"], d["areas"], d["bridge"], d["activities"],
                                   DETAIL_ID)


@register("activity_details", with_domain(_VIEW_SQL))
def q_activity_details(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.campground_activity_details(d["campgrounds"], d["areas"], d["bridge"],
                                         d["activities"])


# 14. nearby count per park ---------------------------------------------------
@register("nearby_counts", with_domain(f"""
SELECT p.park_id, p.name, CAST(COUNT(d.campground_id) AS BIGINT) AS nearby_campground_count
FROM parks p LEFT JOIN (
  SELECT p2.park_id, c.campground_id,
         {dist_sql('p2.latitude', 'p2.longitude', 'c.latitude', 'c.longitude')} AS distance_km
  FROM parks p2, campgrounds c) d
  ON d.park_id = p.park_id AND d.distance_km <= {NEARBY_RADIUS_KM}
GROUP BY p.park_id, p.name"""))
def q_nearby(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.nearby_counts(d["parks"], d["campgrounds"], NEARBY_RADIUS_KM)


# 15. nearest N per park ------------------------------------------------------
@register("nearest_n", with_domain(f"""
SELECT park_id, park_name, campground_id, campground_name, campground_type, distance_km,
       distance_rank FROM (
  SELECT p.park_id, p.name AS park_name, c.campground_id, c.name AS campground_name,
         c.campground_type,
         {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} AS distance_km,
         CAST(ROW_NUMBER() OVER (PARTITION BY p.park_id ORDER BY
           {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')},
           c.campground_id) AS BIGINT) AS distance_rank
  FROM parks p, campgrounds c) r
WHERE distance_rank <= {NEAREST_N}"""))
def q_nearest(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.nearest_campgrounds(d["parks"], d["campgrounds"], NEAREST_N)


# 16. free with known amenities ----------------------------------------------
@register("free_known", with_domain(f"""
SELECT campground_id, name, campground_type, water_category, restroom_category, recarea_id,
       official_url
FROM campgrounds WHERE fee_charged = 'NO' AND water_category <> 'UNKNOWN'
  AND restroom_category <> 'UNKNOWN'
ORDER BY lower(name), campground_id LIMIT {FREE_LIMIT}"""))
def q_free_known(spark, sf_dir):
    return S.free_with_known_amenities(P.campgrounds(spark, sf_dir), FREE_LIMIT)


# 17. completeness ------------------------------------------------------------
_FLAGS_SQL = """
  CASE WHEN recarea_id IS NOT NULL THEN 1 ELSE 0 END AS has_recreation_area_link,
  CASE WHEN official_url IS NOT NULL THEN 1 ELSE 0 END AS has_official_url,
  CASE WHEN directions IS NOT NULL THEN 1 ELSE 0 END AS has_directions,
  CASE WHEN fee_charged <> 'UNKNOWN' THEN 1 ELSE 0 END AS has_known_fee_status,
  CASE WHEN water_category <> 'UNKNOWN' THEN 1 ELSE 0 END AS has_known_water,
  CASE WHEN restroom_category <> 'UNKNOWN' THEN 1 ELSE 0 END AS has_known_restroom"""
_COMPLETENESS_VIEW = f"""
SELECT campground_id, name AS campground_name, recarea_id, {_FLAGS_SQL},
  (CASE WHEN recarea_id IS NOT NULL THEN 1 ELSE 0 END
   + CASE WHEN official_url IS NOT NULL THEN 1 ELSE 0 END
   + CASE WHEN directions IS NOT NULL THEN 1 ELSE 0 END
   + CASE WHEN fee_charged <> 'UNKNOWN' THEN 1 ELSE 0 END
   + CASE WHEN water_category <> 'UNKNOWN' THEN 1 ELSE 0 END
   + CASE WHEN restroom_category <> 'UNKNOWN' THEN 1 ELSE 0 END) AS completeness_fields_present,
  6 AS completeness_fields_total
FROM campgrounds"""


@register("completeness_rows", with_domain(_COMPLETENESS_VIEW))
def q_completeness_rows(spark, sf_dir):
    return S.completeness_rows(P.campgrounds(spark, sf_dir))


@register("completeness_report", with_domain(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS campground_count,
  CAST(SUM(has_recreation_area_link) AS BIGINT) AS linked_recreation_area_count,
  CAST(SUM(1 - has_recreation_area_link) AS BIGINT) AS missing_recreation_area_link_count,
  CAST(SUM(has_official_url) AS BIGINT) AS official_url_count,
  CAST(SUM(has_directions) AS BIGINT) AS directions_count,
  CAST(SUM(has_known_fee_status) AS BIGINT) AS known_fee_status_count,
  CAST(SUM(has_known_water) AS BIGINT) AS known_water_count,
  CAST(SUM(has_known_restroom) AS BIGINT) AS known_restroom_count,
  CAST(SUM(completeness_fields_present) AS BIGINT) AS completeness_fields_present,
  CAST(SUM(completeness_fields_total) AS BIGINT) AS completeness_fields_total
FROM ({_COMPLETENESS_VIEW}) v"""))
def q_completeness_report(spark, sf_dir):
    return S.completeness_report(P.campgrounds(spark, sf_dir))


# Distance table, bounded by the largest search radius ----------------------
@register("distance_matrix", with_domain(f"""
SELECT park_id, campground_id, distance_km FROM (
  SELECT p.park_id, c.campground_id,
         {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} AS distance_km
  FROM parks p, campgrounds c) d
WHERE distance_km <= {MATRIX_RADIUS_KM}"""))
def q_distance_matrix(spark, sf_dir):
    d = _d(spark, sf_dir)
    p = d["parks"].select("park_id", F.col("latitude").alias("_plat"),
                          F.col("longitude").alias("_plon"))
    c = d["campgrounds"].select("campground_id", "latitude", "longitude")
    return (radius_join(p, c, MATRIX_RADIUS_KM, probe_lat="_plat", probe_lon="_plon",
                        build_lat="latitude", build_lon="longitude")
            .select("park_id", "campground_id", "distance_km"))


# First co-occurring activity pair of each linked area --------------------
@register("first_activity_pairs", with_domain("""
SELECT recarea_id, first_activity_id, second_activity_id FROM (
  SELECT a.recarea_id, a.activity_id AS first_activity_id, b.activity_id AS second_activity_id,
         ROW_NUMBER() OVER (PARTITION BY a.recarea_id ORDER BY a.activity_id, b.activity_id) AS rn
  FROM bridge a JOIN bridge b ON b.recarea_id = a.recarea_id AND b.activity_id > a.activity_id
  WHERE a.recarea_id IN (SELECT recarea_id FROM campgrounds WHERE recarea_id IS NOT NULL)) x
WHERE rn = 1"""))
def q_first_pairs(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.first_activity_pairs(d["bridge"], d["campgrounds"])


# Result cards and map layer of the radius search -------------------------
@register("result_cards", with_domain(f"""
SELECT campground_id,
  CASE WHEN name IS NULL OR trim(name) = '' THEN 'Not available' ELSE name END AS name_label,
  printf('%.1f km', distance_km) AS distance_label,
  CASE campground_type WHEN 'CAMPGROUND' THEN 'Campground'
       WHEN 'GROUP CAMPGROUND' THEN 'Group campground' WHEN 'HORSE CAMP' THEN 'Horse camp' END
       AS campground_type_label,
  CASE fee_charged WHEN 'YES' THEN 'Paid' WHEN 'NO' THEN 'Free' WHEN 'UNKNOWN' THEN 'Unknown'
       ELSE 'Not available' END AS fee_status_label,
  CASE water_category WHEN 'UNKNOWN' THEN 'Unknown' WHEN 'NOT_AVAILABLE' THEN 'Not available'
       WHEN 'NATURAL_SOURCE' THEN 'Natural source' WHEN 'AVAILABLE' THEN 'Available'
       WHEN 'NEARBY' THEN 'Nearby' WHEN 'OTHER' THEN 'Other' END AS water_category_label,
  CASE restroom_category WHEN 'UNKNOWN' THEN 'Unknown' WHEN 'NONE' THEN 'None'
       WHEN 'FLUSH' THEN 'Flush' WHEN 'VAULT' THEN 'Vault' WHEN 'COMPOSTING' THEN 'Composting'
       WHEN 'PORTABLE' THEN 'Portable' WHEN 'MULTIPLE' THEN 'Multiple' WHEN 'OTHER' THEN 'Other'
       END AS restroom_category_label,
  CASE WHEN recreation_area_name IS NULL THEN 'Not available' ELSE recreation_area_name END
       AS recreation_area_label,
  CASE WHEN has_activity_information = 1 THEN 'Available' ELSE 'Not available' END
       AS activity_information_label,
  CASE WHEN regexp_matches(trim(official_url), '(?i)^https?://[^/?#\\s]+')
       THEN trim(official_url) END AS link_url
FROM ({_search_body(SEARCH_PARK, SEARCH_RADIUS_KM, SEARCH_LIMIT)}) r
"""))
def q_result_cards(spark, sf_dir):
    return S.result_cards(q_radius_search(spark, sf_dir))


@register("map_layer", with_domain(f"""
SELECT latitude, longitude, name AS label, 'Selected park' AS kind, '#D62828' AS color,
       180 AS size FROM parks WHERE park_id = {SEARCH_PARK}
UNION ALL
SELECT latitude, longitude, name AS label, 'Campground' AS kind, '#007F5F' AS color,
       55 AS size
FROM ({_search_body(SEARCH_PARK, SEARCH_RADIUS_KM, SEARCH_LIMIT)}) r
"""))
def q_map_layer(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.map_layer(d["parks"], q_radius_search(spark, sf_dir), SEARCH_PARK)


# Page 2 (size 10) of the free-with-amenities list -------------------------
@register("page_slice", with_domain("""
SELECT campground_id, name FROM campgrounds
WHERE fee_charged = 'NO' AND water_category <> 'UNKNOWN' AND restroom_category <> 'UNKNOWN'
ORDER BY campground_id LIMIT 10 OFFSET 20"""))
def q_page_slice(spark, sf_dir):
    c = P.campgrounds(spark, sf_dir)
    rows, _, _ = S.page_slice(
        c.where((F.col("fee_charged") == "NO") & (F.col("water_category") != "UNKNOWN")
                & (F.col("restroom_category") != "UNKNOWN")).select("campground_id", "name"),
        ["campground_id"], page=2, page_size=10)
    return rows
