"""Entity canonicalisation and campground cleaning outputs on driver data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as EN
from ..operators import routing as R
from ..sources import projection as P
from ..session import table_path
from .catalog import register, with_domain

ENTITY_ATTRS = ("event_type", "props")


def _events(spark, sf_dir):
    return P.read_table(spark, sf_dir, "events")


_VC_SQL = """
vc AS (
  SELECT entity_id, attribute, value, COUNT(*) AS value_count FROM (
    SELECT CAST(user_id AS VARCHAR) AS entity_id, 'event_type' AS attribute, event_type AS value
    FROM events
    UNION ALL
    SELECT CAST(user_id AS VARCHAR), 'props', props FROM events) u
  WHERE value IS NOT NULL AND value <> ''
  GROUP BY entity_id, attribute, value),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, attribute
                               ORDER BY value_count DESC, lower(value), value) AS rn,
         COUNT(*) OVER (PARTITION BY entity_id, attribute) AS n_values
  FROM vc)"""


@register("canonical_values", f"""WITH {_VC_SQL}
SELECT entity_id AS user_id,
  COALESCE(MAX(CASE WHEN attribute = 'event_type' AND rn = 1 THEN value END), '') AS event_type,
  COALESCE(MAX(CASE WHEN attribute = 'props' AND rn = 1 THEN value END), '') AS props
FROM ranked GROUP BY entity_id""")
def q_canonical(spark, sf_dir):
    return EN.canonical_entities(_events(spark, sf_dir), "user_id", ENTITY_ATTRS)


@register("value_conflicts", f"""WITH {_VC_SQL}
SELECT 'user' AS entity_type, entity_id, attribute AS source_column, value AS selected_value,
       value_count AS selected_count, n_values AS distinct_non_blank_value_count
FROM ranked WHERE rn = 1 AND n_values > 1""")
def q_conflicts(spark, sf_dir):
    return EN.value_conflicts(_events(spark, sf_dir), "user_id", ENTITY_ATTRS, "user")


@register("conflict_value_counts", f"""WITH {_VC_SQL}
SELECT entity_id, attribute AS source_column, value, value_count FROM ranked WHERE n_values > 1""")
def q_conflict_counts(spark, sf_dir):
    return EN.conflict_value_counts(_events(spark, sf_dir), "user_id", ENTITY_ATTRS)


@register("lang_value_counts", """
SELECT source AS entity_id, 'lang' AS source_column,
  '{' || string_agg('"' || lang || '":' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, lower(lang), lang)
      || '}' AS value_counts
FROM (SELECT source, lang, COUNT(*) AS n FROM documents
      WHERE lang IS NOT NULL AND lang <> '' GROUP BY source, lang) g
GROUP BY source HAVING COUNT(*) > 1""")
def q_lang_value_counts(spark, sf_dir):
    # Languages form a small fixed vocabulary, so the per-source JSON is bounded.
    docs = P.read_table(spark, sf_dir, "documents")
    return EN.ordered_value_counts_text(EN.conflict_value_counts(docs, "source", ["lang"]))


@register("bridge_pairs", """
SELECT CAST(user_id AS VARCHAR) AS recarea_id, event_type AS activity_id,
       CAST(COUNT(*) AS BIGINT) AS source_rows
FROM events GROUP BY user_id, event_type""")
def q_bridge_pairs(spark, sf_dir):
    e = _events(spark, sf_dir)
    return EN.bridge_pairs(e.withColumnRenamed("user_id", "recarea_id")
                           .withColumnRenamed("event_type", "activity_id"),
                           "recarea_id", "activity_id")


@register("bridge_summary", """
SELECT CAST(COUNT(*) AS BIGINT) AS relationship_count,
       CAST(SUM(n) AS BIGINT) AS source_relationship_rows,
       CAST(SUM(n - 1) AS BIGINT) AS duplicate_relationships_removed
FROM (SELECT COUNT(*) AS n FROM events GROUP BY user_id, event_type) g""")
def q_bridge_summary(spark, sf_dir):
    return EN.bridge_summary(q_bridge_pairs(spark, sf_dir))


@register("dropped_relationships", """
SELECT event_id, CASE WHEN a = '' AND b = '' THEN 'MISSING_RECAREAID_AND_ACTIVITYID'
                      WHEN a = '' THEN 'MISSING_RECAREAID' ELSE 'MISSING_ACTIVITYID' END
       AS drop_reason
FROM (SELECT event_id,
        CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS a,
        CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS b FROM events) r
WHERE a = '' OR b = ''""")
def q_dropped_relationships(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select(
        "event_id",
        F.when(F.pmod("event_id", F.lit(11)) == 0, F.lit(" "))
        .otherwise(F.col("user_id").cast("string")).alias("RECAREAID"),
        F.when(F.pmod("event_id", F.lit(13)) == 0, F.lit(""))
        .otherwise(F.col("event_type")).alias("ACTIVITYID"))
    routed = R.relationship_routing(rows, "RECAREAID", "ACTIVITYID", "RECAREAID", "ACTIVITYID")
    return routed.where(F.col("drop_reason").isNotNull()).select("event_id", "drop_reason")


# ------------------------------------------------------------ campground cleaning

@P.memoized
def _clean(spark, sf_dir):
    """Conformed once; the queries below read the written rows."""
    return R.clean_sites(P.raw_site_records(spark, sf_dir), P.area_ids(spark, sf_dir), materialize=True)


def _sites_sql(select_sql: str) -> str:
    return ("WITH " + P.ORACLE_CTES.strip() + ",\n" + P.RAW_SITES_SQL.strip() + "\n"
            + select_sql)


@register("quarantine_routing", _sites_sql("""
SELECT source_row_number,
  CASE WHEN drop_reason = 'UNSUPPORTED_SITE_SUBTYPE' THEN 'UNSUPPORTED_SITE_SUBTYPE'
       ELSE 'INVALID_REQUIRED_DATA' END AS drop_category,
  drop_reason, COALESCE(globalid, '') AS globalid, site_cn, site_id, public_site_name,
  site_name, site_subtype, latitude, longitude
FROM routed_reasons WHERE drop_reason IS NOT NULL"""))
def q_quarantine(spark, sf_dir):
    return R.dropped_sites(R.route_sites(P.raw_site_records(spark, sf_dir)))


@register("unmatched_links", _sites_sql("""
SELECT campground_id, site_cn, site_id, name, site_subtype, usda_portal_url, recid_extracted,
  CASE WHEN usda_portal_url = '' THEN 'MISSING_USDA_PORTAL_URL'
       WHEN recid_extracted = '' THEN 'RECID_NOT_FOUND_IN_USDA_PORTAL_URL'
       ELSE 'RECID_NOT_IN_RECREATION_AREAS' END AS unmatched_reason
FROM clean_sites WHERE recarea_id = ''"""))
def q_unmatched(spark, sf_dir):
    return _clean(spark, sf_dir).audits["unmatched"]


@register("clean_campgrounds", _sites_sql("SELECT * FROM clean_sites"))
def q_clean_campgrounds(spark, sf_dir):
    return _clean(spark, sf_dir).tables["campgrounds"]


_NORM_NAME = "trim(regexp_replace(upper({x}), '[^A-Z0-9]+', ' ', 'g'))"
_ATAN2 = ("(6371.0088 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))")


def _atan2_sql():
    s1 = "sin(radians(CAST(b.latitude AS DOUBLE) - CAST(a.latitude AS DOUBLE)) / 2)"
    s2 = "sin(radians(CAST(b.longitude AS DOUBLE) - CAST(a.longitude AS DOUBLE)) / 2)"
    h = (f"({s1} * {s1} + cos(radians(CAST(a.latitude AS DOUBLE))) * "
         f"cos(radians(CAST(b.latitude AS DOUBLE))) * ({s2} * {s2}))")
    return _ATAN2.format(a=h)


@register("duplicate_candidates", _sites_sql(f"""
SELECT campground_id_1, campground_id_2, name_1, name_2, normalized_name, latitude_1,
       longitude_1, latitude_2, longitude_2, round(d, 6) AS distance_km,
       'EXACT_NORMALIZED_NAME_AND_DISTANCE_LE_1_KM' AS candidate_rule FROM (
  SELECT a.campground_id AS campground_id_1, b.campground_id AS campground_id_2,
         a.name AS name_1, b.name AS name_2, {_NORM_NAME.format(x='a.name')} AS normalized_name,
         CAST(a.latitude AS DOUBLE) AS latitude_1, CAST(a.longitude AS DOUBLE) AS longitude_1,
         CAST(b.latitude AS DOUBLE) AS latitude_2, CAST(b.longitude AS DOUBLE) AS longitude_2,
         {_atan2_sql()} AS d
  FROM clean_sites a JOIN clean_sites b
    ON {_NORM_NAME.format(x='a.name')} = {_NORM_NAME.format(x='b.name')}
   AND a.campground_id < b.campground_id
  WHERE {_NORM_NAME.format(x='a.name')} <> '') p
WHERE d <= 1.0"""))
def q_duplicates(spark, sf_dir):
    return _clean(spark, sf_dir).audits["duplicates"]
