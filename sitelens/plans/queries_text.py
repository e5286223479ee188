"""Text parsing and normalisation queries (parks text, amenities, URLs, HTML).

The oracles do not parse text: they compute the expected values from the
integers that generated the text, so they check the Spark parsers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amenities as A
from ..functions import parse as PR
from ..functions import text as TX
from ..operators import routing as R
from ..sources import projection as P
from ..session import table_path
from .catalog import register

_NS_HEX = "6ba7b8119dad11d180b400c04fd430c8"   # RFC 4122 URL namespace


def _uuid5_sql(name_sql: str) -> str:
    h = f"sha1(unhex('{_NS_HEX}') || encode('{PR.DEFAULT_ID_PREFIX}' || lower({name_sql})))"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
            f"translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || "
            f"substr({h},18,3) || '-' || substr({h},21,12))")


_PARK_BASE = """
base AS (
  SELECT s.s_suppkey AS k, s.s_name, COALESCE(n.n_name, '') AS nation,
         (s.s_suppkey * 7919) % 1700 - 850 AS la, (s.s_suppkey * 104729) % 3600 - 1800 AS lo
  FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey),
named AS (
  SELECT *, CASE k % 9 WHEN 1 THEN s_name WHEN 2 THEN s_name || ' & Preserve' ELSE s_name END
            AS name
  FROM base WHERE k % 9 <> 0)"""


def _coord_sql(t):
    dec = f"(CAST(abs({t}) AS DOUBLE) / 10)"
    dms = (f"((CAST(floor(abs({t}) / 10) AS DOUBLE) + CAST((abs({t}) % 10) * 6 AS DOUBLE) / 60)"
           f" + 0.0 / 3600)")
    val = f"(CASE WHEN k % 4 IN (0, 1) THEN {dec} WHEN k % 4 = 2 THEN {dms} END)"
    return f"(CASE WHEN {t} < 0 THEN -{val} ELSE {val} END)"


@register("park_parse", f"""WITH {_PARK_BASE.strip()}
SELECT k + 2 AS source_row_number, {_uuid5_sql('name')} AS park_id, name,
  CASE WHEN k % 4 = 3 THEN 'Unknown location' ELSE nation END AS state_or_territory,
  {_coord_sql('la')} AS latitude, {_coord_sql('lo')} AS longitude,
  CASE WHEN k % 3 = 0 THEN make_date(CAST(1900 + k % 120 AS BIGINT), CAST(k % 12 + 1 AS BIGINT),
                                     CAST(k % 28 + 1 AS BIGINT)) END AS established_date,
  CASE k % 4 WHEN 0 THEN CAST(CAST((k * 7919) % 10000000 AS VARCHAR) || '.'
                              || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DOUBLE)
             WHEN 2 THEN NULL ELSE CAST((k * 7919) % 10000000 AS DOUBLE) END AS area_acres,
  CASE WHEN k % 3 = 1 THEN NULL ELSE CAST((k * 104729) % 5000000 AS BIGINT) END
       AS recreation_visitors_2021,
  'Founded near ' || s_name AS description
FROM named""")
def q_park_parse(spark, sf_dir):
    return R.clean_parks(P.raw_park_records(spark, sf_dir)).tables["parks"]


_F = R.PARK_FIELDS


@register("park_parse_failures", f"""WITH {_PARK_BASE.strip()}
SELECT k + 2 AS source_row_number, '' AS park_id, '' AS name, '{_F['name']}' AS source_field,
       '' AS raw_value, 'MISSING_PARK_NAME' AS failure_reason FROM base WHERE k % 9 = 0
UNION ALL
SELECT k + 2, {_uuid5_sql('name')}, name, '{_F['location']}', 'Unknown location',
       'UNPARSEABLE_OR_OUT_OF_RANGE_COORDINATES' FROM named WHERE k % 4 = 3
UNION ALL
SELECT k + 2, {_uuid5_sql('name')}, name, '{_F['established']}',
       CASE WHEN k % 3 = 1 THEN 'not a date' ELSE '' END, 'UNPARSEABLE_DATE'
FROM named WHERE k % 3 <> 0
UNION ALL
SELECT k + 2, {_uuid5_sql('name')}, name, '{_F['area']}', 'unknown', 'UNPARSEABLE_ACREAGE'
FROM named WHERE k % 4 = 2
UNION ALL
SELECT k + 2, {_uuid5_sql('name')}, name, '{_F['visitors']}', '12.5',
       'UNPARSEABLE_VISITOR_COUNT' FROM named WHERE k % 3 = 1""")
def q_park_failures(spark, sf_dir):
    return R.clean_parks(P.raw_park_records(spark, sf_dir)).audits["failures"]


@register("amenity_categories", "WITH " + P.ORACLE_CTES.strip() + ",\n"
          + P.RAW_SITES_SQL.strip() + """
SELECT source_row_number, water_availability AS water_category,
       restroom_availability AS restroom_category, fee_charged,
       CASE WHEN total_capacity_raw = '' THEN '' ELSE total_capacity END AS total_capacity,
       lat AS latitude, lon AS longitude
FROM routed_sites""")
def q_amenities(spark, sf_dir):
    r = P.raw_site_records(spark, sf_dir).select(
        "*", TX.phrase_text("water_availability").alias("_wt"),
        TX.phrase_text("restroom_availability").alias("_rt"))
    return r.select(
        "source_row_number",
        A.water_from_phrase(F.col("_wt")).alias("water_category"),
        A.restroom_from_phrase(F.col("_rt")).alias("restroom_category"),
        A.convert_fee("fee_charged").alias("fee_charged"),
        A.parse_total_capacity("total_capacity").alias("total_capacity"),
        PR.parse_latitude("latitude").alias("latitude"),
        PR.parse_longitude("longitude").alias("longitude"))


def _param_sql(key):
    q = "COALESCE(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '')"
    return f"COALESCE(regexp_extract('&' || {q}, '(?i)&{key}(?:=([^&]*))?(?:&|$)', 1), '')"


@register("url_params", f"""
SELECT page_id, {_param_sql('page')} AS page_param, {_param_sql('ref')} AS ref_param,
       CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/?#\\s]+') THEN trim(url) END
         AS safe_url
FROM pages""")
def q_url_params(spark, sf_dir):
    from ..operators.search import safe_http_url
    p = P.read_table(spark, sf_dir, "pages")
    return p.select("page_id", PR.extract_query_param("url", "page").alias("page_param"),
                    PR.extract_query_param("url", "ref").alias("ref_param"),
                    safe_http_url(F.col("url")).alias("safe_url"))


@register("html_to_text")
def q_html_text(spark, sf_dir):
    """Visible text of every page (entities decoded, script/style dropped).
    Python's HTML parser runs in an Arrow-batched UDF; no SQL equivalent."""
    p = P.read_table(spark, sf_dir, "pages")
    return p.select("page_id", TX.html_to_text("html").alias("text"))
