"""Campground job statistics: category counts, missingness, link shares,
drop reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.amenities import RESTROOM_CATEGORIES, WATER_CATEGORIES
from ..operators import routing as R
from ..operators import summaries as SM
from ..sources import projection as P
from .catalog import oracle_of, register
from .queries_entities import _clean


def _sql(select_sql: str) -> str:
    return "WITH " + P.ORACLE_CTES.strip() + ",\n" + P.RAW_SITES_SQL.strip() + "\n" + select_sql


def _domain_sql(label, column, values):
    dom = " UNION ALL ".join(f"SELECT '{v}' AS category" for v in values)
    return (f"SELECT '{label}' AS category_type, d.category, CAST(COUNT(c.{column}) AS BIGINT) "
            f"AS row_count FROM ({dom}) d LEFT JOIN clean_sites c ON c.{column} = d.category "
            f"GROUP BY d.category")


@register("category_counts", _sql(
    _domain_sql("site_subtype", "site_subtype", R.ALLOWED_SUBTYPES) + "\nUNION ALL\n"
    + _domain_sql("water_availability", "water_availability", WATER_CATEGORIES)
    + "\nUNION ALL\n"
    + _domain_sql("restroom_availability", "restroom_availability", RESTROOM_CATEGORIES)))
def q_category_counts(spark, sf_dir):
    camps = _clean(spark, sf_dir).tables["campgrounds"]
    return (SM.zero_filled_counts(camps, "site_subtype", R.ALLOWED_SUBTYPES)
            .unionByName(SM.zero_filled_counts(camps, "water_availability", WATER_CATEGORIES))
            .unionByName(SM.zero_filled_counts(camps, "restroom_availability",
                                               RESTROOM_CATEGORIES)))


# Fixed values that must equal the reference: source columns whose
# missingness is reported over the retained campground rows.
MISSINGNESS_COLUMNS = ("water_availability", "restroom_availability", "directions",
                       "usda_portal_url", "fee_charged", "total_capacity")
_RAW_OF = {"water_availability": "water_availability_raw",
           "restroom_availability": "restroom_availability_raw",
           "fee_charged": "fee_charged_raw", "total_capacity": "total_capacity_raw"}


@register("subset_missingness", _sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS source_column, "
    f"CAST(COUNT(*) FILTER (WHERE trim(COALESCE({_RAW_OF.get(c, c)}, '')) = '') AS BIGINT) "
    f"AS missing_count, round(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER "
    f"(WHERE trim(COALESCE({_RAW_OF.get(c, c)}, '')) = '') * 100.0 / COUNT(*) ELSE 0.0 END, 6) "
    f"AS missing_percentage FROM kept_sites" for c in MISSINGNESS_COLUMNS) + ") m"))
def q_subset_missingness(spark, sf_dir):
    raw = P.raw_site_records(spark, sf_dir)
    kept = R.route_sites(raw).where(F.col("drop_reason").isNull())
    return SM.missingness(kept, MISSINGNESS_COLUMNS)


@register("link_shares", _sql("""
SELECT CAST(COUNT(*) AS BIGINT) AS final_campground_row_count,
  CAST(COUNT(DISTINCT campground_id) AS BIGINT) AS unique_identifier_count,
  CAST(COUNT(*) FILTER (WHERE recarea_id <> '') AS BIGINT) AS validated_recarea_link_count,
  round(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE recarea_id <> '') * 100.0 / COUNT(*)
        ELSE 0.0 END, 6) AS validated_recarea_link_percentage,
  CAST(COUNT(*) FILTER (WHERE recarea_id = '') AS BIGINT) AS unmatched_recarea_link_count,
  round(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE recarea_id = '') * 100.0 / COUNT(*)
        ELSE 0.0 END, 6) AS unmatched_recarea_link_percentage
FROM clean_sites"""))
def q_link_shares(spark, sf_dir):
    return SM.link_shares(_clean(spark, sf_dir).tables["campgrounds"])


@register("drop_reason_counts", _sql("""
SELECT CASE WHEN drop_reason = 'UNSUPPORTED_SITE_SUBTYPE' THEN 'UNSUPPORTED_SITE_SUBTYPE'
            ELSE 'INVALID_REQUIRED_DATA' END AS drop_category,
       drop_reason, CAST(COUNT(*) AS BIGINT) AS row_count
FROM routed_reasons WHERE drop_reason IS NOT NULL GROUP BY 1, 2"""))
def q_drop_reason_counts(spark, sf_dir):
    return SM.counts_by(_clean(spark, sf_dir).audits["dropped"], "drop_category", "drop_reason")
