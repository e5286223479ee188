"""Summaries and checks of the jobs, over the raw records that the given tables are projected to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources import projection as P
from . import jobs as J
from .catalog import oracle_of, register, with_domain
from .queries_entities import _clean, _sites_sql



def _metric(name: str, category: str, value: str, source: str) -> str:
    return f"SELECT '{name}' AS metric, {category} AS category, CAST({value} AS DOUBLE) AS value FROM {source}"


def _of(query: str) -> str:
    return f"({oracle_of(query)}) q"


_SHARES = ("final_campground_row_count", "unique_identifier_count", "validated_recarea_link_count",
           "validated_recarea_link_percentage", "unmatched_recarea_link_count", "unmatched_recarea_link_percentage")

_CAMPGROUND_SQL = "\nUNION ALL ".join([
    _metric("source_row_count", "''", "count(*)", "customer"),
    *[_metric(c, "''", c, _of("link_shares")) for c in _SHARES],
    _metric("retained_subtype_counts", "category", "row_count", _of("category_counts") + " WHERE category_type = 'site_subtype'"),
    _metric("water_category_counts", "category", "row_count", _of("category_counts") + " WHERE category_type = 'water_availability'"),
    _metric("restroom_category_counts", "category", "row_count",
            _of("category_counts") + " WHERE category_type = 'restroom_availability'"),
    _metric("missing_count", "source_column", "missing_count", _of("subset_missingness")),
    _metric("missing_percentage", "source_column", "missing_percentage", _of("subset_missingness")),
    _metric("dropped_row_count", "''", "count(*)", _of("quarantine_routing")),
    _metric("dropped_row_counts_by_category", "d.category", "count(q.drop_category)",
            "(SELECT unnest(['UNSUPPORTED_SITE_SUBTYPE', 'INVALID_REQUIRED_DATA']) AS category) d LEFT JOIN "
            + _of("quarantine_routing") + " ON q.drop_category = d.category GROUP BY d.category"),
    _metric("dropped_row_counts_by_reason", "drop_reason", "count(*)", _of("quarantine_routing") + " GROUP BY drop_reason"),
    _metric("unmatched_campground_count", "''", "count(*)", _of("unmatched_links")),
    _metric("duplicate_candidate_pair_count", "''", "count(*)", _of("duplicate_candidates"))])


@register("campground_job_figures", _CAMPGROUND_SQL)
def q_campground_job_figures(spark, sf_dir):
    return J.campground_figures(P.raw_site_records(spark, sf_dir), _clean(spark, sf_dir))


@register("campground_job_issues", _sites_sql("""
SELECT 'duplicate_campground_id' AS issue, campground_id AS record_key FROM clean_sites GROUP BY campground_id HAVING count(*) > 1
UNION ALL SELECT 'invalid_coordinates', campground_id FROM clean_sites
  WHERE TRY_CAST(latitude AS DOUBLE) IS NULL OR TRY_CAST(longitude AS DOUBLE) IS NULL
UNION ALL SELECT 'float_suffix_objectid', campground_id FROM clean_sites WHERE regexp_matches(objectid, '^[0-9]+[.]0$')"""))
def q_campground_job_issues(spark, sf_dir):
    """The job's own checks over its output: no row is expected of this data."""
    return J.check_campgrounds(_clean(spark, sf_dir), P.area_ids(spark, sf_dir))


@register("park_job_figures", "\nUNION ALL ".join([
    _metric("source_row_count", "''", "count(*)", "supplier"),
    _metric("processed_park_row_count", "''", "count(*)", _of("park_parse")),
    _metric("valid_coordinate_park_count", "''", "count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL)",
            _of("park_parse")),
    _metric("invalid_coordinate_park_count", "''", "count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL)",
            _of("park_parse")),
    _metric("parse_failure_count", "''", "count(*)", _of("park_parse_failures")),
    _metric("parse_failure_counts_by_reason", "failure_reason", "count(*)",
            _of("park_parse_failures") + " GROUP BY failure_reason")]))
def q_park_job_figures(spark, sf_dir):
    return J.checked_parks(P.raw_park_records(spark, sf_dir)).audits["figures"]


CAP = 5


@register("capped_campgrounds", with_domain(f"""
SELECT campground_id, name, (SELECT count(*) FROM campgrounds) > {CAP} AS more_exist
FROM campgrounds ORDER BY campground_id LIMIT {CAP}"""))
def q_capped(spark, sf_dir):
    """The first rows, and whether there are more."""
    rows, more = S.capped(P.domain(spark, sf_dir)["campgrounds"].select("campground_id", "name"), ["campground_id"], CAP)
    return rows.withColumn("more_exist", F.lit(more))
