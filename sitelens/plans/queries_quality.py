"""Validation queries: issues table, orphans, duplicate keys, key health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import projection as P
from .catalog import dist_sql, oracle_of, register, with_domain
from .queries_search import (ALL_ACTIVITIES, MATRIX_RADIUS_KM, q_distance_matrix,
                             q_search_all)


def _t(spark, sf_dir, name):
    return P.read_table(spark, sf_dir, name)


_MATRIX_SQL = f"""(SELECT park_id, campground_id, distance_km FROM (
  SELECT p.park_id, c.campground_id,
         {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} AS distance_km
  FROM parks p, campgrounds c) d0 WHERE distance_km <= {MATRIX_RADIUS_KM})"""

_ISSUES_SQL = f"""
SELECT 'invalid_national_park_coordinate' AS issue, CAST(park_id AS VARCHAR) AS record_key
FROM parks WHERE latitude NOT BETWEEN -90.0 AND 90.0 OR longitude NOT BETWEEN -180.0 AND 180.0
UNION ALL
SELECT 'invalid_campground_coordinate', CAST(campground_id AS VARCHAR) FROM campgrounds
WHERE latitude NOT BETWEEN -90.0 AND 90.0 OR longitude NOT BETWEEN -180.0 AND 180.0
UNION ALL
SELECT 'invalid_campground_type', CAST(campground_id AS VARCHAR) FROM campgrounds
WHERE campground_type NOT IN ('CAMPGROUND', 'GROUP CAMPGROUND', 'HORSE CAMP')
UNION ALL
SELECT 'invalid_water_category', CAST(campground_id AS VARCHAR) FROM campgrounds
WHERE water_category NOT IN ('AVAILABLE', 'NOT_AVAILABLE', 'NATURAL_SOURCE', 'NEARBY',
                             'OTHER', 'UNKNOWN')
UNION ALL
SELECT 'invalid_restroom_category', CAST(campground_id AS VARCHAR) FROM campgrounds
WHERE restroom_category NOT IN ('FLUSH', 'VAULT', 'COMPOSTING', 'PORTABLE', 'MULTIPLE',
                                'NONE', 'OTHER', 'UNKNOWN')
UNION ALL
SELECT 'duplicate_recreation_area_activity',
       CAST(recarea_id AS VARCHAR) || ':' || CAST(activity_id AS VARCHAR)
FROM bridge GROUP BY recarea_id, activity_id HAVING COUNT(*) > 1
UNION ALL
SELECT 'no_linked_campgrounds', ''
WHERE NOT EXISTS (SELECT 1 FROM campgrounds WHERE recarea_id IS NOT NULL)
UNION ALL
SELECT 'no_unlinked_campgrounds', ''
WHERE NOT EXISTS (SELECT 1 FROM campgrounds WHERE recarea_id IS NULL)
UNION ALL
SELECT 'water_unknown_or_negative_missing', ''
WHERE NOT EXISTS (SELECT 1 FROM campgrounds WHERE water_category = 'UNKNOWN')
   OR NOT EXISTS (SELECT 1 FROM campgrounds WHERE water_category = 'NOT_AVAILABLE')
UNION ALL
SELECT 'restroom_unknown_or_negative_missing', ''
WHERE NOT EXISTS (SELECT 1 FROM campgrounds WHERE restroom_category = 'UNKNOWN')
   OR NOT EXISTS (SELECT 1 FROM campgrounds WHERE restroom_category = 'NONE')
UNION ALL
SELECT 'negative_distance', CAST(park_id AS VARCHAR) || ':' || CAST(campground_id AS VARCHAR)
FROM {_MATRIX_SQL} m WHERE distance_km < 0.0
UNION ALL
SELECT 'duplicate_park_campground_distance',
       CAST(park_id AS VARCHAR) || ':' || CAST(campground_id AS VARCHAR)
FROM {_MATRIX_SQL} m GROUP BY park_id, campground_id HAVING COUNT(*) > 1
UNION ALL
SELECT DISTINCT 'campground_recarea_orphan', CAST(c.recarea_id AS VARCHAR) FROM campgrounds c
WHERE c.recarea_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM areas a WHERE a.recarea_id = c.recarea_id)
UNION ALL
SELECT 'duplicate_lineitem_line',
       CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
UNION ALL
SELECT 'negative_customer_balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
"""


@register("validation_issues", with_domain(_ISSUES_SQL))
def q_validation_issues(spark, sf_dir):
    d = P.domain(spark, sf_dir)
    matrix = q_distance_matrix(spark, sf_dir)
    return Q.union_issues([
        Q.location_issues(d["parks"], d["campgrounds"], d["areas"], d["bridge"],
                          distances=matrix),
        Q.orphan_issues(d["campgrounds"], "recarea_id", d["areas"], "recarea_id",
                        "campground_recarea_orphan"),
        Q.duplicate_issues(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"],
                           "duplicate_lineitem_line"),
        Q.negative_issues(_t(spark, sf_dir, "customer"), ["c_custkey"], "c_acctbal",
                          "negative_customer_balance"),
    ])


@register("fk_orphans", with_domain("""
SELECT DISTINCT c.recarea_id FROM campgrounds c
WHERE c.recarea_id IS NOT NULL
  AND c.recarea_id NOT IN (SELECT recarea_id FROM areas)"""))
def q_fk_orphans(spark, sf_dir):
    d = P.domain(spark, sf_dir)
    return Q.orphan_keys(d["campgrounds"], "recarea_id", d["areas"], "recarea_id")


@register("duplicate_keys", """
SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_duplicate_keys(spark, sf_dir):
    return Q.duplicate_groups(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("matrix_cardinality", with_domain(f"""
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM {_MATRIX_SQL} m) AS matrix_rows,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM parks) AS park_count,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM campgrounds) AS campground_count,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM parks) * (SELECT CAST(COUNT(*) AS BIGINT) FROM campgrounds)
         AS full_matrix_rows"""))
def q_matrix_cardinality(spark, sf_dir):
    d = P.domain(spark, sf_dir)
    return Q.cardinality_report(q_distance_matrix(spark, sf_dir), d["parks"], d["campgrounds"])


def _key_sql(table, keys):
    null_cond = " OR ".join(f"{k} IS NULL" for k in keys)
    not_null = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    klist = ", ".join(keys)
    return f"""
SELECT '{table}' AS table_name, '{','.join(keys)}' AS key_columns,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM {table}) AS row_count,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM {table} WHERE {null_cond}) AS null_key_rows,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT {klist} FROM {table} WHERE {not_null}
     GROUP BY {klist} HAVING COUNT(*) > 1) g) AS duplicate_key_groups,
  (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM {table}
     WHERE {not_null} GROUP BY {klist} HAVING COUNT(*) > 1) g) AS excess_rows"""


_KEY_TABLES = (("parks", ("park_id",)), ("campgrounds", ("campground_id",)),
               ("areas", ("recarea_id",)), ("activities", ("activity_id",)),
               ("bridge", ("recarea_id", "activity_id")), ("orders", ("o_orderkey",)),
               ("lineitem", ("l_orderkey", "l_linenumber")))


@register("key_checks", with_domain("\nUNION ALL\n".join(_key_sql(t, k) for t, k in _KEY_TABLES)))
def q_key_checks(spark, sf_dir):
    d = P.domain(spark, sf_dir)
    d["orders"] = _t(spark, sf_dir, "orders")
    d["lineitem"] = _t(spark, sf_dir, "lineitem")
    return Q.union_issues([Q.key_report(d[t], t, list(k)) for t, k in _KEY_TABLES])


_N_SELECTED = len(dict.fromkeys(ALL_ACTIVITIES))


@register("all_activity_check", f"""
SELECT CAST(COUNT(*) AS BIGINT) AS result_rows,
  CAST(COUNT(DISTINCT campground_id) AS BIGINT) AS result_campgrounds,
  CAST(COUNT(*) * {_N_SELECTED} AS BIGINT) AS matched_pairs,
  CAST(0 AS BIGINT) AS failing_rows
FROM ({oracle_of("search_all_activities")}) r""")
def q_all_activity_check(spark, sf_dir):
    d = P.domain(spark, sf_dir)
    return Q.activity_check_counts(q_search_all(spark, sf_dir), d["bridge"], ALL_ACTIVITIES)
