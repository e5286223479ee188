"""Profiling queries over driver tables (values profiled as text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PF
from ..sources import projection as P
from .catalog import register

# Every column of the tables, and a text table whose values (written from the key)
# reach the types that the others do not have.
PROFILED = (("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
            ("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        "o_orderdate", "o_orderpriority")),
            ("typed", ("flag", "nothing", "moment", "day", "padded", "ratio", "word")))
TYPED_SQL = """typed AS (SELECT
  CASE s_suppkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' ELSE '' END AS flag,
  CASE s_suppkey % 2 WHEN 0 THEN chr(9) || ' ' ELSE NULL END AS nothing,
  '2021-03-0' || (1 + s_suppkey % 9) || 'T10:0' || (s_suppkey % 10) || ':00Z' AS moment,
  'March ' || (1 + s_suppkey % 28) || ', 2020' AS day,
  '00' || s_suppkey AS padded,
  (s_suppkey % 7) || '.' || (s_suppkey % 4) || 'e2' AS ratio,
  'w' || (s_suppkey % 5) AS word FROM supplier)"""


def _typed(spark, sf_dir):
    k = F.col("s_suppkey")
    part = lambda n, plus=0: (k % n + plus).cast("string")
    return P.read_table(spark, sf_dir, "supplier").select(
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "N").otherwise("").alias("flag"),
        F.when(k % 2 == 0, "\t ").alias("nothing"),
        F.concat(F.lit("2021-03-0"), part(9, 1), F.lit("T10:0"), part(10), F.lit(":00Z")).alias("moment"),
        F.concat(F.lit("March "), part(28, 1), F.lit(", 2020")).alias("day"),
        F.concat(F.lit("00"), k.cast("string")).alias("padded"),
        F.concat(part(7), F.lit("."), part(4), F.lit("e2")).alias("ratio"),
        F.concat(F.lit("w"), part(5)).alias("word"))


def _t(spark, sf_dir, name):
    return P.read_table(spark, sf_dir, name)


def _cells_sql(table, cols):
    parts = [f"SELECT {i + 1} AS column_position, '{c}' AS column_name, "
             f"CAST({c} AS VARCHAR) AS value, rn FROM numbered_{table}"
             for i, c in enumerate(cols)]
    return "\nUNION ALL\n".join(parts)


def _profile_sql(table, cols):
    ident = [c for c in cols if PF.is_identifier_name(c)]
    ident_sql = ("column_name IN (" + ", ".join(f"'{c}'" for c in ident) + ")") if ident else "FALSE"
    bools = ", ".join(f"'{b}'" for b in PF.BOOLEAN_WORDS)
    pres = "(value IS NOT NULL AND NOT regexp_full_match(value, '\\s*'))"
    return f"""
numbered_{table} AS (SELECT *, ROW_NUMBER() OVER () - 1 AS rn FROM {table}),
counts_{table} AS (
  SELECT column_position, column_name, value, COUNT(*) AS n, MIN(rn) AS first_row
  FROM ({_cells_sql(table, cols)}) c GROUP BY column_position, column_name, value),
stats_{table} AS (
  SELECT column_position, column_name, CAST(SUM(n) AS BIGINT) AS row_count,
    CAST(SUM(CASE WHEN {pres} THEN n ELSE 0 END) AS BIGINT) AS non_missing_count,
    CAST(COUNT(CASE WHEN {pres} THEN value END) AS BIGINT) AS distinct_count,
    CAST(MAX(length(COALESCE(value, ''))) AS BIGINT) AS maximum_text_length,
    COALESCE(bool_and(CASE WHEN {pres} THEN upper(value) IN ({bools}) END), TRUE) AS b_bool,
    COALESCE(bool_and(CASE WHEN {pres} THEN regexp_matches(value, '{PF.INTEGER_PATTERN}') END), TRUE) AS b_int,
    COALESCE(bool_or(CASE WHEN {pres} THEN regexp_matches(value, '{PF.LEADING_ZERO_PATTERN}')
        AND regexp_replace(value, '[+-]?0+', '', 'g') <> '' END), FALSE) AS b_lead0,
    COALESCE(bool_and(CASE WHEN {pres} THEN regexp_matches(value, '{PF.INTEGER_PATTERN}')
        OR regexp_matches(value, '{PF.FLOAT_PATTERN}') END), TRUE) AS b_num,
    COALESCE(bool_and(CASE WHEN {pres} THEN regexp_matches(value, '{PF.ISO_DATETIME_PATTERN}') END), TRUE) AS b_dt,
    COALESCE(bool_and(CASE WHEN {pres} THEN regexp_matches(value, '{PF.ISO_DATE_PATTERN}') END), TRUE) AS b_d,
    COALESCE(bool_and(CASE WHEN {pres} THEN try_strptime(value, '%B %d, %Y') IS NOT NULL END), TRUE) AS b_ld
  FROM counts_{table} GROUP BY column_position, column_name),
samples_{table} AS (
  SELECT column_position, column_name, string_agg(value, '|' ORDER BY r) AS sample_values FROM (
    SELECT column_position, column_name, value,
           ROW_NUMBER() OVER (PARTITION BY column_position, column_name ORDER BY first_row, value) AS r
    FROM counts_{table} WHERE {pres}) s WHERE r <= {PF.SAMPLE_LIMIT}
  GROUP BY column_position, column_name),
profile_{table} AS (
  SELECT '{table}' AS dataset, s.column_position, s.column_name,
    CASE WHEN distinct_count = 0 THEN 'empty' WHEN {ident_sql} THEN 'string'
         WHEN b_bool THEN 'boolean' WHEN b_int AND b_lead0 THEN 'string' WHEN b_int THEN 'integer'
         WHEN b_num THEN 'float' WHEN b_dt THEN 'datetime' WHEN b_d OR b_ld THEN 'date'
         ELSE 'string' END AS inferred_data_type,
    row_count, non_missing_count, row_count - non_missing_count AS missing_count,
    round(CASE WHEN row_count > 0 THEN (row_count - non_missing_count) * 100.0 / row_count
               ELSE 0.0 END, 6) AS missing_percentage,
    distinct_count, COALESCE(p.sample_values, '') AS sample_values, maximum_text_length
  FROM stats_{table} s LEFT JOIN samples_{table} p
    ON p.column_position = s.column_position AND p.column_name = s.column_name)"""


@register("column_profile", f"WITH {TYPED_SQL}, " + ",".join(_profile_sql(t, c) for t, c in PROFILED)
          + "\n" + "\nUNION ALL\n".join(f"SELECT * FROM profile_{t}" for t, _ in PROFILED))
def q_column_profile(spark, sf_dir):
    out = None
    for table, cols in PROFILED:
        rows = _typed(spark, sf_dir) if table == "typed" else _t(spark, sf_dir, table).select(*cols)
        p = PF.column_profile(rows, table)
        out = p if out is None else out.unionByName(p)
    return out


_LI_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _key_single_sql(col):
    pres = f"({col} IS NOT NULL AND trim(CAST({col} AS VARCHAR)) <> '')"
    return f"""SELECT '{col}' AS candidate, 1 AS column_count, COUNT(*) AS row_count,
  COUNT(*) FILTER (WHERE NOT {pres}) AS missing_key_rows,
  COUNT(DISTINCT CASE WHEN {pres} THEN CAST({col} AS VARCHAR) END) AS distinct_non_missing_count
FROM lineitem"""


@register("key_analysis", f"""
SELECT 'lineitem' AS dataset, candidate, column_count, CAST(row_count AS BIGINT) AS row_count,
  CAST(row_count - missing_key_rows AS BIGINT) AS non_missing_key_rows,
  CAST(missing_key_rows AS BIGINT) AS missing_key_rows,
  CAST(distinct_non_missing_count AS BIGINT) AS distinct_non_missing_count,
  CAST(row_count - missing_key_rows - distinct_non_missing_count AS BIGINT)
    AS duplicate_non_missing_rows,
  (row_count - missing_key_rows > 0 AND distinct_non_missing_count = row_count - missing_key_rows)
    AS is_unique_among_non_missing,
  (row_count > 0 AND missing_key_rows = 0) AS is_complete,
  (row_count > 0 AND missing_key_rows = 0 AND row_count - missing_key_rows > 0
   AND distinct_non_missing_count = row_count - missing_key_rows) AS is_candidate_key
FROM ({' UNION ALL '.join(_key_single_sql(c) for c in _LI_COLS)}
  UNION ALL
  SELECT 'l_orderkey,l_linenumber', 2, COUNT(*), 0,
         (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d)
  FROM lineitem) k""")
def q_key_analysis(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(*_LI_COLS)
    return PF.key_analysis(li, "lineitem", [("l_orderkey", "l_linenumber")])


@register("duplicate_rows", """
SELECT 'documents' AS dataset, CAST(COUNT(*) AS BIGINT) AS exact_duplicate_group_count,
  CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS exact_duplicate_row_count,
  CAST(COALESCE(SUM(n), 0) AS BIGINT) AS exact_duplicate_rows_involved
FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text, lang, source, n_chars
      HAVING COUNT(*) > 1) g""")
def q_duplicate_rows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars")
    return PF.duplicate_rows(d, "documents")


@register("value_frequencies", """
SELECT p_name AS value, CAST(COUNT(*) AS BIGINT) AS count FROM part
WHERE p_name IS NOT NULL AND trim(p_name) <> ''
GROUP BY p_name ORDER BY count DESC, value LIMIT 20""")
def q_value_frequencies(spark, sf_dir):
    return PF.top_values(_t(spark, sf_dir, "part"), "p_name", 20)


@register("fd_violations", """
WITH pairs AS (SELECT DISTINCT p_name AS determinant, CAST(p_partkey AS VARCHAR) AS dependent
               FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> ''),
     c AS (SELECT determinant, COUNT(*) AS n FROM pairs GROUP BY determinant HAVING COUNT(*) > 1)
SELECT p.determinant, p.dependent, CAST(c.n AS BIGINT) AS n_dependents
FROM pairs p JOIN c ON c.determinant = p.determinant""")
def q_fd_violations(spark, sf_dir):
    return PF.fd_violations(_t(spark, sf_dir, "part"), "p_name", "p_partkey")


# Names as a source might write them, made from the key; the oracle says from the key
# which marks each one must get.
_NAMES_SQL = """(SELECT p_partkey AS k, CASE p_partkey % 9
  WHEN 0 THEN p_name WHEN 1 THEN p_name || ' *' WHEN 2 THEN p_name || '[a]' WHEN 3 THEN p_name || '[]'
  WHEN 4 THEN p_name || '[note 4][5]' WHEN 5 THEN p_name || chr(9) WHEN 6 THEN p_name || chr(10) || chr(10) || 'x'
  WHEN 7 THEN chr(160) || p_name ELSE '*[' || p_name || ']  *' END AS name FROM part)"""
_STAR, _CITED, _SPACED = "k % 9 IN (1, 8)", "k % 9 IN (2, 4, 8)", "k % 9 IN (5, 6, 7, 8)"


def _names(spark, sf_dir):
    k, n = F.col("p_partkey") % 9, F.col("p_name")
    name = (F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" *"))).when(k == 2, F.concat(n, F.lit("[a]")))
            .when(k == 3, F.concat(n, F.lit("[]"))).when(k == 4, F.concat(n, F.lit("[note 4][5]")))
            .when(k == 5, F.concat(n, F.lit("\t"))).when(k == 6, F.concat(n, F.lit("\n\nx")))
            .when(k == 7, F.concat(F.lit("\u00a0"), n)).otherwise(F.concat(F.lit("*["), n, F.lit("]  *"))))
    return _t(spark, sf_dir, "part").select(name.alias("name"))


@register("name_flags", f"""
SELECT CAST(COUNT(*) FILTER (WHERE {_STAR}) AS BIGINT) AS star_count,
  CAST(COUNT(*) FILTER (WHERE {_CITED}) AS BIGINT) AS citation_count,
  CAST(COUNT(*) FILTER (WHERE {_SPACED}) AS BIGINT) AS unusual_whitespace_count,
  CAST(COUNT(DISTINCT CASE WHEN k % 9 NOT IN (0, 3) THEN name END) AS BIGINT) AS flagged_count
FROM {_NAMES_SQL} n""")
def q_name_flags(spark, sf_dir):
    return PF.name_flags(_names(spark, sf_dir), "name")


@register("flagged_names", f"""
SELECT DISTINCT name, {_STAR} AS has_star, {_CITED} AS has_citation, {_SPACED} AS has_unusual_whitespace
FROM {_NAMES_SQL} n WHERE k % 9 NOT IN (0, 3)""")
def q_flagged_names(spark, sf_dir):
    return PF.flagged_names(_names(spark, sf_dir), "name")


@register("attribute_conflicts", """
WITH cells AS (SELECT source AS key, 'lang' AS attribute, coalesce(lang, '') AS value FROM documents
  UNION SELECT source, 'n_chars', coalesce(CAST(n_chars AS VARCHAR), '') FROM documents),
pairs AS (SELECT DISTINCT * FROM cells WHERE key IS NOT NULL AND trim(key) <> ''),
many AS (SELECT attribute, key, COUNT(*) AS n_values FROM pairs GROUP BY attribute, key HAVING COUNT(*) > 1),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY key) AS key_rank,
  COUNT(*) OVER (PARTITION BY attribute) AS conflicting_keys FROM many),
shown AS (SELECT p.attribute, p.key, p.value,
  ROW_NUMBER() OVER (PARTITION BY p.attribute, p.key ORDER BY p.value) AS r FROM pairs p)
SELECT k.attribute, CAST(k.conflicting_keys AS BIGINT) AS conflicting_keys, CAST(k.key_rank AS BIGINT) AS key_rank,
  k.key, CAST(k.n_values AS BIGINT) AS n_values, string_agg(s.value, '|' ORDER BY s.value) AS first_values
FROM ranked k JOIN shown s ON s.attribute = k.attribute AND s.key = k.key
WHERE k.key_rank <= 10 AND s.r <= 5 GROUP BY ALL""")
def q_attribute_conflicts(spark, sf_dir):
    return PF.attribute_conflicts(_t(spark, sf_dir, "documents"), "source", ["lang", "n_chars"])


@register("duplicated_ids", """
WITH ids AS (SELECT CAST(l_partkey AS VARCHAR) AS id, l_orderkey, l_linenumber FROM lineitem),
top AS (SELECT id, COUNT(*) AS n_rows FROM ids GROUP BY id HAVING COUNT(*) > 1 ORDER BY n_rows DESC, id LIMIT 10),
r AS (SELECT i.*, t.n_rows, ROW_NUMBER() OVER (PARTITION BY i.id ORDER BY l_orderkey, l_linenumber) AS record_rank
  FROM ids i JOIN top t ON t.id = i.id)
SELECT id, CAST(n_rows AS BIGINT) AS n_rows, CAST(record_rank AS BIGINT) AS record_rank, l_orderkey, l_linenumber
FROM r WHERE record_rank <= 3""")
def q_duplicated_ids(spark, sf_dir):
    return PF.duplicated_ids(_t(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"])


@register("subset_counts", """
WITH r AS (SELECT CASE WHEN event_id % 11 = 0 THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS a,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS b FROM events),
m AS (SELECT *, (a = ' ' OR b IS NULL) AS bad FROM r)
SELECT CAST(COUNT(*) AS BIGINT) AS row_count, CAST(COUNT(*) FILTER (WHERE bad) AS BIGINT) AS missing_either_rows,
  CAST(COUNT(DISTINCT nullif(a, ' ')) AS BIGINT) AS first_ids, CAST(COUNT(DISTINCT b) AS BIGINT) AS second_ids,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT DISTINCT a, b FROM m WHERE NOT bad) d) AS distinct_pairs,
  CAST(COUNT(*) FILTER (WHERE NOT bad)
    - (SELECT COUNT(*) FROM (SELECT DISTINCT a, b FROM m WHERE NOT bad) d) AS BIGINT) AS repeated_pair_rows
FROM m""")
def q_subset_counts(spark, sf_dir):
    e = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select(
        F.when(e % 11 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("a"),
        F.when(e % 13 != 0, F.col("event_type")).alias("b"))
    return PF.subset_counts(rows, "a", "b")
