"""Source queries: record shapes, typed load, conversion failures, raw audits, HTML fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import routing as R
from ..sources import csv as CSV
from ..sources import projection as P
from ..sources import tables as T
from .catalog import register


def _t(spark, sf_dir, name):
    return P.read_table(spark, sf_dir, name)


# Records of three fields written from the key: quoted separators and quotes never count.
@register("csv_row_shapes", """
SELECT k AS supplier_id, CASE k % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE 1 END AS fields,
  CASE k % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'short' WHEN 5 THEN 'short' ELSE 'long' END AS row_shape
FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT p_partkey FROM part) s""")
def q_csv_row_shapes(spark, sf_dir):
    keys = (_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
            .unionByName(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))))
    k, key = F.col("k") % 6, F.col("k").cast("string")
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit(', the ""first"",\n'), key, F.lit('"'))
    record = (F.when(k == 0, F.concat_ws(",", key, quoted, F.lit("x")))
              .when(k == 1, F.concat_ws(",", key, F.lit(""), F.lit('""')))
              .when(k == 2, F.concat_ws(",", key, quoted))
              .when(k == 3, F.concat_ws(",", key, quoted, F.lit("x"), F.lit("y")))
              .when(k == 4, F.concat_ws(",", key, quoted, F.lit("x"), F.lit("")))
              .otherwise(quoted))
    n = CSV.field_count(record)
    return keys.select(F.col("k").alias("supplier_id"), n.cast("int").alias("fields"),
                       CSV.row_shape(n, 3).alias("row_shape"))


# Text of a typed load: blanks, numbers in several spellings, words where numbers belong.
_LOAD_SQL = """(SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS id_text,
  CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN '12' WHEN 2 THEN '1.5' WHEN 3 THEN '1d' WHEN 4 THEN 'inf'
    WHEN 5 THEN 'nan' ELSE CAST(s_suppkey AS VARCHAR) END AS number_text,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Nan' WHEN 2 THEN 'NaN' ELSE s_name END AS name_text,
  CASE s_suppkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN '' ELSE 'maybe' END AS flag_text FROM supplier)"""


def _load_spec():
    from ..functions import parse as PR
    return T.TableSpec("suppliers", (
        T.ColumnSpec("supplier_id", "id_text", PR.as_integer, required=True),
        T.ColumnSpec("count", "number_text", PR.as_integer),
        T.ColumnSpec("amount", "number_text", PR.as_real),
        T.ColumnSpec("name", "name_text", PR.null_if_missing, required=True),
        T.ColumnSpec("flag", "flag_text", PR.as_yn_flag)), ("supplier_id",))


def _load_rows(spark, sf_dir):
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    n, m, q = k % 7, k % 5, k % 4
    return _t(spark, sf_dir, "supplier").select(
        k.alias("source_row_number"), text.alias("id_text"),
        F.when(n == 0, "").when(n == 1, "12").when(n == 2, "1.5").when(n == 3, "1d").when(n == 4, "inf")
        .when(n == 5, "nan").otherwise(text).alias("number_text"),
        F.when(m == 0, "").when(m == 1, "Nan").when(m == 2, "NaN").otherwise(F.col("s_name")).alias("name_text"),
        F.when(q == 0, "Y").when(q == 1, "N").when(q == 2, "").otherwise("maybe").alias("flag_text"))


@register("typed_load", f"""
SELECT k AS supplier_id, CASE k % 7 WHEN 1 THEN 12 WHEN 6 THEN k END AS count,
  CASE k % 7 WHEN 1 THEN 12.0 WHEN 2 THEN 1.5 WHEN 6 THEN CAST(k AS DOUBLE) END::DOUBLE AS amount,
  nullif(name_text, '') AS name, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS flag
FROM {_LOAD_SQL} r""")
def q_typed_load(spark, sf_dir):
    return T.load_table(_load_rows(spark, sf_dir), _load_spec())


@register("load_failures", f"""
SELECT k AS source_row_number, column_name, raw_value FROM (
  SELECT k, 'count' AS column_name, number_text AS raw_value FROM {_LOAD_SQL} r WHERE k % 7 IN (2, 3, 4, 5)
  UNION ALL SELECT k, 'amount', number_text FROM {_LOAD_SQL} r WHERE k % 7 IN (3, 4, 5)
  UNION ALL SELECT k, 'name', '' FROM {_LOAD_SQL} r WHERE k % 5 = 0
  UNION ALL SELECT k, 'flag', 'maybe' FROM {_LOAD_SQL} r WHERE k % 4 = 3) f""")
def q_load_failures(spark, sf_dir):
    return T.conversion_failures(_load_rows(spark, sf_dir), _load_spec())


_RELATION_SQL = """(SELECT event_id,
  CASE WHEN event_id % 11 = 0 THEN ' ' ELSE '<' || user_id || '> &amp; co' END AS area,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS activity FROM events)"""


@register("dropped_rows_raw", f"""
SELECT event_id, CASE WHEN event_id % 143 = 0 THEN 'MISSING_RECAREAID_AND_ACTIVITYID'
    WHEN event_id % 11 = 0 THEN 'MISSING_RECAREAID' ELSE 'MISSING_ACTIVITYID' END AS drop_reason, area, activity
FROM {_RELATION_SQL} r WHERE event_id % 11 = 0 OR event_id % 13 = 0""")
def q_dropped_rows_raw(spark, sf_dir):
    """The audit holds values as they came, while the rule looks at cleaned ones."""
    e = F.col("event_id")
    raw = _t(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit("<"), F.col("user_id"), F.lit("> &amp; co"))).alias("area"),
        F.when(e % 13 == 0, "").otherwise(F.col("event_type")).alias("activity"))
    cleaned = raw.select("*", TX.preserve_identifier("area").alias("area_id"),
                         TX.preserve_identifier("activity").alias("activity_id"))
    routed = R.relationship_routing(cleaned, "area_id", "activity_id", "RECAREAID", "ACTIVITYID")
    return routed.where(F.col("drop_reason").isNotNull()).select("event_id", "drop_reason", "area", "activity")


@register("row_accounting", """
SELECT CAST(COUNT(*) AS BIGINT) AS source_rows,
  CAST(COUNT(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 13 <> 0) AS BIGINT) AS kept_rows,
  CAST(COUNT(*) FILTER (WHERE event_id % 11 = 0 OR event_id % 13 = 0) AS BIGINT) AS dropped_rows,
  CAST(0 AS BIGINT) AS unaccounted_rows FROM events""")
def q_row_accounting(spark, sf_dir):
    source = _t(spark, sf_dir, "events")
    dropped = q_dropped_rows_raw(spark, sf_dir)
    e = F.col("event_id")
    kept = source.where((e % 11 != 0) & (e % 13 != 0))
    return R.row_accounting(source, kept, dropped)


# Page fragments written from the key around a text that is known.
@register("html_fragments", """
SELECT p_partkey AS part_id, CASE p_partkey % 6
  WHEN 0 THEN p_name WHEN 1 THEN p_name || ' & co' WHEN 2 THEN 'a ' || p_name || ' b'
  WHEN 3 THEN '5<10 ' || p_name WHEN 4 THEN p_name ELSE '' END AS plain FROM part""")
def q_html_fragments(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    html = (F.when(k == 0, F.concat(F.lit(" <p>"), n, F.lit("</p>\n")))
            .when(k == 1, F.concat(F.lit("<b>"), n, F.lit("</b> &amp;&nbsp;co")))
            .when(k == 2, F.concat(F.lit("<ul><li>a<li>"), n, F.lit("</ul><br>b")))
            .when(k == 3, F.concat(F.lit("5<10 "), n))
            .when(k == 4, F.concat(F.lit("<script>x<y</script><style>p{}</style><!-- c -->"), n, F.lit("<template>t</template>")))
            .otherwise(F.lit("<div> \t</div>")))
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.coalesce(TX.html_to_text(html), F.lit("")).alias("plain"))
