"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Lines of one page are told apart by 128-bit hashes.
MAX_RATIO = 0.05
MIN_PAGES = 3
BROADCAST_BYTES = 4 << 20


def _key(col):
    return F.unhex(F.md5(col))


def boilerplate_lines(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, lines): hashes of the lines on more than ``max_ratio`` of a site's pages.

    ``pages`` has site (not null) and text. Pages of one site with the same
    text count once, so a page that was copied does not turn its own lines
    into boilerplate. A line that appears several times on a page counts once
    there; blank lines are never boilerplate. A site of n pages with L
    distinct lines each on average has fewer than L / max_ratio such lines,
    whatever its size, so the gathered list stays short.
    """
    pages = pages.filter("text is not null").select("site", "text", _key(F.col("text")).alias("page"))
    lines = pages.select("site", "page", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    seen = (lines.filter(F.trim("line") != "").select("site", "page", _key(F.col("line")).alias("line"))
            .distinct().groupBy("site", "line").agg(F.count("*").alias("c")).filter(F.col("c") >= min_pages))
    total = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n"))
    return (seen.join(total, "site").filter(F.col("c") > F.col("n") * max_ratio)
            .groupBy("site").agg(F.collect_list("line").alias("lines")))


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``text`` freed of boilerplate lines, plus n_lines and n_dropped (long).

    A line goes if the share of the site's distinct pages that hold it is above
    ``max_ratio`` and it is on at least ``min_pages`` of them. What stays
    keeps its order, joined by one \\n; a text of which nothing stays is
    empty, and a text without such lines is unchanged. A null text stays null
    with 0 lines; a null site is a site of its own; repeated rows are each
    kept; an empty table gives an empty table. Other columns pass through; the
    names n_lines and n_dropped are taken over by this operator.

    The frequent lines are found once and kept as a checkpoint. They are
    broadcast only if their counted size is within BROADCAST_BYTES; beyond it
    the plain join splits a large site's rows adaptively.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # a null site gets a name that no other site has
    key = F.concat(F.when(F.col(site).isNull(), "n").otherwise("s"), F.coalesce(F.col(site).cast("string"), F.lit("")))
    frequent = boilerplate_lines(docs.select(key.alias("site"), F.col(text).alias("text")),
                                 max_ratio, min_pages).checkpoint()
    size = frequent.agg(F.sum(F.size("lines") * 16 + F.length("site") + 64)).first()[0] or 0
    k_site, k_key, k_lines, k_stay = fresh(docs, "line_site", "line_key", "site_lines", "stay")
    side = frequent.select(F.col("site").alias(k_site), F.col("lines").alias(k_lines))
    joined = docs.select(*keep).withColumn(k_key, key)
    joined = joined.join(F.broadcast(side) if size <= BROADCAST_BYTES else side,
                         F.col(k_key) == F.col(k_site), "left")
    lines = F.split(text, "\n", -1)
    stay = F.when(F.col(k_lines).isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(k_lines), _key(x))))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return (joined.withColumn(k_stay, stay)
            .withColumn("n_lines", n)
            .withColumn("n_dropped", F.when(F.col(text).isNull(), 0)
                        .otherwise(F.col("n_lines") - F.size(k_stay)).cast("long"))
            .withColumn(text, F.array_join(k_stay, "\n"))
            .select(*keep, "n_lines", "n_dropped"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS site, source, text FROM documents),
pages AS (SELECT DISTINCT site, text FROM d WHERE text IS NOT NULL),
total AS (SELECT site, count(*) AS n FROM pages GROUP BY site),
lines AS (SELECT DISTINCT site, text, unnest(string_split(text, chr(10))) AS line FROM pages),
frequent AS (SELECT l.site, l.line FROM lines l JOIN total t ON l.site = t.site
  WHERE trim(l.line) <> '' GROUP BY l.site, l.line, t.n
  HAVING count(*) >= {MIN_PAGES} AND count(*) > t.n * {MAX_RATIO}),
lists AS (SELECT site, list(line) AS bad FROM frequent GROUP BY site),
split AS (SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS parts,
  coalesce(x.bad, []::VARCHAR[]) AS bad FROM d LEFT JOIN lists x ON d.site = x.site),
kept AS (SELECT doc_id, source, text, parts,
  list_filter(parts, lambda p: trim(p) = '' OR NOT list_contains(bad, p)) AS stay FROM split)
"""

OP9_SQL = ORACLE + """
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(stay, chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(parts) END::BIGINT AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(parts) - len(stay) END::BIGINT AS n_dropped
FROM kept
"""
