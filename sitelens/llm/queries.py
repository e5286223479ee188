"""Registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (capfilter, fingerprint, gridcode, hashring, linefreq, mixing, ordermh, pagetext, phrases, piecebpe, tokencount,
               toxicity, warczip)
from .common import table

# Target shares of the domains quality|toxic of op6.
WEIGHTS = {"1|0": 0.85, "0|0": 0.10, "1|1": 0.03, "0|1": 0.02}


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.archived_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.linked_vectors(table(spark, sf_dir, "embeddings"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                               WEIGHTS, ["quality", "toxic"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.encode_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linefreq.drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermh.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashring.assign_shards(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op13_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridcode.code_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_warc_zip, op3_toxicity, op4_cap_filters, op5_page_text, op6_mixing,
                            op7_token_counts, op8_pieces, op9_line_dedup, op10_near_dedup, op11_hash_ring, op12_phrases,
                            op13_grid_codes)}

# The archive's rows in plain SQL. DuckDB has no base32, so the digest's 160 bits are cut into fives.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS largest FROM p),
bits AS (SELECT *, list_reduce(list_transform(range(1, 41),
  lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][
    instr('0123456789abcdef', substr(hex, i, 1))]), lambda a, b: a || b) AS bin FROM d)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bin, 5 * i + 1, 1)::INT + 8 * substr(bin, 5 * i + 2, 1)::INT + 4 * substr(bin, 5 * i + 3, 1)::INT
      + 2 * substr(bin, 5 * i + 4, 1)::INT + substr(bin, 5 * i + 5, 1)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM bits
"""

# All pairs of equal labels, and the smallest id that links reach.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS other FROM v
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a),
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN comp c ON v.vec_id = c.id LEFT JOIN deg d ON v.vec_id = d.a
"""

ORACLES = {"op2_warc_zip": OP2_SQL, "op4_cap_filters": OP4_SQL, "op9_line_dedup": linefreq.OP9_SQL,
           "op11_hash_ring": hashring.OP11_SQL, "op12_phrases": phrases.OP12_SQL, "op13_grid_codes": gridcode.OP13_SQL}
