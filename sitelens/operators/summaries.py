"""Job statistics as small aggregates (no driver-side loops)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text


def zero_filled_counts(df: DataFrame, column: str, domain: Sequence[str],
                       label: str | None = None) -> DataFrame:
    """Count per category of a fixed domain, categories without rows kept
    with 0. The domain is a literal list (fixed size), joined to the
    partially aggregated counts."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(v,) for v in domain], "category string")
    counts = df.groupBy(F.col(column).alias("category")).agg(
        F.count(F.lit(1)).cast("bigint").alias("_n"))
    return (dom.join(counts, "category", "left")
            .select(F.lit(label or column).alias("category_type"), "category",
                    F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("row_count")))


def percent(part, total):
    return F.round(F.when(total > 0, part * 100.0 / total).otherwise(F.lit(0.0)), 6)


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per source column: rows whose cleaned text is blank, and their
    percentage of all rows (one aggregate, then unpivot)."""
    aggs = [F.count(F.lit(1)).alias("_total")] + [
        F.count_if(clean_text(F.col(c)) == "").alias(f"_m{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("source_column"),
                             F.col(f"_m{i}").cast("bigint").alias("missing_count"))
                    for i, c in enumerate(columns)])
    return (row.select("_total", F.explode(arr).alias("_s"))
            .select("_s.source_column", "_s.missing_count",
                    percent(F.col("_s.missing_count"), F.col("_total"))
                    .alias("missing_percentage")))


def link_shares(campgrounds: DataFrame) -> DataFrame:
    """Distinct ids, linked and unlinked counts and percentages (one row)."""
    total = F.count(F.lit(1))
    linked = F.count_if(F.col("recarea_id") != "")
    return campgrounds.agg(
        total.cast("bigint").alias("final_campground_row_count"),
        F.countDistinct("campground_id").cast("bigint").alias("unique_identifier_count"),
        linked.cast("bigint").alias("validated_recarea_link_count"),
        percent(linked, total).alias("validated_recarea_link_percentage"),
        (total - linked).cast("bigint").alias("unmatched_recarea_link_count"),
        percent(total - linked, total).alias("unmatched_recarea_link_percentage"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))


METRIC_COLUMNS = ("metric", "category", "value")


def as_metrics(one_row: DataFrame) -> DataFrame:
    """A one-row result as (metric, category, value) rows, category empty."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("category"),
                               F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.explode(cells).alias("_m")).select("_m.*")


def counted_metrics(df: DataFrame, metric: str, column: str) -> DataFrame:
    """Rows by the values of ``column`` as metric rows."""
    return df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), "category", "value")


def rows_metric(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), F.lit("").alias("category"), "value")


def union_metrics(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
