"""Entity canonicalisation from repeated source rows.

Source rows repeat an entity's attributes (one row per relationship); the
canonical value of an attribute is its most frequent non-blank value, ties
broken by the case-folded value and then the value itself. The plan is
unpivot -> count per (entity, attribute, value) -> min_by per (entity,
attribute): all three steps aggregate partially before their shuffle, so a
very frequent entity never sends its raw rows to one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, preserve_identifier


def attribute_values(df: DataFrame, id_col: str, attrs: Sequence[str],
                     clean=None) -> DataFrame:
    """Long form (entity_id, attribute, value) of the non-blank values."""
    def prep(c):
        v = F.col(c).cast("string")
        return clean(v) if clean is not None else v
    long = df.select(preserve_identifier(F.col(id_col).cast("string")).alias("entity_id"),
                     F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"),
                                                  prep(a).alias("value"))
                                         for a in attrs])).alias("_kv"))
    return (long.select("entity_id", "_kv.attribute", "_kv.value")
            .where((F.col("entity_id") != "") & F.col("value").isNotNull()
                   & (F.col("value") != "")))


def value_counts(df: DataFrame, id_col: str, attrs: Sequence[str], clean=None) -> DataFrame:
    return (attribute_values(df, id_col, attrs, clean)
            .groupBy("entity_id", "attribute", "value")
            .agg(F.count(F.lit(1)).cast("bigint").alias("value_count")))


def _choice_key():
    # Smallest key wins: highest count, then case-folded value, then value.
    return F.struct((-F.col("value_count")).alias("n"), casefold("value").alias("f"),
                    F.col("value").alias("v"))


def selected_values(counts: DataFrame) -> DataFrame:
    """Per (entity, attribute): selected value and count, and the number of
    distinct non-blank values."""
    return (counts.groupBy("entity_id", "attribute")
            .agg(F.min_by(F.col("value"), _choice_key()).alias("selected_value"),
                 F.max("value_count").alias("selected_count"),
                 F.count(F.lit(1)).cast("bigint").alias("distinct_non_blank_value_count")))


def canonical_entities(df: DataFrame, id_col: str, attrs: Sequence[str], clean=None
                       ) -> DataFrame:
    """One row per entity with at least one non-blank attribute; each
    attribute holds its canonical value ('' when all its values are blank)."""
    sel = selected_values(value_counts(df, id_col, attrs, clean))
    wide = (sel.groupBy("entity_id").pivot("attribute", list(attrs))
            .agg(F.first("selected_value")))
    return wide.select(F.col("entity_id").alias(id_col),
                       *[F.coalesce(F.col(a), F.lit("")).alias(a) for a in attrs])


def value_conflicts(df: DataFrame, id_col: str, attrs: Sequence[str], entity_type: str,
                    clean=None) -> DataFrame:
    """(entity, attribute) pairs with more than one distinct non-blank value."""
    sel = selected_values(value_counts(df, id_col, attrs, clean))
    return (sel.where(F.col("distinct_non_blank_value_count") > 1)
            .select(F.lit(entity_type).alias("entity_type"), "entity_id",
                    F.col("attribute").alias("source_column"), "selected_value",
                    "selected_count", "distinct_non_blank_value_count"))


def conflict_value_counts(df: DataFrame, id_col: str, attrs: Sequence[str], clean=None
                          ) -> DataFrame:
    """Every value of every conflicting (entity, attribute), with its count
    and an ordering key (count desc, case-folded, literal). Long format: no
    group is collected into one row, however many values it has."""
    counts = value_counts(df, id_col, attrs, clean)
    conflicting = (counts.groupBy("entity_id", "attribute").agg(F.count(F.lit(1)).alias("_d"))
                   .where(F.col("_d") > 1).drop("_d"))
    return (counts.join(conflicting, ["entity_id", "attribute"], "left_semi")
            .select("entity_id", F.col("attribute").alias("source_column"), "value",
                    "value_count"))


MOST_LISTED = 1000  # values of a group that are written as one text


def ordered_value_counts_text(long_counts: DataFrame, max_values: int = MOST_LISTED) -> DataFrame:
    """``{"value":count,...}`` per group in choice order, for the groups of at most
    ``max_values`` values; larger ones have NULL here and stand in the long form alone. Groups
    are counted before a value is gathered, so none is gathered beyond that bound."""
    keys = ["entity_id", "source_column"]
    sizes = long_counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    small = long_counts.join(sizes.where(F.col("_size") <= max_values), keys, "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct(
        (-F.col("value_count")).alias("n"), casefold("value").alias("f"),
        F.col("value").alias("v"), F.col("value_count").alias("c"))))
    listed = (small.groupBy(*keys).agg(ordered.alias("_o"))
              .select(*keys, F.to_json(F.map_from_entries(F.transform(
                  "_o", lambda x: F.struct(x["v"], x["c"])))).alias("value_counts")))
    return sizes.select(*keys).join(listed, keys, "left")


def bridge_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct (left, right) pairs with the number of source rows each."""
    return (df.select(preserve_identifier(F.col(left).cast("string")).alias(left),
                      preserve_identifier(F.col(right).cast("string")).alias(right))
            .where((F.col(left) != "") & (F.col(right) != ""))
            .groupBy(left, right).agg(F.count(F.lit(1)).cast("bigint").alias("source_rows")))


def bridge_summary(pairs: DataFrame) -> DataFrame:
    """Pairs kept, source rows, and duplicate rows removed (sum of n - 1)."""
    return pairs.agg(F.count(F.lit(1)).cast("bigint").alias("relationship_count"),
                     F.sum("source_rows").cast("bigint").alias("source_relationship_rows"),
                     F.sum(F.col("source_rows") - 1).cast("bigint")
                     .alias("duplicate_relationships_removed"))
