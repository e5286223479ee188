"""Profiles of long texts, hash clashes, composite keys, folding, bounded lists."""

import json
import sys

from pyspark.sql import functions as F

from column_helpers import apply
from sitelens.functions.text import casefold
from sitelens.operators import entities as EN
from sitelens.operators import profile as PF


def test_casefold_of_every_code_point(spark):
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    texts = ["".join(map(chr, points[i:i + 64])) for i in range(0, len(points), 64)]
    texts += ["Straße", "STRASSE", "İstanbul", "ﬁn ﬃ", "ΌΣΟΣ", "plain ASCII", "", "a\U00010400b"]
    assert apply(spark, lambda c: casefold(c), texts) == [t.casefold() for t in texts]
    assert apply(spark, lambda c: casefold(c), [None]) == [None]


def test_long_texts_are_counted_by_hash_and_shown_whole(spark):
    long = ["9" * 80, "x " * 50, "2021-01-01T00:00:00." + "1" * 60, " " * 70]
    rows = [(i, long[i % 4], "0" + "1" * 70, str(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "place int, mixed string, digits string, short string")
    got = {r.column_name: r for r in PF.column_profile(df, "d", ["place"]).collect()}
    m = got["mixed"]
    assert (m.distinct_count, m.non_missing_count, m.missing_count, m.maximum_text_length) == (3, 30, 10, 100)
    assert m.sample_values.split("|") == [long[0], long[1], long[2]] and m.inferred_data_type == "string"
    assert got["digits"].inferred_data_type == "string"  # a leading zero
    assert got["short"].inferred_data_type == "integer" and got["short"].sample_values == "0|1|2"
    nine = spark.createDataFrame([(1, "9" * 80)], "place int, n string")
    assert PF.column_profile(nine, "d", ["place"]).first().inferred_data_type == "integer"


def test_shuffled_bytes_do_not_grow_with_the_text(spark):
    """What is grouped and shuffled holds no text beyond the bound."""
    df = spark.createDataFrame([("y" * 100_000,), ("z" * 100_000,)], "t string")
    counts = PF.cell_counts(df)
    assert [r.short for r in counts.collect()] == [None, None]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    partial = plan[plan.rindex("HashAggregate"):] if "HashAggregate" in plan else plan
    assert "value" not in [c for c in counts.columns] and "partial_count" in partial


def test_composite_keys_in_the_same_scan(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "bc"), ("", "x"), (None, "x"), ("q", " ")], "l string, r string")
    got = {r.candidate: r for r in PF.key_analysis(df, "d", [("l", "r")]).collect()}["l,r"]
    # "a"+"bc" and "ab"+"c" are different keys; a blank part makes the key missing
    assert (got.column_count, got.row_count, got.missing_key_rows, got.distinct_non_missing_count,
            got.duplicate_non_missing_rows, got.is_candidate_key) == (2, 6, 3, 2, 1, False)


def test_duplicate_rows_survive_hash_clashes(spark):
    rows = [(i % 7, f"t{i % 5}", None if i % 2 else "n") for i in range(200)] + [(1000 + i, "once", "x") for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    want = df.groupBy("a", "b", "c").count().where("count > 1").agg(
        F.count(F.lit(1)).alias("g"), F.sum(F.col("count") - 1).alias("e"), F.sum("count").alias("i")).first()
    for mask in (-1, 1, 0):  # 0: every row clashes with every other
        got = PF.duplicate_rows(df, "d", hash_mask=mask).first()
        assert (got.exact_duplicate_group_count, got.exact_duplicate_row_count, got.exact_duplicate_rows_involved) == (
            want.g, want.e, want.i)


def test_value_lists_are_bounded(spark):
    """A group of many values is counted, never gathered."""
    big = spark.range(20_000).select(F.lit("e").alias("id"), F.concat(F.lit("v"), "id").alias("a"))
    small = spark.createDataFrame([("s", "Straße"), ("s", "strasse"), ("s", "Straße")], "id string, a string")
    long = EN.conflict_value_counts(big.unionByName(small), "id", ["a"])
    got = {r.entity_id: r.value_counts for r in EN.ordered_value_counts_text(long).collect()}
    assert got["e"] is None and long.where("entity_id = 'e'").count() == 20_000
    assert list(json.loads(got["s"]).items()) == [("Straße", 2), ("strasse", 1)]
