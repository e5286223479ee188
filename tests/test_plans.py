"""Generated code of the wide cleaning plans compiles: no query falls back to interpretation."""

import os

import pytest

from sitelens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["clean_campgrounds", "quarantine_routing", "duplicate_candidates", "amenity_categories",
                                  "park_parse", "column_profile", "nearby_counts", "nearest_n"])
def test_generated_code_compiles(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    old = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        catalog.queries()[name](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", old)
