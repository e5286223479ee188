"""Every page through the order index equals a slice of the sorted rows."""

import pytest

from sitelens.operators.paging import PageIndex


@pytest.mark.parametrize("range_rows", [7, 40, 1000])
def test_all_pages_with_ties(spark, range_rows):
    rows = [(None if i % 31 == 0 else f"n{i * i % 5}", i % 3, i) for i in range(203)] + [("n1", 1, 1)] * 4
    df = spark.createDataFrame(rows, "name string, kind int, id int").repartition(5)
    index = PageIndex(df, ["name", "kind"], range_rows)
    key = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    want = sorted(rows, key=key)
    for size in (1, 10, 50, 500):
        if size == 1:
            some = (0, 100, 206)
        else:
            some = range(index.pages(size))
        for p in some:
            got, at, pages = index.page(p, size)
            assert [tuple(r) for r in got.collect()] == want[p * size:(p + 1) * size]
            assert (at, pages) == (p, -(-len(want) // size))
    # pages beyond either end are clamped
    assert index.page(10 ** 6, 50)[1] == index.pages(50) - 1 and index.page(-3, 50)[1] == 0
    with pytest.raises(ValueError):
        index.page(0, 0)


def test_a_page_reads_its_ranges_only(spark):
    df = spark.range(1000)
    index = PageIndex(df, ["id"], 50)
    assert len(index.ranges_of(500, 510)) <= 2 and index.total == 1000
    plan = index.page(50, 10)[0]._jdf.queryExecution().executedPlan().toString()
    assert "_order_range" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_an_empty_result_has_one_empty_page(spark):
    index = PageIndex(spark.range(0), ["id"])
    rows, at, pages = index.page(4, 10)
    assert (rows.collect(), at, pages) == ([], 0, 1)
