"""Pages of a large ordered result through an order index.

The rows are written once in ranges of the order, and the number of rows before
each range is kept (one number a range). Page p then reads the one or few
ranges that hold it, however far it lies, and no task gathers what comes before.
"""

from __future__ import annotations

import bisect
import math
import uuid
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

RANGE_ROWS = 100_000
_RANGE = "_order_range"


class PageIndex:
    """``df`` in the order of ``keys`` (column names, ascending); equal keys are ordered by the other
    columns, so pages never overlap and leave nothing out."""

    def __init__(self, df: DataFrame, keys: Sequence[str], range_rows: int = RANGE_ROWS):
        spark = df.sparkSession
        self.order = [*keys, *[c for c in df.columns if c not in keys]]
        self.columns = df.columns
        ranges = max(1, -(-df.count() // range_rows))
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
        # all columns are part of the ranges' bounds: a key that many rows share is parted, too
        (df.repartitionByRange(ranges, *self.order).withColumn(_RANGE, F.spark_partition_id())
         .write.partitionBy(_RANGE).parquet(path))
        self._rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_RANGE, T.IntegerType())])).parquet(path)
        sizes = sorted((r[_RANGE], r["count"]) for r in self._rows.groupBy(_RANGE).count().collect())
        self._numbers = [n for n, _ in sizes]
        self._before = [0]
        for _, n in sizes:
            self._before.append(self._before[-1] + n)

    @property
    def total(self) -> int:
        return self._before[-1]

    def pages(self, page_size: int) -> int:
        if page_size <= 0:
            raise ValueError("page_size must be positive")
        return max(1, math.ceil(self.total / page_size))

    def ranges_of(self, first: int, last: int) -> list[int]:
        """Ranges that hold the rows first .. last - 1 of the order."""
        lo = max(0, bisect.bisect_right(self._before, first) - 1)
        hi = bisect.bisect_left(self._before, last)
        return self._numbers[lo:max(lo, hi)]

    def page(self, page: int, page_size: int) -> tuple[DataFrame, int, int]:
        """(rows of one page in order, page index within 0 .. pages - 1, number of pages)."""
        pages = self.pages(page_size)
        at = min(max(page, 0), pages - 1)
        first, last = at * page_size, min(self.total, (at + 1) * page_size)
        wanted = self.ranges_of(first, last)
        skip = first - self._before[self._numbers.index(wanted[0])] if wanted else 0
        rows = self._rows.where(F.col(_RANGE).isin(wanted)) if wanted else self._rows.limit(0)
        return (rows.orderBy(*self.order).offset(skip).limit(page_size).select(*self.columns), at, pages)
