"""Physical layouts that serve the access paths of the location tables (K7).

* ``write_by_place``: rows along a Z-order curve over the sphere, with the
  unit vector beside them. A search near a point becomes three ranges on the
  vector, which Parquet's minima and maxima answer file by file and row group by
  row group.
* ``write_layout`` (``tables``): rows by ranges of a key and a sort key, for
  (park, distance) and (activity, area).
* ``write_bucketed``: tables hashed on a join key when written, so that joins
  on it need no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import chord_for_km, haversine_km, morton_key, rounded_km, unit_vector
from ..session import ensure_checkpoint_dir

VECTOR = ("unit_x", "unit_y", "unit_z")
_MARGIN = 1e-9  # rounding of distances to 1e-6 km, and of the vector itself


def write_by_place(df: DataFrame, path: str, lat: str, lon: str, files: int, row_group_bytes: int = 16 << 20) -> None:
    """``df`` along the curve in about ``files`` files of equal size, with the columns VECTOR; rows
    without coordinates come first."""
    vector = [v.alias(n) for v, n in zip(unit_vector(lat, lon), VECTOR)]
    (df.select("*", *vector, morton_key(lat, lon).alias("_curve"))
     .repartitionByRange(files, F.col("_curve").asc_nulls_first()).sortWithinPartitions(F.col("_curve").asc_nulls_first())
     .drop("_curve").write.option("parquet.block.size", row_group_bytes).parquet(path))


def near_point(layout: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, radius_km: float,
               distance_col: str = "distance_km") -> DataFrame:
    """Rows of a ``write_by_place`` table within the radius of one point, with the distance. The ranges on
    VECTOR reach the scan; the distance decides."""
    reach = chord_for_km(radius_km) + _MARGIN
    at = layout.sparkSession.range(1).select(*[v.alias(n) for v, n in zip(
        unit_vector(F.lit(float(at_lat)), F.lit(float(at_lon))), VECTOR)]).first()
    box = F.lit(True)
    for n in VECTOR:
        box = box & (F.col(n) >= F.lit(at[n] - reach)) & (F.col(n) <= F.lit(at[n] + reach))
    distance = rounded_km(haversine_km(F.lit(float(at_lat)), F.lit(float(at_lon)), F.col(lat), F.col(lon)))
    return (layout.where(box).withColumn(distance_col, distance)
            .where(F.col(distance_col) <= F.lit(float(radius_km))).drop(*VECTOR))


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table hashed and sorted on ``key``, read back; its files are below ``spark.checkpoint.dir``."""
    spark: SparkSession = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}").saveAsTable(table))
    return spark.table(table)
