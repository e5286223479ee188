"""Small frames for tests of column functions."""

from pyspark.sql import functions as F


def one_col(spark, values, name="v", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def apply(spark, fn, values, dtype="string"):
    df = one_col(spark, values, dtype=dtype).withColumn("_i", F.monotonically_increasing_id())
    rows = df.select("_i", fn("v").alias("r")).orderBy("_i").collect()
    return [r["r"] for r in rows]
