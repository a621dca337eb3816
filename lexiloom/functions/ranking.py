"""Global ordinals without a one-task window: ranks within buckets plus prefix sums of the buckets' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the 0-based ordinal of each row under ``order``, of which ``bucket`` is a coarse prefix.

    Buckets are ranked in parallel; only their sizes, one row a bucket, pass a single task.
    """
    keys = [f"_b{k}" for k in range(len(bucket))]
    own = df.select("*", *(b.alias(k) for b, k in zip(bucket, keys)))
    sizes = own.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    joined = own.withColumn("_r", inner).join(bases, keys)
    return joined.select(*df.columns, (F.col("_base") + F.col("_r")).cast("int").alias(name))
