"""Skew-safe top-n and keep-first per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def with_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position per key.  Meant for groups already cut to a bounded size."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key with their rank.

    Up to the group-limit threshold Spark cuts every key to ``n`` rows per task
    before the shuffle, so a hot key never travels whole.  Beyond it the same
    cut is made by hand, per key and input partition, first.  ``order`` must be total.
    """
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        salted = df.withColumn("_salt", F.spark_partition_id())
        df = with_rank(salted, [*keys, "_salt"], order, out).where(F.col(out) <= n).drop("_salt", out)
    return with_rank(df, keys, order, out).where(F.col(out) <= n)


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key in the given order."""
    return top_per_group(df, [key], order, 1, "_first").drop("_first")
