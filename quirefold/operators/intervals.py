"""Joins of intervals on one axis, page by page, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of a bucket in pixels.
BUCKET = 512


def _dealt(df: DataFrame, low: Column, high: Column, name: str, size: int) -> DataFrame:
    first, last = F.floor(low / size).cast("long"), F.floor(high / size).cast("long")
    return df.withColumn(f"{name}_first", first).withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(
    left: DataFrame, right: DataFrame, left_range: tuple[Column, Column], right_range: tuple[Column, Column], keys: list[str], size: int = BUCKET
) -> DataFrame:
    """Pairs of equal keys whose closed ranges meet in a bucket, each pair once.

    Both sides are dealt into buckets of the axis and joined on (keys, bucket); a pair that shares
    several buckets is kept in the first one only. The caller adds the exact condition. Rows whose
    range is null join nothing.
    """
    a = _dealt(left, *left_range, "l", size)
    b = _dealt(right, *right_range, "r", size)
    once = F.col("bucket") == F.greatest("l_first", "r_first")
    return a.join(b, [*keys, "bucket"]).where(once).drop("bucket", "l_first", "r_first")
