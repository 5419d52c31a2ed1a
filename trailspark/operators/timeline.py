"""Histogram of event times over equal buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 24


def histogram(df: DataFrame, time: str = "TimeGenerated", most: int = MOST) -> DataFrame:
    """(bucket, n) of the buckets that hold rows: as many as the root of the row count, at most ``most``, of equal width."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = df.where(F.col(time).isNotNull()).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.least(F.lit(most), F.ceil(F.sqrt(F.count("*")))).cast("long").alias("k"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double") / F.col("k")
    # one row is joined to all: the bounds
    bucket = F.least(F.floor((at - F.col("lo")) / width), F.col("k") - 1).cast("long")
    return df.where(F.col(time).isNotNull()).join(F.broadcast(span)).select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
