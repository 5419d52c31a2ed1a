"""Bounded collections of a group's values, without a buffer that grows with the group.

``collect_set`` and ``collect_list`` hold a whole group in one task. Here values
are first made distinct (sets), then numbered within their group; the planner
cuts each partition to ``most`` rows a group before it shuffles by group, so the
hottest group brings ``most`` rows a partition and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most values and bytes of a collection.
MAX_VALUES = 1000
MAX_BYTES = 1 << 20


def bounded(elements: Column, most_bytes: int = MAX_BYTES) -> Column:
    """A JSON array of the elements, in order, that fit into so many bytes."""
    start = F.struct(F.lit(0).cast("bigint").alias("size"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        size = acc["size"] + F.octet_length(x)
        fits = size <= most_bytes
        return F.struct(F.when(fits, size).otherwise(acc["size"]).alias("size"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    # only arrays that could be too large are walked
    total = F.aggregate(elements, F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x))
    kept = F.when(total <= most_bytes, elements).otherwise(F.aggregate(elements, start, add)["kept"])
    return F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))


def collect(df: DataFrame, keys: list[str], element: str, distinct: bool, most: int = MAX_VALUES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(keys, collected): JSON arrays of ``element``, a column of JSON text.

    A set holds the ``most`` smallest values in order, a list the first ``most``
    in the frame's order. Null elements count for nothing, so a group of nulls
    alone and an empty frame give no row; null keys are one group.
    """
    held = df.select(*keys, F.col(element).alias("__element"))
    place = F.col("__element") if distinct else F.when(F.col("__element").isNotNull(), F.monotonically_increasing_id())
    held = (held.distinct() if distinct else held).withColumn("__place", place)
    # nulls come last and are left out at the end: a filter here would evaluate elements twice
    window = Window.partitionBy(*keys).orderBy(F.col("__place").asc_nulls_last())
    first = held.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= most)
    ordered = F.array_sort(F.collect_list(F.when(F.col("__element").isNotNull(), F.struct("__n", "__element"))))["__element"]
    grouped = first.groupBy(*keys).agg(ordered.alias("__all"))
    return grouped.where(F.size("__all") > 0).select(*keys, bounded(F.col("__all"), most_bytes).alias("collected"))
