"""The query language on streams.

Row-wise operators run unchanged on a streaming table. Grouping needs event-time
windows and a watermark, so that state ends; Spark takes event time only as a
TIMESTAMP, so the time column is cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.engine import Engine
from trailspark.plans.errors import QueryError
from trailspark.plans.parser import parse
from trailspark.sources.catalog import typed

STATELESS = {"where", "search", "project", "project-away", "project-keep", "project-rename", "project-reorder", "extend", "serialize", "mv-expand", "mv-apply", "union", "as", "lookup"}


def rows(engine: Engine, query: str) -> DataFrame:
    """A streaming frame of a query's rows; operators that need all rows are rejected."""
    script = parse(query)
    for p in [script.main, *[x.value for x in script.lets if hasattr(x.value, "operators")]]:
        for op in p.operators:
            if op.name not in STATELESS:
                raise QueryError(f"{op.name} is not supported on a stream", op.token.line, op.token.column)
    return engine.compile(query).df


def windowed(df: DataFrame, time: str, width: str, keys: tuple[str, ...] = (), slide: str | None = None, late: str = "10 minutes", values: tuple[str, ...] = ()) -> DataFrame:
    """Counts, and sums of ``values``, by event-time window and keys; rows later than ``late`` are dropped."""
    timed = df.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    window = F.window("__at", width, slide) if slide else F.window("__at", width)
    sums = [F.sum(v).alias(f"sum_{v}") for v in values]
    out = timed.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), *sums)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "n", *[f"sum_{v}" for v in values])


def first_seen(df: DataFrame, time: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """Rows whose keys were not seen before within the watermark."""
    return df.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(list(keys)).drop("__at")


def to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream's rows to Parquet files, exactly once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def register(engine: Engine, name: str, df: DataFrame, dynamic: set[str] | None = None) -> None:
    engine.catalog.add(name, typed(df, dynamic))
