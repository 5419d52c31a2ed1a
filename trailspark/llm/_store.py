"""Shared storage: cut lineage with tables that every executor and the driver can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
#: Settings while a table is written: its shuffle files go afterwards, and what an Arrow batch of long texts may hold is bounded.
_DURING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(6 << 20)}
#: For rows of megabytes: how many the Parquet reader holds at a time, and the bytes from which an Arrow batch is full.
_LARGE = {"rows": "spark.sql.parquet.columnarReaderBatchSize", "batch": "spark.sql.execution.arrow.maxBytesPerBatch"}
#: At most so many keys are broadcast as hot ones.
HOT = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where all work is done in one process (tests), a local one."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trailspark-')}"
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trailspark-{uuid.uuid4().hex}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Between the phases of a run of many short jobs: Spark drops plans, broadcasts and shuffles of finished jobs when the driver's garbage is collected, which it asks for itself only twice an hour."""
    spark._jvm.System.gc()


def write(df: DataFrame, path: str, **more: int) -> DataFrame:
    """Write a frame as Parquet and read it back; what the write shuffled is dropped. more: as in _LARGE."""
    spark = df.sparkSession
    during = _DURING | {_LARGE[k]: str(v) for k, v in more.items()}
    before = {k: spark.conf.get(k) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back."""
    return write(df, new_path(df.sparkSession, name))


class Scratch:
    """Intermediate tables of one run, in a folder of their own; each is deleted once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)

    def table(self, df: DataFrame, name: str, **more: int) -> DataFrame:
        return write(df, f"{self.path}/{name}", **more)

    def drop(self, *names: str) -> None:
        for n in names:
            delete(self.spark, f"{self.path}/{n}")


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str], count: str, total: int, how: str = "left", hot: int = HOT, least: int = 1000) -> DataFrame:
    """Rows with the columns of a table that has one row a key; on: column of rows -> column of table.

    ``count`` holds how many rows have a key, and all of them are ``total`` at
    most. Keys of more than total / HOT rows are therefore fewer than HOT: they
    are broadcast, and their rows stay where they are. No other key brings more
    than total / HOT rows (``least`` at least) to one task of the shuffled join.
    """
    edge = max(least, -(-total // hot))
    same = [F.col(a) == F.col(b) for a, b in on.items()]
    if total <= edge:
        return rows.join(table, same, how)
    marked = rows.join(F.broadcast(table.where(F.col(count) > edge)), same, "left")
    rest = marked.where(F.col(count).isNull()).select(*rows.columns).join(table.where(F.col(count) <= edge), same, how)
    return marked.where(F.col(count).isNotNull()).unionByName(rest)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
