"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables up to this size are dealt over the cores; the setting spark.lorekeep.spreadBytes overrides it, 0 leaves all as they lie.
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str, share: int | None = None) -> DataFrame:
    """A table. With ``share``, for work that is far heavier than reading: dealt so that a task has so many bytes of files at most.
    Else: A small one in fewer files than there are cores is dealt over the cores: its row groups may be too few to
    split, and what follows is heavier than moving a few megabytes. Larger tables are left as they lie."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.lorekeep.spreadBytes", str(SPREAD_BYTES)))
    if share and size > share:
        return df.repartition(max(cores, -(-size // share)))
    return df.repartition(cores) if 1 << 20 < size < most and len(df.inputFiles()) < cores else df
