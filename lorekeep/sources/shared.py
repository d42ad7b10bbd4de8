"""Results kept in the folder that all machines share: they survive lost executors and cut the lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages: the one that the cluster names in spark.checkpoint.dir.

    A folder of this machine's own is taken only where there is no cluster (master local) and none is named.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        named = os.path.join(tempfile.gettempdir(), "lorekeep-checkpoints")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder.

    The shuffle files behind it are removed with the end of this one execution, as nothing reads them any more. The rows'
    own files are removed when no plan refers to them any more and the driver collects its garbage, or, where the application
    ends before that, stay in its folder: each application checkpoints in one of its own.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_dir(spark)
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # read at each checkpoint
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new execution, which takes the setting
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
