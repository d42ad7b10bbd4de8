"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

toxicity (7) drops documents that are likely to be toxic; near_duplicates (5) keeps one document of each SimHash
component; repeats (4) cuts every byte of a 200-byte string that occurs again, and keeps all rows, emptied ones included;
decontamination (8) drops documents with a benchmark leak; mixture (6) says how often each document is taken so that
sources meet their target shares. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from lorekeep.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixture", mix_sources),
]

#: SQL expresses neither the fitted models nor the latent search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each stage's result is written as Parquet in the shared folder and read again by the next,
    then removed, also if a stage fails. The last one's stays, as the returned rows are read from it."""
    docs, out, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None

    def remove(folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
            docs = spark.read.parquet(f"{out}/{name}")
            if before:
                remove(before)
            before = f"{out}/{name}"
    except BaseException:
        remove(out)
        raise
    return docs
