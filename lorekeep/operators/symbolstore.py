"""Stored symbols of source files, brought up to date by parsing what has changed.

A row a file (``operators.unitstore``, dealt by the file's id): its content's hash and its symbols. Hashes are rolled up by
folder, so an update first compares one row a folder, reads the stored rows of folders that differ, compares those file by
file, and parses the new and changed ones. What is gone stays as an empty row until the store is compacted.
"""

from __future__ import annotations

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .code import SYMBOL, indexable, symbols_of
from .unitstore import UnitStore

_SYMBOLS = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in SYMBOL.split(", ")) + ">>"
_ROW = ("file_id", "repo", "folder", "file_path", "commit_sha", "blob", "symbols")


def _placed(files: DataFrame) -> DataFrame:
    """file_id, repo, folder, file_path, commit_sha, blob, text. ``blob``: the content's hash, if the files bring one, else made."""
    blob = F.col("blob") if "blob" in files.columns else F.sha2(F.coalesce("text", F.lit("")), 256)
    folder = F.regexp_replace(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1), "/+$", "")
    return indexable(files).select(F.concat_ws("\x1f", "repo", "file_path").alias("file_id"), "repo", folder.alias("folder"), "file_path", "commit_sha", blob.alias("blob"), "text")


def folder_hashes(files: DataFrame) -> DataFrame:
    """repo, folder, hash, n of files (file_id, repo, folder, blob). Sums and exclusive ors don't depend on an order."""
    one = F.xxhash64("file_id", "blob")
    return files.groupBy("repo", "folder").agg(F.concat_ws(":", F.bit_xor(one), F.sum(F.pmod(one, F.lit(1 << 31)))).alias("hash"), F.count("*").alias("n"))


def repository_hashes(folders: DataFrame) -> DataFrame:
    """repo, hash, n: the folders' hashes rolled up."""
    return folders.groupBy("repo").agg(F.bit_xor(F.xxhash64("folder", "hash")).alias("hash"), F.sum("n").alias("n"))


def _parsed(count: Accumulator | None) -> Column:
    @F.pandas_udf(_SYMBOLS)
    def run(path: pd.Series, text: pd.Series) -> pd.Series:
        if count is not None:
            count.add(len(path))
        return pd.Series([symbols_of(p or "", t) for p, t in zip(path, text, strict=True)])

    return run("file_path", "text")


class SymbolStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows = spark, UnitStore(spark, path, key="file_id", counts=None)

    def create(self, files: DataFrame, buckets: int = 64, parsed: Accumulator | None = None) -> dict:
        return self.rows.create(_placed(files).withColumn("symbols", _parsed(parsed)).select(*_ROW), buckets)

    def changes(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(files that are new or differ, with their text; stored files that are gone) of the repositories in ``files``."""
        now = _placed(files)
        was = self._live().join(now.select("repo").distinct(), "repo", "left_semi")
        then = folder_hashes(was).withColumnRenamed("hash", "__was").drop("n")
        differ = folder_hashes(now).drop("n").join(then, ["repo", "folder"], "full").where(~F.col("hash").eqNullSafe(F.col("__was"))).select("repo", "folder")
        ours, theirs = now.join(differ, ["repo", "folder"], "left_semi"), was.join(differ, ["repo", "folder"], "left_semi")
        changed = ours.join(theirs.select("file_id", F.col("blob").alias("__was")), "file_id", "left").where(~F.col("blob").eqNullSafe(F.col("__was"))).drop("__was")
        return changed, theirs.join(ours.select("file_id"), "file_id", "left_anti")

    def update(self, files: DataFrame, parsed: Accumulator | None = None) -> dict:
        """Brings the symbols of the repositories in ``files`` (repo, commit_sha, file_path, text) up to date."""
        changed, gone = self.changes(files)
        none = F.array().cast(_SYMBOLS)
        empty = gone.select("file_id", "repo", "folder", "file_path", F.lit(None).cast("string").alias("commit_sha"), F.lit(None).cast("string").alias("blob"), none.alias("symbols"))
        return self.rows.upsert(changed.withColumn("symbols", _parsed(parsed)).select(*_ROW).unionByName(empty), keep=())

    def _live(self) -> DataFrame:
        return self.rows.read().where("blob IS NOT NULL").select("file_id", "repo", "folder", "file_path", "blob")

    def symbols(self) -> DataFrame:
        """What ``code.extract_symbols`` gives for the stored files; a snapshot for ``freshness.reindex``."""
        each = self.rows.read().where("blob IS NOT NULL").select("repo", "commit_sha", "file_path", F.explode("symbols").alias("s"))
        return each.select("repo", "commit_sha", "file_path", "s.*")
