"""What one task gets stays the same as tables grow: more files, buckets and partitions, not larger ones."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import unitstore
from lorekeep.plans import landed
from lorekeep.sources.tables import table
from lorekeep.sources.versions import Folder


def test_tables_are_dealt_by_their_size(spark, tmp_path):
    spark.range(400_000).select(F.xxhash64("id").alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t", 1 << 18).rdd.getNumPartitions() >= 10 > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("rows", [100, 1000])
def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(unitstore, "BUCKET_ROWS", 25)
    s = unitstore.UnitStore(spark, str(tmp_path / "s"), "id", None)
    s.create(spark.range(rows).withColumn("created_at", F.lit("x")), None)
    assert s.folder.state()["buckets"] == max(16, rows // 25) and s.read().count() == rows


def test_files_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "FILE_BYTES", 2000)
    rows = spark.range(1000).withColumn("text", F.lit("t" * 30))
    landed._lists(rows, str(tmp_path / "in"), F.col("id"), "id", F.struct("id", "text"), None)
    texts = [r.value for r in spark.read.text(str(tmp_path / "in"), wholetext=True).collect()]
    assert sorted(x["id"] for t in texts for x in json.loads(t)) == list(range(1000))
    assert len(texts) >= 15 and max(map(len, texts)) < 6000
    assert len([n for n in Folder(spark, str(tmp_path / "in")).names() if n.endswith(".txt")]) == len(texts)
