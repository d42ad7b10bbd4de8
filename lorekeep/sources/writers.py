"""Sinks. A merge writes beside the old table; the caller swaps folders, as Parquet has no transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.logs import audit_records
from .versions import Folder


def write_units(units: DataFrame, path: str) -> None:
    """Partitioned by source type, sorted by id within files for tight min/max statistics. A type's units are dealt by their
    id as well, so the tasks are as many as the shuffle has, not one for each type."""
    units.repartition("source_type", "ku_id").sortWithinPartitions("ku_id").write.mode("overwrite").partitionBy("source_type").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.dropDuplicates(["src_ku", "dst_ku", "rel"]).write.mode("overwrite").parquet(path)


def append_audit(df: DataFrame, path: str, now: str) -> None:
    """JSON lines, a folder a day."""
    audit_records(df, F.lit(now)).write.mode("append").partitionBy("date").json(path)


def write_seen(seen: DataFrame, path: str) -> None:
    seen.select("number").distinct().write.mode("overwrite").json(path)


def write_packages(packages: DataFrame, path: str) -> None:
    packages.write.mode("overwrite").json(path)


def write_documents(fetched: DataFrame, path: str) -> None:
    """Bodies as Parquet, and beside them the manifest, as JSON lines, of what was written. The former manifest goes first, so a
    failure between the two leaves none, not a false one."""
    Folder(fetched.sparkSession, f"{path}/manifest").remove()
    fetched.write.mode("overwrite").parquet(f"{path}/bodies")
    fetched.sparkSession.read.parquet(f"{path}/bodies").drop("text").write.mode("overwrite").json(f"{path}/manifest")
