"""A table of rows by id, dealt over buckets by a hash of the id; the files of a bucket are replaced as a whole.

Every upsert writes one generation: new files of the buckets that it touches, and nothing else. The manifest
(``sources.versions``) says which generation holds a bucket's rows; it is published last, so a write that breaks off leaves the
former rows. Readers see a bucketed table whose partitions are the generations, so a join on the id needs no shuffle of the
store. It is the generations' number that grows until ``compact``; superseded files are read past until then.

The manifest also holds ``operators.store.inventory``, kept up to date by each upsert: what the touched buckets held is taken
out, what they hold now is put in.
"""

from __future__ import annotations

import json
import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut
from ..sources.versions import Folder
from .store import inventory, upsert

BUCKETS = 64
#: Rows of a bucket as a store is created, where the number of buckets is left to it. A bucket is a task's.
BUCKET_ROWS = 1 << 17


class UnitStore:
    """``key`` is unique and never null. ``counts``: a function to frames of (kind, value, n), or None for no inventory."""

    def __init__(self, spark: SparkSession, path: str, key: str = "ku_id", counts=inventory):
        self.spark, self.folder, self.key, self.counts = spark, Folder(spark, path), key, counts

    # --- writing ----------------------------------------------------------------------------------------------------------

    def create(self, rows: DataFrame, buckets: int | None = BUCKETS) -> dict:
        """With None as many buckets as hold BUCKET_ROWS each, 16 at least."""
        buckets = buckets or max(16, -(-rows.count() // BUCKET_ROWS))
        before = self.folder.state()
        name = self._generation(rows, buckets)
        state = {"buckets": buckets, "schema": rows.schema.json(), "generations": [name], "latest": [0] * buckets, "counts": self._counted(self._plain([name]))}
        return self.folder.publish(state, before["version"])

    def upsert(self, batch: DataFrame, order: str | None = None, keep: tuple[str, ...] = ("created_at",)) -> dict:
        """``store.upsert`` in the buckets of the batch's ids."""
        s = self.folder.state()
        batch = cut(batch)  # what it is made from is read once: its buckets, its rows
        touched = sorted(r[0] for r in batch.select(self._bucket(s["buckets"])).distinct().collect())
        if not touched:
            return s
        schema = T.StructType.fromJson(json.loads(s["schema"]))
        files = self._files(s, touched)
        old = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        name = self._generation(upsert(old, batch.select(*schema.names), self.key, order, keep), s["buckets"])
        number = len(s["generations"])
        latest = [number if b in touched else g for b, g in enumerate(s["latest"])]
        counts = {(k, v): n for k, v, n in s["counts"]}
        for sign, rows in ((-1, self._counted(old)), (1, self._counted(self._plain([name])))):
            for k, v, n in rows:
                counts[k, v] = counts.get((k, v), 0) + sign * n
        return self.folder.publish(s | {"generations": [*s["generations"], name], "latest": latest, "counts": [[*k, n] for k, n in sorted(counts.items()) if n]}, s["version"])

    def compact(self) -> dict:
        """All rows as one generation."""
        s = self.folder.state()
        name = self._generation(self.read(s), s["buckets"])
        return self.folder.publish(s | {"generations": [name], "latest": [0] * s["buckets"]}, s["version"])

    # --- reading ----------------------------------------------------------------------------------------------------------

    def read(self, state: dict | None = None) -> DataFrame:
        """All rows; scanned by bucket where a join or an aggregation on the key profits."""
        s = state or self.folder.state()
        if not s["version"]:
            raise FileNotFoundError(f"no store in {self.folder.path}")
        live = sorted(set(s["latest"]))
        table = f"lorekeep_{uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(s["schema"]))
        empty = self.spark.createDataFrame([], schema).withColumn("__gen", F.lit(0))
        self._save(empty, f"{self.folder.path}/.tables/{table}", table, s["buckets"], ["__gen"])
        for g in live:
            self.spark.sql(f"ALTER TABLE {table} ADD PARTITION (__gen = {g}) LOCATION '{self.folder.path}/{s['generations'][g]}'")
        df = self.spark.table(table)
        holds = F.element_at(F.lit(s["latest"]), self._bucket(s["buckets"]) + 1) == F.col("__gen")
        return (df.where(holds) if len(live) > 1 else df).drop("__gen")

    def inventory(self) -> DataFrame:
        """kind, value, n, from the manifest: no row is read."""
        return self.spark.createDataFrame([tuple(x) for x in self.folder.state()["counts"]], "kind string, value string, n long")

    # --- files ------------------------------------------------------------------------------------------------------------

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.hash(self.key), F.lit(n))

    def _save(self, df: DataFrame, path: str, table: str, buckets: int, by: list[str]) -> None:
        writer = df.write.format("parquet").option("path", path).bucketBy(buckets, self.key).sortBy(self.key)
        (writer.partitionBy(*by) if by else writer).saveAsTable(table)

    def _generation(self, rows: DataFrame, buckets: int) -> str:
        """Each bucket is written by the one task that has it."""
        name, table = self.folder.fresh("generation"), f"lorekeep_{uuid4().hex}"
        self._save(rows.repartition(buckets, self.key), f"{self.folder.path}/{name}", table, buckets, [])
        self.spark.sql(f"DROP TABLE {table}")  # the table is external: its files stay
        return name

    def _plain(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder.path}/{n}" for n in names])

    def _files(self, s: dict, buckets: list[int]) -> list[str]:
        """The live files of these buckets."""
        out = []
        for g in sorted({s["latest"][b] for b in buckets}):
            of = Folder(self.spark, f"{self.folder.path}/{s['generations'][g]}")
            wanted = {b for b in buckets if s["latest"][b] == g}
            out += [f"{of.path}/{n}" for n in of.names() if (m := re.search(r"_(\d{5})(?:\.c\d+)?\.[\w.]*parquet$", n)) and int(m[1]) in wanted]
        return out

    def _counted(self, rows: DataFrame) -> list[list]:
        return [[*r] for r in self.counts(rows).select("kind", "value", "n").collect()] if self.counts else []
