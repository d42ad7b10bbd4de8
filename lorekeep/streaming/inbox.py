"""The intent inbox as a stream: files are picked up once (the checkpoint is the claim), judged and routed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.policy import gate, route
from ..operators.validate import intent_errors


def judged(intents: DataFrame, policy: dict, binary: str, kill_switch: bool = False) -> DataFrame:
    """Intents with errors, decision, status, folder and failure_reason. Of intents with one id in a batch the one that was
    created first stays, of equal times the least as text."""
    order = W.partitionBy("action_id").orderBy("created_at", F.to_json(F.struct(*intents.columns)))
    return _decided(intents.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r"), policy, binary, kill_switch)


def _decided(intents: DataFrame, policy: dict, binary: str, kill_switch: bool) -> DataFrame:
    out = route(gate(intent_errors(intents, binary), policy, binary, kill_switch))
    bad = F.size("errors") > 0
    why = F.when(bad, F.array_join("errors", ",")).when(F.col("status") == "denied", F.col("reason"))
    return out.withColumn("status", F.when(bad, "invalid").otherwise(F.col("status"))).withColumn("folder", F.when(bad, "failed").otherwise(F.col("folder"))).withColumn("failure_reason", why)


def inbox_stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.INTENT).option("multiLine", True).option("pathGlobFilter", "*.json")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(folder)


#: Of an Arrow batch, as intents may be long.
BATCH_BYTES = 4 << 20
#: A stream's settings, which it takes over as it starts. The store keeps states on disk, so handled ids don't have to fit into
#: memory; states expire with the next batch that has data, not in batches of their own, which would have no end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # one pool an executor for all its stores, not buffers of each store's own
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a put needn't look up whether its key is new
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}
#: States stay so much longer than they are needed: should the clock be set back by less, no intent is taken for late.
SLACK_MS = 86_400_000


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows id, at, intent those with an id's least time, of equal times with the least text."""
    least: dict[str, tuple[str, str]] = {}
    for b in batches:
        for id_, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            least[id_] = min(least.get(id_, (*row,)), (*row,))
    some, size = [], 0
    while least:
        id_, row = least.popitem()
        some.append((id_, *row))
        size += len(row[1])
        if size >= BATCH_BYTES or not least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), b.schema.types, strict=True)], schema=b.schema)
            some, size = [], 0


def first_seen(intents: DataFrame, keep_ms: int) -> DataFrame:
    """Of a stream's intents those whose id hasn't been handled in the last ``keep_ms``: of one batch's with an id the one that
    was created first, of equal times the least as text. A state per id; it expires, so states don't grow for ever.

    The batches' time is cut into spans of ``keep_ms``. An intent marks its id for the span of its batch and for the next one,
    and it is new if its id isn't marked yet for its own span. So an id is known for ``keep_ms`` at least and for twice as long
    at most, counted from its last repeat. Marks are a native deduplication's rows: no Python is called for a single id.
    """
    span = max(1, keep_ms)
    flat = intents.select(F.coalesce("action_id", F.lit("")).alias("id"), F.coalesce("created_at", F.lit("")).alias("at"), F.to_json(F.struct(*intents.columns)).alias("intent"))
    least = flat.repartition("id").mapInArrow(_least, flat.schema).withColumn("ahead", F.explode(F.array(F.lit(0), F.lit(1))))
    begins = F.timestamp_millis((F.floor(F.unix_millis(F.current_timestamp()) / span) + F.col("ahead")) * span)
    marks = least.select("id", begins.alias("span"), F.when(F.col("ahead") == 0, F.col("intent")).alias("intent"))
    fresh = marks.withWatermark("span", f"{span + SLACK_MS} milliseconds").dropDuplicates(["id", "span"]).where("intent IS NOT NULL")
    return fresh.select(F.from_json("intent", intents.schema).alias("i")).select("i.*")


def run_inbox(
    spark: SparkSession, folder: str, out: str, checkpoint: str, policy: dict, binary: str, kill_switch: bool = False, poll: str | None = None, keep_days: float = 30, files_a_batch: int | None = None
) -> StreamingQuery:
    """Writes judged intents as Parquet by folder (done, failed). Without ``poll`` it handles what is there and ends.

    A batch that is run again after a failure overwrites its own folder, so every intent is written once. An action id that
    has been handled in the last ``keep_days`` is not handled again, also after a restart, as the states lie with the
    checkpoint; repeating an id keeps its state alive. A batch reads its own files and no earlier output.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("folder").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        fresh = first_seen(inbox_stream(spark, folder, files_a_batch), round(keep_days * 86_400_000))
        # decided before batches are cut, so the policy's expressions are made once, not for each batch
        writer = _decided(fresh, policy, binary, kill_switch).writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
