"""Plans over the driver's tables, which stand in for the engine's records (see TESTDATA.md)."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unit_id
from ..operators import ingest, retrieve, segments, store
from ..sources.shared import cut, shared_dir
from ..sources.tables import table

NOW = "2024-01-01T00:00:00Z"


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: labels give authority and taint, the id's remainders freshness."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    m = lambda k: F.col("doc_id") % k
    authority = F.when(F.col("quality") == 1, F.when(m(5) == 0, "AUTHORITATIVE").otherwise("REVIEWED")).when(F.col("quality") == 0, "DEPRECATED").when(m(2) == 0, "REVIEWED").otherwise("DRAFT")
    freshness = F.when(m(7) == 0, "STALE").when(m(7) == 1, "UNKNOWN").when(m(7) == 2, "EXPIRED").otherwise("FRESH")
    taint = F.when(F.col("toxic") == 1, "SENSITIVE").when(m(3) == 0, "CLEAN").otherwise("INTERNAL")
    ref = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    prov = F.array(F.struct(F.lit("DOC_ID").alias("kind"), ref.alias("ref"), F.lit("").alias("quote"), F.lit("CLEAN").alias("quote_taint"), F.lit(NOW).alias("captured_at"), F.lit(True).alias("retrievable")))
    out = d.select("doc_id", unit_id(F.lit("PLAYBOOK"), ref, none, none).alias("ku_id"), F.lit("PLAYBOOK").alias("source_type"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), taint.alias("taint"), authority.alias("authority"), freshness.alias("freshness"), prov.alias("provenance"), F.col("source").alias("repo"), none.alias("commit_sha"), none.alias("file_path"), none.alias("symbol"), F.sha2("text", 256).alias("content_hash"), F.lit(False).alias("public_ok"), F.lit(False).alias("derived_stale"), F.lit(NOW).alias("updated_at"), F.lit(NOW).alias("created_at"))
    return out.withColumn("serve_blocked", ingest.serve_blocked(F.col("provenance"), F.col("freshness"), F.col("authority"), F.lit(False)))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def document_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    """The documents' stored lexical index. The first query of an application that asks for it writes it to the shared folder;
    the later ones, and those in other sessions of the application, read it. Documents that have changed get another one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    of = (sf_dir, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    name = sha1(repr(of).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/lexical-{spark.sparkContext.applicationId}-{name}"
    try:
        return segments.open_index(spark, path)
    except FileNotFoundError:
        # the registered queries rank so many queries at once that blocks would nearly all be opened
        segments.write_index(document_units(spark, sf_dir).select("ku_id", "title", "symbol", "body"), path, blocks=False)
        return segments.open_index(spark, path)


def chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads; the assistant is me."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), F.col("role").alias("author"), "text", F.concat("conv_id", F.lit("/"), "turn").alias("msg_id"), F.lit("CLEAN").alias("taint"))


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chats -> pairs -> candidates -> units -> review -> one verdict for every benchmark item, asked whole."""
    from .. import schemas

    pairs = ingest.pair_questions(chat_threads(spark, sf_dir), "assistant")
    cands = ingest.pairs_to_candidates(pairs)
    full = cands.select(*[(F.col(f.name) if f.name in cands.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANDIDATE])
    units, _ = ingest.ingest(full, NOW)
    one = store.last_of_each(units, ["ku_id"], "body")  # of units with one id the greatest body, whatever the order
    reviewed, _ = store.promote_drafts(one, NOW)
    # the index and the ranking both read the units, so they are built once
    return retrieve.serve(cut(reviewed), benchmark_queries(spark, sf_dir)).drop("titles", "bodies")
