"""Sources. Every reader has an explicit schema, so nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import blank
from ..operators.code import indexable
from .shared import cut


def _objects(spark: SparkSession, path: str | list[str], schema: T.StructType, *extra: Column) -> DataFrame:
    """JSON files, each one object or a list of them; files that don't parse give no rows. ``extra``: of the files' metadata."""
    spec = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(spec).json(path)
    return df.select("*", *extra).where("_corrupt IS NULL").drop("_corrupt")


def raw_items(spark: SparkSession, path: str) -> DataFrame:
    """Source dumps: {source_type, text, meta} or flat objects, whose other keys become meta. Needs a source_type. A dump is read as
    one text, so a file has to fit a task."""
    text = spark.read.text(path, wholetext=True)
    one = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    each = text.select(F.explode(F.from_json(one, "array<map<string,string>>")).alias("m"))
    flat = F.map_filter("m", lambda k, v: ~k.isin("source_type", "text", "meta") & v.isNotNull())
    meta = F.coalesce(F.from_json(F.try_element_at("m", F.lit("meta")), "map<string,string>"), flat)
    return each.select(F.try_element_at("m", F.lit("source_type")).alias("source_type"), F.coalesce(F.try_element_at("m", F.lit("text")), F.lit("")).alias("text"), meta.alias("meta")).where("coalesce(source_type, '') <> ''")


def candidates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _objects(spark, path, schemas.CANDIDATE)


def merged_candidates(spark: SparkSession, folder: str, pattern: str = "doc-*.json") -> DataFrame:
    """Candidates of many files with file and pos; files that don't parse or hold no list give none."""
    text = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lists = text.where(F.col("value").rlike(r"^\s*\["))
    parsed = lists.select("file", F.posexplode(F.from_json("value", T.ArrayType(schemas.CANDIDATE))).alias("pos", "c"))
    return parsed.select("file", "pos", "c.*")


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Chat search results as flat messages, with has_more and next_cursor of their page."""
    pages = _objects(spark, path, schemas.CHAT_PAGE).select("result.*")
    talks = pages.select("hasMore", "nextCursor", F.explode("conversationMessagesList").alias("t"))
    m = talks.select("hasMore", "nextCursor", "t.openConversationId", "t.singleChat", F.explode("t.messages").alias("m"))
    return m.select(F.col("openConversationId").alias("conversation_id"), F.coalesce("singleChat", F.lit(False)).alias("single_chat"), F.col("m.senderOpenDingTalkId").alias("sender_id"), F.col("m.sender").alias("sender_name"), F.col("m.content").alias("content"), F.col("m.createTime").alias("create_time"), F.col("m.openMessageId").alias("msg_id"), F.coalesce("hasMore", F.lit(False)).alias("has_more"), F.col("nextCursor").alias("next_cursor"))


def doc_pages(spark: SparkSession, path: str, max_pages: int = 30) -> DataFrame:
    """Documents of landed search pages, up to the first page that says it is the last or has no token. The pages of a search
    lie in a folder of their own, which is its ``search``."""
    pages = _objects(spark, path, schemas.DOC_PAGE, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("search")).where(F.col("page") < max_pages)
    last = ~F.coalesce("hasMore", F.lit(False)) | (F.coalesce("nextPageToken", F.lit("")) == "")
    stop = pages.where(last).groupBy("search").agg(F.min("page").alias("stop"))
    kept = pages.join(stop, "search", "left").where("stop IS NULL OR page <= stop")
    return kept.select("search", "page", F.explode("documents").alias("i")).select("search", "page", "i.*")


def code_units(units: DataFrame, repo: str) -> DataFrame:
    """What the freshness check needs of a repository's code units: no bodies are read."""
    return units.where((F.col("source_type") == "CODE") & (F.col("repo") == repo)).select("ku_id", "repo", "file_path", "symbol", "commit_sha", "content_hash", "authority", "source_type")


def documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Fetched documents with their manifest columns (file, chars); empty ones are skipped."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    return text.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.length("value").alias("chars")).where(F.length(F.trim("value")) > 0)


def fetched_documents(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows of ``doc_pages`` with their bodies (nodeId, text): node_id, name, file, create_time, chars, text.

    Rows without an id and blank or missing bodies are skipped; a document that several pages list, or several bodies hold, is
    one, with the least name, its time, and the greatest body. Without a name
    the id is the name. The file's name is the name's first 40 characters, other than word characters and hyphens as
    underscores, and the id's first 8.
    """
    listed = found.where(~blank("nodeId")).select("nodeId", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("nodeId")).alias("name"), "createTime")
    listed = listed.groupBy("nodeId").agg(F.min(F.struct("name", "createTime")).alias("l")).select("nodeId", "l.*")
    both = listed.join(bodies.where(~blank("text")).groupBy("nodeId").agg(F.max("text").alias("text")), "nodeId")
    stem = F.substring(F.regexp_replace("name", r"(?U)[^\w\-]", "_"), 1, 40)
    file = F.concat(stem, F.lit("_"), F.substring("nodeId", 1, 8), F.lit(".md"))
    return both.select(F.col("nodeId").alias("node_id"), "name", file.alias("file"), F.col("createTime").alias("create_time"), F.length("text").alias("chars"), "text")


def source_files(spark: SparkSession, folder: str, repo: str, commit: str | None = None) -> DataFrame:
    """Indexable source files of an exported tree: repo, commit_sha, file_path, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^.*?" + "/" + folder.strip("/").split("/")[-1] + "/", "")
    out = files.select(F.lit(repo).alias("repo"), F.lit(commit).cast("string").alias("commit_sha"), path.alias("file_path"), F.decode("content", "UTF-8").alias("text"))
    return indexable(out)


def units(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    df = spark.read.schema(schemas.KNOWLEDGE_UNIT).parquet(path)
    return (df.where(F.col("source_type") == source_type) if source_type else df).orderBy("ku_id")


def audit(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Audit lines; malformed ones are dropped."""
    df = spark.read.option("mode", "DROPMALFORMED").schema(schemas.AUDIT).json(path)
    return df.where(F.col("ts").startswith(date)) if date else df


def inbox(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Intents in order of creation, then file name."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", pattern).schema(schemas.INTENT).json(folder)
    return df.withColumn("file", F.col("_metadata.file_name")).orderBy("created_at", "file")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Undo snapshots by creation; malformed ones are skipped."""
    spec = schemas.parse("snapshot_id string, action_id string, kind string, created_at string, payload string, encrypted boolean")
    return _objects(spark, folder, spec).orderBy("created_at", "snapshot_id")


def issues(spark: SparkSession, path: str, limit: int = 80) -> DataFrame:
    return _objects(spark, path, schemas.ISSUE).orderBy(F.col("number").desc()).limit(limit)


def named_rows(spark: SparkSession, path: str, field: str = "projects") -> DataFrame:
    """id, name of answers that wrap a list: {"projects": [...]}. Answers without the list give none."""
    got = _objects(spark, path, schemas.parse(f"{field} array<struct<id:string,name:string>>"))
    return got.select(F.explode(field).alias("x")).select("x.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """pod (the file's name), ln (from 0), line. Read line by line, so a large log is split; lines are numbered within a split,
    and a split's first number follows from the counts of those before it, one row for each split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("_metadata.file_name", r"\.log$", "").alias("pod"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = cut(lines)
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"])
    return numbered.select("pod", (F.col("at") - F.col("first") + F.col("before")).alias("ln"), "line")
