"""Queries over records that are landed as files and read back: sources, sinks, stores, the stream.

A query writes a table's rows into a folder of its own in the shared folder, in the form that the source has, reads them with
the reader, keeps what it read and removes the folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import ingest, ops, policy, segments, validate
from ..operators.symbolstore import SymbolStore
from ..operators.unitstore import UnitStore
from ..policy_data import default_policy
from ..sources import readers, writers
from ..sources.shared import cut, shared_dir
from ..sources.tables import table
from ..sources.versions import Folder
from ..streaming.inbox import run_inbox
from .knowledge import NOW
from .records import BINARY, LATER, ORACLE_SQL, _cat, _prov, _units, registered
from .records import _files as _source_files

#: Files that a query lands, where its result says so or they stay small; else as many as keep a file to FILE_BYTES.
FILES, FILE_BYTES = 8, 4 << 20


@contextmanager
def landing(spark: SparkSession) -> Iterator[str]:
    folder = Folder(spark, f"{shared_dir(spark)}/landed-{uuid4().hex}")
    try:
        yield folder.path
    finally:
        folder.remove()


def _lists(rows: DataFrame, path: str, key: Column, order: str, form: Column, files: int | None = FILES) -> None:
    """Files that hold a JSON list each: so many by the key's remainder, or, with None, as many as the rows' size asks for, dealt by the
    key's hash. A file is made and read by a task each."""
    if files is None:
        size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(form.alias("x"))))).alias("n")).first()["n"] or 0
        files, key = max(FILES, -(-size // FILE_BYTES)), F.pmod(F.xxhash64(key), F.lit(max(FILES, -(-size // FILE_BYTES))))
    each = rows.select((key % files).alias("g"), F.col(order).alias("o"), form.alias("x"))
    lists = each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("xs"))
    _files(lists.select(F.to_json("xs", {"ignoreNullFields": "false"}).alias("value")), path)


def _files(texts: DataFrame, path: str) -> None:
    """One file a row."""
    texts.write.option("maxRecordsPerFile", 1).text(path)


# --- sources --------------------------------------------------------------------------------------------------------------


@registered("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'qa' ELSE 'issue' END AS source_type, sha256(coalesce(text, '')) AS text_sha FROM documents WHERE doc_id % 7 <> 0")
def landed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source dumps, with meta as an object or as keys of the item; every seventh has no source type."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    kind = F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 2 == 0, "qa").otherwise("issue").alias("source_type")
    with landing(spark) as at:
        _lists(d.where("doc_id % 2 = 0"), f"{at}/a", i, "doc_id", F.struct(kind, "text", F.struct(i.cast("string").alias("id")).alias("meta")), None)
        _lists(d.where("doc_id % 2 = 1"), f"{at}/b", i, "doc_id", F.struct(kind, "text", i.cast("string").alias("id")), None)
        got = readers.raw_items(spark, f"{at}/a").union(readers.raw_items(spark, f"{at}/b"))
        return cut(got.select(F.col("meta")["id"].alias("id"), "source_type", F.sha2("text", 256).alias("text_sha")))


@registered(f"""SELECT 't' || o_orderkey AS title, row_number() OVER (PARTITION BY o_orderkey % {FILES} ORDER BY o_orderkey) - 1 AS pos, 'D' || o_custkey AS ref FROM orders""")
def landed_candidates(spark, sf_dir):
    """Candidate lists of several files, and a file that isn't JSON."""
    n = F.col("o_orderkey")
    with landing(spark) as at:
        _lists(table(spark, sf_dir, "orders"), f"{at}/in", n, "o_orderkey", F.struct(F.lit("QA").alias("source_type"), _cat("t", n).alias("title"), F.array(F.struct(F.lit("DOC_ID").alias("kind"), _cat("D", F.col("o_custkey")).alias("ref"))).alias("provenance")))
        spark.createDataFrame([("not json",)], "value string").write.mode("append").text(f"{at}/in")
        got = readers.merged_candidates(spark, f"{at}/in", "part-*")
        return cut(got.select("title", F.col("pos").cast("long").alias("pos"), F.get("provenance", F.lit(0))["ref"].alias("ref")))


@registered(f"""SELECT conv_id::VARCHAR AS conversation_id, conv_id || '/' || turn AS msg_id, role AS sender_id, text AS content, conv_id % 3 = 0 AS single_chat, conv_id % {FILES} = 1 AS has_more FROM conversations""")
def landed_chats(spark, sf_dir):
    """Pages of a chat search."""
    c = table(spark, sf_dir, "conversations")
    said = F.struct(F.concat("conv_id", F.lit("/"), "turn").alias("openMessageId"), F.col("role").alias("senderOpenDingTalkId"), F.col("role").alias("sender"), F.col("text").alias("content"), F.lit(NOW).alias("createTime"))
    talks = c.groupBy("conv_id").agg(F.collect_list(said).alias("messages"))
    talk = F.struct(F.col("conv_id").cast("string").alias("openConversationId"), F.when(F.col("conv_id") % 3 == 0, True).alias("singleChat"), "messages")
    pages = talks.groupBy((F.col("conv_id") % FILES).alias("g")).agg(F.collect_list(talk).alias("conversationMessagesList"))
    with landing(spark) as at:
        _files(pages.select(F.to_json(F.struct(F.struct("conversationMessagesList", (F.col("g") == 1).alias("hasMore"), F.lit("next").alias("nextCursor")).alias("result"))).alias("value")), at)
        return cut(readers.chat_messages(spark, at).select("conversation_id", "msg_id", "sender_id", "content", "single_chat", "has_more"))


@registered("""WITH p AS (SELECT p_partkey AS i, p_partkey % 4 AS s, (p_partkey // 4) % 40 AS page FROM part)
SELECT s, page, 'N' || i AS node_id FROM p WHERE page < 30 AND (s <> 1 OR page <= 3) AND (s <> 2 OR page <= 5)""")
def landed_searches(spark, sf_dir):
    """Four searches of 40 pages: to the limit of pages, to a last page, to a missing token, and to the limit again."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 4).alias("s"), (F.floor(F.col("p_partkey") / 4) % 40).cast("int").alias("page"))
    pages = p.groupBy("s", "page").agg(F.collect_list(F.struct(_cat("N", F.col("i")).alias("nodeId"), F.lit("doc").alias("name"))).alias("documents"))
    more = (F.col("s") != 1) | (F.col("page") != 3)
    token = F.when((F.col("s") != 2) | (F.col("page") != 5), "t")
    with landing(spark) as at:
        pages.select("s", F.to_json(F.struct("page", more.alias("hasMore"), token.alias("nextPageToken"), "documents")).alias("value")).write.partitionBy("s").option("maxRecordsPerFile", 1).text(at)
        got = readers.doc_pages(spark, f"{at}/*")
        return cut(got.select(F.regexp_extract("search", r"s=(\d+)$", 1).cast("long").alias("s"), F.col("page").cast("long").alias("page"), F.col("nodeId").alias("node_id")))


@registered("""SELECT 'N' || p_partkey AS node_id, substr(regexp_replace(CASE WHEN p_partkey % 4 = 0 THEN 'N' || p_partkey ELSE p_name END, '[^\\w-]', '_', 'g'), 1, 40) || '_' || substr('N' || p_partkey, 1, 8) || '.md' AS file,
length('# ' || p_name)::BIGINT AS chars, sha256('# ' || p_name) AS text_sha FROM part WHERE p_partkey % 5 <> 0""")
def landed_documents(spark, sf_dir):
    """Found documents, some on two pages, some without a name or a body; bodies and the manifest as they are written."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    found = p.select(_cat("N", i).alias("nodeId"), F.when(i % 4 == 0, "").otherwise(F.col("p_name")).alias("name"), F.lit(NOW).alias("createTime"))
    bodies = p.select(_cat("N", i).alias("nodeId"), F.when(i % 5 == 0, " \n").otherwise(_cat("# ", F.col("p_name"))).alias("text"))
    with landing(spark) as at:
        writers.write_documents(readers.fetched_documents(found.union(found.where("substr(nodeId, 2) % 3 = 0")), bodies), at)
        manifest = spark.read.schema("node_id string, file string, chars long").json(f"{at}/manifest")
        return cut(manifest.join(spark.read.parquet(f"{at}/bodies").select("node_id", F.sha2("text", 256).alias("text_sha")), "node_id"))


@registered("""SELECT 'K' || o_orderkey AS ku_id, 'CODE' AS source_type, 'r' || o_orderkey % 5 AS repo, 's' || o_orderkey AS symbol FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 2
UNION ALL SELECT 'K' || o_orderkey, 'QA', NULL, NULL FROM orders WHERE o_orderkey % 3 = 1""")
def landed_units(spark, sf_dir):
    """Units by type: the questions, and the code of one repository."""
    n = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("CODE"), F.lit("QA"), F.lit("ISSUE")), (n % 3 + 1).cast("int"))
    code = lambda c: F.when(n % 3 == 0, c)
    u = _units(table(spark, sf_dir, "orders"), ku_id=_cat("K", n), source_type=kind, repo=code(_cat("r", n % 5)), symbol=code(_cat("s", n)), provenance=_prov(_cat("D", n)))
    with landing(spark) as at:
        writers.write_units(u, at)
        mine = readers.code_units(readers.units(spark, at), "r2").select("ku_id", "source_type", "repo", "symbol")
        return cut(mine.union(readers.units(spark, at, "QA").select("ku_id", "source_type", "repo", "symbol")))


@registered("""SELECT 'A' || event_id AS action_id, CASE WHEN event_id % 3 = 0 THEN 'cli' ELSE 'classify' END AS event FROM events WHERE ts::DATE = (SELECT min(ts::DATE) FROM events)""")
def landed_audit(spark, sf_dir):
    """Two appends, broken lines among them; the records of the first day."""
    e = table(spark, sf_dir, "events")
    day = e.agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
    kinds = {"ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "event": F.when(F.col("event_id") % 3 == 0, "what").otherwise("classify"), "action_id": _cat("A", F.col("event_id")), "actor": F.lit("cli")}
    rows = e.select("event_id", *[kinds.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.AUDIT])
    with landing(spark) as at:
        for half in (0, 1):
            writers.append_audit(rows.where(F.col("event_id") % 2 == half).drop("event_id"), at, NOW)
        spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(f"{at}/date={day}")
        return cut(readers.audit(spark, at, day).select("action_id", "event"))


def _intents(spark, sf_dir) -> DataFrame:
    """Ids in order, some odd; reads, forbidden commands, foreign ones."""
    e = F.col("event_id")
    id_ = F.when(e % 5 == 0, _cat("AI-", e)).otherwise(F.concat(F.lit("AI-20240101-"), F.lpad(F.lower(F.hex("event_id")), 8, "0")))
    argv = F.when(e % 3 == 0, F.array(*map(F.lit, (BINARY, "auth", "export")))).otherwise(F.array(*map(F.lit, (BINARY, "chat", "message", "list"))))
    label = F.struct(F.lit("maybe").alias("commit_class"), F.lit("CLEAN").alias("taint"), F.lit(False).alias("public_ok"))
    return table(spark, sf_dir, "events").select(e, F.struct(id_.alias("action_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit("cli").alias("source"), argv.alias("argv"), label.alias("semantic_labels")).alias("x"))


_INTENT_ID = "CASE WHEN event_id % 5 = 0 THEN 'AI-' || event_id ELSE 'AI-20240101-' || lpad(lower(to_hex(event_id)), 8, '0') END"


@registered(f"""SELECT {_INTENT_ID} AS action_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events""")
def landed_inbox(spark, sf_dir):
    """The intents of several files."""
    with landing(spark) as at:
        _lists(_intents(spark, sf_dir), f"{at}/in", F.col("event_id"), "event_id", F.col("x"))
        return cut(readers.inbox(spark, f"{at}/in", "part-*").select("action_id", "created_at"))


@registered(f"""SELECT {_INTENT_ID} AS action_id, CASE WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_id % 3 = 0 THEN 'denied' ELSE 'execute' END AS status,
CASE WHEN event_id % 5 = 0 THEN 'action_id' WHEN event_id % 3 = 0 THEN 'never' ELSE '' END AS why, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS folder FROM events""")
def streamed_inbox(spark, sf_dir):
    """The inbox as a stream; a second run finds half of the intents landed again and handles none of them."""
    with landing(spark) as at:
        i = _intents(spark, sf_dir)
        for n, part in enumerate((i, i.where("event_id % 2 = 0"))):
            _lists(part, f"{at}/land{n}", F.col("event_id"), "event_id", F.col("x"), None)
            Folder(spark, f"{at}/land{n}").move(f"{at}/in", ".txt", f"-{n}.json")
            run_inbox(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", default_policy(), BINARY, files_a_batch=64).awaitTermination()
        return cut(spark.read.parquet(f"{at}/out").select("action_id", "status", F.coalesce("failure_reason", F.lit("")).alias("why"), "folder"))


@registered(ORACLE_SQL["name_resolution"])
def landed_projects(spark, sf_dir):
    """Names and ids looked up in answers that wrap their lists, one of them without a list."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    known = n.select(key.alias("id"), F.lower("n_name").alias("name")).unionByName(n.select(_cat("t", key).alias("id"), _cat("TWIN", F.col("n_regionkey")).alias("name")))
    asked = n.select(F.col("n_name").alias("query")).union(n.select(key)).union(n.select(_cat("twin", F.col("n_regionkey"))).distinct()).union(spark.createDataFrame([("nobody",)], "query string"))
    with landing(spark) as at:
        each = known.groupBy((F.xxhash64("id") % FILES).alias("g")).agg(F.collect_list(F.struct("id", "name")).alias("projects"))
        _files(each.select(F.to_json(F.struct("projects")).alias("value")), at)
        spark.createDataFrame([('{"error": "none"}',)], "value string").write.mode("append").text(at)
        found = validate.resolve_by_name(readers.named_rows(spark, at), asked)
        return cut(found.select("query", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("error", F.lit("")).alias("error")))


@registered("""SELECT 'S' || o_orderkey AS snapshot_id, 'A' || o_orderkey AS action_id, o_orderstatus AS kind FROM orders WHERE o_orderkey % 2 = 0""")
def landed_snapshots(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0"), F.col("o_orderkey")
    with landing(spark) as at:
        _lists(o, at, F.floor(n / 2), "o_orderkey", F.struct(_cat("S", n).alias("snapshot_id"), _cat("A", n).alias("action_id"), F.col("o_orderstatus").alias("kind"), F.lit(NOW).alias("created_at")))
        spark.createDataFrame([("{torn",)], "value string").write.mode("append").text(at)
        return cut(readers.snapshots(spark, at).select("snapshot_id", "action_id", "kind"))


@registered("""SELECT number, title, line FROM (SELECT o_orderkey AS number, 'o' || o_orderkey AS title, o_orderstatus AS line FROM orders ORDER BY o_orderkey DESC LIMIT 80) WHERE number NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def landed_issues(spark, sf_dir):
    """The open issues' newest 80 without those in the stored seen set."""
    n = F.col("o_orderkey")
    with landing(spark) as at:
        _lists(table(spark, sf_dir, "orders"), f"{at}/issues", n, "o_orderkey", F.struct(n.alias("number"), _cat("o", n).alias("title"), F.array(F.struct(_cat("line:", F.col("o_orderstatus")).alias("name"))).alias("labels")))
        writers.write_seen(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("number")), f"{at}/seen")
        new = ops.new_issues(readers.issues(spark, f"{at}/issues"), spark.read.schema("number long").json(f"{at}/seen"))
        return cut(new.select("number", "title", "line"))


@registered("SELECT event_type AS pod, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ln, 'e' || event_id AS line FROM events")
def landed_logs(spark, sf_dir):
    """A log for every kind of event, in lines."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pod"), "event_id", _cat("e", F.col("event_id")).alias("value"))
    with landing(spark) as at:
        e.repartition("pod").sortWithinPartitions("pod", "event_id").select("pod", "value").write.partitionBy("pod").text(f"{at}/in")
        for name in Folder(spark, f"{at}/in").names():
            if name.startswith("pod="):
                Folder(spark, f"{at}/in/{name}").move(f"{at}/logs", ".txt", ".log", name.removeprefix("pod="))
        return cut(readers.log_lines(spark, f"{at}/logs").select("pod", F.col("ln").cast("long").alias("ln"), "line"))


# --- stores ---------------------------------------------------------------------------------------------------------------


@registered(f"""SELECT 'A' || event_id AS action_id, CASE WHEN event_id % 2 = 0 THEN 'execute' ELSE 'draft' END AS status, '{NOW}' AS created_at, CASE WHEN event_id % 2 = 0 THEN '{LATER}' ELSE '{NOW}' END AS updated_at FROM events""")
def recorded_actions(spark, sf_dir):
    """Drafts, and the half of them that is carried out later."""
    e = table(spark, sf_dir, "events").select("event_id", _cat("A", F.col("event_id")).alias("action_id"), F.lit("R1").alias("level"), F.lit("HUMAN_CONFIRM").alias("decision"))
    first = policy.record_actions(spark.createDataFrame([], schemas.ACTION), e.withColumn("status", F.lit("draft")), NOW)
    both = policy.record_actions(first, e.where("event_id % 2 = 0").withColumn("status", F.lit("execute")), LATER)
    return both.select("action_id", "status", "created_at", "updated_at")


def _stored(spark, sf_dir, at: str) -> UnitStore:
    """Even orders' units, then a third of all anew, then some again."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    make = lambda rows, mark, now: _units(rows, ku_id=_cat("K", n), title=_cat(mark, n), source_type=F.lit("QA"), authority=F.when(n % 4 == 0, "DRAFT").otherwise("REVIEWED"), freshness=F.lit("STALE" if mark == "b" else "FRESH"), serve_blocked=n % 4 == 0, created_at=F.lit(now), provenance=_prov(_cat("D", n)))
    s = UnitStore(spark, f"{at}/units")
    s.create(make(o.where(n % 2 == 0), "a", NOW), None)
    s.upsert(make(o.where(n % 3 == 0), "b", LATER))
    s.upsert(make(o.where(n % 100 == 6), "c", LATER))
    return s


_STORED_SQL = f"""WITH s AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 100 = 6 THEN 'c' WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS mark,
CASE WHEN o_orderkey % 2 = 0 THEN '{NOW}' ELSE '{LATER}' END AS created_at FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"""


@registered(f"{_STORED_SQL} SELECT 'K' || n AS ku_id, mark || n AS title, created_at FROM s")
def stored_units(spark, sf_dir):
    """Units by id in buckets, after two upserts."""
    with landing(spark) as at:
        return cut(_stored(spark, sf_dir, at).read().select("ku_id", "title", "created_at"))


@registered(f"""{_STORED_SQL} SELECT 'total' AS kind, '' AS value, count(*) AS n FROM s UNION ALL SELECT 'source_type', 'QA', count(*) FROM s UNION ALL SELECT 'authority', CASE WHEN n % 4 = 0 THEN 'DRAFT' ELSE 'REVIEWED' END, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'freshness', CASE mark WHEN 'b' THEN 'STALE' ELSE 'FRESH' END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'serve_blocked', '', count(*) FROM s WHERE n % 4 = 0""")
def kept_inventory(spark, sf_dir):
    """The inventory that the upserts have kept up to date."""
    with landing(spark) as at:
        return _stored(spark, sf_dir, at).inventory()


@registered(ORACLE_SQL["code_symbols"])
def updated_symbols(spark, sf_dir):
    """Symbols of a stored repository state in which a tenth of the files were other ones, brought up to date."""
    now = _source_files(spark, sf_dir)
    i = F.regexp_extract("file_path", r"(\d+)", 1).cast("long")
    old = now.where(i % 20 != 3).withColumn("text", F.when(i % 20 == 6, "def old():\n    pass\n").otherwise(F.col("text")))
    gone = now.where(i % 10 == 2).withColumn("file_path", F.concat(F.lit("old/"), "file_path"))
    with landing(spark) as at:
        s = SymbolStore(spark, at)
        s.create(old.unionByName(gone), 16)
        s.update(now)
        return cut(s.symbols().select("file_path", "symbol", "kind", "line_start", "line_end", "content_hash", "signature", "docstring"))


@registered("""WITH t AS (SELECT c_custkey AS n, unnest([CASE WHEN c_custkey % 50 < 3 THEN 'new' || c_custkey % 50 ELSE 'old' END, 'c' || c_custkey % 97, 'name' || c_custkey]) AS term FROM customer WHERE c_custkey % 50 <> 9)
SELECT term, count(*) AS df FROM t GROUP BY term""")
def segment_refreshes(spark, sf_dir):
    """A stored index after three refreshes, of a fiftieth of the units each, units that go, and a merge."""
    n = F.col("c_custkey")
    unit = lambda rows, word: rows.select(_cat("K", n).alias("ku_id"), F.lit(word).alias("title"), F.lit(None).cast("string").alias("symbol"), _cat("name", n, " c", n % 97).alias("body"))
    c = table(spark, sf_dir, "customer")
    with landing(spark) as at:
        segments.write_index(unit(c, "old"), at)
        for k in range(3):
            segments.refresh_index(unit(c.where(n % 50 == k), f"new{k}"), at, c.where(n % 50 == 9).select(_cat("K", n).alias("ku_id")) if k == 1 else None)
        before = segments.open_index(spark, at)
        kept = before.terms.groupBy("term").agg(F.sum("df").alias("was"))
        segments.merge_index(spark, at)
        after = segments.open_index(spark, at).terms.groupBy("term").agg(F.sum("df").alias("df"))
        return cut(after.join(kept, "term").where("was = df").select("term", "df"))


@registered("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'bad_source_type' WHEN doc_id % 7 = 0 THEN 'empty_title' WHEN coalesce(trim(text, E' \\n\\t\\r'), '') = '' THEN 'empty_body' WHEN doc_id % 13 = 0 THEN 'no_provenance' ELSE 'ok' END AS drop_reason, count(*) AS n FROM documents GROUP BY 1""")
def ingest_counts(spark, sf_dir):
    """What one pass of ingestion over all documents counts."""
    d, m = table(spark, sf_dir, "documents"), lambda k: F.col("doc_id") % k
    values = {
        "source_type": F.when(m(5) == 0, "blog").otherwise("playbook"), "title": F.when(m(7) == 0, " ").otherwise(_cat("t", F.col("doc_id"))), "body": F.col("text"),
        "provenance": F.when(m(13) != 0, F.array(F.struct(F.lit("DOC_ID").alias("kind"), _cat("D", F.col("doc_id")).alias("ref"), *[F.lit(None).cast("string").alias(x) for x in ("quote", "quote_taint", "captured_at")]))),
    }
    rows, counts = ingest.ingest_once(d.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANDIDATE]), NOW)
    with landing(spark) as at:
        rows.write.partitionBy("drop_reason").parquet(at)
        return spark.createDataFrame(ingest.ingest_report(counts.get), "drop_reason string, n long")
