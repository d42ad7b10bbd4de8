"""Spark types of the engine's records."""

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "boolean": T.BooleanType, "double": T.DoubleType, "int": T.IntegerType, "bigint": T.LongType, "binary": T.BinaryType}


def _parts(body: str) -> list[str]:
    """Splits at commas outside angle brackets."""
    out, depth, at = [], 0, 0
    for k, ch in enumerate(body):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(body[at:k].strip())
            at = k + 1
    return [*out, body[at:].strip()]


def parse(text: str) -> T.DataType:
    """A type, or a struct from "name type, ..."; needs no session, so schemas exist at import."""
    text = text.strip()
    if text in _SIMPLE:
        return _SIMPLE[text]()
    inner = text[text.find("<") + 1 : -1]
    if text.startswith("array<") and len(_parts(text)) == 1:
        return T.ArrayType(parse(inner))
    if text.startswith("map<") and len(_parts(text)) == 1:
        return T.MapType(*map(parse, _parts(inner)))
    if text.startswith("struct<") and len(_parts(text)) == 1:
        return T.StructType([T.StructField(n, parse(t)) for n, t in (p.split(":", 1) for p in _parts(inner))])
    return T.StructType([T.StructField(n, parse(t)) for n, t in (p.split(" ", 1) for p in _parts(text))])


PROVENANCE = parse("struct<kind:string,ref:string,quote:string,quote_taint:string,captured_at:string,retrievable:boolean>")
LINKED = "array<struct<repo:string,file_path:string,symbol:string>>"

CANDIDATE = parse(
    "source_type string, title string, body string, declared_taint string, confidence double, owner string, "
    "provenance array<struct<kind:string,ref:string,quote:string,quote_taint:string,captured_at:string>>, "
    "repo string, commit_sha string, file_path string, symbol string, content_hash string, freshness string, "
    f"line_range array<int>, linked_symbols {LINKED}"
)
RAW_ITEM = parse("source_type string, text string, meta map<string,string>")
KNOWLEDGE_UNIT = parse(
    "ku_id string, source_type string, title string, body string, body_redacted boolean, taint string, authority string, "
    "public_ok boolean, confidence double, freshness string, provenance array<struct<kind:string,ref:string,quote:string,quote_taint:string,captured_at:string,retrievable:boolean>>, "
    "repo string, commit_sha string, file_path string, symbol string, line_range struct<start:int,end:int>, content_hash string, "
    "owner string, serve_blocked boolean, derived_stale boolean, expires_at string, superseded_by string, last_verified_at string, created_at string, updated_at string"
)
CHAT_PAGE = parse(
    "result struct<conversationMessagesList:array<struct<openConversationId:string,singleChat:boolean,"
    "messages:array<struct<openMessageId:string,senderOpenDingTalkId:string,sender:string,content:string,createTime:string>>>>,hasMore:boolean,nextCursor:string>"
)
DOC_PAGE = parse("page int, hasMore boolean, nextPageToken string, documents array<struct<nodeId:string,name:string,docUrl:string,contentType:string,extension:string,createTime:string,creatorUid:string>>")
INTENT = parse(
    "action_id string, created_at string, source string, argv array<string>, cwd string, stdin string, "
    "semantic_labels struct<commit_class:string,taint:string,public_ok:boolean>, meta map<string,string>"
)
AUDIT = parse(
    "ts string, seq bigint, event string, action_id string, actor string, argv_norm_sha256 string, level string, decision string, "
    "reason string, detail map<string,string>, pid int"
)
EDGE = parse("src_ku string, dst_ku string, rel string")
ACTION = parse("action_id string, level string, decision string, status string, created_at string, updated_at string")
CONFIRM = parse("action_id string, argv_norm_sha256 string, issued_at bigint, ttl_seconds int, token string, used boolean")
ISSUE = parse("number bigint, title string, labels array<struct<name:string>>")
