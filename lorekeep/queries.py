"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .enums import COMMITMENT_MARKERS
from .functions import redaction, taint, text
from .functions.commands import argv_hash, normalize
from .operators import freshness, ingest, logs, ops, policy, retrieve, scan, store, validate
from .operators.segments import jaccard_best
from .plans.knowledge import answered_questions, benchmark_queries, chat_threads, document_index, document_units, table
from .plans import landed, records  # noqa: F401  landed adds to the records' queries
from .policy_data import default_policy

BINARY = "cli"

# --- SQL building blocks ----------------------------------------------------------------------------------------------

_RUNS = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{FAFF}]+|[A-Za-z0-9_]+"


def _tok(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '{_RUNS}'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9_]') THEN [lower(r)] WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"


_KU = """ku AS (
  SELECT d.doc_id, 'KU-' || substr(sha1('PLAYBOOK|doc:' || d.doc_id || '||'), 1, 16) AS ku_id, substr(text, 1, 80) AS title, text AS body, source AS repo,
    CASE WHEN toxic = 1 THEN 'SENSITIVE' WHEN d.doc_id % 3 = 0 THEN 'CLEAN' ELSE 'INTERNAL' END AS taint,
    CASE WHEN quality = 1 THEN CASE WHEN d.doc_id % 5 = 0 THEN 'AUTHORITATIVE' ELSE 'REVIEWED' END WHEN quality = 0 THEN 'DEPRECATED' WHEN d.doc_id % 2 = 0 THEN 'REVIEWED' ELSE 'DRAFT' END AS authority,
    CASE d.doc_id % 7 WHEN 0 THEN 'STALE' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'EXPIRED' ELSE 'FRESH' END AS freshness
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
_Q = "q AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark)"
_BM25 = f"""
tok AS (SELECT ku_id, {_tok("title || '  ' || body")} AS t FROM ku),
qt AS (SELECT DISTINCT query_id, unnest({_tok("query")}) AS term FROM q),
tf AS (SELECT ku_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT ku_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok),
idf AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM tf, st GROUP BY term),
bm AS (
  SELECT query_id, tf.ku_id, round(-sum(CASE WHEN w > 0 THEN w ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN idf ON idf.term = tf.term, st GROUP BY ALL
),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, ku_id) AS lex_rank FROM bm QUALIFY lex_rank <= 20),
rel AS (
  SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-9 * greatest(abs(min(score) OVER w), abs(max(score) OVER w)) THEN 1.0
            ELSE (max(score) OVER w - score) / (max(score) OVER w - min(score) OVER w) END AS relevance
  FROM top WINDOW w AS (PARTITION BY query_id)
)"""
_RANKED = f"""
cand AS (
  SELECT r.query_id, r.lex_rank, r.relevance, k.*, 0.3 * CASE freshness WHEN 'FRESH' THEN 1.0 WHEN 'EXPIRED' THEN 0.0 ELSE 0.3 END
    + 0.3 * CASE authority WHEN 'AUTHORITATIVE' THEN 1.0 WHEN 'REVIEWED' THEN 0.7 WHEN 'DEPRECATED' THEN 0.0 ELSE 0.2 END + 0.4 * relevance AS fused,
    len(list_intersect(list_distinct({_tok("q.query")}), {_tok("k.title || '  ' || k.body")}))::DOUBLE / len(list_distinct({_tok("q.query")})) AS lex
  FROM rel r JOIN ku k ON r.ku_id = k.ku_id JOIN q ON q.query_id = r.query_id
  WHERE authority NOT IN ('DRAFT', 'DEPRECATED') AND freshness <> 'EXPIRED'
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, lex_rank, ku_id) AS rank FROM cand QUALIFY rank <= 5)"""

# --- queries ----------------------------------------------------------------------------------------------------------


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 3), " ").alias("head"))


def match_expressions(spark, sf_dir):
    return benchmark_queries(spark, sf_dir).select("query_id", text.match_expression("query").alias("expression"), text.has_marker("query", COMMITMENT_MARKERS).alias("marked"))


def term_statistics(spark, sf_dir):
    return scan.term_counts(document_units(spark, sf_dir), "body")


def bm25_topk(spark, sf_dir):
    hits = retrieve.lexical_hits(document_units(spark, sf_dir), benchmark_queries(spark, sf_dir), 5, index=document_index(spark, sf_dir))
    return hits.select("query_id", "ku_id", F.col("lex_rank").cast("long").alias("lex_rank"), F.round("relevance", 6).alias("relevance"))


def jaccard_topk(spark, sf_dir):
    best = jaccard_best(document_index(spark, sf_dir), benchmark_queries(spark, sf_dir), 20)
    return best.select("query_id", "ku_id", F.col("rank").cast("long").alias("rank"), F.round("relevance", 9).alias("relevance"))


def ranked_evidence(spark, sf_dir):
    r = retrieve.retrieve(document_units(spark, sf_dir), benchmark_queries(spark, sf_dir), index=document_index(spark, sf_dir))
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "ku_id", F.round("fused", 6).alias("fused"), F.round("lexical_overlap", 6).alias("lexical_overlap"))


def verdicts(spark, sf_dir):
    v = retrieve.serve(document_units(spark, sf_dir), benchmark_queries(spark, sf_dir), index=document_index(spark, sf_dir))
    return v.select("query_id", "decision", "reason", F.round("confidence", 6).alias("confidence"), F.size("citations").cast("long").alias("n_citations"), F.array_join(F.transform("citations", lambda c: c["prov_ref"]), ",").alias("refs"))


def draft_previews(spark, sf_dir):
    d = retrieve.drafts(retrieve.serve(document_units(spark, sf_dir), benchmark_queries(spark, sf_dir), index=document_index(spark, sf_dir)))
    return d.select("query_id", "would_answer", F.coalesce(F.sha2("draft_text", 256), F.lit("")).alias("draft_sha"), F.coalesce("abstain_reason", F.lit("")).alias("abstain_reason"))


def contradiction_groups(spark, sf_dir):
    d = document_units(spark, sf_dir).select(text.question_fingerprint("title").alias("fingerprint"), text.answer_hash("body").alias("h"))
    g = d.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_answers"))
    return g.where("n_answers >= 2 AND fingerprint <> ''").select(F.sha2("fingerprint", 256).alias("fingerprint"), "n", "n_answers")


def qa_pairs(spark, sf_dir):
    p = ingest.pair_questions(chat_threads(spark, sf_dir), "assistant")
    return p.select("thread_id", "q_pos", "a_pos", "question", "answer")


def qa_unit_ids(spark, sf_dir):
    p = ingest.pairs_to_candidates(ingest.pair_questions(chat_threads(spark, sf_dir), "assistant"))
    none = F.lit(None).cast("string")
    return p.select(text.unit_id(F.lit("QA"), F.get("provenance", F.lit(0))["ref"], none, none).alias("ku_id"), "title", F.sha2("body", 256).alias("body_sha"), "declared_taint")


def flagship(spark, sf_dir):
    v = answered_questions(spark, sf_dir)
    return v.select("query_id", "decision", "reason", F.round("confidence", 6).alias("confidence"), F.size("citations").cast("long").alias("n_citations"))


def validation_report(spark, sf_dir):
    d, m = table(spark, sf_dir, "documents"), lambda k: F.col("doc_id") % k
    entry = F.struct(F.when(m(13) == 0, "nowhere").otherwise("doc_id").alias("kind"), F.when(m(17) == 0, "  ").otherwise(F.concat(F.lit("doc:"), "doc_id")).alias("ref"))
    c = d.select(F.when(m(5) == 0, "blog").otherwise("Playbook").alias("source_type"), F.when(m(7) == 0, " \n").otherwise(F.substring("text", 1, 20)).alias("title"), F.when(m(11) == 0, "").otherwise(F.col("text")).alias("body"), F.array(entry).alias("provenance"))
    return validate.drop_report(validate.drop_reason(c))


def entropy_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select(F.explode(F.regexp_extract_all("text", F.lit(redaction.ENTROPY_TOKEN.replace("\\s", " \\t\\n\\x0B\\f\\r")), F.lit(0))).alias("token")).where(F.length("token") >= redaction.ENTROPY_LENGTH).distinct()
    return t.select("token", F.round(text.entropy("token"), 6).alias("bits"))


def redaction_hits(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("doc_id", redaction.redact(F.coalesce("text", F.lit(""))).alias("r"))
    return r.select("doc_id", F.size("r.hits").cast("long").alias("n_hits"), F.col("r.max_taint").alias("max_taint"), F.sha2("r.text", 256).alias("text_sha"))


def taint_fold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    declared = F.element_at(F.array(F.lit("clean"), F.lit("INTERNAL"), F.lit("odd")), (F.col("doc_id") % 3 + 1).cast("int"))
    found = F.when(F.col("toxic") == 1, "SENSITIVE").when(F.contains("text", F.lit("@")), "INTERNAL").otherwise("CLEAN")
    return d.select("doc_id", taint.strictest(taint.coerce(declared, "INTERNAL"), found).alias("taint"), taint.strictest(declared, found).alias("raw"))


def unit_inventory(spark, sf_dir):
    return store.inventory(document_units(spark, sf_dir))


def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ku_id"), "event_id", F.col("event_type").alias("state"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    old = e.where("event_id % 2 = 0").groupBy("ku_id").agg(F.max("event_id").alias("event_id"), F.max_by("state", "event_id").alias("state"), F.min_by("created_at", "event_id").alias("created_at"))
    return store.upsert(old, e.where("event_id % 2 = 1").select(*old.columns), "ku_id", "event_id")


def derived_stale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rel = F.when(F.col("l_linenumber") % 3 == 0, "SUPERSEDES").when(F.col("l_linenumber") % 3 == 1, "ISSUE_CODE").otherwise("QA_CODE")
    edges = li.select(F.concat(F.lit("O"), "l_orderkey").alias("src_ku"), F.concat(F.lit("P"), "l_partkey").alias("dst_ku"), rel.alias("rel"))
    seeds = table(spark, sf_dir, "part").where("p_size <= 2").select(F.concat(F.lit("P"), "p_partkey").alias("ku_id"))
    return store.neighbours(edges, seeds)


def authority_transitions(spark, sf_dir):
    e, kinds = table(spark, sf_dir, "events"), ("DRAFT", "REVIEWED", "AUTHORITATIVE", "DEPRECATED")
    pick = lambda k: F.element_at(F.array(*map(F.lit, kinds)), (F.floor(F.col("event_id") / k) % 4 + 1).cast("int"))
    out = e.select("event_id", pick(1).alias("current"), pick(4).alias("target"), (F.col("user_id") % 3 > 0).alias("has"))
    return out.select("event_id", F.coalesce(store.transition_error(F.col("current"), F.col("target"), F.col("has")), F.lit("")).alias("error"))


def freshness_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    units = d.select(F.col("source").alias("repo"), F.lit("f").alias("file_path"), F.col("doc_id").cast("string").alias("symbol"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "QA").otherwise("CODE").alias("source_type"), F.when(F.col("doc_id") % 11 == 0, "FRESH").otherwise("UNKNOWN").alias("freshness"), "doc_id")
    snapshot = d.where("doc_id % 5 <> 0").select(F.col("source").alias("repo"), F.lit("f").alias("file_path"), F.col("doc_id").cast("string").alias("symbol"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return freshness.verified(units, snapshot).select("doc_id", "freshness")


_ARGV = (
    "cli chat message list --yes", "/bin/cli doc delete x -y", "cli auth export", "cli auth status", "cli chat message list-direct", "cli nothing", "cli", "sh mail send", "cli mail message search-x", "cli aitable record query a",
)


def _intents(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    argv = F.split(F.element_at(F.array(*map(F.lit, _ARGV)), (F.col("event_id") % len(_ARGV) + 1).cast("int")), " ")
    label = F.struct(F.when(F.col("event_id") % 3 == 0, "yes").otherwise("maybe").alias("commit_class"), F.when(F.col("event_id") % 7 == 0, "SENSITIVE").otherwise("INTERNAL").alias("taint"), F.lit(False).alias("public_ok"))
    return e.select(F.col("event_id").alias("action_id"), argv.alias("argv"), label.alias("semantic_labels"))


def policy_gate(spark, sf_dir):
    g = policy.gate(_intents(spark, sf_dir), default_policy(), BINARY)
    return g.select("action_id", F.coalesce("level", F.lit("")).alias("level"), "decision", "never", "requires_confirm", "human_only", F.array_join("matched_prefix", " ").alias("prefix"), F.coalesce("argv_norm_sha256", F.lit("")).alias("argv_sha"))


def inbox_errors(spark, sf_dir):
    e, m = table(spark, sf_dir, "events"), lambda k: F.col("event_id") % k
    id_ = F.when(m(3) == 0, F.concat(F.lit("AI-"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("AI-20240101-"), F.lpad(F.lower(F.hex("event_id")), 8, "0")))
    created = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(m(4) == 0, "").otherwise("Z"))
    argv = F.when(m(5) == 0, F.array().cast("array<string>")).when(m(5) == 1, F.array(F.lit("sh"))).otherwise(F.array(F.lit(BINARY), F.lit("x")))
    label = F.when(m(2) == 0, F.struct(F.when(m(6) == 0, "no").otherwise("maybe").alias("commit_class"), F.when(m(10) == 0, "odd").otherwise("CLEAN").alias("taint")))
    i = e.select("event_id", id_.alias("action_id"), created.alias("created_at"), F.when(m(9) == 0, "web").otherwise("cli").alias("source"), argv.alias("argv"), label.alias("semantic_labels"))
    return validate.intent_errors(i, BINARY).select("event_id", F.array_join("errors", ",").alias("errors"))


def confirm_outcomes(spark, sf_dir):
    """Tokens issued at 1000 for 300 s, then presented: unchanged, changed, expired, used or never issued."""
    i, m, key = _intents(spark, sf_dir), lambda k: F.col("action_id") % k, b"secret"
    rec = policy.issue_tokens(i.where(m(6) != 0), key, 1000, 300, (BINARY,)).withColumn("used", m(6) == 1).withColumn("issued_at", F.when(m(6) == 2, F.lit(1).cast("long")).otherwise(F.col("issued_at")))
    shown = i.withColumn("argv", F.when(m(6) == 3, F.array(F.lit(BINARY), F.lit("other"))).otherwise(F.col("argv")))
    return policy.verify_tokens(shown, rec.withColumn("token", F.when(m(6) == 4, "forged").otherwise(F.col("token"))), key, 1200, (BINARY,)).drop("h")


def patrol_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = F.array(F.struct(F.concat(F.lit("priority:"), "o_orderpriority").alias("name")), F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("line:"), "o_orderstatus")).otherwise("other").alias("name")))
    issues = o.select(F.col("o_orderkey").alias("number"), F.concat(F.lit("order "), "o_orderkey").alias("title"), names.alias("labels"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("number"))
    return ops.new_issues(issues, seen)


def log_context(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pod"), F.col("event_id").alias("ln"), F.col("props").alias("line"))
    return logs.grep_context(e, '"k": ?1', 2).select("pod", "ln", "is_match")


def log_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pod"), F.col("event_id").alias("ln"), F.col("props").alias("line"))
    return logs.tail(e, 25)


def audit_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.concat("event_type", F.lit("-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event"), (F.col("user_id") % 10).alias("pid"))
    return logs.audit_sequence(e).withColumn("seq", F.col("seq").cast("long"))


def impact_by_source(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.when(F.col("doc_id") % 2 == 0, "a.md").otherwise("a.bin").alias("file_path"), "text")
    return ops.impact(f, ["[Ll]icense", "token"], ["@", "http"])


def admissions(spark, sf_dir):
    c, m = table(spark, sf_dir, "conversations"), lambda k: F.col("conv_id") % k
    msgs = c.select(F.when(m(4) == 0, "single").otherwise("group").alias("conversationType"), F.when(m(5) == 0, "").otherwise(F.col("conv_id").cast("string")).alias("conversationId"))
    allowed = c.where("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("conversation_id"))
    return validate.admit_messages(msgs, allowed).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def probe_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("user_id") % 3 == 0, "404").when(F.col("user_id") % 3 == 1, F.when(F.col("event_id") % 50 == 0, "200").otherwise("404")).otherwise("000")
    p = e.select(F.col("user_id").cast("string").alias("host"), code.alias("code"), F.when(F.col("user_id") % 2 == 0, "elb").otherwise("nginx").alias("server"), F.lit("").alias("router"))
    return logs.diagnose(p)


def encryption_roundtrip(spark, sf_dir):
    u, key = document_units(spark, sf_dir).select("doc_id", "body", "provenance"), F.lit("0123456789abcdef0123456789abcdef")
    return store.decrypted(store.encrypted(u, key), key).select("doc_id", F.sha2("body", 256).alias("body_sha"))


def numbered_references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 4 > 0, F.array(F.struct(F.lit("FILE").alias("kind"), F.col("source").alias("ref")))).otherwise(F.array().cast("array<struct<kind:string,ref:string>>")).alias("provenance"))
    return ingest.unique_references(d).select("pos", F.coalesce(F.get("provenance", F.lit(0))["ref"], F.lit("")).alias("ref"))


def acceptance_measures(spark, sf_dir):
    u = document_units(spark, sf_dir)
    return ops.acceptance(u, u.where("doc_id % 50 = 0"), index=document_index(spark, sf_dir))


def triage_packages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 50 = 0").select(F.concat("conv_id", F.lit("/"), "turn").alias("msg_id"), F.col("text").alias("content"))
    t = ops.triage(c, document_units(spark, sf_dir), index=document_index(spark, sf_dir))
    return t.select("msg_id", "decision", "reason", F.col("n_citations").cast("long").alias("n_citations"), F.size("kus").cast("long").alias("n_kus"))


def command_hashes(spark, sf_dir):
    return _intents(spark, sf_dir).select("action_id", argv_hash(normalize(F.col("argv"), (BINARY,))).alias("argv_sha"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, tokenize_stats, match_expressions, term_statistics, bm25_topk, jaccard_topk, ranked_evidence, verdicts, draft_previews, contradiction_groups, qa_pairs, qa_unit_ids,
        validation_report, entropy_tokens, redaction_hits, taint_fold, unit_inventory, upsert_last_wins, derived_stale, authority_transitions, freshness_verify, policy_gate, inbox_errors,
        confirm_outcomes, patrol_new, log_context, log_tail, audit_sequence, impact_by_source, admissions, probe_verdicts, encryption_roundtrip, numbered_references, acceptance_measures, triage_packages, command_hashes,
    )
}

# --- SQL --------------------------------------------------------------------------------------------------------------

_PAIRS = """
m AS (SELECT conv_id AS thread_id, turn AS pos, role AS author, text, conv_id || '/' || turn AS msg_id FROM conversations WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''),
t AS (SELECT *, coalesce(sum((author = 'assistant')::INT) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM m),
p AS (
  SELECT thread_id, max(pos) FILTER (author <> 'assistant') AS q_pos, max(pos) FILTER (author = 'assistant') AS a_pos,
    arg_max(text, pos) FILTER (author <> 'assistant') AS question, arg_max(text, pos) FILTER (author = 'assistant') AS answer, arg_max(msg_id, pos) FILTER (author <> 'assistant') AS q_msg
  FROM t GROUP BY thread_id, turn HAVING count(DISTINCT author) FILTER (author <> 'assistant') = 1 AND count(*) FILTER (author = 'assistant') > 0
)"""
_STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_INTENT = "(SELECT event_id, [" + ", ".join("['" + "', '".join(a.split()) + "']" for a in _ARGV) + f"][event_id % {len(_ARGV)} + 1] AS argv FROM events)"
_NORM = "list_filter(CASE WHEN string_split(argv[1], '/')[-1] = 'cli' THEN argv[2:] ELSE argv END, lambda t: t NOT IN ('--yes', '-y'))"


def _rules_sql() -> str:
    p = default_policy()
    rows = [("never", x, 2000 + len(x), "") for x in p["never"]] + [("white", e["match"], 1000 + len(e["match"]), "R0") for e in p["r0_whitelist"]] + [("rule", r["prefix"], len(r["prefix"]), r["level"]) for r in p["rules"]]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{' '.join(x)}', {n}, '{level}')" for k, x, n, level in rows) + ") v(kind, prefix, o, level)"


_CHAT_Q = "q AS (SELECT conv_id || '/' || turn AS query_id, text AS query FROM conversations WHERE role = 'user' AND conv_id % 50 = 0 AND trim(coalesce(text, ''), E' \\n\\t\\r') <> '')"
_SELF_Q = "q AS (SELECT ku_id AS query_id, title AS query FROM ku WHERE doc_id % 50 = 0 AND trim(coalesce(title, ''), E' \\n\\t\\r') <> '')"
_DRAFT = _STRIP.format(f"string_agg({_STRIP.format('body')}, chr(10) || chr(10) ORDER BY rank)")


#: The chats' answered questions as units. Their texts hold nothing that is redacted; ``redaction_hits`` is about that.
_CHAT_KU = f"""{_PAIRS}, ku AS (SELECT q_msg AS doc_id, 'KU-' || substr(sha1('QA|' || q_msg || '||'), 1, 16) AS ku_id, substr({_STRIP.format('question')}, 1, 120) AS title,
  'Q: ' || {_STRIP.format('question')} || chr(10) || 'A: ' || {_STRIP.format('answer')} AS body, 'REVIEWED' AS authority, 'UNKNOWN' AS freshness FROM p)"""
_SPLIT = f"""split AS (SELECT DISTINCT query_id FROM (SELECT query_id, fp FROM (SELECT query_id, array_to_string(list_sort(list_distinct({_tok('title')})), '|') AS fp, regexp_replace({_STRIP.format('body')}, '\\s+', ' ', 'g') AS h FROM ranked)
  WHERE fp <> '' GROUP BY ALL HAVING count(DISTINCT h) >= 2))"""
_NO_SPLIT = "split AS (SELECT query_id FROM ranked WHERE FALSE)"


def _redaction_sql() -> str:
    """The detectors one after the other, and tokens of high entropy. RE2 has no look-around, so digits beside a phone number
    are taken along and put back; texts in which two detectors' matches overlap need the exact rule, which the tests compare."""
    out = "coalesce(text, '')"
    for name, pattern, _ in redaction.DETECTORS:
        to, by = pattern.replace("'", "''"), f"[REDACTED:{name.upper()}]"
        if name == "phone":
            to, by = "(^|[^0-9])" + pattern.split(")", 1)[1].rsplit("(?!", 1)[0] + "([^0-9]|$)", f"\\1{by}\\3"
            to = to.replace("(?:[-\\s]?\\d){8}", "((?:[-\\s]?\\d){8})")
        out = f"regexp_replace({out}, '{to}', '{by}', 'g')"
    bits = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -(len(string_split(t, c)) - 1) / length(t) * log2((len(string_split(t, c)) - 1) / length(t))))"
    token = redaction.ENTROPY_TOKEN.replace("'", "''")
    secret = f"list_filter(list_distinct(regexp_extract_all(x, '{token}')), lambda t: length(t) >= {redaction.ENTROPY_LENGTH} AND NOT contains(t, 'REDACTED') AND NOT regexp_matches(t, '[\\x{{3000}}-\\x{{303F}}\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{FF00}}-\\x{{FFEF}}]') AND {bits} >= {redaction.ENTROPY_BITS})"
    label = {2: [], 1: []}
    for name, _, taint_ in redaction.DETECTORS:
        label[2 if taint_ == "SENSITIVE" else 1].append(f"contains(y, '[REDACTED:{name.upper()}]')")
    label[2].append("contains(y, '[REDACTED:HIGH_ENTROPY]')")
    return f"""WITH a AS (SELECT doc_id, {out} AS x FROM documents), b AS (SELECT doc_id, list_reduce(list_prepend(x, {secret}), lambda acc, t: replace(acc, t, '[REDACTED:HIGH_ENTROPY]')) AS y FROM a)
        SELECT doc_id, (len(string_split(y, '[REDACTED:')) - 1)::BIGINT AS n_hits, CASE WHEN {' OR '.join(label[2])} THEN 'SENSITIVE' WHEN {' OR '.join(label[1])} THEN 'INTERNAL' ELSE 'CLEAN' END AS max_taint, sha256(y) AS text_sha FROM b"""


def _verdict_sql(q: str, ku: str = _KU, split: str = _NO_SPLIT) -> str:
    """CTEs up to r: query_id, n, refs, fused, reason."""
    marked = " OR ".join(f"contains(lower(query), '{m}')" for m in COMMITMENT_MARKERS)
    return f"""{ku}, {q}, {_BM25}, {_RANKED}, {split},
        v AS (SELECT query_id, count(*) AS n, string_agg('doc:' || doc_id, ',' ORDER BY rank) AS refs, arg_min(fused, rank) AS fused, arg_min(relevance, rank) AS rel, arg_min(lex, rank) AS lex, arg_min(freshness, rank) AS f, bool_or(freshness = 'FRESH') AS fresh FROM ranked GROUP BY query_id),
        r AS (SELECT query_id, n, refs, fused, CASE WHEN {marked} THEN 'commitment_marker' WHEN n IS NULL THEN 'no_hit' WHEN f = 'STALE' AND NOT fresh THEN 'best_stale_no_fresh' WHEN query_id IN (FROM split) THEN 'contradiction' WHEN rel < 0.35 AND lex < 0.15 THEN 'low_relevance' ELSE 'ok' END AS reason FROM q LEFT JOIN v USING (query_id))"""


ORACLE_SQL = {
    "flagship": f"WITH {_verdict_sql(_Q, _CHAT_KU, _SPLIT)} SELECT query_id, CASE WHEN reason = 'ok' THEN 'ANSWERABLE' ELSE 'ABSTAIN' END AS decision, reason, CASE WHEN reason IN ('commitment_marker', 'no_hit') THEN 0.0 ELSE round(fused, 6) END::DOUBLE AS confidence, coalesce(n, 0) AS n_citations FROM r",
    "redaction_hits": _redaction_sql(),
    "tokenize_stats": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t[1:3], ' ') AS head FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "match_expressions": f"WITH {_Q}, e AS (SELECT query_id, query, pos, t FROM (SELECT query_id, query, unnest({_tok('query')}) AS t, generate_subscripts({_tok('query')}, 1) AS pos FROM q)), f AS (SELECT query_id, query, t, min(pos) AS pos FROM e GROUP BY ALL) SELECT query_id, string_agg('\"' || t || '\"', ' OR ' ORDER BY pos) AS expression, " + " OR ".join(f"contains(lower(any_value(query)), '{m}')" for m in COMMITMENT_MARKERS) + " AS marked FROM f GROUP BY query_id",
    "term_statistics": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "bm25_topk": f"WITH {_KU}, {_Q}, {_BM25} SELECT query_id, ku_id, lex_rank, round(relevance, 6) AS relevance FROM rel",
    "jaccard_topk": f"""WITH {_KU}, {_Q}, u AS (SELECT ku_id, list_distinct({_tok("title || '  ' || body")}) AS t FROM ku), x AS (SELECT query_id, list_distinct({_tok('query')}) AS t FROM q),
        j AS (SELECT query_id, ku_id, round(len(list_intersect(x.t, u.t))::DOUBLE / len(list_distinct(list_concat(x.t, u.t))), 9) AS relevance FROM x, u WHERE list_has_any(x.t, u.t))
        SELECT query_id, ku_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, ku_id) AS rank, relevance FROM j QUALIFY rank <= 20""",
    "ranked_evidence": f"WITH {_KU}, {_Q}, {_BM25}, {_RANKED} SELECT query_id, rank, ku_id, round(fused, 6) AS fused, round(lex, 6) AS lexical_overlap FROM ranked",
    "verdicts": f"WITH {_verdict_sql(_Q)} SELECT query_id, CASE WHEN reason = 'ok' THEN 'ANSWERABLE' ELSE 'ABSTAIN' END AS decision, reason, CASE WHEN reason IN ('commitment_marker', 'no_hit') THEN 0.0 ELSE round(fused, 6) END AS confidence, coalesce(n, 0) AS n_citations, coalesce(refs, '') AS refs FROM r",
    "draft_previews": f"WITH {_verdict_sql(_Q)}, t AS (SELECT query_id, {_DRAFT} AS draft FROM ranked WHERE coalesce(body, '') <> '' GROUP BY query_id) SELECT query_id, coalesce(reason = 'ok' AND draft <> '', FALSE) AS would_answer, CASE WHEN reason = 'ok' AND draft <> '' THEN sha256(draft) ELSE '' END AS draft_sha, CASE WHEN reason <> 'ok' THEN reason WHEN coalesce(draft, '') = '' THEN 'low_coverage' ELSE '' END AS abstain_reason FROM r LEFT JOIN t USING (query_id)",
    "acceptance_measures": f"WITH {_verdict_sql(_SELF_Q)}, t AS (SELECT query_id, {_DRAFT} AS draft FROM ranked WHERE coalesce(body, '') <> '' GROUP BY query_id), h AS (SELECT r.query_id, EXISTS (FROM ranked k WHERE k.query_id = r.query_id AND k.ku_id = r.query_id) AS hit, reason = 'ok' AND coalesce(draft, '') <> '' AS ok FROM r LEFT JOIN t ON t.query_id = r.query_id) SELECT 'DOC' AS stratum, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND ok) AS answered FROM h",
    "triage_packages": f"WITH {_verdict_sql(_CHAT_Q)} SELECT query_id AS msg_id, CASE WHEN reason = 'ok' THEN 'ANSWERABLE' ELSE 'ABSTAIN' END AS decision, reason, coalesce(n, 0) AS n_citations, CASE WHEN reason = 'ok' THEN n ELSE 0 END AS n_kus FROM r",
    "contradiction_groups": f"""WITH {_KU}, g AS (SELECT array_to_string(list_sort(list_distinct({_tok('title')})), '|') AS f, sha256(regexp_replace({_STRIP.format('body')}, '\\s+', ' ', 'g')) AS h FROM ku)
        SELECT sha256(f) AS fingerprint, count(*) AS n, count(DISTINCT h) AS n_answers FROM g WHERE f <> '' GROUP BY f HAVING count(DISTINCT h) >= 2""",
    "qa_pairs": f"WITH {_PAIRS} SELECT thread_id, q_pos, a_pos, question, answer FROM p",
    "qa_unit_ids": f"WITH {_PAIRS} SELECT 'KU-' || substr(sha1('QA|' || q_msg || '||'), 1, 16) AS ku_id, substr({_STRIP.format('question')}, 1, 120) AS title, sha256('Q: ' || {_STRIP.format('question')} || chr(10) || 'A: ' || {_STRIP.format('answer')}) AS body_sha, 'INTERNAL' AS declared_taint FROM p",
    "validation_report": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'bad_source_type' WHEN doc_id % 7 = 0 OR trim(substr(coalesce(text, ''), 1, 20), E' \\n\\t\\r') = '' THEN 'empty_title' WHEN doc_id % 11 = 0 OR trim(coalesce(text, ''), E' \\n\\t\\r') = '' THEN 'empty_body' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'no_provenance' ELSE 'ok' END AS drop_reason, count(*) AS n FROM documents GROUP BY 1",
    "entropy_tokens": r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r"''<>(){}\[\],;]+')) AS token FROM documents), u AS (SELECT token, unnest(string_split(token, '')) AS ch FROM t WHERE length(token) >= 20), c AS (SELECT token, ch, count(*) AS n FROM u GROUP BY ALL)
        SELECT token, round(sum(-(n / length(token)) * log2(n / length(token))), 6) AS bits FROM c GROUP BY token""",
    "taint_fold": "WITH x AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 2 WHEN contains(coalesce(text, ''), '@') THEN 1 ELSE 0 END AS f FROM documents d LEFT JOIN labels USING (doc_id)) SELECT doc_id, ['CLEAN', 'INTERNAL', 'SENSITIVE'][greatest(f, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) + 1] AS taint, ['CLEAN', 'INTERNAL', 'SENSITIVE'][greatest(f, CASE doc_id % 3 WHEN 1 THEN 1 ELSE 2 END) + 1] AS raw FROM x",
    "unit_inventory": f"WITH {_KU} SELECT 'total' AS kind, '' AS value, count(*) AS n FROM ku UNION ALL SELECT 'source_type', 'PLAYBOOK', count(*) FROM ku UNION ALL SELECT 'authority', authority, count(*) FROM ku GROUP BY 2 UNION ALL SELECT 'freshness', freshness, count(*) FROM ku GROUP BY 2 UNION ALL SELECT 'serve_blocked', '', count(*) FROM ku WHERE freshness = 'EXPIRED' OR authority = 'DRAFT'",
    "upsert_last_wins": "WITH o AS (SELECT user_id, max(event_id) AS e, arg_max(event_type, event_id) AS s, arg_min(ts, event_id) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(event_id) AS e, arg_max(event_type, event_id) AS s, arg_min(ts, event_id) AS c FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(b.user_id, o.user_id) AS ku_id, coalesce(b.e, o.e) AS event_id, coalesce(b.s, o.s) AS state, strftime(coalesce(o.c, b.c), '%Y-%m-%d %H:%M:%S') AS created_at FROM o FULL JOIN b ON o.user_id = b.user_id",
    "derived_stale": "SELECT DISTINCT 'O' || l_orderkey AS ku_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 2 AND l_linenumber % 3 <> 0",
    "authority_transitions": "WITH e AS (SELECT event_id, event_id % 4 AS c, (event_id // 4) % 4 AS t, user_id % 3 > 0 AS has FROM events) SELECT event_id, CASE WHEN c = t THEN '' WHEN NOT ((c = 0 AND t IN (1, 3)) OR (c = 1 AND t IN (2, 3, 0)) OR (c = 2 AND t IN (1, 3)) OR (c = 3 AND t = 1)) THEN 'illegal_transition' WHEN NOT has AND t <> 0 THEN 'no_provenance' ELSE '' END AS error FROM e",
    "freshness_verify": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 5 <> 0) THEN 'UNKNOWN' WHEN doc_id % 5 = 0 THEN 'EXPIRED' WHEN doc_id % 3 = 0 THEN 'STALE' ELSE 'FRESH' END AS freshness FROM documents",
    "policy_gate": f"""WITH rules AS ({_rules_sql()}), i AS (SELECT event_id, argv, {_NORM} AS n FROM {_INTENT}),
        h AS (SELECT event_id, arg_max(kind, o) AS kind, arg_max(prefix, o) AS prefix, arg_max(rules.level, o) AS lv FROM i JOIN rules ON array_to_string(n[1:len(string_split(prefix, ' '))], ' ') = prefix GROUP BY event_id),
        x AS (SELECT i.event_id AS action_id, argv[1] = 'cli' AS valid, n, coalesce(kind = 'never', FALSE) AS nv, coalesce(prefix, '') AS prefix, CASE WHEN kind = 'never' THEN '' ELSE coalesce(lv, 'R2') END AS lv FROM i LEFT JOIN h USING (event_id)),
        y AS (SELECT *, CASE WHEN NOT valid OR nv THEN 'DENY' WHEN lv = 'R0' AND NOT (action_id % 3 = 0 OR action_id % 7 = 0) THEN 'AUTO' ELSE 'HUMAN_CONFIRM' END AS decision FROM x)
        SELECT action_id, CASE WHEN valid THEN lv ELSE 'R2' END AS level, decision, valid AND nv AS never, decision = 'HUMAN_CONFIRM' AS requires_confirm, valid AND NOT nv AND lv = 'R3' AS human_only, prefix, CASE WHEN valid THEN sha256(array_to_string(n, chr(10))) ELSE '' END AS argv_sha FROM y""",
    "inbox_errors": "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'action_id' END, CASE WHEN event_id % 4 = 0 THEN 'created_at' END, CASE WHEN event_id % 9 = 0 THEN 'source' END, CASE event_id % 5 WHEN 0 THEN 'argv_missing' WHEN 1 THEN 'argv_head' END, CASE WHEN event_id % 2 = 0 AND event_id % 6 = 0 THEN 'commit_class' END, CASE WHEN event_id % 10 = 0 THEN 'taint' END) AS errors FROM events",
    "confirm_outcomes": "SELECT event_id AS action_id, CASE event_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'used' WHEN 2 THEN 'expired' WHEN 3 THEN 'hash_mismatch' WHEN 4 THEN 'hmac_mismatch' ELSE 'ok' END AS reason, event_id % 6 = 5 AS ok FROM events",
    "patrol_new": "SELECT o_orderkey AS number, 'order ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '无' END AS line, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "log_context": "WITH e AS (SELECT event_type AS pod, event_id AS ln, regexp_matches(props, '\"k\": ?1') AS is_match FROM events) SELECT pod, ln, is_match FROM e QUALIFY max(is_match::INT) OVER (PARTITION BY pod ORDER BY ln ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1",
    "log_tail": "SELECT event_type AS pod, event_id AS ln, props AS line FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 25",
    "audit_sequence": "WITH e AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, event_type || '-' || lpad(event_id::VARCHAR, 9, '0') AS event, user_id % 10 AS pid FROM events) SELECT ts, event, pid, row_number() OVER (PARTITION BY pid ORDER BY ts, event) AS seq FROM e",
    "impact_by_source": "SELECT * FROM (SELECT source AS repo, count(*) FILTER (regexp_matches(text, '([Ll]icense)|(token)')) AS impl_files, count(*) FILTER (regexp_matches(text, '(@)|(http)')) AS consumer_files FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) WHERE impl_files + consumer_files > 0",
    "admissions": "SELECT CASE WHEN reason = 'group_allowed' THEN 'signal' ELSE 'drop' END AS kind, reason, count(*) AS n FROM (SELECT CASE WHEN conv_id % 4 = 0 THEN 'non_group_conversation_type:''single''' WHEN conv_id % 5 = 0 THEN 'missing_conversation_id' WHEN conv_id % 3 <> 0 THEN 'group_not_in_allowed_groups' ELSE 'group_allowed' END AS reason FROM conversations) GROUP BY ALL",
    "probe_verdicts": "SELECT user_id::VARCHAR AS host, CASE WHEN bool_or(user_id % 3 = 1 AND event_id % 50 = 0) THEN 'reachable' WHEN user_id % 3 <> 2 AND user_id % 2 = 0 THEN 'gateway_route_missing' ELSE 'unreachable' END AS verdict FROM events GROUP BY user_id",
    "encryption_roundtrip": "SELECT doc_id, sha256(text) AS body_sha FROM documents",
    "numbered_references": "SELECT doc_id AS pos, CASE WHEN doc_id % 4 > 0 THEN source || '#k' || (row_number() OVER (ORDER BY source, doc_id) - 1) ELSE '' END AS ref FROM documents",
    "command_hashes": f"SELECT event_id AS action_id, sha256(array_to_string({_NORM}, chr(10))) AS argv_sha FROM {_INTENT}",
}

QUERIES |= records.QUERIES
ORACLE_SQL |= records.ORACLE_SQL
