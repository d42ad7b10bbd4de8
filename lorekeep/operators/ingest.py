"""From candidates to knowledge units, and pairing of chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..enums import FRESHNESS
from ..functions import redaction, taint
from ..functions.text import blank, strip, unit_id
from .validate import drop_reason, drop_report, usable_provenance


def serve_blocked(provenance: Column, freshness: Column, authority: Column, evidence_broken: Column) -> Column:
    """A unit can't serve without provenance, when expired, as a draft, or when its evidence is broken."""
    broken = F.exists(provenance, lambda p: ~F.coalesce(p["retrievable"], F.lit(True)))
    return F.coalesce(F.size(provenance), F.lit(0)).__le__(0) | (freshness == "EXPIRED") | (authority == "DRAFT") | evidence_broken | F.coalesce(broken, F.lit(False))


def build_units(candidates: DataFrame, now: str, default_taint: str = "INTERNAL") -> DataFrame:
    """Valid candidates -> units: redacted, labelled by the strictest of declared, found and quoted, always a DRAFT.

    ``now`` is the clock (RFC 3339 text). Structural columns stay for CODE only; titles, kinds and refs aren't redacted.
    Adds ``redaction_fired`` and keeps ``linked_symbols`` for edges. Candidates that redaction fails on give no unit
    (``ingest_once`` reports them).
    """
    return _built(candidates, now, default_taint).where("build_error IS NULL").drop("build_error")


def _built(candidates: DataFrame, now: str, default_taint: str, *more: str) -> DataFrame:
    """The units with ``build_error``, and the candidates' columns ``more``."""
    code = F.col("st") == "CODE"
    only = lambda c: F.when(code, F.col(c))
    df = candidates.withColumn("st", F.upper("source_type")).withColumn("usable", usable_provenance(F.col("provenance")))
    # quotes are redacted in their place, so a reference can't come to lie with another unit
    df = df.withColumn("rb", redaction.redact(F.col("body"), code)).withColumn("rq", redaction.redact_each(F.transform("usable", lambda p: p["quote"]), code))

    def entry(p: Column, i: Column) -> Column:
        red = F.get("rq", i)
        return F.struct(
            F.upper(p["kind"]).alias("kind"), p["ref"].alias("ref"), red["text"].alias("quote"),
            taint.strictest(taint.coerce(p["quote_taint"]), red["max_taint"]).alias("quote_taint"), F.coalesce(p["captured_at"], F.lit(now)).alias("captured_at"), F.lit(True).alias("retrievable"),
        )

    prov = F.transform("usable", entry)
    df = df.withColumn("prov", F.when(F.size("usable") > 0, prov)).withColumn("quote_fired", F.exists("rq", lambda r: r["fired"]))
    prov = F.col("prov")
    labels = F.concat(F.array(taint.coerce(F.col("declared_taint"), default_taint), F.col("rb.max_taint")), F.transform("prov", lambda p: p["quote_taint"]))
    fresh = F.when(code & F.upper("freshness").isin(*FRESHNESS), F.upper("freshness")).otherwise("UNKNOWN")
    none = F.lit(None).cast("string")
    return df.select(
        unit_id(F.col("st"), F.get("prov", F.lit(0))["ref"], only("symbol"), only("content_hash")).alias("ku_id"),
        F.col("st").alias("source_type"), F.substring("title", 1, 200).alias("title"), F.col("rb.text").alias("body"), F.lit(True).alias("body_redacted"),
        taint.strictest_of(labels).alias("taint"), F.lit("DRAFT").alias("authority"), F.lit(False).alias("public_ok"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        fresh.alias("freshness"), prov.alias("provenance"), only("repo").alias("repo"), only("commit_sha").alias("commit_sha"), only("file_path").alias("file_path"), only("symbol").alias("symbol"),
        F.when(code & (F.size("line_range") == 2), F.struct(F.get("line_range", F.lit(0)).alias("start"), F.get("line_range", F.lit(1)).alias("end"))).alias("line_range"),
        only("content_hash").alias("content_hash"), "owner", F.lit(True).alias("serve_blocked"), F.lit(False).alias("derived_stale"),
        none.alias("expires_at"), none.alias("superseded_by"), none.alias("last_verified_at"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
        ((F.size("rb.hits") > 0) | F.coalesce("quote_fired", F.lit(False))).alias("redaction_fired"), "linked_symbols",
        F.coalesce(F.col("rb.error"), F.get(F.array_compact(F.transform("rq", lambda r: r["error"])), F.lit(0))).alias("build_error"), *more,
    )


def ingest(candidates: DataFrame, now: str, default_taint: str = "INTERNAL") -> tuple[DataFrame, DataFrame]:
    """(units of the valid candidates, report of all: drop_reason, n)."""
    tagged = drop_reason(candidates)
    return build_units(tagged.where("drop_reason = 'ok'"), now, default_taint), drop_report(tagged)


#: What an ingestion counts, in the order of the checks.
REASONS = ("bad_source_type", "empty_title", "empty_body", "no_provenance", "build_error", "ok")


def ingest_once(candidates: DataFrame, now: str, default_taint: str = "INTERNAL") -> tuple[DataFrame, Observation]:
    """(rows, counts): every candidate in one pass over the source, with ``drop_reason`` and ``drop_note`` behind the units' columns.

    Rows whose reason is 'ok' are units; the others have a null ku_id and the title's first 120 characters. A candidate on which
    redaction fails is a build_error, noted with the error's name, and the rest of its batch goes on. ``counts.get`` has n of
    each of REASONS and ``redacted``, once an action has run over the rows (a write, say); rows of which only a part is asked
    for are counted in part.
    """
    tagged = drop_reason(candidates.withColumn("__title", F.col("title")))
    ok = F.col("drop_reason") == "ok"
    # what is dropped brings no text to the Python workers
    fed = tagged.withColumn("body", F.when(ok, F.col("body"))).withColumn("provenance", F.when(ok, F.col("provenance")))
    built = _built(fed, now, default_taint, "drop_reason", "__title")
    reason = F.when(F.col("drop_reason") != "ok", F.col("drop_reason")).when(F.col("build_error").isNotNull(), "build_error").otherwise("ok")
    rows = built.withColumn("drop_reason", reason).withColumn("drop_note", F.col("build_error"))
    good = F.col("drop_reason") == "ok"
    keep = [c for c in rows.columns if c not in ("build_error", "__title", "drop_reason", "drop_note")]
    rows = rows.select(*[F.when(good, F.col(c)).otherwise(F.substring("__title", 1, 120) if c == "title" else F.lit(None)).alias(c) for c in keep], "drop_reason", "drop_note")
    counts = Observation()
    return rows.observe(counts, *[F.count_if(F.col("drop_reason") == r).alias(r) for r in REASONS], F.count_if(F.col("redaction_fired")).alias("redacted")), counts


def ingest_report(counts: dict) -> list[tuple[str, int]]:
    """(drop_reason, n) of what has been counted, without zeros."""
    return [(r, counts[r]) for r in REASONS if counts[r]]


def linked_edges(units: DataFrame, code: DataFrame) -> DataFrame:
    """Edges from issues and questions to the code units that their linked symbols name."""
    links = units.where("source_type IN ('ISSUE','QA')").select("ku_id", "source_type", F.explode("linked_symbols").alias("l"))
    wanted = links.select(F.col("ku_id").alias("src_ku"), F.concat("source_type", F.lit("_CODE")).alias("rel"), "l.repo", "l.file_path", "l.symbol")
    found = code.where("source_type = 'CODE'").select(F.col("ku_id").alias("dst_ku"), "repo", "file_path", "symbol")
    return wanted.join(found, ["repo", "file_path", "symbol"]).select("src_ku", "dst_ku", "rel").distinct()


def pair_questions(messages: DataFrame, me: str) -> DataFrame:
    """Question-answer pairs of threads (thread_id, pos, author, text, msg_id, taint).

    Blank messages don't count. A message of ``me`` answers the last message before it if exactly one other author wrote
    since the last message of ``me``; each message of ``me`` starts anew. Two windows over a thread; no driver loop.
    """
    text = messages.where(~blank("text")).withColumn("mine", F.coalesce(F.col("author") == me, F.lit(False)))
    before = W.partitionBy("thread_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    turn = text.withColumn("turn", F.coalesce(F.sum(F.col("mine").cast("int")).over(before), F.lit(0)))
    asked = F.when(~F.col("mine"), F.struct("pos", "author", "text", "msg_id", "taint"))
    group = turn.groupBy("thread_id", "turn").agg(
        F.max_by(asked, F.when(~F.col("mine"), F.col("pos"))).alias("q"),
        F.min(F.when(~F.col("mine"), F.coalesce("author", F.lit("")))).alias("lo"),
        F.max(F.when(~F.col("mine"), F.coalesce("author", F.lit("")))).alias("hi"),
        F.max_by(F.struct("pos", "text", "msg_id", "taint"), F.when(F.col("mine"), F.col("pos"))).alias("a"),
    )
    good = group.where("q IS NOT NULL AND a IS NOT NULL AND a.text IS NOT NULL AND lo = hi")
    return good.select("thread_id", F.col("q.pos").alias("q_pos"), F.col("a.pos").alias("a_pos"), F.col("q.text").alias("question"), F.col("a.text").alias("answer"), F.col("q.msg_id").alias("q_msg"), F.col("a.msg_id").alias("a_msg"), F.col("q.taint").alias("q_taint"), F.col("a.taint").alias("a_taint"))


def pairs_to_candidates(pairs: DataFrame) -> DataFrame:
    """QA candidates with provenance of the question, then the answer, where they have message ids."""
    point = lambda c: F.when(~blank(c), F.struct(F.lit("MSG_ID").alias("kind"), F.col(c).alias("ref"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("string").alias("quote_taint"), F.lit(None).cast("string").alias("captured_at")))
    q, a = strip("question"), strip("answer")
    label = taint.strictest(F.coalesce("q_taint", F.lit("CLEAN")), F.coalesce("a_taint", F.lit("CLEAN")), F.lit("INTERNAL"))
    return pairs.select(F.lit("QA").alias("source_type"), F.substring(q, 1, 120).alias("title"), F.concat(F.lit("Q: "), q, F.lit("\nA: "), a).alias("body"), label.alias("declared_taint"), F.array_compact(F.array(point("q_msg"), point("a_msg"))).alias("provenance"))


def to_signals(messages: DataFrame, allowed: DataFrame, redactor=redaction.redact) -> DataFrame:
    """Admitted group messages as signals: redacted text, at least INTERNAL."""
    from .validate import admit_messages, message_refs, message_text

    kept = admit_messages(messages, allowed).where("kind = 'signal'")
    sender = [c for c in ("senderId", "senderStaffId") if c in messages.columns]
    out = kept.withColumn("raw", message_text(kept)).withColumn("ids", message_refs(kept)).withColumn("r", redactor(F.col("raw"), F.lit(False)))
    who = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in sender], F.lit("")) if sender else F.lit("")
    return out.select(F.col("conversationId").alias("conversation_id"), who.alias("sender_id"), F.col("raw").alias("text"), taint.strictest(F.lit("INTERNAL"), F.col("r.max_taint")).alias("taint"), F.col("r.text").alias("redacted_text"), F.col("ids").alias("refs"))


def unique_references(candidates: DataFrame, order: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """Adds #k<i> to each candidate's first reference; i counts all candidates over the files in order.

    Files are numbered by counts per file, so only the file list, not the rows, is ordered in one place.
    """
    file, pos = order
    per = candidates.groupBy(file).agg(F.count("*").alias("n"))
    base = per.select(file, (F.sum("n").over(W.orderBy(file)) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy(file).orderBy(pos)) - 1
    numbered = candidates.withColumn("at", rank).join(base, file)
    ref = F.concat(F.coalesce(F.col("first")["ref"], F.lit("")), F.lit("#k"), (F.col("before") + F.col("at")).cast("string"))
    out = numbered.withColumn("first", F.get("provenance", F.lit(0)))
    fixed = F.concat(F.array(F.col("first").withField("ref", ref)), F.slice("provenance", F.lit(2), F.greatest(F.size("provenance"), F.lit(1))))
    return out.withColumn("provenance", F.when(F.size("provenance") > 0, fixed).otherwise(F.col("provenance"))).drop("at", "before", "first")


