"""Validation and admission: rows keep a reason instead of being silently lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import AUTHORITIES, FRESHNESS, PROVENANCE_KINDS, SOURCE_TYPES, TAINTS
from ..functions.text import blank


def usable_provenance(provenance: Column) -> Column:
    """Entries of a known kind (any case) with a reference that isn't blank; empty for null."""
    good = lambda p: F.upper(p["kind"]).isin(*PROVENANCE_KINDS) & ~blank(p["ref"])
    return F.coalesce(F.filter(provenance, lambda p: F.coalesce(good(p), F.lit(False))), F.filter(provenance, lambda p: F.lit(False)))


def drop_reason(df: DataFrame) -> DataFrame:
    """Adds ``drop_reason``: the first rule that a candidate fails, or 'ok'."""
    reason = (
        F.when(~F.coalesce(F.upper("source_type"), F.lit("")).isin(*SOURCE_TYPES), "bad_source_type")
        .when(blank("title"), "empty_title")
        .when(blank("body"), "empty_body")
        .when(F.coalesce(F.size(usable_provenance(F.col("provenance"))), F.lit(0)) <= 0, "no_provenance")
        .otherwise("ok")
    )
    return df.withColumn("drop_reason", reason)


def drop_report(df: DataFrame) -> DataFrame:
    """drop_reason, n of a DataFrame with ``drop_reason``."""
    return df.groupBy("drop_reason").agg(F.count("*").alias("n"))


def strict_errors(df: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule of the strict, case-sensitive form that a candidate fails, or null."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    code = F.col("source_type") == "CODE"
    kinds = F.exists(F.coalesce("provenance", F.array().cast(df.schema["provenance"].dataType)), lambda p: ~F.coalesce(p["kind"], F.lit("")).isin(*PROVENANCE_KINDS))
    error = (
        F.when(~F.coalesce("source_type", F.lit("")).isin(*SOURCE_TYPES), "source_type")
        .when(blank("title"), "title")
        .when(blank("body"), "body")
        .when(kinds, "provenance.kind")
        .when(code & (empty("repo") | empty("file_path") | empty("symbol")), "code_fields")
        .when(F.col("line_range").isNotNull() & (F.size("line_range") != 2), "line_range")
        .when(F.col("freshness").isNotNull() & ~F.col("freshness").isin(*FRESHNESS), "freshness")
        .when(F.col("declared_taint").isNotNull() & ~F.col("declared_taint").isin(*TAINTS), "declared_taint")
    )
    return df.withColumn("error", error)


def admit_messages(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``reason``: only group messages of allowed conversations are signals; all else is dropped.

    ``allowed``: conversation_id. The list is joined, so it may be of any size.
    """
    ok = allowed.select(F.col("conversation_id").alias("conversationId"), F.lit(True).alias("__ok")).distinct()
    reason = (
        F.when(~F.coalesce(F.col("conversationType") == "group", F.lit(False)), F.concat(F.lit("non_group_conversation_type:"), F.coalesce(F.concat(F.lit("'"), "conversationType", F.lit("'")), F.lit("None"))))
        .when(F.coalesce("conversationId", F.lit("")) == "", "missing_conversation_id")
        .when(F.col("__ok").isNull(), "group_not_in_allowed_groups")
        .otherwise("group_allowed")
    )
    joined = df.join(ok, "conversationId", "left").withColumn("reason", reason).drop("__ok")
    return joined.withColumn("kind", F.when(F.col("reason") == "group_allowed", "signal").otherwise("drop"))


def message_text(df: DataFrame) -> Column:
    """Text of a message: text.content, or text itself, or content; empty if none is a string."""
    kind = df.schema["text"].dataType.simpleString() if "text" in df.columns else ""
    first = F.col("text.content") if kind.startswith("struct") else F.col("text") if kind else F.lit(None)
    return F.coalesce(first, F.col("content") if "content" in df.columns else F.lit(None), F.lit(""))


def message_refs(df: DataFrame) -> Column:
    """Reference ids: refs, else references; a single one as a list; nulls removed."""
    source = next((c for c in ("refs", "references") if c in df.columns), None)
    empty = F.array().cast("array<string>")
    if source is None:
        return empty
    if df.schema[source].dataType.simpleString().startswith("array"):
        return F.coalesce(F.filter(F.col(source).cast("array<string>"), lambda x: x.isNotNull()), empty)
    return F.when(F.col(source).isNull(), empty).otherwise(F.array(F.col(source).cast("string")))


#: Forms and labels that an action intent must have.
ACTION_ID = r"^AI-\d{8}-[0-9a-fA-F]{8}$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
INTENT_SOURCES = ("cli", "test", "triage", "work")
COMMIT_CLASSES = ("none", "maybe", "yes")


def intent_errors(df: DataFrame, binary: str) -> DataFrame:
    """Adds ``errors``: every rule that an intent breaks, in a fixed order; empty for a valid one."""
    argv, labels = F.col("argv"), F.col("semantic_labels")
    unless = lambda good, name: F.when(~F.coalesce(good, F.lit(False)), F.lit(name))
    no_argv = argv.isNull() | (F.size(argv) == 0)
    checks = [
        unless(F.col("action_id").rlike(ACTION_ID), "action_id"),
        unless(F.col("created_at").rlike(RFC3339), "created_at"),
        unless(F.col("source").isin(*INTENT_SOURCES), "source"),
        F.when(no_argv, F.lit("argv_missing")).when(F.exists(argv, lambda t: t.isNull()), F.lit("argv_not_strings")).when(F.get(argv, F.lit(0)) != binary, F.lit("argv_head")),
        F.when(labels.isNotNull() & ~F.coalesce(labels["commit_class"], F.lit("maybe")).isin(*COMMIT_CLASSES), F.lit("commit_class")),
        F.when(labels.isNotNull() & ~F.coalesce(labels["taint"], F.lit("INTERNAL")).isin(*TAINTS), F.lit("taint")),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def known_authority(label: Column) -> Column:
    return label.isin(*AUTHORITIES)


def resolve_by_name(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(query) -> query, id, error: an exact id wins, else the only row with that name in any case, else an error."""
    exact = wanted.join(df.select(F.col("id").alias("query"), F.col("id")).distinct(), "query", "left")
    named = df.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n"), F.min("id").alias("named"))
    both = exact.withColumn("low", F.lower("query")).join(named, "low", "left")
    found = F.coalesce("id", F.when(F.col("n") == 1, F.col("named")))
    error = F.when(found.isNotNull(), F.lit(None).cast("string")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("not_found"))
    return both.select("query", found.alias("id"), error.alias("error"))
