"""Ranking of evidence, gates, and the decision whether a query may be answered. All for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..enums import ANSWER_PREFIX, AUTHORITY_DEFAULT, AUTHORITY_SCORE, COMMITMENT_MARKERS, FRESH_DEFAULT, FRESH_SCORE, settings
from ..functions.taint import external_safe
from ..functions.text import answer_hash, coverage, has_marker, question_fingerprint, share_found, strip, token_set, tokens
from ..sources.shared import cut
from .index import bm25, jaccard_hits, query_terms, small, unit_text
from .segments import Index, bm25_best, passing_index


def lookup(label: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def fused(s: dict, freshness: Column, authority: Column, relevance: Column) -> Column:
    return s["w_fresh"] * lookup(freshness, FRESH_SCORE, FRESH_DEFAULT) + s["w_auth"] * lookup(authority, AUTHORITY_SCORE, AUTHORITY_DEFAULT) + s["w_rel"] * relevance


def minmax(value: Column, *keys: str) -> Column:
    """Scaled to 0..1 within the keys; 1 if all are (nearly) equal."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    close = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return F.when(close, 1.0).otherwise((value - lo) / (hi - lo))


def symbol_hits(units: DataFrame, queries: DataFrame, repos: list[str] | None = None) -> DataFrame:
    """query_id, ku_id: a query token is the symbol (any case) or one of its tokens. Equi-join on exploded tokens."""
    code = units.where("source_type = 'CODE' AND coalesce(symbol, '') <> ''")
    code = code.where(F.col("repo").isin(*repos)) if repos else code
    names = code.select("ku_id", F.explode(F.array_distinct(F.concat(F.array(F.lower("symbol")), tokens("symbol")))).alias("term"))
    return query_terms(queries).join(names, "term").select("query_id", "ku_id").distinct()


def symbol_search(units: DataFrame, symbol: str, repo: str | None = None, file_path: str | None = None) -> DataFrame:
    """Distinct units with exactly this symbol."""
    out = units.where((F.col("source_type") == "CODE") & (F.col("symbol") == symbol))
    for c, v in (("repo", repo), ("file_path", file_path)):
        out = out.where(F.col(c) == v) if v else out
    return out.select("ku_id", "repo", "file_path", "symbol").distinct()


def lexical_hits(units: DataFrame, queries: DataFrame, top_n: int, scorer: str = "bm25", index: Index | DataFrame | None = None) -> DataFrame:
    """query_id, ku_id, relevance, lex_rank.

    bm25: the best max(4 top_n, 20) by score (ties by ku_id), scaled by min-max; the window's limit is applied per task
    before the shuffle. jaccard: every unit with a shared term. ``index``: a stored index, of segments or a table of
    ``lexical_index``; without one, the units' terms are made once and kept in the shared folder while the ranking reads them.
    Parts of the ranking run while this is called.
    """
    if scorer == "jaccard":
        return jaccard_hits(units, queries).withColumn("lex_rank", F.lit(0))
    if not isinstance(index, DataFrame):
        top = bm25_best(index or passing_index(units), queries, max(4 * top_n, 20))
        return top.select("query_id", "ku_id", minmax(-F.col("score"), "query_id").alias("relevance"), "lex_rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "ku_id"))
    few = small(query_terms(queries))
    top = bm25(index, queries, few).withColumn("lex_rank", rank).where(F.col("lex_rank") <= max(4 * top_n, 20))
    return top.select("query_id", "ku_id", minmax(-F.col("score"), "query_id").alias("relevance"), "lex_rank")


def passes_gates(external: bool = False) -> Column:
    ok = ~F.col("serve_blocked") & (F.col("freshness") != "EXPIRED") & (F.col("authority") != "DEPRECATED")
    return ok & external_safe(F.col("taint")) if external else ok


def evidence_broken() -> Column:
    """Flagged, without provenance, or with a first reference that can't be fetched."""
    first = F.get("provenance", F.lit(0))["retrievable"]
    return F.coalesce("evidence_broken", F.lit(False)) | (F.coalesce(F.size("provenance"), F.lit(0)) <= 0) | ~F.coalesce(first, F.lit(True))


def retrieve(units: DataFrame, queries: DataFrame, s: dict | None = None, external: bool = False, repos: list[str] | None = None, scorer: str = "bm25", snapshot: DataFrame | None = None, index: Index | DataFrame | None = None) -> DataFrame:
    """Ranked candidates: query_id, rank, ku_id, via, relevance, lexical_overlap, fused and the unit's columns.

    Symbol hits come first and win over lexical ones of the same unit; gates run after the lexical top-k, so what
    they drop has still shaped the scale. With ``snapshot`` (repo, file_path, symbol, content_hash of current code) the
    candidates' freshness is checked before the gates. Ties: symbol hits, then lexical rank, then ku_id.
    """
    s = settings(s)
    l1 = symbol_hits(units, queries, repos).select("query_id", "ku_id", F.lit(1.0).alias("relevance"), F.lit(0).alias("lex_rank"), F.lit("symbol").alias("via"))
    l2 = lexical_hits(units, queries, s["top_n"], scorer, index).withColumn("via", F.lit("fts" if scorer == "bm25" else "inverted"))
    hits = l2.join(l1, ["query_id", "ku_id"], "left_anti").unionByName(l1)
    # texts are read for the best only: until these are known, what moves is what gates and scores need
    light = units if snapshot is not None else units.select("ku_id", "repo", "freshness", "authority", "taint", "serve_blocked")
    rows = hits.join(light, "ku_id")
    if repos:
        rows = rows.where(F.col("repo").isin(*repos))
    if snapshot is not None:
        from .freshness import verified

        rows = verified(rows, snapshot, code_only=True)
        rows = rows.withColumn("serve_blocked", F.col("serve_blocked") | (F.col("freshness") == "EXPIRED"))
    lex = F.when(F.col("via") == "symbol", 1.0).otherwise(share_found(F.col("qt"), token_set(unit_text())))
    rows = rows.where(passes_gates(external)).withColumn("fused", fused(s, F.col("freshness"), F.col("authority"), F.col("relevance")))
    order = W.partitionBy("query_id").orderBy(F.col("fused").desc(), (F.col("via") != "symbol").cast("int"), "lex_rank", "ku_id")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(s["top_n"], 0))
    if snapshot is None:
        best = best.select("query_id", "rank", "ku_id", "via", "relevance", "fused").join(units, "ku_id")
    best = best.join(queries.select("query_id", token_set("query").alias("qt")), "query_id")
    return best.withColumn("lexical_overlap", lex).drop("qt", "lex_rank")


def contradictions(candidates: DataFrame) -> DataFrame:
    """query_id of queries with two reviewed units of one key and different content. Missing hashes don't count."""
    strong = candidates.where("authority IN ('REVIEWED', 'AUTHORITATIVE')")
    code = strong.where("source_type = 'CODE' AND symbol IS NOT NULL").select("query_id", F.concat_ws("\x1f", F.lit("C"), F.coalesce("repo", F.lit("")), F.coalesce("file_path", F.lit("")), "symbol").alias("key"), F.col("content_hash").alias("h"))
    qa = strong.where("source_type = 'QA'").select("query_id", F.concat(F.lit("Q"), question_fingerprint("title")).alias("key"), answer_hash("body").alias("h")).where("key <> 'Q'")
    return code.unionByName(qa).groupBy("query_id", "key").agg(F.count_distinct("h").alias("n")).where("n >= 2").select("query_id").distinct()


def citation() -> Column:
    """Source identifiers only: no body and no quote."""
    first = F.get("provenance", F.lit(0))
    return F.struct("ku_id", "source_type", "authority", "freshness", F.coalesce(first["kind"], F.lit("")).alias("prov_kind"), F.coalesce(first["ref"], F.lit("")).alias("prov_ref"), F.col("fused").alias("score"))


def serve(units: DataFrame, queries: DataFrame, s: dict | None = None, external: bool = False, repos: list[str] | None = None, scorer: str = "bm25", snapshot: DataFrame | None = None, index: Index | DataFrame | None = None) -> DataFrame:
    """One verdict a query: query_id, query, decision, reason, confidence, citations, titles, bodies (of the cited units).

    Reasons in order: commitment_marker (such queries never reach the index), no_hit, all_draft, all_expired,
    broken_provenance, best_stale_no_fresh, contradiction, low_relevance (twice), ok.
    """
    s = settings(s)
    marked = queries.withColumn("marked", has_marker("query", COMMITMENT_MARKERS))
    # at most top_n rows a query, read for the rows, the contradictions and the citations alike
    found = cut(retrieve(units, marked.where("NOT marked").select("query_id", "query"), s, external, repos, scorer, snapshot, index))
    flags = found.withColumn("broken", evidence_broken() if "evidence_broken" in found.columns else evidence_broken_plain())
    row = F.struct("rank", "relevance", "lexical_overlap", "fused", "freshness", "broken", F.col("title"), F.col("body"), citation().alias("citation"))
    per = flags.groupBy("query_id").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.every(F.col("authority") == "DRAFT").alias("drafts"), F.every(F.col("freshness") == "EXPIRED").alias("expired"),
        F.some(F.col("freshness") == "FRESH").alias("fresh"), F.some(F.col("authority").isin("REVIEWED", "AUTHORITATIVE")).alias("strong"),
    )
    per = per.join(contradictions(found).withColumn("split", F.lit(True)), "query_id", "left")
    top = F.get("rows", F.lit(0))
    low = ((top["relevance"] < s["abstain_rel_min"]) & (top["lexical_overlap"] < s["abstain_lex_min"])) | ((top["fused"] < s["conf_floor"]) & ~F.col("strong"))
    all_ = marked.join(per, "query_id", "left")
    reason = (
        F.when(F.col("marked"), "commitment_marker").when(F.col("rows").isNull(), "no_hit").when(F.col("drafts"), "all_draft").when(F.col("expired"), "all_expired")
        .when(top["broken"], "broken_provenance").when((top["freshness"] == "STALE") & ~F.col("fresh"), "best_stale_no_fresh")
        .when(F.coalesce("split", F.lit(False)), "contradiction").when(low, "low_relevance").otherwise("ok")
    )
    quiet = F.col("reason").isin("commitment_marker", "no_hit", "all_draft", "all_expired")
    out = all_.withColumn("reason", reason)
    none = F.lit(None)
    return out.select(
        "query_id", "query", F.when(F.col("reason") == "ok", "ANSWERABLE").otherwise("ABSTAIN").alias("decision"), "reason",
        F.when(quiet, 0.0).otherwise(top["fused"]).alias("confidence"),
        F.when(F.col("rows").isNull(), F.array().cast(out.select(F.transform("rows", lambda r: r["citation"])).schema[0].dataType)).otherwise(F.transform("rows", lambda r: r["citation"])).alias("citations"),
        F.when(F.col("reason") == "ok", F.transform("rows", lambda r: r["title"])).otherwise(none).alias("titles"),
        F.when(F.col("reason") == "ok", F.transform("rows", lambda r: r["body"])).otherwise(none).alias("bodies"),
    )


def evidence_broken_plain() -> Column:
    first = F.get("provenance", F.lit(0))["retrievable"]
    return (F.coalesce(F.size("provenance"), F.lit(0)) <= 0) | ~F.coalesce(first, F.lit(True))


def drafts(verdicts: DataFrame, s: dict | None = None) -> DataFrame:
    """query_id, would_answer, draft_text, abstain_reason, citations, assistant_prefix: previews, never sent."""
    s = settings(s)
    bodies = F.filter(F.slice("bodies", F.lit(1), F.lit(s["top_n"])), lambda b: F.coalesce(b, F.lit("")) != "")
    text = strip(F.array_join(F.transform(bodies, strip), "\n\n"))
    # columns of their own, so that the token sets are made once
    made = verdicts.withColumn("__text", text).withColumn("__draft", token_set("__text")).withColumn("__corpus", token_set(F.concat_ws(" ", "titles", "bodies")))
    enough = (F.col("__text") != "") & (coverage(F.col("__draft"), F.col("__corpus")) >= s["coverage_min"])
    made = made.withColumn("__ok", (F.col("decision") == "ANSWERABLE") & F.coalesce(enough, F.lit(False)))
    ok = F.col("__ok")
    why = F.when(ok, F.lit(None).cast("string")).when(F.col("decision") != "ANSWERABLE", F.col("reason")).otherwise("low_coverage")
    return made.select("query_id", ok.alias("would_answer"), F.when(ok, F.col("__text")).alias("draft_text"), why.alias("abstain_reason"), "citations", F.lit(ANSWER_PREFIX).alias("assistant_prefix"))
