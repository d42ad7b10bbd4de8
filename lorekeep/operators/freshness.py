"""Freshness of code units against a snapshot of the current symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def current_symbols(symbols: DataFrame) -> DataFrame:
    """repo, file_path, symbol, content_hash: of equal names in a file the first one counts."""
    return symbols.groupBy("repo", "file_path", "symbol").agg(F.min_by("content_hash", F.struct("line_start", "line_end")).alias("content_hash"))


def verified(units: DataFrame, snapshot: DataFrame, code_only: bool = False) -> DataFrame:
    """Units with ``freshness`` checked: EXPIRED if the symbol is gone, STALE if its hash differs, else FRESH.

    Other source types are UNKNOWN, or with ``code_only`` not looked at and keep theirs. Code of a repository that the
    snapshot doesn't hold keeps its own.
    """
    # one row a symbol; of equal keys the least hash counts (``current_symbols`` picks the first in the file)
    now = snapshot.groupBy("repo", "file_path", "symbol").agg(F.min("content_hash").alias("__now"))
    repos = snapshot.select("repo").distinct().withColumn("__known", F.lit(True))
    out = units.join(now, ["repo", "file_path", "symbol"], "left").join(repos, "repo", "left")
    state = F.when(F.col("__now").isNull(), "EXPIRED").when(F.coalesce("content_hash", F.lit("")).isin("") | (F.col("content_hash") == F.col("__now")), "FRESH").otherwise("STALE")
    fresh = F.when((F.col("source_type") == "CODE") & F.coalesce("__known", F.lit(False)), state)
    fresh = fresh.when((F.col("source_type") != "CODE") & F.lit(not code_only), "UNKNOWN").otherwise(F.col("freshness"))
    return out.withColumn("freshness", fresh).select(*units.columns)


def reindex(units: DataFrame, edges: DataFrame, snapshot: DataFrame, now: str) -> DataFrame:
    """Reconciles a repository's units: gone ones expire, drifted ones are stale and lose AUTHORITATIVE, neighbours are
    derived-stale, equal ones are fresh again."""
    ours = units.join(snapshot.select("repo").distinct(), "repo", "left_semi").where("source_type = 'CODE'")
    judged = verified(ours, snapshot).select("ku_id", "freshness", "authority")
    of = lambda f: judged.where(F.col("freshness") == f).select("ku_id")
    out = store.mark_fresh(units, of("FRESH"), now)
    out = store.expire(out, of("EXPIRED"), now)
    out = store.mark_stale(out, of("STALE"), now)
    out = store.downgrade(out, judged.where("freshness = 'STALE' AND authority = 'AUTHORITATIVE'"), "REVIEWED", now)
    return store.propagate_stale(out, edges, judged.where("freshness IN ('STALE','EXPIRED')"), now)
