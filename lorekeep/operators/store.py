"""Upserts, edges, labels' state machines and inventory over unit tables. Tables are Parquet; a merge rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..enums import TRANSITIONS


def last_of_each(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by ``order`` of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    return batch.withColumn("__r", rank).where("__r = 1").drop("__r")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str] | str = "ku_id", order: str | None = None, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``batch`` replace those of ``existing`` but for the ``keep`` columns, which stay as first written.

    Within the batch the last row by ``order`` wins, and ``keep`` is taken from its first row.
    """
    keys = [keys] if isinstance(keys, str) else keys
    new = batch
    if order:
        first = batch.groupBy(*keys).agg(*[F.min_by(c, order).alias(f"__{c}") for c in keep])
        new = last_of_each(batch, keys, order).join(first, keys)
        new = new.select(*[F.col(f"__{c}").alias(c) if c in keep else F.col(c) for c in existing.columns])
    old = existing.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
    merged = new.join(old, keys, "left").select(*[F.coalesce(F.col(f"__old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in existing.columns])
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(merged)


def replace_children(existing: DataFrame, batch: DataFrame, parents: DataFrame, key: str = "ku_id") -> DataFrame:
    """All children of the written parents are replaced by the batch's."""
    return existing.join(parents.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(batch.select(*existing.columns))


def provenance_rows(units: DataFrame) -> DataFrame:
    """ku_id, pos and an entry's columns: the child table of provenance."""
    return units.select("ku_id", F.posexplode("provenance").alias("pos", "p")).select("ku_id", "pos", "p.*")


def symbol_rows(units: DataFrame) -> DataFrame:
    return units.where("source_type = 'CODE' AND coalesce(symbol, '') <> ''").select("repo", "file_path", "symbol", "ku_id").distinct()


def nest_provenance(units: DataFrame, children: DataFrame) -> DataFrame:
    """Units with their provenance children nested in order."""
    fields = [c for c in children.columns if c not in ("ku_id", "pos")]
    per = children.groupBy("ku_id").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("provenance"))
    nested = per.withColumn("provenance", F.transform("provenance", lambda p: p.dropFields("pos")))
    return units.drop("provenance").join(nested, "ku_id", "left")


def add_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new.select(*existing.columns)).dropDuplicates(["src_ku", "dst_ku", "rel"])


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """ku_id of units one ISSUE_CODE or QA_CODE edge away from the seeds, in either direction."""
    near = edges.where("rel IN ('ISSUE_CODE','QA_CODE')")
    ids = seeds.select("ku_id").distinct()
    out = near.join(ids, near.dst_ku == ids.ku_id, "left_semi").select(F.col("src_ku").alias("ku_id"))
    return out.union(near.join(ids, near.src_ku == ids.ku_id, "left_semi").select(F.col("dst_ku").alias("ku_id"))).distinct()


def transition_error(current: Column, target: Column, has_provenance: Column) -> Column:
    """Why an authority change is refused, or null."""
    allowed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        allowed = allowed | ((current == a) & target.isin(*bs))
    return (
        F.when(current.isNull(), "unknown_ku").when(current == target, F.lit(None).cast("string")).when(~allowed, "illegal_transition")
        .when(~has_provenance & (target != "DRAFT"), "no_provenance")
    )


def set_authority(units: DataFrame, changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(units after legal changes, refused changes with ``error``). changes: ku_id, target; one a unit."""
    state = units.select("ku_id", F.col("authority").alias("current"), (F.coalesce(F.size("provenance"), F.lit(0)) > 0).alias("has"))
    judged = changes.join(state, "ku_id", "left").withColumn("error", transition_error(F.col("current"), F.col("target"), F.col("has")))
    ok = judged.where("error IS NULL AND current <> target").select("ku_id", F.col("target").alias("__t"))
    joined, moved = units.join(ok, "ku_id", "left"), F.col("__t").isNotNull()
    out = joined.withColumn("authority", F.coalesce("__t", "authority")).withColumn("serve_blocked", F.when(moved, F.col("__t").isin("DRAFT", "DEPRECATED")).otherwise(F.col("serve_blocked")))
    return out.withColumn("updated_at", F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))).drop("__t"), judged.where("error IS NOT NULL").select("ku_id", "target", "error")


def promote_drafts(units: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """All drafts to REVIEWED, by the same rules."""
    return set_authority(units, units.where("authority = 'DRAFT'").select("ku_id", F.lit("REVIEWED").alias("target")), now)


def set_freshness(units: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """changes: ku_id, freshness, optional last_verified_at. EXPIRED blocks; FRESH clears the derived flag."""
    seen = F.col("last_verified_at") if "last_verified_at" in changes.columns else F.lit(None).cast("string")
    new = changes.select("ku_id", F.col("freshness").alias("__f"), seen.alias("__v"))
    out, f = units.join(new, "ku_id", "left"), F.col("__f")
    out = out.withColumn("serve_blocked", F.when(f == "EXPIRED", True).otherwise(F.col("serve_blocked"))).withColumn("derived_stale", F.when(f == "FRESH", False).otherwise(F.col("derived_stale")))
    out = out.withColumn("last_verified_at", F.coalesce("__v", "last_verified_at")).withColumn("updated_at", F.when(f.isNotNull(), F.lit(now)).otherwise(F.col("updated_at")))
    return out.withColumn("freshness", F.coalesce("__f", "freshness")).drop("__f", "__v")


def _updated(units: DataFrame, ids: DataFrame, now: str, **columns: Column) -> DataFrame:
    """Sets columns of the named units."""
    out = units.join(ids.select("ku_id").distinct().withColumn("__hit", F.lit(True)), "ku_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    for c, v in (columns | {"updated_at": F.lit(now)}).items():
        out = out.withColumn(c, F.when(hit, v).otherwise(F.col(c)))
    return out.drop("__hit")


def expire(units: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Evidence is gone: expired, blocked, provenance not retrievable."""
    gone = F.transform("provenance", lambda p: p.withField("retrievable", F.lit(False)))
    return _updated(units, ids, now, freshness=F.lit("EXPIRED"), serve_blocked=F.lit(True), provenance=gone)


def downgrade(units: DataFrame, ids: DataFrame, target: str, now: str) -> DataFrame:
    return _updated(units, ids, now, authority=F.lit(target), serve_blocked=F.lit(target in ("DRAFT", "DEPRECATED")))


def mark_stale(units: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    return _updated(units, ids, now, freshness=F.lit("STALE"))


def mark_fresh(units: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    return _updated(units, ids, now, freshness=F.lit("FRESH"), derived_stale=F.lit(False), last_verified_at=F.lit(now))


def propagate_stale(units: DataFrame, edges: DataFrame, seeds: DataFrame, now: str) -> DataFrame:
    return _updated(units, neighbours(edges, seeds), now, derived_stale=F.lit(True))


def mark_stale_files(units: DataFrame, edges: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """Code units of changed files (repo, file_path) become STALE, AUTHORITATIVE ones REVIEWED; neighbours derived-stale."""
    hit = units.where("source_type = 'CODE'").join(files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi").select("ku_id")
    lower = F.when(F.col("authority") == "AUTHORITATIVE", "REVIEWED").otherwise(F.col("authority"))
    return propagate_stale(_updated(units, hit, now, freshness=F.lit("STALE"), authority=lower), edges, hit, now)


def inventory(units: DataFrame) -> DataFrame:
    """kind, value, n: totals, counts by source type, authority and freshness, blocked, stale, expired and public units."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (
        ("total", F.lit("")), ("source_type", F.col("source_type")), ("authority", F.col("authority")), ("freshness", F.col("freshness")),
        ("serve_blocked", F.when(F.col("serve_blocked"), "")), ("public_ok", F.when(F.col("public_ok"), "")),
    )])
    return units.select(F.explode(keys).alias("k")).where("k.value IS NOT NULL").groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def last_commits(units: DataFrame) -> DataFrame:
    """repo and the commit of its most recently updated code unit."""
    return units.where("source_type = 'CODE' AND repo IS NOT NULL").groupBy("repo").agg(F.max_by("commit_sha", F.struct("updated_at", "ku_id")).alias("last_commit"))


def public_view(units: DataFrame) -> DataFrame:
    """Units without bodies and quotes."""
    safe = F.transform("provenance", lambda p: p.dropFields("quote"))
    return units.drop("body").withColumn("provenance", safe)


def encrypted(units: DataFrame, key: Column) -> DataFrame:
    """Body and quotes as AES-256-GCM binaries: nonce, ciphertext, tag."""
    seal = lambda c: F.aes_encrypt(c, key, F.lit("GCM"))
    return units.withColumn("body", seal(F.col("body"))).withColumn("provenance", F.transform("provenance", lambda p: p.withField("quote", seal(p["quote"]))))


def decrypted(units: DataFrame, key: Column) -> DataFrame:
    open_ = lambda c: F.aes_decrypt(c, key, F.lit("GCM")).cast("string")
    return units.withColumn("body", open_(F.col("body"))).withColumn("provenance", F.transform("provenance", lambda p: p.withField("quote", open_(p["quote"]))))


def flags_as_numbers(df: DataFrame) -> DataFrame:
    """Booleans as 0/1, as row-oriented stores keep them."""
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in df.schema])
