"""Risk classification of command lines by longest-prefix rules, the gate, and confirm tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commands import argv_hash, confirm_token, normalize
from .store import upsert

STRICTNESS = {"AUTO": 0, "HUMAN_CONFIRM": 1, "DENY": 2}


def check_policy(policy: dict) -> dict:
    """The policy, or ValueError: never must not be empty, R0 and the deny level must be defined, rules need known levels."""
    levels = policy.get("levels") or {}
    if not policy.get("never") or any(len(p) != 2 for p in policy["never"]):
        raise ValueError("never must hold pairs")
    if "R0" not in levels:
        raise ValueError("level R0 is missing")
    if (policy.get("defaults") or {}).get("deny_level") not in levels:
        raise ValueError("deny_level isn't a level")
    if any(r.get("level") not in levels or not r.get("prefix") for r in policy.get("rules", [])):
        raise ValueError("a rule needs a prefix and a known level")
    return policy


def load_policy(text: str) -> dict:
    """From YAML text where a YAML library is installed, else from JSON."""
    try:
        import yaml

        return check_policy(yaml.safe_load(text))
    except ImportError:
        import json

        return check_policy(json.loads(text))


def rule_table(spark: SparkSession, policy: dict) -> DataFrame:
    """kind (never, white, rule), prefix, n, level: the policy's rows. One file's worth, so it may be broadcast."""
    rows = [("never", "\n".join(p), 2, None) for p in policy["never"]]
    rows += [("white", "\n".join(e["match"]), len(e["match"]), "R0") for e in policy.get("r0_whitelist", [])]
    rows += [("rule", "\n".join(r["prefix"]), len(r["prefix"]), r["level"]) for r in policy.get("rules", [])]
    return spark.createDataFrame(rows, "kind string, prefix string, n int, level string")


def rule_map(policy: dict) -> Column:
    """prefix -> struct<order, kind, prefix, level>, of equal prefixes the strongest kind."""
    rows = [(2000 + 2, "never", "\n".join(p), None) for p in policy["never"]]
    rows += [(1000 + len(e["match"]), "white", "\n".join(e["match"]), "R0") for e in policy.get("r0_whitelist", [])]
    rows += [(len(r["prefix"]), "rule", "\n".join(r["prefix"]), r["level"]) for r in policy.get("rules", [])]
    best = {row[2]: row for row in sorted(rows, key=lambda r: r[0])}
    value = lambda o, k, p, v: F.struct(F.lit(o).alias("order"), F.lit(k).alias("kind"), F.lit(p).alias("prefix"), F.lit(v).cast("string").alias("level"))
    return F.create_map(*[x for row in best.values() for x in (F.lit(row[2]), value(*row))])


def _level(policy: dict, level: Column, key: str) -> Column:
    out = F.lit(False)
    for name, spec in policy["levels"].items():
        out = F.when(level == name, F.lit(bool(spec.get(key)))).otherwise(out)
    return out


def classify(df: DataFrame, policy: dict, names: tuple[str, ...]) -> DataFrame:
    """Adds normalized, level, decision, never and matched_prefix to rows with ``argv``.

    A never pair wins, then the longest whitelist prefix, then the longest rule, else the deny level. Each row looks its own
    prefixes up, at most as many as the longest rule has words, in a literal map of the policy: no key, no shuffle, so rows
    that share an id are judged each by its own command.
    """
    rules = rule_map(policy)
    longest = max([2, *(len(r["prefix"]) for r in policy.get("rules", [])), *(len(e["match"]) for e in policy.get("r0_whitelist", []))])
    out = df.withColumn("normalized", normalize(F.col("argv"), names))
    prefix_of = lambda k: F.array_join(F.slice("normalized", F.lit(1), k), "\n")
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("normalized"), F.lit(longest)))), lambda k: F.try_element_at(rules, prefix_of(k)))
    joined = out.withColumn("hit", F.array_max(F.filter(found, lambda h: h.isNotNull())))
    never = F.coalesce(F.col("hit.kind") == "never", F.lit(False))
    level = F.when(~never, F.coalesce("hit.level", F.lit(policy["defaults"]["deny_level"])))
    decision = F.when(never, "DENY").when(_level(policy, level, "auto"), "AUTO").otherwise("HUMAN_CONFIRM")
    prefix = F.when(F.col("hit").isNull(), F.array().cast("array<string>")).otherwise(F.split("hit.prefix", "\n"))
    return joined.withColumn("level", level).withColumn("decision", decision).withColumn("never", never).withColumn("matched_prefix", prefix).drop("hit")


def gate(intents: DataFrame, policy: dict, binary: str, kill_switch: bool = False, names: tuple[str, ...] = ()) -> DataFrame:
    """Adds level, decision, requires_confirm, never, human_only, argv_norm_sha256 and reason to intents.

    A wrong head is denied; labels (a commitment, sensitive data) only tighten; the kill switch denies all else.
    """
    ruled = classify(intents, policy, (binary, *names))
    valid = F.coalesce(F.get("argv", F.lit(0)) == binary, F.lit(False))
    labels = F.col("semantic_labels")
    tight = F.coalesce(labels["commit_class"] == "yes", F.lit(False)) | F.coalesce(labels["taint"] == "SENSITIVE", F.lit(False))
    killed = F.lit(kill_switch)
    strict = F.when(tight & (F.col("decision") == "AUTO"), "HUMAN_CONFIRM").otherwise(F.col("decision"))
    final = F.when(~valid | F.col("never") | killed, "DENY").otherwise(strict)
    reason = F.when(~valid, "invalid_argv").when(F.col("never"), "never").when(killed, "kill_switch").when(strict != F.col("decision"), "tightened").when(F.size("matched_prefix") == 0, "default_deny").otherwise("matched")
    out = ruled.select(*[c for c in ruled.columns if c not in ("level", "decision", "never")], F.when(valid, F.col("level")).otherwise(policy["defaults"]["deny_level"]).alias("level"), final.alias("decision"), (valid & F.col("never")).alias("never"), reason.alias("reason"))
    live = valid & ~F.col("never") & ~killed
    out = out.withColumn("requires_confirm", F.col("decision") == "HUMAN_CONFIRM").withColumn("human_only", live & _level(policy, F.col("level"), "human_only"))
    return out.withColumn("argv_norm_sha256", F.when(valid, argv_hash(F.col("normalized"))))


def issue_tokens(intents: DataFrame, key: bytes, now: int, ttl: int, names: tuple[str, ...]) -> DataFrame:
    """Confirm records of action_id and argv."""
    hash_ = argv_hash(normalize(F.col("argv"), names))
    out = intents.select("action_id", hash_.alias("argv_norm_sha256"), F.lit(now).cast("long").alias("issued_at"), F.lit(ttl).alias("ttl_seconds"))
    token = confirm_token(key, F.col("action_id"), F.col("argv_norm_sha256"), F.col("issued_at"), F.col("ttl_seconds"))
    return out.withColumn("token", token).withColumn("used", F.lit(False))


def verify_tokens(presented: DataFrame, records: DataFrame, key: bytes, now: int, names: tuple[str, ...]) -> DataFrame:
    """action_id, h, ok, reason: missing, used, expired, hash, hmac or ok. ``consumed`` marks the accepted ones as used.

    Each distinct command (``h``: its hash) that is presented for an id gets a verdict; equal ones are one. Of several
    records of an id the one issued last counts.
    """
    ours = presented.select("action_id", argv_hash(normalize(F.col("argv"), names)).alias("h")).distinct()
    last = records.groupBy("action_id").agg(F.max(F.struct("issued_at", "used", "ttl_seconds", "argv_norm_sha256", "token")).alias("r"))
    both = ours.join(last, "action_id", "left").select("action_id", "h", "r.*")
    good = confirm_token(key, F.col("action_id"), F.col("h"), F.col("issued_at"), F.col("ttl_seconds"))
    reason = (
        F.when(F.col("token").isNull(), "missing").when(F.col("used"), "used").when(F.lit(now) > F.col("issued_at") + F.col("ttl_seconds"), "expired")
        .when(F.col("h") != F.col("argv_norm_sha256"), "hash_mismatch").when(F.col("good") != F.col("token"), "hmac_mismatch").otherwise("ok")
    )
    return both.withColumn("good", good).select("action_id", "h", reason.alias("reason")).withColumn("ok", F.col("reason") == "ok")


def consumed(records: DataFrame, verified: DataFrame) -> DataFrame:
    """Records after verification: an accepted token is used."""
    hit = verified.where("ok").select("action_id", F.lit(True).alias("__u")).distinct()
    return records.join(hit, "action_id", "left").withColumn("used", F.col("used") | F.coalesce("__u", F.lit(False))).drop("__u")


def route(gated: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Adds status (denied, draft, execute) and folder (failed, done): what happens to a gated intent. A verdict frees the
    command that it was given for, no other one of that id."""
    ok = verified.where("ok").select("action_id", F.col("h").alias("argv_norm_sha256"), F.lit(True).alias("__ok")).distinct() if verified is not None else None
    out = gated.join(ok, ["action_id", "argv_norm_sha256"], "left") if ok is not None else gated.withColumn("__ok", F.lit(None).cast("boolean"))
    status = F.when(F.col("decision") == "DENY", "denied").when((F.col("decision") == "HUMAN_CONFIRM") & ~F.coalesce("__ok", F.lit(False)), "draft").otherwise("execute")
    return out.withColumn("status", status).withColumn("folder", F.when(status == "denied", "failed").otherwise("done")).drop("__ok")


def record_actions(actions: DataFrame, routed: DataFrame, now: str) -> DataFrame:
    """The actions table after a batch of routed intents: level, decision and status as of now, created_at as first written.
    Intents without an id aren't recorded; of several with one id the greatest (status, decision, level) counts."""
    last = routed.where("action_id IS NOT NULL").groupBy("action_id").agg(F.max(F.struct("status", "decision", "level")).alias("r"))
    new = last.select("action_id", "r.level", "r.decision", "r.status", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return upsert(actions, new, "action_id")


def shim_allows(level: Column, token_ok: Column) -> Column:
    """Only R0 runs without a valid gate token."""
    return (F.coalesce(level, F.lit("")) == "R0") | F.coalesce(token_ok, F.lit(False))


def inverse_intents(snapshots: DataFrame, binary: str, now: str) -> DataFrame:
    """For each snapshot (action_id, kind) the intent to undo it: a placeholder that goes through the gate like any other."""
    none = F.lit(None).cast("string")
    new_id = F.concat(F.lit("AI-"), F.regexp_replace(F.lit(now[:10]), "-", ""), F.lit("-"), F.substring(F.sha2(F.concat(F.lit("undo|"), "action_id"), 256), 1, 8))
    label = F.struct(F.lit("maybe").alias("commit_class"), F.lit("INTERNAL").alias("taint"), F.lit(False).alias("public_ok"))
    meta = F.create_map(F.lit("inverse_of"), F.col("action_id"), F.lit("restore_kind"), F.col("kind"), F.lit("best_effort"), F.lit("true"))
    return snapshots.select(new_id.alias("action_id"), F.lit(now).alias("created_at"), F.lit("cli").alias("source"), F.array(F.lit(binary), F.lit("undo"), F.col("action_id")).alias("argv"), none.alias("cwd"), none.alias("stdin"), label.alias("semantic_labels"), meta.alias("meta"))
