"""Log analytics: pods of a service, matches with context, tails, audit trails, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Names that an audit record may have. A deployment adds its daemon's name to the actors.
AUDIT_EVENTS = (
    "classify", "gate_decision", "confirm_issued", "confirm_verified", "confirm_rejected", "shim_invoke", "shim_deny", "exec_result", "refresh_lock_acquire",
    "refresh_lock_release", "scaffold", "kill_switch", "privacy_filter", "undo_snapshot", "cli",
)
AUDIT_ACTORS = ("executor", "shim", "policygate", "cli", "privacy", "store")


def pods_of(pods: DataFrame, service: str) -> DataFrame:
    """Pods whose deployment (the name without its last two dash parts) is the service; if none, those with its prefix."""
    deployment = F.regexp_replace("pod", "-[^-]*-[^-]*$", "")
    exact = pods.where(deployment == service)
    some = exact.limit(1).select(F.lit(True).alias("__some"))
    loose = pods.where(F.col("pod").startswith(service + "-")).join(some, F.col("__some"), "left_anti")
    return exact.unionByName(loose.select(*pods.columns))


def grep_context(lines: DataFrame, pattern: str, context: int = 0, key: str = "pod", order: str = "ln", text: str = "line") -> DataFrame:
    """Matching lines and the ``context`` lines after each, every line once.

    Lines are dealt by ranges of (key, order), so a busy pod is cut into stretches, each a window of its own. Only the first
    ``context`` lines of a stretch look beyond it: their matches come from a window over the stretches' ends, which are
    2 * ``context`` lines for each stretch.
    """
    given = lines.withColumn("is_match", F.coalesce(F.col(text).rlike(pattern), F.lit(False)))
    dealt = cut(given.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("__part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33)))
    stretch, hit = W.partitionBy(key, "__part"), F.col("is_match").cast("int")
    near = lambda w: F.max(hit).over(w.orderBy(order).rowsBetween(-context, 0))
    placed = dealt.withColumn("__at", F.row_number().over(stretch.orderBy(order))).withColumn("__n", F.count("*").over(stretch)).withColumn("__near", near(stretch))
    ends = placed.where((F.col("__at") <= context) | (F.col("__at") > F.col("__n") - context))
    first = ends.withColumn("__near", near(W.partitionBy(key))).where(F.col("__at") <= context)
    out = placed.where(F.col("__at") > context).unionByName(first)
    return out.where("__near = 1").select(*given.columns)


def tail(lines: DataFrame, n: int, key: str = "pod", order: str = "ln") -> DataFrame:
    """The last n lines of each pod. The rank's limit is applied in every task before the shuffle, so a busy pod sends n lines
    of each task, not all."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return lines.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def audit_records(df: DataFrame, now: Column, actors: tuple[str, ...] = AUDIT_ACTORS) -> DataFrame:
    """Audit rows as written: an unknown event becomes ``cli`` and an unknown actor ``store``, the given value kept in detail."""
    detail = F.coalesce("detail", F.create_map().cast("map<string,string>"))
    bad_event, bad_actor = ~F.coalesce("event", F.lit("")).isin(*AUDIT_EVENTS), ~F.coalesce("actor", F.lit("")).isin(*actors)
    extra = F.map_filter(F.create_map(F.lit("_invalid_event"), F.when(bad_event, F.col("event")), F.lit("_invalid_actor"), F.when(bad_actor, F.col("actor"))), lambda k, v: v.isNotNull())
    out = df.withColumn("detail", F.map_concat(detail, extra)).withColumn("event", F.when(bad_event, "cli").otherwise(F.col("event"))).withColumn("actor", F.when(bad_actor, "store").otherwise(F.col("actor")))
    return out.withColumn("ts", F.coalesce("ts", now)).withColumn("date", F.substring("ts", 1, 10))


def audit_sequence(df: DataFrame) -> DataFrame:
    """Adds seq, counted by pid in order of ts."""
    return df.withColumn("seq", F.row_number().over(W.partitionBy("pid").orderBy("ts", "event")))


def audit_tail(df: DataFrame, n: int) -> DataFrame:
    """The last n records, newest first: a top-k, not a sort of all."""
    return df.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def diagnose(probes: DataFrame) -> DataFrame:
    """host, verdict of probe results (host, path, code, server, router)."""
    gateway = (F.col("code") == "404") & (F.lower("server").startswith("apisix") | (F.col("server") == "elb") | (F.coalesce("router", F.lit("")) != ""))
    per = probes.groupBy("host").agg(F.some(F.substring("code", 1, 1).isin("2", "3")).alias("up"), F.some(F.coalesce(gateway, F.lit(False))).alias("gw"))
    return per.select("host", F.when(F.col("up"), "reachable").when(F.col("gw"), "gateway_route_missing").otherwise("unreachable").alias("verdict"))
