"""Impact analysis, patrol of new issues, triage packages and acceptance measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sieve import matches_any
from ..functions.text import blank
from ..sources.shared import cut
from .retrieve import drafts, serve
from .segments import Index

#: Patterns of the shared components, and which files count.
COMPONENTS = {
    "sso": ([r"sa-token", r"is-concurrent", r"StpUtil", r"SaLoginModel", r"LoginDeviceResolver"], [r"/api/sso", r"ssoUrl", r"SsoApiService", r"X-Product-Code", r"productCode"]),
    "redis": ([r"alone-redis", r"spring\.redis", r"RedisTemplate", r"[Rr]edisson"], [r"REDIS_HOST", r"SATOKEN_REDIS", r"redis://"]),
    "kafka": ([r"\bkafka\b", r"KafkaTemplate", r"@KafkaListener"], [r"KAFKA_URL", r"bootstrap-servers", r"[Tt]opic"]),
    "gateway": ([r"apisix", r"x-router-code"], [r"/api/backend", r"/api/sso", r"/api/dataset", r"/api/data-convertor"]),
}
SCANNED = r"\.(java|yml|yaml|ts|tsx|js|jsx|vue|json|properties|xml|env|md)$|(^|/)\.env[^/]*$"


def scan(files: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Files (repo, file_path, text) that match any of the patterns."""
    return files.where(F.col("file_path").rlike(SCANNED) & matches_any(F.col(text), patterns)).select("repo", "file_path")


def impact(files: DataFrame, impl: list[str], consumer: list[str]) -> DataFrame:
    """repo, impl_files, consumer_files, for every repository that a change of a component touches. One scan."""
    hit = lambda ps: F.count_if(matches_any(F.col("text"), ps))
    return files.where(F.col("file_path").rlike(SCANNED)).groupBy("repo").agg(hit(impl).alias("impl_files"), hit(consumer).alias("consumer_files")).where("impl_files + consumer_files > 0")


def label_with(prefix: str, default: Column) -> Column:
    """The first label with a prefix."""
    names = F.filter(F.transform("labels", lambda x: x["name"]), lambda n: n.startswith(prefix))
    return F.coalesce(F.get(names, F.lit(0)), default)


def new_issues(issues: DataFrame, seen: DataFrame) -> DataFrame:
    """Open issues not seen before, with their line and priority."""
    fresh = issues.join(seen.select("number").distinct(), "number", "left_anti")
    line = F.regexp_replace(label_with("line:", F.lit("line:无")), "line:", "")
    priority = F.regexp_replace(label_with("priority:", F.lit("priority:?")), "^[^:]*:", "")
    return fresh.select("number", "title", line.alias("line"), priority.alias("priority"))


def notice_line(base: str) -> Column:
    """Text of a patrol notice."""
    return F.format_string(f"· #%d [%s/%s]《%s》\n  {base}/issues/%d", "number", "line", "priority", F.substring("title", 1, 34), "number")


def announcement(agent: str) -> Column:
    """Fixed-form progress text of a task (title, target_branch, issue); free text never enters."""
    title = F.coalesce(F.when(F.trim("title") != "", F.trim("title")), F.lit("(无标题)"))
    ref = F.coalesce(F.concat(F.lit("feedback#"), F.col("issue").cast("string"), F.lit(" ")), F.lit(""))
    target = F.when(F.coalesce("target_branch", F.lit("")) != "", F.concat(F.lit(" → "), "target_branch")).otherwise("")
    return F.concat(F.lit(f"🤖 {agent} 正在处理 "), ref, F.lit("《"), title, F.lit("》\n· 任务已发布，执行中"), target, F.lit("\n（自动进度播报·非本人发言）"))


def seen_after(seen: DataFrame, new: DataFrame, notified: bool) -> DataFrame:
    """Seen numbers after a patrol: the new ones count only if the notice went out."""
    return seen.select("number").union(new.select("number")).distinct() if notified else seen.select("number")


def triage(messages: DataFrame, units: DataFrame, s: dict | None = None, index: Index | DataFrame | None = None) -> DataFrame:
    """A package a message (msg_id, content): decision, reason, the number of citations and up to five titles and bodies."""
    asked = messages.where(~blank("content")).select(F.col("msg_id").alias("query_id"), F.col("content").alias("query"))
    v = serve(units, asked, s, index=index)
    five = F.slice(F.arrays_zip(F.coalesce("titles", F.array().cast("array<string>")).alias("title"), F.coalesce("bodies", F.array().cast("array<string>")).alias("body")), 1, 5)
    return v.select(F.col("query_id").alias("msg_id"), F.col("query").alias("message"), "decision", "reason", F.size("citations").alias("n_citations"), five.alias("kus"))


def window_bounds(now: Column, days: int) -> tuple[Column, Column]:
    """From ``days`` ago to a day ahead."""
    return now - F.make_dt_interval(F.lit(days)), now + F.make_dt_interval(F.lit(1))


def sample_units(units: DataFrame, n: int = 80, seed: int = 42) -> DataFrame:
    """A fixed sample by hash of the id: the same rows on every run."""
    return units.orderBy(F.xxhash64("ku_id", F.lit(seed)), "ku_id").limit(n)


def acceptance(units: DataFrame, sample: DataFrame, s: dict | None = None, index: Index | DataFrame | None = None) -> DataFrame:
    """stratum, n, hits, answered: whether a unit is found by its own symbol (code) or title."""
    code = F.col("source_type") == "CODE"
    asked = sample.select(F.col("ku_id").alias("query_id"), F.when(code, F.coalesce("symbol", "title")).otherwise(F.col("title")).alias("query"), F.when(code, "CODE").otherwise("DOC").alias("stratum")).where(~blank("query"))
    v = cut(serve(units, asked.select("query_id", "query"), s, index=index))
    hit = F.exists("citations", lambda c: c["ku_id"] == F.col("query_id"))
    would = drafts(v, s).select("query_id", "would_answer")
    judged = v.select("query_id", hit.alias("hit")).join(would, "query_id").join(asked.select("query_id", "stratum"), "query_id")
    return judged.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("would_answer")).alias("answered"))


def traceable(units: DataFrame) -> DataFrame:
    """One row: units with provenance and those whose first reference isn't blank."""
    first = F.get("provenance", F.lit(0))["ref"]
    with_ = F.coalesce(F.size("provenance"), F.lit(0)) > 0
    return units.agg(F.count_if(with_).alias("total"), F.count_if(with_ & ~blank(first)).alias("resolvable"))


def leak_counts(units: DataFrame) -> DataFrame:
    """category, n: secrets that are still in bodies after redaction."""
    from ..functions.redaction import DETECTORS

    secret = [(n, p) for n, p, label in DETECTORS if label == "SENSITIVE"]
    found = F.array(*[F.struct(F.lit(n).alias("category"), F.regexp_count("body", F.lit(p)).alias("n")) for n, p in secret])
    return units.select(F.explode(found).alias("x")).groupBy("x.category").agg(F.sum("x.n").alias("n"))


