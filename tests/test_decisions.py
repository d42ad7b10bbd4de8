"""Policy, tokens, inbox (batch and stream), logs, patrol, sources."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.operators import logs, ops, policy, validate
from lorekeep.policy_data import default_policy
from lorekeep.sources import readers, writers
from lorekeep.streaming import inbox

NOW = "2024-01-01T00:00:00Z"
CASES = {
    "chat message list": ("R0", "AUTO"), "chat message list --all": ("R0", "AUTO"), "chat message list-direct": ("R2", "HUMAN_CONFIRM"), "chat message send x": ("R3", "HUMAN_CONFIRM"),
    "auth export": (None, "DENY"), "auth status": ("R3", "HUMAN_CONFIRM"), "todo create": ("R1", "HUMAN_CONFIRM"), "unknown": ("R2", "HUMAN_CONFIRM"), "": ("R2", "HUMAN_CONFIRM"),
}


def intents(spark, *rows):
    names = schemas.INTENT.names
    base = {"created_at": "2024-01-01T00:00:00Z", "source": "cli", "semantic_labels": ("maybe", "INTERNAL", False)}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schemas.INTENT)


def test_policy_data():
    p = policy.check_policy(default_policy())
    assert (len(p["never"]), len(p["r0_whitelist"]), len(p["rules"])) == (4, 86, 48)
    with pytest.raises(ValueError):
        policy.check_policy(p | {"never": []})
    assert policy.load_policy(json.dumps(p))["defaults"]["deny_level"] == "R2"


def test_classify(spark):
    df = spark.createDataFrame([(k, ["cli", *k.split(), "--yes"]) for k in CASES], "action_id string, argv array<string>")
    got = {r.action_id: (r.level, r.decision) for r in policy.classify(df, default_policy(), ("cli",)).collect()}
    assert got == CASES


def test_rows_that_share_an_id(spark):
    """Each row is judged by its own command, and a verdict frees the command that it was given for."""
    argv = {"chat message list": "AUTO", "doc delete x": "HUMAN_CONFIRM"}
    df = spark.createDataFrame([("same", ["cli", *k.split()]) for k in argv], "action_id string, argv array<string>")
    assert {" ".join(r.argv[1:]): r.decision for r in policy.classify(df, default_policy(), ("cli",)).collect()} == argv
    key, two = b"k", intents(spark, {"action_id": "a", "argv": ["cli", "mail", "send"]}, {"action_id": "a", "argv": ["cli", "doc", "delete", "x"]})
    rec = policy.issue_tokens(two.where("argv[1] = 'mail'"), key, 100, 300, ("cli",))
    old = policy.issue_tokens(two.where("argv[1] = 'doc'"), key, 50, 300, ("cli",))
    done = policy.verify_tokens(two.union(two), rec.union(old), key, 200, ("cli",))
    assert sorted(r.reason for r in done.collect()) == ["hash_mismatch", "ok"]
    routed = policy.route(policy.gate(two, default_policy(), "cli"), done)
    assert {r.argv[1]: r.status for r in routed.collect()} == {"mail": "execute", "doc": "draft"}


def test_gate(spark):
    read = ["cli", "chat", "message", "list"]
    df = intents(spark, {"action_id": "a", "argv": read}, {"action_id": "b", "argv": read, "semantic_labels": ("yes", "CLEAN", False)}, {"action_id": "c", "argv": read, "semantic_labels": ("no", "SENSITIVE", False)}, {"action_id": "d", "argv": ["sh"]}, {"action_id": "e", "argv": ["cli", "mail", "send"]})
    got = {r.action_id: (r.decision, r.reason, r.human_only) for r in policy.gate(df, default_policy(), "cli").collect()}
    assert got == {"a": ("AUTO", "matched", False), "b": ("HUMAN_CONFIRM", "tightened", False), "c": ("HUMAN_CONFIRM", "tightened", False), "d": ("DENY", "invalid_argv", False), "e": ("HUMAN_CONFIRM", "matched", True)}
    assert {r.decision for r in policy.gate(df, default_policy(), "cli", kill_switch=True).collect()} == {"DENY"}


def test_tokens(spark):
    df, key = intents(spark, {"action_id": "a", "argv": ["cli", "x"]}), b"k"
    rec = policy.issue_tokens(df, key, 100, 300, ("cli",))
    ask = lambda d, now=200, r=rec, k=key: policy.verify_tokens(d, r, k, now, ("cli",)).first().reason
    assert ask(df.withColumn("argv", F.array(F.lit("cli"), F.lit("x"), F.lit("--yes")))) == "ok"
    assert ask(df, 401) == "expired" and ask(df, k=b"other") == "hmac_mismatch"
    assert ask(df.withColumn("argv", F.array(F.lit("cli"), F.lit("y")))) == "hash_mismatch"
    used = policy.consumed(rec, policy.verify_tokens(df, rec, key, 200, ("cli",)))
    assert ask(df, r=used) == "used" and ask(df, r=rec.limit(0)) == "missing"


GOOD = {"action_id": "AI-20240101-0000000a", "created_at": "2024-01-01T00:00:00Z", "source": "cli", "argv": ["cli", "chat", "message", "list"]}


def test_intent_errors(spark):
    df = intents(spark, GOOD, GOOD | {"action_id": "x", "source": "web", "argv": []}, GOOD | {"argv": ["sh"], "created_at": "now", "semantic_labels": ("no", "odd", None)})
    assert [r.errors for r in validate.intent_errors(df, "cli").collect()] == [[], ["action_id", "source", "argv_missing"], ["created_at", "argv_head", "commit_class", "taint"]]


def test_inbox_stream(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    put = lambda name, x: (box / name).write_text(json.dumps(x))
    put("1.json", GOOD)
    put("2.json", GOOD | {"action_id": "AI-20240101-0000000b", "argv": ["cli", "auth", "export"]})
    put("3.json", GOOD | {"action_id": "bad"})
    for _ in range(2):  # the second run finds nothing new
        inbox.run_inbox(spark, str(box), str(tmp_path / "out"), str(tmp_path / "ck"), default_policy(), "cli").awaitTermination()
    rows = {r.action_id: (r.folder, r.status, r.failure_reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"AI-20240101-0000000a": ("done", "execute", None), "AI-20240101-0000000b": ("failed", "denied", "never"), "bad": ("failed", "invalid", "action_id")}
    put("4.json", GOOD | {"created_at": "2024-01-02T00:00:00Z", "argv": ["cli", "mail", "send"]})  # an id that has been handled
    put("5.json", GOOD | {"action_id": "AI-20240101-0000000c"})
    inbox.run_inbox(spark, str(box), str(tmp_path / "out"), str(tmp_path / "ck"), default_policy(), "cli").awaitTermination()
    again = [(r.action_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(again) == 4 and ("AI-20240101-0000000c", "execute") in again and (GOOD["action_id"], "execute") in again
    assert [r.action_id for r in readers.inbox(spark, str(box)).collect()][0] == GOOD["action_id"]
    assert policy.shim_allows(F.lit("R0"), F.lit(None).cast("boolean")) is not None


def test_logs(spark):
    lines = spark.createDataFrame([("p", i, "hit" if i in (2, 3, 9) else "x") for i in range(12)], "pod string, ln int, line string")
    assert [r.ln for r in logs.grep_context(lines, "hit", 2).orderBy("ln").collect()] == [2, 3, 4, 5, 9, 10, 11]
    assert logs.tail(lines, 3).count() == 3
    rng = __import__("random").Random(4)
    many = [(p, k * 3 + p_, rng.random() < 0.1) for p_, (p, n) in enumerate((("busy", 900), ("calm", 5), ("idle", 1))) for k in range(n)]
    df = spark.createDataFrame([(p, k, "hit" if h else "no") for p, k, h in many], "pod string, ln int, line string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # stretches of their own, short ones too
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        for context in (0, 1, 4, 40):
            got = sorted((r.pod, r.ln, r.is_match) for r in logs.grep_context(df, "hit", context).collect())
            want = [(p, k, h) for p in ("busy", "calm", "idle") for own in [[x for x in many if x[0] == p]] for i, (_, k, h) in enumerate(own) if any(x[2] for x in own[max(0, i - context) : i + 1])]
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pods = spark.createDataFrame([("web-1-a",), ("web-next-1-b",), ("api-x",)], "pod string")
    assert [r.pod for r in logs.pods_of(pods, "web").collect()] == ["web-1-a"]
    assert [r.pod for r in logs.pods_of(pods, "api").collect()] == ["api-x"]
    rec = spark.createDataFrame([(None, None, "odd", "a", "who", None, None, None, "r", None, 1)], schemas.AUDIT)
    out = logs.audit_records(rec, F.lit("2024-01-02T00:00:00.000Z")).first()
    assert (out.event, out.actor, out.detail, out.date) == ("cli", "store", {"_invalid_event": "odd", "_invalid_actor": "who"}, "2024-01-02")
    seq = logs.audit_sequence(spark.createDataFrame([("2", "a", 1), ("1", "b", 1)], "ts string, event string, pid int"))
    assert logs.audit_tail(seq, 1).first().event == "a"


def test_patrol(spark):
    issues = spark.createDataFrame([(1, "one", [("line:web",), ("priority:high",)]), (2, "two", [("x",)]), (3, "three", [])], schemas.ISSUE)
    seen = spark.createDataFrame([(3,)], "number long")
    new = ops.new_issues(issues, seen)
    assert {(r.number, r.line, r.priority) for r in new.collect()} == {(1, "web", "high"), (2, "无", "?")}
    assert ops.seen_after(seen, new, False).count() == 1 and ops.seen_after(seen, new, True).count() == 3
    assert "#1 [web/high]" in new.where("number = 1").select(ops.notice_line("http://x")).first()[0]


def test_impact(spark):
    files = spark.createDataFrame([("a", "x.java", "uses StpUtil"), ("b", "y.ts", "ssoUrl = 1"), ("c", "z.bin", "StpUtil")], "repo string, file_path string, text string")
    assert {(r.repo, r.impl_files, r.consumer_files) for r in ops.impact(files, *ops.COMPONENTS["sso"]).collect()} == {("a", 1, 0), ("b", 0, 1)}
    assert [r.repo for r in ops.scan(files, ["StpUtil"]).collect()] == ["a"]


def test_sources(spark, tmp_path):
    (tmp_path / "dump.json").write_text(json.dumps([{"source_type": "QA", "text": "t", "meta": {"msg_id": "m"}}, {"source_type": "CODE", "text": "x", "repo": "r"}, {"text": "no type"}]))
    got = {r.source_type: r.meta for r in readers.raw_items(spark, str(tmp_path / "dump.json")).collect()}
    assert got == {"QA": {"msg_id": "m"}, "CODE": {"repo": "r"}}
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "doc-a.json").write_text(json.dumps([{"source_type": "QA", "title": "a"}, {"source_type": "QA", "title": "b"}]))
    (docs / "doc-b.json").write_text("{broken")
    (docs / "doc-c.json").write_text(json.dumps({"title": "no list"}))
    assert [(r.file, r.pos, r.title) for r in readers.merged_candidates(spark, str(docs)).orderBy("pos").collect()] == [("doc-a.json", 0, "a"), ("doc-a.json", 1, "b")]
    assert readers.candidates(spark, str(docs / "doc-c.json")).first().title == "no list"
    (tmp_path / "chat.json").write_text(json.dumps({"result": {"hasMore": True, "nextCursor": "n", "conversationMessagesList": [{"openConversationId": "c", "messages": [{"openMessageId": "m", "content": "hi"}]}]}}))
    m = readers.chat_messages(spark, str(tmp_path / "chat.json")).first()
    assert (m.msg_id, m.conversation_id, m.single_chat, m.has_more) == ("m", "c", False, True)
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("x = 1")
    (src / "node_modules" / "b.js").write_text("x")
    (src / "c.txt").write_text("x")
    assert [r.file_path for r in readers.source_files(spark, str(src), "r", "c").collect()] == ["a.py"]
    (tmp_path / "web.log").write_text("a\nb")
    assert [(r.pod, r.ln, r.line) for r in readers.log_lines(spark, str(tmp_path / "web.log")).orderBy("ln").collect()] == [("web", 0, "a"), ("web", 1, "b")]
    long = [f"line {k} " + "x" * (k % 50) for k in range(5000)]
    (tmp_path / "big-1-a.log").write_text("\n".join(long) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits of one file
    try:
        got = readers.log_lines(spark, str(tmp_path / "*.log")).where("pod = 'big-1-a'").orderBy("ln").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in got] == long and [r.ln for r in got] == list(range(5000))
    (docs / "x.md").write_text("# T\nbody")
    (docs / "y.md").write_text(" ")
    assert [(r.file, r.chars) for r in readers.documents(spark, str(docs)).collect()] == [("x.md", 8)]
    pages = tmp_path / "pages"
    pages.mkdir()
    for k, more in ((0, True), (1, False), (2, True)):
        (pages / f"{k}.json").write_text(json.dumps({"page": k, "hasMore": more, "nextPageToken": "t", "documents": [{"nodeId": f"n{k}", "name": "x"}]}))
    assert [r.nodeId for r in readers.doc_pages(spark, str(pages)).orderBy("page").collect()] == ["n0", "n1"]
    other = tmp_path / "more"
    other.mkdir()
    for k, more in ((0, False), (1, True)):
        (other / f"{k}.json").write_text(json.dumps({"page": k, "hasMore": more, "nextPageToken": "t", "documents": [{"nodeId": f"m{k}", "name": "x"}]}))
    both = readers.doc_pages(spark, [str(pages), str(other)]).collect()
    assert sorted(r.nodeId for r in both) == ["m0", "n0", "n1"] and len({r.search for r in both}) == 2


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([("2024-01-02T00:00:00.000Z", 1, "classify", "a", "cli", None, None, None, "r", {"k": "v"}, 1)], schemas.AUDIT)
    writers.append_audit(rec, str(tmp_path / "audit"), "2024-01-03T00:00:00.000Z")
    (tmp_path / "audit" / "date=2024-01-02" / "bad.json").write_text("{oops\n")
    back = readers.audit(spark, str(tmp_path / "audit"), "2024-01-02").collect()
    assert [r.detail for r in back if r.event] == [{"k": "v"}]
    writers.write_edges(spark.createDataFrame([("a", "b", "QA_CODE")] * 2, schemas.EDGE), str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 1


def test_undo_and_announcements(spark):
    snaps = spark.createDataFrame([("AI-1", "doc")], "action_id string, kind string")
    r = policy.inverse_intents(snaps, "cli", NOW).first()
    assert r.argv == ["cli", "undo", "AI-1"] and r.meta["restore_kind"] == "doc" and r.semantic_labels.commit_class == "maybe"
    assert validate.intent_errors(policy.inverse_intents(snaps, "cli", NOW), "cli").first().errors == []
    t = spark.createDataFrame([(" Fix ", "main", 7), (None, None, None)], "title string, target_branch string, issue long")
    got = [x[0] for x in t.select(ops.announcement("helper")).collect()]
    assert "feedback#7 《Fix》" in got[0] and "→ main" in got[0] and "(无标题)" in got[1]


def test_small_decisions(spark):
    p = spark.createDataFrame([("a", "200", "x", ""), ("b", "404", "elb", ""), ("c", "000", "", "")], "host string, code string, server string, router string")
    assert {r.host: r.verdict for r in logs.diagnose(p).collect()} == {"a": "reachable", "b": "gateway_route_missing", "c": "unreachable"}
    rows = spark.createDataFrame([("1", "Web"), ("2", "web"), ("3", "Api")], "id string, name string")
    ask = spark.createDataFrame([("1",), ("API",), ("web",), ("none",)], "query string")
    assert {r.query: (r.id, r.error) for r in validate.resolve_by_name(rows, ask).collect()} == {"1": ("1", None), "API": ("3", None), "web": (None, "ambiguous"), "none": (None, "not_found")}


def test_fetched_documents(spark, tmp_path):
    names = "nodeId string, name string, createTime string"
    found = spark.createDataFrame([("node-0001-x", "Plan: Q1/Ü", "t1"), ("node-0001-x", "Plan: Q1/Ü", "t1"), ("n2", "", None), ("n3", "blank", "t3"), (None, "no id", "t4"), ("n5", "gone", "t5")], names)
    bodies = spark.createDataFrame([("node-0001-x", "# A\nb"), ("n2", "two"), ("n3", " \n"), (None, "x")], "nodeId string, text string")
    rows = readers.fetched_documents(found, bodies)
    writers.write_documents(rows, str(tmp_path / "docs"))
    held = spark.read.schema("node_id string, name string, file string, create_time string, chars int").json(str(tmp_path / "docs" / "manifest"))
    assert sorted(map(tuple, held.collect())) == [("n2", "n2", "n2_n2.md", None, 3), ("node-0001-x", "Plan: Q1/Ü", "Plan__Q1_Ü_node-000.md", "t1", 5)]
    assert {r.node_id: r.text for r in spark.read.parquet(str(tmp_path / "docs" / "bodies")).collect()} == {"node-0001-x": "# A\nb", "n2": "two"}
    assert readers.fetched_documents(found.limit(0), bodies).count() == 0


def test_actions_table(spark):
    held = spark.createDataFrame([("a", "R2", "HUMAN_CONFIRM", "draft", "t0", "t0"), ("z", "R0", "AUTO", "execute", "t0", "t0")], schemas.ACTION)
    batch = spark.createDataFrame([("a", "R2", "HUMAN_CONFIRM", "execute"), ("b", None, "DENY", "denied"), ("b", None, "DENY", "denied"), (None, "R0", "AUTO", "execute")], "action_id string, level string, decision string, status string")
    got = sorted(map(tuple, policy.record_actions(held, batch, "t1").collect()))
    assert got == [("a", "R2", "HUMAN_CONFIRM", "execute", "t0", "t1"), ("b", None, "DENY", "denied", "t1", "t1"), ("z", "R0", "AUTO", "execute", "t0", "t0")]
    assert policy.record_actions(held.limit(0), batch.limit(0), "t1").count() == 0
