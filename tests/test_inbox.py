"""The inbox as a stateful stream: repeats, restarts, late and expired ids, and batches that cost the same however many came before."""

import json
import statistics
import time

import pytest

from lorekeep.policy_data import default_policy
from lorekeep.streaming import inbox

GOOD = {
    "action_id": "AI-20240101-0000000a", "created_at": "2024-01-01T00:00:00Z", "source": "cli", "argv": ["cli", "chat", "message", "list"],
    "semantic_labels": {"commit_class": "maybe", "taint": "CLEAN", "public_ok": False},
}


@pytest.fixture(autouse=True)
def few_states(spark):
    """A state store for each partition: two will do."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, tmp_path, **options):
    q = inbox.run_inbox(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), default_policy(), "cli", **options)
    q.awaitTermination(120)
    assert not q.isActive
    return q


def put(tmp_path, n, number, **change):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{n:04}.json").write_text(json.dumps(GOOD | {"action_id": f"AI-20240101-{number:08x}"} | change))


def handled(spark, tmp_path):
    return sorted((r.action_id, r.created_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_ids_are_handled_once(spark, tmp_path):
    for n, (number, at) in enumerate(((1, "05"), (1, "03"), (2, "01"), (1, "04"))):  # of one batch the first created
        put(tmp_path, n, number, created_at=f"2024-01-{at}T00:00:00Z")
    run(spark, tmp_path)
    a, b, c = (f"AI-20240101-{n:08x}" for n in (1, 2, 3))
    assert handled(spark, tmp_path) == [(a, "2024-01-03T00:00:00Z"), (b, "2024-01-01T00:00:00Z")]
    put(tmp_path, 10, 1, created_at="2023-01-01T00:00:00Z")  # late: created long before what has been handled
    put(tmp_path, 11, 3, created_at="2022-01-01T00:00:00Z")
    run(spark, tmp_path)  # a restart: the states come back with the checkpoint
    assert [x for x, _ in handled(spark, tmp_path)] == [a, b, c]


def test_ids_expire(spark, tmp_path):
    put(tmp_path, 0, 1)
    run(spark, tmp_path, keep_days=1 / 86_400)
    time.sleep(1.2)
    put(tmp_path, 1, 2)  # the batch with which the first id's state goes
    run(spark, tmp_path, keep_days=1 / 86_400)
    put(tmp_path, 2, 1, created_at="2024-02-01T00:00:00Z")
    run(spark, tmp_path, keep_days=1 / 86_400)
    assert [x for x, _ in handled(spark, tmp_path)].count("AI-20240101-00000001") == 2


def test_batches_cost_the_same(spark, tmp_path):
    for n in range(24):
        put(tmp_path, n, n % 20)
    q = run(spark, tmp_path, files_a_batch=1)
    took = [p["batchDuration"] for p in q.recentProgress if p["numInputRows"]]
    assert len(took) == 24 and len(handled(spark, tmp_path)) == 20
    assert statistics.median(took[-8:]) < 1.5 * statistics.median(took[4:12])


def test_time_is_not_spent_on_ids_one_by_one(spark, tmp_path):
    def land(n, ids):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n:04}.json").write_text(json.dumps([GOOD | {"action_id": f"AI-20240101-{i:08x}"} for i in ids]))

    land(0, range(10))
    run(spark, tmp_path)
    land(1, range(10, 20))
    few = run(spark, tmp_path).lastProgress["batchDuration"]
    land(2, range(15, 60_000))
    many = run(spark, tmp_path).lastProgress["batchDuration"]
    assert [x for x, _ in handled(spark, tmp_path)] == [f"AI-20240101-{i:08x}" for i in range(60_000)]
    assert many < 4 * few + 4_000


def test_first_of_equal_times_is_the_least_as_text(spark, tmp_path):
    for n, source in enumerate(("work", "test", "cli", "triage") * 30):
        put(tmp_path, n, n % 3, source=source)
    put(tmp_path, 200, 7, source=None)
    (tmp_path / "in" / "201.json").write_text(json.dumps([GOOD | {"action_id": None}, GOOD | {"action_id": ""}]))
    run(spark, tmp_path)
    rows = [(r.action_id, r.source, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted((a, s, t) for a, s, t in rows if a and s) == [(f"AI-20240101-{i:08x}", "cli", "execute") for i in range(3)]
    assert sorted((a or "", t) for a, s, t in rows if not a or not s) == [("", "invalid"), ("AI-20240101-00000007", "invalid")]
