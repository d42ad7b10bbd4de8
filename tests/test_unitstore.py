"""Rows by id in buckets: upserts, look-ups without a shuffle, torn writes, the inventory."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import store
from lorekeep.operators.unitstore import UnitStore
from lorekeep.sources.versions import Folder

UNITS = "ku_id string, source_type string, authority string, freshness string, serve_blocked boolean, public_ok boolean, created_at string, n int"


def batch(spark, r, size, now, ids=400):
    kinds = ("CODE", "QA", "ISSUE")
    rows = [(f"K{r.randrange(ids)}", r.choice(kinds), r.choice(("DRAFT", "REVIEWED")), r.choice(("FRESH", "STALE", None)), r.random() < 0.3, r.random() < 0.5, f"t{now:03}", r.randrange(10**6)) for _ in range(size)]
    return spark.createDataFrame(rows, UNITS)


def rows(df):
    return sorted(map(repr, map(tuple, df.select("ku_id", "source_type", "authority", "freshness", "serve_blocked", "public_ok", "created_at", "n").collect())))


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    r, s = random.Random(1), UnitStore(spark, str(tmp_path / "units"))
    first = store.last_of_each(batch(spark, r, 500, 0), ["ku_id"], "n").cache()
    s.create(first, 16)
    want = first
    for now in range(1, 4):
        new = batch(spark, r, 6, now, 5000).cache()
        touched = {x[0] for x in new.select(F.pmod(F.hash("ku_id"), F.lit(16))).distinct().collect()}
        want = store.upsert(want, new, "ku_id", "n").cache()
        state = s.upsert(new, "n")
        written = [f for f in os.listdir(f"{s.folder.path}/{state['generations'][-1]}") if f.endswith(".parquet")]
        assert 0 < len(written) <= len(touched) < 16
        assert rows(s.read()) == rows(want)
    before = rows(s.read())
    state = s.compact()
    assert state["generations"] and len(state["generations"]) == 1 and rows(s.read()) == before
    s.folder.keep_only(set(state["generations"]))
    assert rows(s.read()) == before and s.upsert(first.limit(0))["version"] == state["version"]


def test_look_ups_do_not_shuffle_the_store(spark, tmp_path):
    r, s = random.Random(2), UnitStore(spark, str(tmp_path / "units"))
    s.create(store.last_of_each(batch(spark, r, 300, 0), ["ku_id"], "n"), 8)
    s.upsert(batch(spark, r, 5, 1), "n")
    hits = spark.createDataFrame([(f"K{i}", i) for i in range(50)], "ku_id string, hit int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = s.read().join(hits, "ku_id")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == s.read().where("cast(substr(ku_id, 2) as int) < 50").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan


def test_torn_writes_and_rival_writers(spark, tmp_path, monkeypatch):
    r, path = random.Random(3), str(tmp_path / "units")
    s = UnitStore(spark, path)
    s.create(store.last_of_each(batch(spark, r, 100, 0), ["ku_id"], "n"), 4)
    before = rows(s.read())
    monkeypatch.setattr(Folder, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.upsert(batch(spark, r, 50, 1), "n")
    monkeypatch.undo()
    assert rows(s.read()) == before
    state = s.folder.state()
    s.upsert(batch(spark, r, 5, 2), "n")
    with pytest.raises(RuntimeError):
        s.folder.publish(state, state["version"])
    with pytest.raises(FileNotFoundError):
        UnitStore(spark, str(tmp_path / "nowhere")).read()


def test_inventory_follows_the_upserts(spark, tmp_path):
    r, s = random.Random(4), UnitStore(spark, str(tmp_path / "units"))
    s.create(store.last_of_each(batch(spark, r, 60, 0), ["ku_id"], "n"), 4)
    for now in range(1, 13):
        s.upsert(batch(spark, r, r.randrange(1, 30), now), "n")
    count = lambda df: sorted(tuple(x) for x in df.select("kind", "value", "n").collect())
    assert count(s.inventory()) == count(store.inventory(s.read()))
