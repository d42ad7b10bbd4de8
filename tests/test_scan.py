"""Rankings without blocks: the rows of whole rankings, and what moves is bounded by the queries, not by their postings."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import retrieve, scan, segments

from .test_segments import equal, some_queries, some_units


@pytest.mark.parametrize("postings, queries", [(1 << 21, 1 << 14), (300, 5)])
def test_rankings_are_those_of_all_units(spark, tmp_path, monkeypatch, postings, queries):
    monkeypatch.setattr(scan, "BLOCK_QUERIES", queries)
    held = scan.SLICE
    scan.SLICE = postings
    try:
        units, asked, path = some_units(spark), some_queries(spark), str(tmp_path / "ix")
        segments.write_index(units, path, blocks=False)
        for k in (1, 20):
            equal(spark, path, units, asked, k)
        new = some_units(spark, 4, seed=10, first=60).limit(4)
        segments.refresh_index(new, path)
        units = units.join(new.select("ku_id"), "ku_id", "left_anti").select(*new.columns).union(new).cache()
        equal(spark, path, units, asked)
        segments.merge_index(spark, path)
        assert segments.open_index(spark, path).blocks is None
        equal(spark, path, units, asked)
    finally:
        scan.SLICE = held


def moved(spark, df):
    """Rows that the exchanges of a plan have written."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            todo.append(p.plan())
        else:
            if p.nodeName() == "Exchange":
                out += p.metrics().apply("shuffleRecordsWritten").value()
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def test_what_many_queries_move_is_k_rows_a_task(spark, tmp_path):
    """2,000 units and 200 queries with common words: 400,000 pairs share one."""
    r = random.Random(2)
    word = lambda: "w" + str(r.randrange(12))
    units = spark.createDataFrame([(f"K{i}", word(), None, " ".join(word() for _ in range(8))) for i in range(2000)], "ku_id string, title string, symbol string, body string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(8))) for i in range(200)], "query_id string, query string")
    segments.write_index(units, str(tmp_path / "ix"), blocks=False)
    best = segments.bm25_best(segments.open_index(spark, str(tmp_path / "ix")), asked, 5)
    assert moved(spark, best) <= 200 * 5 * 3 * spark.sparkContext.defaultParallelism


def test_term_counts(spark):
    units = spark.createDataFrame([("a", "x X y"), ("b", "x 中文字"), ("c", None), ("d", "")], "ku_id string, body string")
    want = [("x", 2, 3), ("y", 1, 1), ("中文", 1, 1), ("文字", 1, 1)]
    got = scan.term_counts(units, "body")
    assert sorted(map(tuple, got.collect())) == want
    assert moved(spark, got) <= 5  # a row a term and task, not one a term and unit


def test_texts_are_joined_to_the_best_only(spark):
    """The rows that are ranked hold no texts."""
    body = "w " * 50
    units = spark.createDataFrame([(f"K{i}", "w", None, body, "r", "FRESH", "REVIEWED", "CLEAN", False, "QA") for i in range(40)], "ku_id string, title string, symbol string, body string, repo string, freshness string, authority string, taint string, serve_blocked boolean, source_type string")
    asked = spark.createDataFrame([("q", "w")], "query_id string, query string")
    got = retrieve.retrieve(units, asked, {"top_n": 3})
    assert [r.ku_id for r in got.orderBy("rank").collect()] == ["K0", "K1", "K10"] and got.first().body == body
    text = got._jdf.queryExecution().optimizedPlan().toString()
    ranked = next(x for x in text.splitlines() if "row_number" in x and "fused" in x)
    assert "body" not in ranked
    assert got.select(F.max("lexical_overlap")).first()[0] == 1.0
