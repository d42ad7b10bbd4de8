"""The stored index: segments, refreshes, merges, and the pruned rankings against whole ones."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.text import token_set
from lorekeep.operators import index, segments
from lorekeep.sources.versions import Folder


def some_units(spark, n=400, seed=1, first=0):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(4000)]
    rows = [(f"K{first + i}", f"t{r.randrange(9)}", None, "the " * (i % 7 > 0) + " ".join(r.choices(words, k=r.choice((0, 3, 20, 90))))) for i in range(n)]
    rows += [(f"K{first + n + i}", "same", "sym", "the copy of w1 w2") for i in range(30)]
    return spark.createDataFrame(rows, "ku_id string, title string, symbol string, body string")


def some_queries(spark):
    r = random.Random(5)
    rows = [(f"q{i}", "the " + " ".join(f"w{int(r.paretovariate(0.8))}" for _ in range(r.choice((1, 4, 25))))) for i in range(12)]
    return spark.createDataFrame(rows + [("stop", "the the"), ("none", "nowhere"), ("empty", ""), ("same", "same sym copy of"), ("blank", None)], "query_id string, query string")


def whole_bm25(units, queries, k):
    from pyspark.sql import Window as W

    got = index.bm25(index.lexical_index(units), queries)
    return got.withColumn("lex_rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "ku_id"))).where(F.col("lex_rank") <= k)


def whole_jaccard(units, queries, k):
    sets = {r[0]: set(r[1]) for r in units.select("ku_id", token_set(index.unit_text())).collect()}
    out = []
    for q, t in queries.select("query_id", token_set("query")).collect():
        best = sorted((-len(s & set(t)) / len(s | set(t)), u) for u, s in sets.items() if s & set(t))[:k]
        out += [(q, u, round(-j, 9), n + 1) for n, (j, u) in enumerate(best)]
    return sorted(out)


def equal(spark, path, units, queries, k=20):
    ix = segments.open_index(spark, path)
    want = sorted(map(tuple, whole_bm25(units, queries, k).collect()))
    assert sorted(map(tuple, segments.bm25_best(ix, queries, k).select("query_id", "ku_id", "score", "lex_rank").collect())) == want and want
    got = sorted((q, u, round(j, 9), n) for q, u, j, n in segments.jaccard_best(ix, queries, k).collect())
    assert got == whole_jaccard(units, queries, k)


@pytest.mark.parametrize("postings, blocks, bits", [(4096, 256, 7), (5, 3, 2), (40, 256, 0)])
def test_rankings_are_those_of_all_units(spark, tmp_path, monkeypatch, postings, blocks, bits):
    monkeypatch.setattr(segments, "SEED_POSTINGS", postings)
    monkeypatch.setattr(segments, "SEED_BLOCKS", blocks)
    monkeypatch.setattr(segments, "SLOT_BITS", bits)
    units, queries = some_units(spark), some_queries(spark)
    segments.write_index(units, str(tmp_path / "ix"))
    for k in (1, 20) if bits == 2 else (20,):
        equal(spark, str(tmp_path / "ix"), units, queries, k)


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_refreshes_and_a_merge(spark, tmp_path):
    path, queries = str(tmp_path / "ix"), some_queries(spark)
    units = some_units(spark).cache()
    segments.write_index(units, path)
    for n in range(3):
        before = files(path)
        new = some_units(spark, 4, seed=10 + n, first=60 * n).limit(4).union(some_units(spark, 1, seed=20 + n, first=5000 + n).limit(1)).cache()
        gone = spark.createDataFrame([(f"K{300 + n}",), ("never there",)], "ku_id string")
        state = segments.refresh_index(new, path, gone)
        after = files(path)
        assert set(before) < set(after) and state["version"] == n + 2 and state["dead"][-1]["units"] == 5 and state["segments"][-1]["units"] == 5
        units = units.join(new.select("ku_id").union(gone), "ku_id", "left_anti").select(*new.columns).union(new).cache()
        if n:
            equal(spark, path, units, queries)
    spread = segments.open_index(spark, path)
    assert spread.n_docs == units.count() and spread.terms.groupBy("term").agg(F.sum("df").alias("df")).where("df < 0").count() == 0
    state = segments.merge_index(spark, path)
    assert len(state["segments"]) == 1 and state["dead"] == [] and state["segments"][0]["units"] == units.count()
    equal(spark, path, units, queries)
    Folder(spark, path).keep_only({x["name"] for x in state["segments"]})
    assert len([n for n in os.listdir(path) if not n.startswith(".")]) == 2
    equal(spark, path, units, queries)


def test_a_refresh_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path, units, queries = str(tmp_path / "ix"), some_units(spark, 50), some_queries(spark)
    segments.write_index(units, path)
    monkeypatch.setattr(segments, "_write_segment", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        segments.refresh_index(units.limit(3), path)
    equal(spark, path, units, queries)
    folder = Folder(spark, path)
    folder.publish({"segments": []}, folder.version())
    with pytest.raises(RuntimeError):
        folder.publish({"segments": []}, folder.version() - 1)


def test_units_without_rows(spark, tmp_path):
    units = some_units(spark).limit(0)
    segments.write_index(units, str(tmp_path / "ix"))
    ix = segments.open_index(spark, str(tmp_path / "ix"))
    assert segments.bm25_best(ix, some_queries(spark), 5).count() == segments.jaccard_best(ix, some_queries(spark), 5).count() == 0
    with pytest.raises(FileNotFoundError):
        segments.open_index(spark, str(tmp_path / "nowhere"))


def test_stop_words_are_left_closed(spark, tmp_path, monkeypatch):
    """A word of four units in five, asked together with rare ones: a tenth of its postings at most is opened. Slots are small
    as the corpus is."""
    monkeypatch.setattr(segments, "SLOT_BITS", 3)
    r = random.Random(3)
    rows = [(f"K{i}", "", None, "the " * (i % 5 > 0) + " ".join(f"v{r.randrange(3000)}" for _ in range(12))) for i in range(20_000)]
    units = spark.createDataFrame(rows, "ku_id string, title string, symbol string, body string")
    queries = spark.createDataFrame([(f"q{i}", "the " + " ".join(f"v{r.randrange(3000)}" for _ in range(4))) for i in range(5)], "query_id string, query string")
    segments.write_index(units, str(tmp_path / "ix"))
    ix, seen = segments.open_index(spark, str(tmp_path / "ix")), []
    got = segments.bm25_best(ix, queries, 20, seen)
    assert sorted(map(tuple, got.select("query_id", "ku_id", "score", "lex_rank").collect())) == sorted(map(tuple, whole_bm25(units, queries, 20).collect()))
    opened = Counter()
    for _, df in seen[:2]:
        for r in df.where("term = 'the'").groupBy("query_id").agg(F.sum("n").alias("n")).collect():
            opened[r.query_id] += r.n
    assert max(opened.values(), default=0) <= 16_000 / 10, opened
    seen = []
    got = segments.jaccard_best(ix, queries, 20, seen)
    assert sorted((q, u, round(j, 9), n) for q, u, j, n in got.collect()) == whole_jaccard(units, queries, 20)
    assert seen[1][1].where("term = 'the'").count() == 0 and seen[2][1].count() < 5 * 20_000 / 10
    assert math.isclose(ix.n_tokens, 20_000 * 12 + 16_000)
