"""Paged search against a local stub, info and bodies, and ingestion in one pass."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlparse
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.functions import redaction
from lorekeep.operators import ingest
from lorekeep.sources import search

#: Pages of a search by its query: numbers of documents; what ends them.
SEARCHES = {"long": [2] * 40, "one": [3], "none": [0], "hole": [2, 0, 2], "no token": [2, 2], "odd": [2]}


@pytest.fixture(scope="module")
def stub():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            calls.append(q)
            pages, at = SEARCHES[q["query"]], int(q.get("cursor", 0))
            docs = [{"nodeId": f"{q['query']}-{at}-{i}", "name": f"n{i}", "extension": "adoc" if i else "pdf"} for i in range(min(pages[at], int(q["limit"])))]
            docs = [d for d in docs if q.get("extensions") in (None, d["extension"])]
            more = at + 1 < len(pages)
            body = {"documents": docs or None, "hasMore": more, "nextPageToken": str(at + 1) if more and q["query"] != "no token" else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps("text" if q["query"] == "odd" else body).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", calls
    server.shutdown()


def client(url):
    def fetch(params):
        with urlopen(url + "?" + urlencode({k: v for k, v in params.items() if v is not None}), timeout=10) as r:
            return json.loads(r.read())

    return fetch


def test_searches_are_paged(spark, stub):
    url, calls = stub
    df = search.search_documents(spark, [{"name": q, "query": q} for q in SEARCHES], client(url))
    assert df.columns[:3] == ["search", "page", "nodeId"] and df.rdd.getNumPartitions() == len(SEARCHES)
    got = {r.search: (r.n, r.pages) for r in df.groupBy("search").agg(F.count("*").alias("n"), (F.max("page") + 1).alias("pages")).collect()}
    assert got == {"long": (60, 30), "one": (3, 1), "hole": (4, 3), "no token": (2, 1)}  # 30 pages at most; an empty page goes on
    assert search.search_documents(spark, [{"query": "long"}], client(url), max_pages=31).count() == 62
    calls.clear()
    assert df.where("search = 'one'").count() == 3 and {c["query"] for c in calls} == {"one"}
    calls.clear()
    assert df.where("search IN ('one', 'hole') AND extension = 'adoc'").count() == 4 and {c.get("extensions") for c in calls} == {"adoc"}
    calls.clear()
    few = search.search_documents(spark, [{"name": "a", "query": "long"}], client(url), rows=5).collect()
    assert [r.page for r in few] == [0, 0, 1, 1, 2] and len(calls) == 3 and calls[-1]["limit"] == "1"


def test_info_and_bodies(spark):
    found = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (" ",), (None,)], "nodeId string")
    texts = {"a": "# A", "b": {"content": "", "markdown": "B"}}
    got = {r.nodeId: (r.text, r.error) for r in search.document_bodies(found, lambda n: texts[n]).collect()}
    assert got == {"a": ("# A", None), "b": ("B", None), "c": (None, "KeyError: 'c'")}
    info = {r.nodeId: (r.contentType, r.error) for r in search.document_info(found, lambda n: {"contentType": "ALIDOC"} if n == "a" else [n]).collect()}
    assert info == {"a": ("ALIDOC", None), "b": (None, None), "c": (None, None)}


def test_one_pass_reports_what_it_drops(spark, tmp_path, monkeypatch):
    good = redaction.find
    monkeypatch.setattr(redaction, "find", lambda text, scan=True: 1 / 0 if "boom" in (text or "") else good(text, scan))
    ref, bad = [("DOC_ID", "d", "q", None, None)], [("DOC_ID", "d", "boom quote", None, None)]
    body = "call 13812345678 and more"
    rows = [("QA", "t", "fine", ref), ("QA", "t2", body, ref), ("odd", "t", "b", ref), ("QA", " ", "b", ref), ("QA", "t", "", ref), ("QA", "t", "b", []), ("QA", "x" * 200, "boom", ref), ("QA", "t", "b", bad)]
    df = spark.createDataFrame(rows, "source_type string, title string, body string, provenance array<struct<kind:string,ref:string,quote:string,quote_taint:string,captured_at:string>>")
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    full = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANDIDATE])
    out, counts = ingest.ingest_once(full, "2024-01-01T00:00:00Z")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out.write.partitionBy("drop_reason").parquet(str(tmp_path / "out"))
    fired = counts.get
    assert dict(ingest.ingest_report(fired)) == {"bad_source_type": 1, "empty_title": 1, "empty_body": 1, "no_provenance": 1, "build_error": 2, "ok": 2} and fired["redacted"] == 1
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.drop_note, len(r.title)) for r in got.where("drop_reason = 'build_error'").orderBy(F.length("title")).collect()] == [("ZeroDivisionError", 1), ("ZeroDivisionError", 120)]
    assert got.where("ku_id IS NOT NULL").count() == got.where("drop_reason = 'ok'").count() == 2 and got.where("drop_reason <> 'ok' AND body IS NOT NULL").count() == 0
    units, report = ingest.ingest(full, "2024-01-01T00:00:00Z")
    assert sorted(r.ku_id for r in units.collect()) == sorted(r.ku_id for r in got.where("ku_id IS NOT NULL").collect())
