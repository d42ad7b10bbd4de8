"""Paged document search, and info and bodies of what it finds, as Spark sources over any client.

A client is a function that takes the call's parameters and returns the decoded answer; it is shipped to the executors, which
call it. Every search is a partition of its own, so searches run side by side and a lost executor repeats only its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .. import schemas

SCHEMA = StructType([*schemas.parse("search string, page int").fields, *schemas.DOC_PAGE["documents"].dataType.elementType.fields])

Page = Callable[[dict], object]


class Search(InputPartition):
    def __init__(self, name: str, params: dict, pages: int, page_size: int, rows: int | None):
        super().__init__(name)
        self.name, self.params, self.pages, self.page_size, self.rows = name, params, pages, page_size, rows


class SearchReader(DataSourceReader):
    def __init__(self, fetch: Page, searches: list[dict], pages: int, page_size: int, rows: int | None):
        self.fetch, self.pages, self.page_size, self.rows = fetch, pages, page_size, rows
        self.searches = {str(x.get("name", n)): {k: v for k, v in x.items() if k != "name" and v is not None} for n, x in enumerate(searches)}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Searches that a filter on ``search`` rules out aren't made; a single asked-for extension goes into the call."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("search",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.searches = {k: v for k, v in self.searches.items() if k in wanted}
            elif isinstance(f, EqualTo) and f.attribute == ("extension",):
                for v in self.searches.values():
                    v.setdefault("extensions", f.value)
                yield f  # the service may not know it: Spark filters as well
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Search(k, v, self.pages, self.page_size, self.rows) for k, v in self.searches.items()]

    def read(self, partition: Search) -> Iterator[tuple]:
        """Page by page, until a page says it is the last, has no token for the next, isn't an object, or the pages or rows asked
        for are there. Of a search whose rows are limited no page is asked for beyond them."""
        token, left = None, partition.rows
        columns = [f.name for f in SCHEMA.fields[2:]]
        for page in range(partition.pages):
            if left is not None and left <= 0:
                return
            size = partition.page_size if left is None else min(partition.page_size, left)
            got = self.fetch(partition.params | {"limit": size, "cursor": token})
            if not isinstance(got, dict):
                return
            for d in (got.get("documents") or [])[:left]:
                yield (partition.name, page, *[d.get(c) for c in columns])
            left = None if left is None else left - len(got.get("documents") or [])
            token = got.get("nextPageToken")
            if not got.get("hasMore") or not token:
                return


def search_documents(spark: SparkSession, searches: list[dict], fetch: Page, max_pages: int = 30, page_size: int = 30, rows: int | None = None) -> DataFrame:
    """search, page and the documents' columns. searches: parameters of the calls (query, creatorUids, extensions) and an optional
    name each; ``rows``: at most so many documents a search."""

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return "document_search"

        def schema(self) -> StructType:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            o = self.options
            return SearchReader(fetch, json.loads(o["searches"]), int(o["maxpages"]), int(o["pagesize"]), int(o["rows"]) if o.get("rows") else None)

    # asked for when a plan is made, so it stays on
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
    reader = spark.read.format("document_search").option("searches", json.dumps(searches)).option("maxpages", str(max_pages)).option("pagesize", str(page_size))
    return (reader.option("rows", str(rows)) if rows else reader).load()


def _called(found: DataFrame, call: Callable[[str], str | None], column: str) -> DataFrame:
    """nodeId and what the client returns for it, each id once; a call that fails gives its error and no value."""
    ids = found.select("nodeId").where(F.trim("nodeId") != "").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values, errors = b["nodeId"].to_pylist(), [], []
            for node in ids:
                try:
                    value, error = call(node), None
                except Exception as e:  # one document must not fail the others
                    value, error = None, f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, values, errors)], names=["nodeId", column, "error"])

    return ids.mapInArrow(run, f"nodeId string, {column} string, error string")


def document_info(found: DataFrame, info: Callable[[str], object]) -> DataFrame:
    """nodeId, contentType, extension, name, error: what decides whether a document can be read. Answers that aren't objects count
    as empty ones."""
    as_text = lambda node: json.dumps(x if isinstance(x := info(node), dict) else {})
    got = _called(found, as_text, "info").withColumn("i", F.from_json("info", "contentType string, extension string, name string"))
    return got.select("nodeId", "i.*", "error")


def document_bodies(found: DataFrame, read: Callable[[str], object]) -> DataFrame:
    """nodeId, text, error: an answer's text, or the content or else the markdown of an object."""

    def text(node: str) -> str | None:
        got = read(node)
        return got if isinstance(got, str) else (got.get("content") or got.get("markdown")) if isinstance(got, dict) else None

    return _called(found, text, "text")
