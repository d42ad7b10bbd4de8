"""Shared helpers: reading tables, walking Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut, shared_dir  # noqa: F401  used by the operators' modules
from ..sources.tables import table  # noqa: F401

BATCH_BYTES = 4 << 20

#: A-Z folded, every other ASCII sign that is no digit or letter a space, other bytes kept.
_WORDS = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))
#: The same, with line ends kept.
_LINES = _WORDS[:10] + b"\n" + _WORDS[11:]


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z folded, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def ascii_word_lines(text: str | None) -> list[list[bytes]]:
    """``ascii_words`` of each line."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").translate(_LINES).split(b"\n")]


def joined_ascii_words(texts: list[str | None], size: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """Texts as in ``ascii_words``, not split, joined by spaces up to about ``size`` bytes: first index, bytes, starts."""
    first, parts, starts, at = 0, [], [], 0
    for n, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").translate(_WORDS)
        if parts and at + len(raw) > size:
            yield first, b" ".join(parts), starts
            first, parts, starts, at = n, [], [], 0
        parts.append(raw)
        starts.append(at)
        at += len(raw) + 1
    if parts:
        yield first, b" ".join(parts), starts


def bound_batches(df: DataFrame) -> None:
    """Long rows: a batch is bounded by its bytes, on both sides of the pipe, whatever the number of its rows. The setting is
    read when the plan runs, so it stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str | T.StructType) -> DataFrame:
    """``fn`` takes an iterator of {column: list} and yields the same for ``schema``; values cross in Arrow batches."""
    spec = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df)
    arrow = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spec)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; extra ones, whatever their names, don't reach the operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])
