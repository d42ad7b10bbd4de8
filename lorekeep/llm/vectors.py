"""Helpers of the two vector operators: rows that count, whole-number components, blocks of rows, the first rows of an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, need

#: Components, as whole numbers, may be this large at most, so that distances and sums stay exact in 64 bits.
LIMIT = 1 << 26


def kept(df: DataFrame, dims: int, vector: str, *names: str) -> DataFrame:
    """``names`` and ``vector`` (array<double>) of the rows whose vector has ``dims`` components, none null, NaN or infinite."""
    v = F.col(f"`{vector}`")
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return need(df, *names, vector).where(F.coalesce(fine, F.lit(False))).withColumn(vector, v.cast("array<double>"))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; an error beyond LIMIT."""
    out = np.floor(values * scale)
    if len(out) and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component beyond {LIMIT} / {scale} can't be reckoned exactly")
    return out.astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows each, the last of fewer."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(column: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """Rows of whole-number components."""
    flat = column.combine_chunks().flatten()
    return whole_numbers(flat.to_numpy(zero_copy_only=False), scale).reshape(-1, dims)


def first_rows(df: DataFrame, order: list[Column], vector: str, count: int, scale: int) -> np.ndarray:
    """Vectors of the first ``count`` rows in the order, as whole numbers: all that comes to the driver."""
    got = df.orderBy(*order, vector).limit(count).select(vector).collect()
    return np.stack([whole_numbers(np.array(r[0]), scale) for r in got]) if got else np.zeros((0, 0), np.int64)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """``fn`` yields {column: values} for ``schema``."""
    arrow = to_arrow_schema(schema)
    bound_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def floor_means(old: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Every entry that has rows becomes the componentwise floor of its sum by its count; the others stay."""
    new = old.copy()
    for k, (n, total) in sums.items():
        new[k] = [s // n for s in total]
    return new
