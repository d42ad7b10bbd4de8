"""Codebooks for vectors cut into parts, learned by filtering Lloyd rounds (operator 12).

Vectors are turned into whole numbers, gathered in blocks of BLOCK rows as they lie, and cut into PARTS equal consecutive
parts. Every block gets a kd-tree over each of its parts once: a node knows the box, sum and count of the parts under it and
is halved at the median of its longest side, down to LEAF parts or to parts that are all equal. The blocks with their trees are
kept in the shared folder, so a round reads them in one narrow pass.

A round walks each tree from the top, level by level, with a set of candidate entries for each node. The candidate nearest to
the box's middle eliminates every other one that is no nearer at the corner of the box that suits that one best (if both are
equally near there, the lower index stays). A node with one candidate left is assigned whole, by its cached sum and count; the
parts of a leaf are compared exactly with the candidates left to the leaf. All of it is whole numbers, so results are exact. A
task adds up its blocks and sends one row a part position and entry.

Kept are vectors of ``dims`` components, none null or non-finite; other rows aren't returned. Repeated rows count each. Null ids
stand behind all others, equal ids are put in order by their vectors. With fewer kept vectors than entries there are as
many entries as vectors; of equal entries the lowest index gets the parts. Components beyond 2^26 after scaling raise an error.
Null labels are one label. An empty table gives none; other columns are ignored. Ids and labels may have any type.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .vectors import blocks, first_rows, floor_means, kept, map_arrow, matrix

ENTRIES, PARTS, ROUNDS, DIMS, SCALE = 16, 8, 6, 64, 4096
BLOCK, LEAF = 4096, 32


class Tree:
    """A kd-tree over rows of whole numbers: rows ``lo`` to ``hi`` of ``order``, left child ``left`` (the right one follows; 0:
    leaf), corners ``low`` and ``high`` of the box, ``sums``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        spans, low, high, todo = [], [], [], [(0, len(x))] if len(x) else []
        at = 0
        while at < len(todo):
            lo, hi = todo[at]
            rows = self.order[lo:hi]
            y = x[rows]
            low.append(a := y.min(axis=0))
            high.append(b := y.max(axis=0))
            side = int((b - a).argmax())
            left = 0
            if hi - lo > leaf and b[side] > a[side]:
                mid = (hi - lo) // 2
                self.order[lo:hi] = rows[np.argpartition(y[:, side], mid)]
                left = len(todo)
                todo += [(lo, lo + mid), (lo + mid, hi)]
            spans.append((lo, hi, left))
            at += 1
        self.lo, self.hi, self.left = np.array(spans, np.int64).reshape(-1, 3).T
        self.low, self.high = np.array(low).reshape(len(spans), -1), np.array(high).reshape(len(spans), -1)
        upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[self.order], axis=0)])
        self.sums = upto[self.hi] - upto[self.lo]

    FIELDS = (("lo", np.int32, 0), ("hi", np.int32, 0), ("left", np.int32, 0), ("low", np.int32, 1), ("high", np.int32, 1), ("sums", np.int64, 1))

    def packed(self, x: np.ndarray) -> list[bytes]:
        return [self.order.astype(np.int32).tobytes(), x[self.order].astype(np.int32).tobytes(), *[getattr(self, n).astype(kind).tobytes() for n, kind, _ in self.FIELDS]]


def unpacked(raw: list[bytes], width: int) -> dict:
    out = {"order": np.frombuffer(raw[0], np.int32), "x": np.frombuffer(raw[1], np.int32).reshape(-1, width).astype(np.int64)}
    for (name, kind, wide), b in zip(Tree.FIELDS, raw[2:], strict=True):
        a = np.frombuffer(b, kind).astype(np.int64)
        out[name] = a.reshape(-1, width) if wide else a
    return out


def walk(t: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Whole nodes and their entries; rows of leaves (places in the tree's order) and theirs; the number of exact comparisons."""
    n, e = len(book), np.arange(len(book))
    nodes, entries, rows, labels, compared = [], [], [], [], 0
    at, live = np.zeros(min(1, len(t["lo"])), np.int64), np.ones((min(1, len(t["lo"])), n), bool)
    while len(at):
        low, high = t["low"][at], t["high"][at]
        to_middle = ((2 * book[None] - (low + high)[:, None]) ** 2).sum(axis=2)
        best = np.where(live, to_middle, np.iinfo(np.int64).max).argmin(axis=1)
        lead = book[best][:, None]
        corner = np.where(book[None] > lead, high[:, None], low[:, None])
        behind = ((book[None] - corner) ** 2).sum(axis=2) - ((lead - corner) ** 2).sum(axis=2)
        live &= (behind < 0) | (behind == 0) & (e < best[:, None]) | (e == best[:, None])
        whole = live.sum(axis=1) == 1
        nodes.append(at[whole])
        entries.append(live[whole].argmax(axis=1))
        leaf = ~whole & (t["left"][at] == 0)
        if leaf.any():
            lo, size = t["lo"][at[leaf]], (t["hi"] - t["lo"])[at[leaf]]
            of = np.repeat(np.arange(len(size)), size)
            row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[of]
            i, k = np.nonzero(live[leaf][of])
            # the distance in front, the index behind: the least is the nearest, of equals the lowest
            key = ((t["x"][row[i]] - book[k]) ** 2).sum(axis=1) * n + k
            rows.append(row)
            labels.append(np.minimum.reduceat(key, np.flatnonzero(np.r_[True, i[1:] != i[:-1]])) % n)
            compared += len(i)
        open_ = ~whole & ~leaf
        child = t["left"][at[open_]]
        at, live = np.stack([child, child + 1], axis=1).reshape(-1), np.repeat(live[open_], 2, axis=0)
    flat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return flat(nodes), flat(entries), flat(rows), flat(labels), compared


def grown(df: DataFrame, key: str, vector: str, label: str, dims: int, parts: int, scale: int, block: int = BLOCK) -> DataFrame:
    """One row a block: ids, labels and, for every part, its tree; kept in the shared folder."""
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(df.schema[key].dataType)), T.StructField("labels", T.ArrayType(df.schema[label].dataType)), T.StructField("trees", T.ArrayType(T.ArrayType(T.BinaryType())))]
    )
    width = dims // parts

    def run(batches):
        for b in blocks(batches, block):
            x = matrix(b[vector], dims, scale)
            listed = {n: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), b[c].combine_chunks()) for n, c in (("ids", key), ("labels", label))}
            yield listed | {"trees": [[Tree(y := x[:, p * width : (p + 1) * width]).packed(y) for p in range(parts)]]}

    return cut(map_arrow(df, run, schema))


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, n, width = books.shape
    shared, sums = trees.sparkSession.sparkContext.broadcast(books), [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", *sums)]])

    def run(batches):
        total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for b in batches:
            for raw in b["trees"]:
                for p, packed in enumerate(raw.as_py()):
                    t = unpacked(packed, width)
                    nodes, entries, rows, labels, _ = walk(t, shared.value[p])
                    np.add.at(total[p], entries, t["sums"][nodes])
                    np.add.at(count[p], entries, (t["hi"] - t["lo"])[nodes])
                    np.add.at(total[p], labels, t["x"][rows])
                    np.add.at(count[p], labels, 1)
        at = np.indices((parts, n)).reshape(2, -1).astype(np.int32)
        yield {"part": at[0], "entry": at[1], "n": count.reshape(-1)} | {c: total[:, :, i].reshape(-1) for i, c in enumerate(sums)}

    got = map_arrow(trees.select("trees"), run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).where("n > 0").collect()
    return np.stack([floor_means(books[p], {r["entry"]: (r["n"], [r[c] for c in sums]) for r in got if r["part"] == p}) for p in range(parts)])


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE
) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 for every kept vector. The trees and rounds run while this is called; a
    round brings parts x entries sums to the driver. ``dims`` is a multiple of ``parts``; ``entries`` is 256 at most."""
    spark, rows = df.sparkSession, kept(df, dims, vector, key, label)
    width = dims // parts
    first = first_rows(rows, [F.col(f"`{key}`").asc_nulls_last()], vector, entries, scale)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("__label", df.schema[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2) if len(first) else np.zeros((parts, 0, width), np.int64)
    if len(first):
        trees = grown(rows, key, vector, label, dims, parts, scale)
        for _ in range(rounds):
            books = _round(trees, books)
        shared = spark.sparkContext.broadcast(books)

        def run(batches):
            for b in batches:
                for ids, labels, raw in zip(b["ids"], b["labels"], b["trees"], strict=True):
                    code, error = np.zeros((len(ids.values), parts), np.uint8), np.zeros(len(ids.values), np.int64)
                    for p, packed in enumerate(raw.as_py()):
                        t = unpacked(packed, width)
                        nodes, chosen, at, entry, _ = walk(t, shared.value[p])
                        of = np.empty(len(code), np.int64)
                        of[at] = entry
                        for node, k in zip(nodes.tolist(), chosen.tolist(), strict=True):
                            of[t["lo"][node] : t["hi"][node]] = k
                        code[t["order"], p] = of
                        error[t["order"]] += ((t["x"] - shared.value[p][of]) ** 2).sum(axis=1)
                    yield {key: ids.values, "__label": labels.values, "code": [c.tobytes().hex() for c in code], "error": error}

        coded = cut(map_arrow(trees, run, schema))
    else:
        coded = spark.createDataFrame([], schema)
    sha = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    per = coded.groupBy(F.col("__label").alias("__of")).agg(F.sum("error").alias("label_error"))
    return coded.join(per, F.col("__label").eqNullSafe(F.col("__of"))).select(F.col(f"`{key}`"), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_filtering_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    out = [
        """kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "part AS (SELECT rid, p, v[8 * p + 1 : 8 * p + 8] AS v FROM kept, range(8) r(p))",
        "c0 AS (SELECT p, e, v[8 * p + 1 : 8 * p + 8] AS v FROM (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e, v FROM kept ORDER BY 1 LIMIT 16), range(8) r(p))",
    ]
    near = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for n in range(ROUNDS + 1):
        out.append(f"a{n} AS (SELECT rid, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT k.rid, k.p, c.e, {near} AS d FROM part k JOIN c{n} c USING (p)) GROUP BY rid, p)")
        if n < ROUNDS:
            out.append(
                f"""c{n + 1} AS (
  SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
      SELECT k.p, a.m.e AS e, i, sum(k.v[i]) AS s, count(*) AS n FROM a{n} a JOIN part k USING (rid, p), range(1, 9) r(i) GROUP BY ALL) GROUP BY p, e) m ON m.p = o.p AND m.e = o.e
)"""
            )
    last = f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid) USING (rid)"""
    return "WITH " + ",\n".join(out) + last


ORACLE_SQL = _oracle()
