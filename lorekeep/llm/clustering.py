"""Centroid clustering by dual-tree Lloyd rounds (operator 11).

Vectors are turned into whole numbers and gathered in blocks of BLOCK rows, as they lie. Every block gets a cover tree once:
a node is a vector, the radius that covers what hangs under it, and the sum and count of that; its children cover balls of
half that radius around vectors of their own that lie further apart than that, and the first of them keeps its parent's vector.
Children that would hold only a few vectors share one leaf. The blocks with their trees are kept in the shared folder, so a
round reads them in one narrow pass.

Every round builds a second cover tree, over the centroids, and walks both trees together from the top, level by level: a
pair (node, centroid node) falls if the triangle inequality shows that every vector under the node is nearer to another
centroid; the wider side of what is left is opened. A node with one centroid left is assigned whole by its cached sum and
count; the vectors of a leaf are compared exactly, in whole numbers, with the centroids left to the leaf. Bounds carry a slack
for rounding, so pruning never decides between equal distances. A task adds up its blocks and sends one row a centroid.

Kept are vectors of exactly ``dims`` components, none null or non-finite; other rows aren't returned. Repeated rows count each.
Null ids stand behind all others where rows are put in order, ties are decided by the vector. With fewer kept vectors than
centroids each is one; equal centroids leave their vectors to the smaller number. Components beyond 2^26 after scaling raise an
error, as distances would leave 64 bits. An empty table gives none; other columns are ignored. Ids may have any type.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .vectors import blocks, first_rows, floor_means, kept, map_arrow, matrix

CENTROIDS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
BLOCK, LEAF, FEW = 4096, 64, 16


class CoverTree:
    """Nodes in breadth-first order: ``center`` (row), rows ``lo`` to ``hi`` of ``order``, children ``first`` to ``last``, ``radius``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, few: int = FEW):
        y = x.astype(np.float64)
        away = lambda c, rows: np.sqrt(((y[rows] - y[c]) ** 2).sum(axis=1))
        self.order = np.arange(len(x))
        spans, radius = [], []
        todo = [(0, 0, len(x))] if len(x) else []
        at = 0
        while at < len(todo):
            c, lo, hi = todo[at]
            rows = self.order[lo:hi]
            d = away(c, rows)
            radius.append(r := float(d.max()))
            first = len(todo)
            if hi - lo > leaf and r > 0:
                groups, rest, near = [], rows, d
                while len(rest):
                    inside = near <= r / 2
                    groups.append((c, rest[inside]))
                    rest = rest[~inside]
                    if len(rest):
                        c = rest[0]
                        near = away(c, rest)
                large = [g for n, g in enumerate(groups) if n == 0 or len(g[1]) > few]
                small = [g for n, g in enumerate(groups) if n and len(g[1]) <= few]
                # what many small balls hold is cut into leaves of its own, none of which is opened again
                loose = np.concatenate([g[1] for g in small]) if small else rows[:0]
                large += [(p[0], p) for p in np.split(loose, range(leaf, len(loose), leaf)) if len(p)]
                for c, members in large:
                    self.order[lo : lo + len(members)] = members
                    todo.append((c, lo, lo + len(members)))
                    lo += len(members)
            spans.append((*todo[at], first, len(todo)))
            at += 1
        self.center, self.lo, self.hi, self.first, self.last = np.array(spans, np.int32).reshape(-1, 5).T
        self.radius = np.array(radius)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of the vectors under each node."""
        upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[self.order], axis=0)])
        return upto[self.hi] - upto[self.lo]


class Centroids:
    """The centroids of one round under a cover tree; of equal ones only the first can get vectors and is in the tree."""

    def __init__(self, rows: np.ndarray):
        self.all = rows
        self.number = np.sort(np.unique(rows, axis=0, return_index=True)[1])
        self.rows = rows[self.number]
        tree = CoverTree(self.rows, leaf=1, few=0)
        self.center, self.first, self.last, self.radius = tree.center, tree.first, tree.last, tree.radius


def _opened(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every child of every row."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def walk(block: dict, c: Centroids) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]], int]:
    """Whole nodes (node, centroid), compared leaves (lo, hi, centroid of each vector), and the number of exact comparisons."""
    x, t = block["x"], block["tree"]
    y, cy = x[t["center"]].astype(np.float64), c.rows[c.center].astype(np.float64)
    nodes, leaves, compared = [], [], 0
    q, k = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        d = np.sqrt(((y[q] - cy[k]) ** 2).sum(axis=1))
        bound = np.full(len(y), np.inf)
        np.minimum.at(bound, q, d + t["radius"][q])
        near = d - t["radius"][q] - c.radius[k] <= bound[q] * (1 + 1e-9) + 1e-6
        q, k = q[near], k[near]
        single = c.first[k] == c.last[k]
        left = np.bincount(q, minlength=len(y))
        done = single & (left[q] == 1)
        nodes += zip(q[done].tolist(), c.number[c.center[k[done]]].tolist(), strict=True)
        q, k, single = q[~done], k[~done], single[~done]
        leaf = t["first"] == t["last"]
        wide = ~single & ((c.radius[k] >= t["radius"][q]) | leaf[q])
        waits = np.zeros(len(y), bool)
        waits[q[wide]] = True  # its centroid side is opened first
        ends = leaf[q] & ~waits[q]
        for node, cand in zip(*_groups(q[ends], k[ends]), strict=True):
            lo, hi = t["lo"][node], t["hi"][node]
            cand = np.sort(c.center[cand])
            far = ((x[lo:hi, None, :] - c.rows[None, cand]) ** 2).sum(axis=2)
            leaves.append((int(lo), int(hi), c.number[cand[far.argmin(axis=1)]]))
            compared += far.size
        splits = ~leaf[q] & ~waits[q]
        stay = waits[q] & ~wide
        a, child = _opened(c.first[k[wide]], c.last[k[wide]])
        b, under = _opened(t["first"][q[splits]], t["last"][q[splits]])
        q, k = np.concatenate([q[stay], q[wide][a], under]), np.concatenate([k[stay], child, k[splits][b]])
    return nodes, leaves, compared


def _groups(q: np.ndarray, k: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(q, kind="stable")
    q, k = q[order], k[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    return q[starts].tolist(), np.split(k, starts[1:]) if len(q) else []


def grown(df: DataFrame, key: str, vector: str, dims: int, scale: int, block: int = BLOCK) -> DataFrame:
    """One row a block: ids, vectors in tree order and the tree; kept in the shared folder."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *[T.StructField(n, T.BinaryType()) for n in ("x", "spans", "radius", "sums")]])

    def run(batches):
        for b in blocks(batches, block):
            x = matrix(b[vector], dims, scale)
            tree = CoverTree(x)
            ids = b[key].combine_chunks().take(pa.array(tree.order))
            place = np.empty(len(x), np.int64)
            place[tree.order] = np.arange(len(x))
            spans = np.stack([place[tree.center], tree.lo, tree.hi, tree.first, tree.last]).astype(np.int32)
            yield {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "x": [x[tree.order].astype(np.int32).tobytes()], "spans": [spans.tobytes()], "radius": [tree.radius.tobytes()], "sums": [tree.sums(x).tobytes()]}

    return cut(map_arrow(df, run, schema))


def _blocks_of(batches, dims: int):
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b["x"][i].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
            spans = np.frombuffer(b["spans"][i].as_py(), np.int32).reshape(5, -1).astype(np.int64)
            tree = dict(zip(("center", "lo", "hi", "first", "last"), spans, strict=True)) | {"radius": np.frombuffer(b["radius"][i].as_py())}
            yield {"ids": b["ids"][i].values, "x": x, "tree": tree, "sums": np.frombuffer(b["sums"][i].as_py(), np.int64).reshape(-1, dims)}


def _round(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    dims, shared = centroids.shape[1], trees.sparkSession.sparkContext.broadcast(Centroids(centroids).all)
    sums = [f"s{i}" for i in range(dims)]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("n", "compared", *sums)]])

    def run(batches):
        c = Centroids(shared.value)
        total, count, compared = np.zeros_like(c.all), np.zeros(len(c.all), np.int64), 0
        for block in _blocks_of(batches, dims):
            nodes, leaves, n = walk(block, c)
            compared += n
            for node, k in nodes:
                total[k] += block["sums"][node]
                count[k] += block["tree"]["hi"][node] - block["tree"]["lo"][node]
            for lo, hi, label in leaves:
                np.add.at(total, label, block["x"][lo:hi])
                count += np.bincount(label, minlength=len(count))
        yield {"cluster": np.arange(len(count), dtype=np.int32), "n": count, "compared": np.eye(1, len(count), 0, dtype=np.int64)[0] * compared} | {s: total[:, i] for i, s in enumerate(sums)}

    got = map_arrow(trees, run, schema).groupBy("cluster").agg(*[F.sum(n).alias(n) for n in ("n", *sums)]).where("n > 0").collect()
    return floor_means(centroids, {r["cluster"]: (r["n"], [r[s] for s in sums]) for r in got})


def cluster(df: DataFrame, order: list[Column], key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector. The first ``k`` rows in ``order``
    are the centroids to begin with. The trees and rounds run while this is called; a round brings k sums to the driver."""
    spark, rows = df.sparkSession, kept(df, dims, vector, key)
    kind = df.schema[key].dataType
    centroids = first_rows(rows, order, vector, k, scale)
    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if len(centroids):
        trees = grown(rows, key, vector, dims, scale)
        for _ in range(rounds):
            centroids = _round(trees, centroids)
        shared = spark.sparkContext.broadcast(centroids)

        def run(batches):
            c = Centroids(shared.value)
            for block in _blocks_of(batches, dims):
                label, t = np.empty(len(block["x"]), np.int32), block["tree"]
                nodes, leaves, _ = walk(block, c)
                for node, n in nodes:
                    label[t["lo"][node] : t["hi"][node]] = n
                for lo, hi, n in leaves:
                    label[lo:hi] = n
                yield {key: block["ids"], "cluster": label, "distance": ((block["x"] - c.all[label]) ** 2).sum(axis=1)}

        placed = cut(map_arrow(trees, run, schema))
    else:
        placed = spark.createDataFrame([], schema)
    per = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    sha = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, d, sum(per.values()), sha[c]) for c, d in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select(F.col(f"`{key}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return cluster(table(spark, sf_dir, "embeddings"), [drawn.asc_nulls_last()])


def _oracle() -> str:
    near = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    out = [
        """kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept ORDER BY 1 LIMIT 40)",
    ]
    for n in range(ROUNDS + 1):
        out.append(f"a{n} AS (SELECT rid, min(struct_pack(d := d, c := c)) AS m FROM (SELECT k.rid, c.c, {near} AS d FROM kept k, c{n} c) GROUP BY rid)")
        if n < ROUNDS:
            out.append(
                f"""c{n + 1} AS (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
      SELECT a.m.c AS c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{n} a JOIN kept k USING (rid), range(1, 65) r(i) GROUP BY ALL) GROUP BY c) m ON m.c = o.c
)"""
            )
    last = f"""
SELECT k.vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, sum(a.m.d) OVER (PARTITION BY a.m.c)::BIGINT AS cluster_inertia,
       sum(a.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept k JOIN a{ROUNDS} a USING (rid) JOIN c{ROUNDS} c ON c.c = a.m.c"""
    return "WITH " + ",\n".join(out) + last


ORACLE_SQL = _oracle()
