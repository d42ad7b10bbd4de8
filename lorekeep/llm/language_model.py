"""Language-model scores by deleted interpolation (operator 13).

A word's probability mixes maximum-likelihood estimates of orders 1 to ``order`` and 1 / (V + 1), where V counts the distinct
training tokens. Mixture weights depend on the bucket of the context's frequency (0, 1, 2-3, 4-7, ...). They are learned on
the training rows' held-out part, the documents of DELETED, whose tokens are predicted from counts of the other training
rows: expectation-maximisation over the cells (bucket, estimates) of those tokens, one DataFrame job a round. Scores then use
the counts of all training rows.

How counts meet texts: tasks turn CHUNK tokens at a time into a chunk, that is, each token's number among the chunk's distinct
words and these words' 64-bit hashes; chunks are kept in the shared folder. Every chunk sends its distinct n-grams, with
training and retained counts, to cells of the hash range as sorted arrays; a cell adds them up and answers each chunk in the
chunk's own order. So an n-gram crosses once a chunk however often it occurs, a frequent one can't make a cell large, and texts
are never shuffled. Cells and chunks have a bounded size; their number grows with the input.

Equal n-grams are told by 64-bit hashes. Estimates are rounded to 1/STEPS of a power of two where weights are learned, and
there alone. A context that nothing retained has follows takes no share of its order. Null texts are empty: one end token. Null
ids count as the empty text where rows are dealt to folds. Repeated rows count each; an empty table gives none; other columns
are ignored; without training rows every token has probability 1 / (V + 1) = 1. Very long texts make one long chunk each.
"""

from __future__ import annotations

from hashlib import blake2b
from math import ceil, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, need, table
from .vectors import map_arrow

ORDER = 2
FOLDS, TEST, DELETED = 5, 1, 0
CHUNK, CELL = 1 << 20, 4 << 20
CELLS = 64
STEPS, EM_ROUNDS, GAIN = 64, 30, 1e-6
BUCKETS = 40

#: Training tokens and texts, and those of them that are retained while weights are learned.
_SUMS = ("tokens_all", "texts_all", "tokens_retained", "texts_retained")

_LOWER = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
#: Local numbers of the end token and of what stands before a text.
END, START = 0, 1


def fold(key) -> int:
    return crc32(b"" if key is None else str(key).encode()) % FOLDS


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z folded. White space of bytes is 9 to 13 and 32, as the tokens want it."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def _mixed(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its context and last word."""
    x = (context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + last
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(a: np.ndarray) -> bytes:
    """Compressed by byte planes, which hold much alike in sorted hashes and small counts."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros(0, np.uint8)
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """chunk, ids, folds, lengths (tokens of each text), tokens, hashes, distinct (their number) and _SUMS."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(df.schema[key].dataType)), *[T.StructField(n, T.BinaryType()) for n in ("folds", "lengths", "tokens", "hashes")], *[T.StructField(n, T.LongType()) for n in ("distinct", *_SUMS)]])

    def run(batches):
        ids, lengths, parts, total, known = [], [], [], 0, {b"": END, b" ": START}

        def chunk():
            folds, sizes = np.array([fold(i) for i in ids], np.int8), np.array(lengths, np.int64)
            hashes = np.array([_hash(w) for w in known], np.uint64)
            trained = folds != TEST
            kept = trained & (folds != DELETED)
            sums = dict(zip(_SUMS, (sizes[trained].sum(), trained.sum(), sizes[kept].sum(), kept.sum()), strict=True))
            yield {"ids": [ids], "folds": [folds.tobytes()], "lengths": [packed(sizes)], "tokens": [packed(np.concatenate(parts))], "hashes": [hashes.tobytes()], "distinct": [len(hashes)]} | {k: [int(n)] for k, n in sums.items()}

        for b in batches:
            for i, t in zip(b[key], b[text], strict=True):
                ws = words(t)
                parts.append(np.array([known.setdefault(w, len(known)) for w in ws] + [END], np.int32))
                ids.append(i)
                lengths.append(len(ws) + 1)
                total += len(ws) + 1
                if total >= size:
                    yield from chunk()
                    ids, lengths, parts, total, known = [], [], [], 0, {b"": END, b" ": START}
        if ids:
            yield from chunk()

    return cut(map_batches(need(df, key, text), run, schema).withColumn("chunk", F.monotonically_increasing_id()))


class Chunk:
    """Positions of a chunk, and its distinct n-grams of each order: ``at[k]`` numbers the order's n-gram that ends at a position."""

    def __init__(self, row: dict, order: int):
        self.lengths, self.tokens = unpacked(row["lengths"], np.int64), unpacked(row["tokens"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.fold = np.repeat(np.frombuffer(row["folds"], np.int8), self.lengths)
        self.at = [self.tokens]
        self.size = [row["distinct"]]
        self._from = []
        # the numbers of the words before: outside the text, START
        back = self.tokens
        for k in range(1, order):
            back = np.r_[START, back[:-1]]
            for j in range(k):
                back[self.starts[self.lengths > j] + j] = START
            distinct, at = np.unique(back * (1 << 40) + self.at[-1], return_inverse=True)
            self._from.append((distinct >> 40, distinct & ((1 << 40) - 1)))
            self.at.append(at)
            self.size.append(len(distinct))

    def hashes(self, unigrams: np.ndarray) -> list[np.ndarray]:
        out = [unigrams]
        for first, rest in self._from:
            out.append(_mixed(out[-1][rest], unigrams[first]))
        return out

    def context(self, counts: list[np.ndarray], texts: int) -> list[np.ndarray]:
        """For orders 2 and up: how often each position's context is followed. A context is counted by its own n-gram, and
        those of START by the number of texts."""
        out = []
        for k in range(1, len(counts)):
            n = np.r_[0, counts[k - 1][self.at[k - 1]][:-1]]
            n[self.starts] = texts
            out.append(n)
        return out


def _asked(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """chunk, cell, keys (ascending), all (training counts), retained: what each chunk holds of each cell."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("cell", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in ("keys", "all", "retained")]])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                c = Chunk(row, order)
                for k, h in enumerate(c.hashes(np.frombuffer(row["hashes"], np.uint64))):
                    n = [np.bincount(c.at[k][m], minlength=c.size[k]) for m in (c.fold != TEST, (c.fold != TEST) & (c.fold != DELETED))]
                    by = np.argsort(h)
                    edges = np.searchsorted(h[by] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    full = np.flatnonzero(edges[1:] > edges[:-1])
                    sent = [[packed(a[by[edges[j] : edges[j + 1]]]) for j in full] for a in (h, n[0].astype(np.int32), n[1].astype(np.int32))]
                    yield {"chunk": [row["chunk"]] * len(full), "cell": (full + (k << bits)), "keys": sent[0], "all": sent[1], "retained": sent[2]}

    return map_arrow(rows, run, schema)


def _answers(asked: DataFrame, bits: int) -> DataFrame:
    """chunk, cell, all, retained: the corpus's counts of each asked n-gram, in the asked order; fresh: distinct training words."""

    def add(t: pa.Table) -> pa.Table:
        keys = [unpacked(k.as_py(), np.uint64) for k in t["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        out = {"chunk": t["chunk"], "cell": t["cell"]}
        for name in ("all", "retained"):
            counts = np.concatenate([unpacked(c.as_py(), np.int32) for c in t[name]])
            total = np.bincount(at, counts, len(distinct)).astype(np.int64)
            out[name] = pa.array([packed(a) for a in np.split(total[at], ends)], pa.binary())
            if name == "all":
                fresh = int((total > 0).sum()) if t["cell"][0].as_py() >> bits == 0 else 0
        out["fresh"] = pa.array([fresh] + [0] * (len(keys) - 1), pa.int64())
        return pa.table(out)

    return asked.groupBy("cell").applyInArrow(add, "chunk long, cell long, all binary, retained binary, fresh long")


def counted(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> tuple[DataFrame, dict]:
    """Chunks with the corpus's counts of their n-grams, kept in the shared folder; and the sums that scores need: _SUMS and the
    number of distinct training tokens."""
    rows = chunks(df, key, text)
    n = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS], F.coalesce(F.sum(F.length("tokens")), F.lit(0)).alias("bytes")).first()
    bits = max(int(log2(CELLS)), ceil(log2(max(1, n["bytes"]) / CELL)))
    answers = cut(_answers(_asked(rows.drop("ids"), order, bits), bits))
    distinct = answers.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("v")).first()["v"]
    kinds = [T.StructField(f"{name}{k}", T.BinaryType()) for name in ("all", "retained") for k in range(order)]
    kept = rows.schema["ids"]
    schema = T.StructType([T.StructField("chunk", T.LongType()), kept, *[T.StructField(c, T.BinaryType()) for c in ("folds", "lengths", "tokens")], T.StructField("distinct", T.LongType()), *kinds])

    def meet(chunk: pa.Table, said: pa.Table) -> pa.Table:
        """A chunk's hashes, sorted by cell and key, are in the order of its answers."""
        row = chunk.select(["chunk", "folds", "lengths", "tokens", "hashes", "distinct"]).to_pylist()[0]
        said = said.sort_by("cell")
        c, out = Chunk(row, order), {n: chunk[n] for n in ("chunk", "ids", "folds", "lengths", "tokens")} | {"distinct": chunk["distinct"]}
        cells, place = said["cell"].to_numpy(), {}
        for k, h in enumerate(c.hashes(np.frombuffer(row["hashes"], np.uint64))):
            place[k] = np.argsort(h)
            mine = np.flatnonzero(cells >> bits == k)
            for name in ("all", "retained"):
                counts = np.empty(len(h), np.int64)
                counts[place[k]] = np.concatenate([unpacked(said[name][int(i)].as_py(), np.int64) for i in mine])
                out[f"{name}{k}"] = pa.array([packed(counts)], pa.binary())
        return pa.table({f.name: out[f.name] for f in schema})

    both = cut(rows.groupBy("chunk").cogroup(answers.drop("fresh").groupBy("chunk")).applyInArrow(meet, schema))
    return both, {c: n[c] for c in _SUMS} | {"distinct": distinct}


def _estimates(c: Chunk, counts: list[np.ndarray], tokens: int, texts: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each position (of its longest context), and its estimates, highest order first, 1 / (V + 1) last."""
    contexts = c.context(counts, texts)
    p = [np.full(len(c.tokens), 1 / (distinct + 1)), counts[0][c.at[0]] / max(1, tokens)]
    p += [counts[k][c.at[k]] / np.maximum(1, contexts[k - 1]) for k in range(1, len(counts))]
    longest = contexts[-1] if contexts else np.zeros(len(c.tokens), np.int64)
    return np.minimum(np.frexp(longest.astype(np.float64))[1], BUCKETS - 1), np.array(p[::-1])


def _rows(batches, order: int, name: str):
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).select(["folds", "lengths", "tokens", "distinct", *[f"{name}{k}" for k in range(order)]]).to_pylist()[0]
            yield b["ids"][i].values if "ids" in b.schema.names else None, Chunk(row, order), [unpacked(row[f"{name}{k}"], np.int64) for k in range(order)]


def weights(both: DataFrame, sums: dict, order: int = ORDER) -> np.ndarray:
    """Mixture weights by bucket and order (highest first, the uniform share last), by expectation-maximisation."""
    orders = [f"q{k}" for k in range(order + 1)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(q, T.IntegerType()) for q in orders], T.StructField("n", T.LongType())])
    names = [f"retained{k}" for k in range(order)]

    def run(batches):
        for _, c, counts in _rows(batches, order, "retained"):
            bucket, p = _estimates(c, counts, sums["tokens_retained"], sums["texts_retained"], sums["distinct"])
            with np.errstate(divide="ignore"):
                q = np.where(p > 0, np.rint(np.log2(p) * STEPS), 1).astype(np.int32)  # 1: no share
            cells, n = np.unique(np.vstack([bucket, q])[:, c.fold == DELETED], axis=1, return_counts=True)
            yield {"bucket": cells[0].astype(np.int32), "n": n} | {name: cells[1 + k].astype(np.int32) for k, name in enumerate(orders)}

    cells = map_arrow(both.select("folds", "lengths", "tokens", "distinct", *names), run, schema).groupBy("bucket", *orders).agg(F.sum("n").alias("n"))
    cells = cut(cells.select("bucket", "n", *[F.when(F.col(q) < 1, F.pow(F.lit(2.0), F.col(q) / STEPS)).otherwise(0.0).alias(q) for q in orders]))
    prior = np.ones((BUCKETS, order + 1))  # one more event for each share, so that none is ever 0
    if order > 1:
        prior[0, 0] = 0
    lam = prior / prior.sum(axis=1, keepdims=True)
    before, got = None, []
    for _ in range(EM_ROUNDS):
        share = [F.element_at(F.lit(lam[:, k].tolist()), F.col("bucket") + 1) * F.col(q) for k, q in enumerate(orders)]
        mix = sum(share[1:], share[0])
        got = cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log(mix)).alias("ll"), *[F.sum(F.col("n") * s / mix).alias(q) for s, q in zip(share, orders, strict=True)]).collect()
        total = sum(r["n"] for r in got)
        for r in got:
            lam[r["bucket"]] = (np.array([r[q] for q in orders]) + prior[r["bucket"]]) / (r["n"] + prior[r["bucket"]].sum())
        now = sum(r["ll"] for r in got) / max(1, total)
        if not got or before is not None and now - before < GAIN:
            break
        before = now
    seen = [r["bucket"] for r in got if r["bucket"] > 0]
    for b in range(1, BUCKETS):
        if seen and b not in seen:  # as in the nearest bucket below that has events, else above
            lam[b] = lam[max((s for s in seen if s < b), default=min(seen))]
    return lam


def score(both: DataFrame, sums: dict, lam: np.ndarray, key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score; one narrow pass over the chunks."""
    schema = T.StructType([T.StructField(key, both.schema["ids"].dataType.elementType), T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]])
    shared = both.sparkSession.sparkContext.broadcast(lam if sums["tokens_all"] else np.eye(1, order + 1, order).repeat(BUCKETS, 0))

    def run(batches):
        n, v = sums["tokens_all"], sums["distinct"]
        for ids, c, counts in _rows(batches, order, "all"):
            seen = counts[0][c.at[0]]
            bucket, p = _estimates(c, counts, n, sums["texts_all"], v)
            per = lambda x: np.add.reduceat(x, c.starts)
            mixed = (shared.value[bucket].T * p).sum(axis=0)
            yield {key: ids, "held_out": c.fold[c.starts] == TEST, "n_tokens": c.lengths, "n_known": per((seen > 0).astype(np.int64)), "train_tokens": np.full(len(ids), n), "base_score": per(np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))), "score": per(np.log10(mixed))}

    return map_arrow(both.select("ids", "folds", "lengths", "tokens", "distinct", *[f"all{k}" for k in range(order)]), run, schema)


def language_model_scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    both, sums = counted(df, key, text, order)
    return score(both, sums, weights(both, sums, order), key, order)


def op13_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
