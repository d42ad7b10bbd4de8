"""Suffix-array deduplication by bucket-pointer refinement (operator 4).

A byte is removed if it lies in a LENGTH-byte string that also starts anywhere else in the corpus, in the same document
included. So only the suffix array's buckets of depth LENGTH with two members or more matter. They are found as follows.

1. Initial q-gram buckets. Each LENGTH-byte window has one q-gram of its own, the rightmost one with the least hash: its
   anchor. Equal windows have equal anchors at equal offsets, so windows whose anchors lie in different q-gram buckets are
   never compared. The windows that share an anchor are a run; a run's bytes are its segment. About one byte in 70 is an
   anchor, and only (row, bucket, segment fingerprint) is shuffled, pre-aggregated, copies inside a document once.
2. Buckets with one member drop out. A run's fingerprint is the identifier of the run as a whole: runs that have it in
   common are repeated in all their windows, however many copies there are, without meeting in one task.
3. The others (at the ends of repeated passages) send their segments, one of each, to their bucket's task. There the bucket
   is refined from depth GRAM to twice that and on to LENGTH: suffixes are sorted on their own bucket identifier and on that
   of the suffix some bytes later, both of the depth before; the numbers that this gives are the identifiers that the next
   depth reads, each of them twice. Suffixes left alone drop out. Memory is a fixed number of bytes per segment.
   A bucket of over HOT distinct members is refined by the same doubling, but with hashes as identifiers and a pre-aggregated
   shuffle as the sort, so that no task gathers it. Both ways give the same windows.
4. Repeated runs and windows return to their documents, which mark, cut and hash their bytes.

Fingerprints have 64 bits each; a wrong match needs an anchor's and a segment's to collide at once.
Null texts are empty; texts under LENGTH bytes hold no such string and stay whole. Repeated rows are copies of each other
(each counts as another place). doc_id may be null, repeated and of any type: it is only carried along. Very long texts are
walked in pieces of PIECE bytes, and one mask is held at a time, so memory stays near a few times the longest text. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, table

LENGTH = 200
GRAM = 64
HOT = 10_000
#: Segments that a task gathers before it refines their buckets; the last bucket is gathered to its end.
GATHER = 4000
PIECE = 1 << 18
_POS = np.uint64((1 << 20) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of raw[i : i + gram] for each i; gram is a power of two."""
    x = (raw.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    x ^= x >> np.uint64(29)
    k = level = 1
    while k < gram:
        x = x[:-k] * _ODD[level % 8] + x[k:]
        x ^= x >> np.uint64(31)
        k, level = 2 * k, level + 1
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    return x


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    return np.minimum(key[: len(key) - (width - k)], key[width - k :]) if width > k else key


class Runs:
    """Runs of windows by anchor, of several texts joined: text number, first and last window, anchor, its hash."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
        h = gram_hashes(raw, gram)
        key = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64))
        anchor = (_POS - (_least(key, length - gram + 1) & _POS)).astype(np.int64)
        own = np.repeat(np.arange(len(starts)), ends - starts)[: len(anchor)]
        good = np.arange(len(anchor)) + length <= ends[own]
        new = good.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
        self.first = np.flatnonzero(new)
        stop = np.flatnonzero(good[:-1] & (new[1:] | ~good[1:]))
        self.last = np.concatenate([stop, np.flatnonzero(good[-1:]) + len(good) - 1])
        self.text = own[self.first]
        self.anchor = anchor[self.first]
        self.bucket = h[self.anchor].view(np.int64)


def walk(texts: list[bytes], length: int, gram: int, piece: int) -> Iterator[tuple[list[int], list[int], bytes, Runs]]:
    """Joins short texts, cuts long ones; yields (text numbers, offset of each part in its text, joined bytes, its runs)."""
    parts, offsets, numbers, held = [], [], [], 0

    def flush():
        raw = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        return list(numbers), list(offsets), raw, Runs(np.frombuffer(raw, np.uint8), ends - [len(p) for p in parts], ends, length, gram)

    for n, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, piece):
            part = t[at : at + piece + length - 1]
            if held and held + len(part) > piece:
                yield flush()
                parts, offsets, numbers, held = [], [], [], 0
            parts.append(part)
            offsets.append(at)
            numbers.append(n)
            held += len(part)
    if parts:
        yield flush()


def segments(raw: bytes, runs: Runs, length: int) -> list[int]:
    """Signed 64-bit fingerprint of each run's segment."""
    digest, view = xxhash.xxh64_intdigest, memoryview(raw)
    return np.array([digest(view[a:b]) for a, b in zip(runs.first.tolist(), (runs.last + length).tolist())], np.uint64).view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(df: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """k, bucket, segment, n (2 if the segment recurs in the document): one row per document and segment."""

    def run(batches):
        for b in batches:
            keys, texts = b["k"], [_bytes(t) for t in b["text"]]
            for numbers, _, raw, runs in walk(texts, length, gram, piece):
                seg = segments(raw, runs, length)
                who = np.array(numbers)[runs.text]
                order = np.lexsort((seg, who))
                new = np.ones(len(order), bool)
                new[1:] = (who[order][1:] != who[order][:-1]) | (seg[order][1:] != seg[order][:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(order)))
                yield {"k": [keys[i] for i in who[order][at]], "bucket": runs.bucket[order][at], "segment": seg[order][at], "n": np.minimum(n, 2).astype(np.int32)}

    return map_batches(df.select("k", "text"), run, "k long, bucket long, segment long, n int")


def depths(length: int, gram: int) -> list[int]:
    """From which depth to which the buckets are refined: gram, twice that, and so on, LENGTH at last."""
    out = [gram]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


class Buckets:
    """Bucket identifiers of the suffixes of anchored segments, by depth and by the suffix's place beside the anchor.

    ``column(0, s)`` numbers the suffixes that start s bytes from their anchor by initial bucket and q-gram. A deeper column
    sorts on two identifiers of the depth before, the suffix's own and that of the suffix some bytes later, so each refined
    identifier is used again, by the suffix that it belongs to and by the one before it. Suffixes that are alone, or reach
    beyond their segment, have -1. Columns are made when asked for and dropped once no later window needs them, so what is
    held at once is a fixed number of bytes per segment.
    """

    def __init__(self, bucket: np.ndarray, offset: np.ndarray, segs: list[bytes], length: int, gram: int):
        self.size = np.fromiter(map(len, segs), np.int64, len(segs))
        self.start = np.cumsum(self.size) - self.size + offset
        self.offset, self.depths = offset, depths(length, gram)
        self.grams = gram_hashes(np.frombuffer(b"".join(segs), np.uint8), gram)
        self.of = np.unique(bucket, return_inverse=True)[1].astype(np.uint64) * _ODD[2]
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def column(self, level: int, s: int) -> np.ndarray:
        got = self.held.get((level, s))
        if got is None:
            if level == 0:
                inside = np.flatnonzero((self.offset + s >= 0) & (self.offset + s + self.depths[0] <= self.size))
                code = self.grams[self.start[inside] + s] * _ODD[4] ^ self.of[inside]
            else:
                a, b = self.column(level - 1, s), self.column(level - 1, s + self.depths[level] - self.depths[level - 1])
                inside = np.flatnonzero((a >= 0) & (b >= 0))
                code = a[inside].astype(np.int64) << 32 | b[inside]
            got = np.full(len(self.size), -1, np.int32)
            if len(inside):
                _, number, members = np.unique(code, return_inverse=True, return_counts=True)
                got[inside] = np.where(members[number] > 1, number, -1)
            self.held[level, s] = got
        return got

    def drop(self, s: int) -> None:
        for key in [k for k in self.held if k[1] <= s]:
            del self.held[key]


def refine(bucket: np.ndarray, offset: np.ndarray, segs: list[bytes], length: int, gram: int) -> list[list[int]]:
    """[first, last, first, last, ...] of each segment's windows that are another segment's at the same place beside the anchor.

    ``offset``: of the anchor in its segment. A window holds its anchor, so it starts at most length - gram before it.
    """
    ids, reach = Buckets(bucket, offset, segs, length, gram), length - gram
    hit = np.zeros((len(segs), reach + 3), np.int8)
    for s in range(-reach, 1):
        hit[:, s + reach + 1] = ids.column(len(ids.depths) - 1, s) >= 0
        ids.drop(s)
    step = np.diff(hit, axis=1)
    who, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1
    shift = offset[who] - reach
    pairs = np.stack([first + shift, last + shift], 1)
    bounds = np.searchsorted(who, np.arange(len(segs) + 1))
    return [pairs[a:b].ravel().tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def _resolve(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """contexts: k, bucket, segment, partial, offset, bytes, sorted by bucket -> k, segment, ranges of repeated windows."""

    def run(batches):
        held: dict[str, list] = {c: [] for c in ("k", "bucket", "segment", "partial", "offset", "bytes")}

        def out(n):
            part = {c: v[:n] for c, v in held.items()}
            for c in held:
                held[c] = held[c][n:]
            if not n:
                return None
            got = refine(np.array(part["bucket"], np.int64), np.array(part["offset"], np.int64), part["bytes"], length, gram)
            some = [i for i, w in enumerate(got) if w and part["partial"][i]]
            return {"k": [part["k"][i] for i in some], "segment": [part["segment"][i] for i in some], "ranges": [got[i] for i in some]}

        for b in batches:
            for c in held:
                held[c] += b[c]
            if len(held["k"]) >= GATHER:
                last, n = held["bucket"][-1], len(held["bucket"])
                while n and held["bucket"][n - 1] == last:
                    n -= 1
                if (x := out(n)) and x["k"]:
                    yield x
        if (x := out(len(held["k"]))) and x["k"]:
            yield x

    return map_batches(contexts, run, "k long, segment long, ranges array<int>")


def _spread(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for hot buckets: a window's identifiers of every depth are made where its segment lies, by the same doubling,
    as hashes instead of numbers; the last one is counted by a pre-aggregated shuffle, so no task gathers a bucket."""

    def run(batches):
        steps = depths(length, gram)
        for b in batches:
            for k, g, s, p, o, x in zip(b["k"], b["bucket"], b["segment"], b["partial"], b["offset"], b["bytes"]):
                ids = gram_hashes(np.frombuffer(x, np.uint8), gram) ^ np.uint64(g & (1 << 64) - 1)
                for d, deeper in zip(steps, steps[1:]):
                    ids = (ids[: len(ids) - (deeper - d)] * _ODD[2] ^ ids[deeper - d :]) * _ODD[3]
                    ids ^= ids >> np.uint64(32)
                n = len(ids)
                yield {"k": [k] * n, "segment": [s] * n, "partial": [p] * n, "window": list(range(n)), "place": [w - o for w in range(n)], "id": ids.view(np.int64)}

    each = map_batches(contexts.select("k", "bucket", "segment", "partial", "offset", "bytes"), run, "k long, segment long, partial boolean, window int, place int, id long")
    many = each.groupBy("id", "place").agg(F.count("*").alias("c")).where("c > 1").select("id", "place")
    got = each.where("partial").join(many, ["id", "place"]).groupBy("k", "segment").agg(F.sort_array(F.collect_set("window")).alias("w"))
    return got.select("k", "segment", F.flatten(F.transform("w", lambda w: F.array(w, w))).alias("ranges"))


def _routed(df: DataFrame, length: int) -> Column:
    """Where a row's findings are sent. Findings hold for any row with the segment, so rows that share this number lose
    nothing; it follows from text and doc_id, so only equal rows share it, and rows too short to be found spread freely."""
    return F.when(F.octet_length("text") >= length, F.xxhash64(F.col("doc_id").cast("string"), "text")).otherwise(F.monotonically_increasing_id())


def repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """k, whole array<long>, part array<struct<segment, ranges>>: segments all of whose windows recur, and those of others.

    ``df``: k long (the row's number as in ``_routed``), text.
    """
    df = df.where(F.octet_length("text") >= length)
    every = cut(anchors(df, length, gram, piece))
    segs = every.groupBy("bucket", "segment").agg(F.sum("n").alias("c"), F.min("k").alias("k"))
    sizes = segs.groupBy("bucket").agg(F.sum("c").alias("places"), F.count("*").alias("members"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("open"))
    segs = cut(segs.join(sizes.where("places > 1"), "bucket"))
    full = every.join(segs.where("c > 1").select("bucket", "segment"), ["bucket", "segment"]).select("k", "segment")
    # buckets with a run that isn't repeated as a whole: their runs, one of each segment, are compared by bytes
    todo = segs.where("members > 1 AND open > 0")
    wanted = todo.groupBy("k").agg(F.collect_list(F.struct("segment", (F.col("c") == 1).alias("partial"), (F.col("members") > hot).alias("hot"))).alias("want"))

    def contexts(batches):
        for b in batches:
            texts = [_bytes(t) for t in b["text"]]
            ask = [{w["segment"]: w for w in want} for want in b["want"]]
            out: dict[str, list] = {c: [] for c in ("k", "bucket", "segment", "partial", "hot", "offset", "bytes")}
            for numbers, _, raw, runs in walk(texts, length, gram, piece):
                seg = segments(raw, runs, length)
                for i, (t, s) in enumerate(zip(runs.text.tolist(), seg.tolist())):
                    if w := ask[numbers[t]].pop(s, None):
                        a, z = int(runs.first[i]), int(runs.last[i]) + length
                        for c, v in zip(out, (b["k"][numbers[t]], int(runs.bucket[i]), s, w["partial"], w["hot"], int(runs.anchor[i]) - a, raw[a:z])):
                            out[c].append(v)
            yield out

    asked = df.select("k", "text").join(wanted, "k")
    spec = "k long, bucket long, segment long, partial boolean, hot boolean, offset int, bytes binary"
    sent = cut(map_batches(asked, contexts, spec))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = _resolve(sent.where("NOT hot").drop("hot").repartition(parts, "bucket").sortWithinPartitions("bucket"), length, gram)
    some = cold.unionByName(_spread(sent.where("hot"), length, gram))
    found = full.select("k", F.col("segment").alias("whole"), F.lit(None).cast("struct<segment:bigint,ranges:array<int>>").alias("part"))
    found = found.unionByName(some.select("k", F.lit(None).cast("long").alias("whole"), F.struct("segment", "ranges").alias("part")))
    return found.groupBy("k").agg(F.collect_set("whole").alias("whole"), F.collect_list("part").alias("part"))


def removed_bytes(text: bytes, whole: list[int] | None, part: list[dict] | None, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> np.ndarray:
    """Mask of the removed bytes of one text."""
    if not whole and not part:
        return np.zeros(len(text), bool)
    # how many found windows open less close at a byte; no more than ``length`` lie over one byte
    step = np.zeros(len(text) + 1, np.int16 if length < 1 << 14 else np.int32)
    by = dict.fromkeys(whole or ()) | {f["segment"]: f["ranges"] for f in part or ()}
    for _, offsets, raw, runs in walk([text], length, gram, piece):
        for a, z, t, s in zip(runs.first.tolist(), runs.last.tolist(), runs.text.tolist(), segments(raw, runs, length).tolist()):
            if s in by:
                # a lone text is never joined to another, so the part starts at 0 of its joined bytes
                for i, j in [(0, z - a)] if by[s] is None else zip(by[s][::2], by[s][1::2]):
                    step[offsets[t] + a + i] += 1
                    step[offsets[t] + a + j + length] -= 1
    np.cumsum(step, out=step)
    return step[:-1] > 0


def _with_masks(df: DataFrame, make: Callable[[bytes, np.ndarray], dict], schema: str, keep: str = "doc_id", **params) -> DataFrame:
    """``keep`` and what ``make`` gives for each text and its mask; one text's mask is held at a time."""
    length = params.get("length", LENGTH)
    rows = df.select(_routed(df, length).alias("k"), F.col(keep).alias("keep"), "text")
    joined = rows.join(repeats(df.select(_routed(df, length).alias("k"), "text"), **params), "k", "left").select("keep", "text", "whole", "part")
    at = {c: params[c] for c in ("length", "gram", "piece") if c in params}
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in names}
            for t, whole, part in zip(b["text"], b["whole"], b["part"]):
                raw = _bytes(t)
                for c, v in make(raw, removed_bytes(raw, whole, part, **at)).items():
                    out[c].append(v)
            yield {"keep": b["keep"]} | out

    return map_batches(joined, run, f"keep {rows.schema['keep'].dataType.simpleString()}, {schema}")


def dedup_report(df: DataFrame, **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``df`` (doc_id, text)."""

    def make(raw, mask):
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if mask.any() else raw
        spans = int(mask[:1].sum()) + np.count_nonzero(mask[1:] & ~mask[:-1])
        return {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}

    out = _with_masks(df, make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **params)
    return out.withColumnRenamed("keep", "doc_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def cut_repeats(df: DataFrame, **params) -> DataFrame:
    """``df`` with repeated bytes cut from its texts and n_chars, if there is one, set anew. No row is dropped.

    A character of which some bytes are repeated and some not is cut as a whole.
    """
    others = [c for c in df.columns if c not in ("text", "n_chars")]
    packed = df.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))

    def make(raw, mask):
        return {"text": np.frombuffer(raw, np.uint8)[~mask].tobytes().decode("utf-8", "ignore") if mask.any() else raw.decode("utf-8", "surrogatepass")}

    out = _with_masks(packed, make, "text string", keep="others", **params)
    size = {"n_chars": F.length("text").cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {}
    return out.select(*[size.get(c, F.col(f"keep.`{c}`" if c != "text" else "text")).alias(c) for c in df.columns])


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, s, md5_number(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM d)),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS g FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM r)),
span AS (SELECT rid, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY rid, g),
piece AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b FROM span
  UNION ALL SELECT rid, max(b), NULL FROM span GROUP BY rid
),
kept AS (SELECT p.rid, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS h FROM piece p JOIN d ON d.rid = p.rid GROUP BY p.rid),
n AS (SELECT rid, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM span GROUP BY rid)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN kept ON kept.rid = d.rid
"""
