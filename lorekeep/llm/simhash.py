"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 5).

A fingerprint has 8 positional bytes. Two that differ in at most 3 bits share at least SHARED = 5 of them. Postings on single
bytes would list 1/256 of all documents each, so the index's postings hold four positional bytes at a time: PLANES are 14
sets of four byte positions such that any three positions lie in one of them; the complement of a plane is a plane, so
whichever bytes two linked fingerprints differ in, they meet in a list. In every list the positional bytes that a pair
shares are tallied, pairs below SHARED dropped, and the bits of the rest verified. A list yields a spanning star for each of
its components, never all its pairs; the stars' components are joined by large-star/small-star rounds.

A list of over LONG members is not gathered: its members pass on as postings of a fifth byte, one for each position that is
left (a link leaves at least one of the four equal), and are dealt to tasks anew. Members of such a list differ in three
bytes only, so it holds 2**24 at most. In a list that is still long, the members that a fingerprint is tallied with are
looked up: those that differ from it in the one to three bits that a link allows. Tally and check are the same everywhere,
and so are the links, whatever LONG is.

Copies are collapsed first: one row per distinct fingerprint. Null, empty and blank texts have fingerprint 0 and link like
any other. Ties: a component is named by its least doc_id. Rows with a null doc_id link like any other and may join numbered
rows; a component without any doc_id has a null name, and ``one_of_each`` keeps all rows with a null doc_id. Repeated doc_ids are kept as rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, need, table
from .components import components

BITS = 3
SHARED = 8 - BITS
#: The planes of the cube whose corners are the byte positions: four positions each, any three positions in one of them.
PLANES = [tuple(i for i in range(8) if (i & n).bit_count() % 2 == side) for n in range(1, 8) for side in (0, 1)]
#: Five positions: a plane and one more.
WIDER = sorted({tuple(sorted((*p, i))) for p in PLANES for i in range(8) if i not in p})
#: From this length a list is split by a fifth byte; the links do not depend on it.
LONG = 2048
_STEP = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of ``width``-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = ends - size
    n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        a, b = starts[at : min(n, at + _STEP)].tolist(), (ends[at + width - 1 : min(n, at + _STEP) + width - 1] - 1).tolist()
        h = np.array([digest(joined[i:j], seed) for i, j in zip(a, b)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (long; the fingerprint's bits as a signed number)."""

    def run(batches):
        for b in batches:
            yield {key: b[key], "fp": [v - (1 << 64) if (v := fingerprint(t)) >> 63 else v for t in b[text]]}

    return map_batches(need(df, key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, fp long")


def _flips() -> np.ndarray:
    """All differences of one to BITS bits in 24 bits."""
    one = [1 << i for i in range(24)]
    return np.array([sum(c) for k in range(1, BITS + 1) for c in combinations(one, k)], np.uint64)


def _near(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) reach the tally of shared positional bytes and pass the check of their bits."""
    x = fp[a] ^ fp[b]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def stars(fp: np.ndarray, fifth: tuple[int, ...] | None = None) -> np.ndarray:
    """For each fingerprint of one list an index that stands for its component. ``fifth``: the list's five positions."""
    label = np.full(len(fp), -1, np.int64)
    rest = np.arange(len(fp))
    packed = None
    if fifth and len(fp) > LONG:
        split = fp.view(np.uint8).reshape(-1, 8)
        packed = sum(split[:, i].astype(np.uint64) << np.uint64(8 * k) for k, i in enumerate(i for i in range(8) if i not in fifth))
        flips, order = _flips(), np.argsort(packed, kind="stable")
        have = packed[order]
    while len(rest):
        front, rest, name = rest[:1], rest[1:], rest[0]
        label[front] = name
        while len(front) and len(rest):
            near = np.zeros(len(fp), bool)
            for at in range(0, len(front), 128):
                some = front[at : at + 128]
                if packed is not None:
                    want = packed[some, None] ^ flips[None, :]
                    k = np.minimum(np.searchsorted(have, want), len(have) - 1)
                    i, j = np.nonzero(have[k] == want)
                    a, b = some[i], order[k[i, j]]
                    near[b[_near(fp, a, b)]] = True
                else:
                    for c in range(0, len(rest), 4096):
                        part = rest[c : c + 4096]
                        a, b = np.repeat(some, len(part)), np.tile(part, len(some))
                        near[b[_near(fp, a, b)]] = True
            front, rest = rest[near[rest]], rest[~near[rest]]
            label[front] = name
    return label


def keys_of(fp: np.ndarray, number: int, positions: tuple[int, ...]) -> np.ndarray:
    """The list of each fingerprint: the number of the set of positions, then the bytes there."""
    split = fp.view(np.uint8).reshape(-1, 8)
    out = np.full(len(fp), number, np.int64)
    for i in positions:
        out = out << 8 | split[:, i]
    return out


_LINK = "u long, v long, list long, fp long"


def postings(nodes: DataFrame) -> DataFrame:
    """list and fp, for fingerprints ``fp``."""
    byte = lambda i: F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255))
    lists = []
    for k, plane in enumerate(PLANES):
        x = F.lit(k).cast("long")
        for i in plane:
            x = F.shiftleft(x, 8) + byte(i)
        lists.append(x)
    return nodes.select(F.explode(F.array(*lists)).alias("list"), "fp")


def list_links(listed: DataFrame, sets: list[tuple[int, ...]], final: bool) -> DataFrame:
    """listed: list, fp, sorted by list within partitions -> links u, v between fingerprints; or, if not ``final``, members of
    long lists as postings list, fp of five positions. No more than LONG members of a list are held if not ``final``."""

    def work(fp: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        fp = np.unique(fp)
        label = stars(fp, sets[number] if final else None)
        own = np.flatnonzero(label != np.arange(len(fp)))
        return fp[own].view(np.int64), fp[label[own]].view(np.int64)

    def further(fp: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        wider = [tuple(sorted((*sets[number], i))) for i in range(8) if i not in sets[number]]
        return np.concatenate([keys_of(fp, WIDER.index(w), w) for w in wider]), np.tile(fp.view(np.int64), len(wider))

    width = 8 * len(sets[0])
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in _LINK.split(", ")])

    def batch(links: list, on: list) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        k, f = (np.concatenate(x) for x in zip(*on)) if on else (np.zeros(0, np.int64),) * 2
        none = lambda n: pa.nulls(n, pa.int64())
        cols = [pa.concat_arrays([pa.array(x), none(len(k))]) for x in (u, v)] + [pa.concat_arrays([none(len(u)), pa.array(x)]) for x in (k, f)]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        now, parts, held, long = None, [], 0, False  # the list at hand
        for b in batches:
            lists, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            links, on = [], []
            starts = np.flatnonzero(np.diff(lists, prepend=lists[:1] - 1)) if len(lists) else np.zeros(0, int)
            ends = np.append(starts[1:], len(lists))
            one = ends - starts == 1  # most lists hold one member, and only the first and last may go on elsewhere
            for at in np.flatnonzero(~one | (np.arange(len(one)) == 0) | (np.arange(len(one)) == len(one) - 1)).tolist():
                name, fp = int(lists[starts[at]]), fps[starts[at] : ends[at]]
                if name != now:
                    if held > 1 and not long:
                        links.append(work(np.concatenate(parts), now >> width))
                    now, parts, held, long = name, [], 0, False
                if long:
                    on.append(further(fp, now >> width))
                    continue
                parts.append(fp)
                held += len(fp)
                if held > LONG and not final:
                    on.append(further(np.concatenate(parts), now >> width))
                    parts, long = [], True
            yield batch(links, on)
        if held > 1 and not long:
            yield batch([work(np.concatenate(parts), now >> width)], [])

    return listed.mapInArrow(run, _LINK)


def links_of(nodes: DataFrame) -> DataFrame:
    """u, v: links that connect every component of the fingerprints ``fp`` (distinct) of ``nodes``."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "list").sortWithinPartitions("list")
    first = cut(list_links(dealt(postings(nodes)), PLANES, final=False))
    again = list_links(dealt(first.where("list IS NOT NULL").select("list", "fp")), WIDER, final=True)
    return first.unionByName(again).where("u IS NOT NULL").select("u", "v")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp, component (least key reachable over links of at most 3 bits, null if none has a key), for every row.

    The nodes of the components are the fingerprints themselves, so that one without a key links as well.
    """
    fps = cut(fingerprints(df, text, key))
    nodes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    comp = components(links_of(nodes.select("fp")))
    linked = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(linked.join(names, "root").select("fp", "component"), "fp")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(df: DataFrame) -> DataFrame:
    """Of each near-duplicate component the row with the least doc_id stays. Rows that share one doc_id are one document and stay together."""
    least = near_duplicates(df).where("doc_id = component").select("doc_id").distinct()
    rest = df.where("doc_id IS NULL")
    return df.join(least, "doc_id", "left_semi").select(*df.columns).unionByName(rest)
