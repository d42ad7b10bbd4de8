"""Benchmark decontamination by latent semantic retrieval (operator 8).

1. Terms are the benchmark's distinct words; their inverse frequencies are counted over all documents.
2. Randomised SVD: every document is cut into passages of PASSAGE words, each a unit TF-IDF row of A. One distributed pass
   gives Z = A'(A G) for a random G, summed term by term; the driver takes the leading right singular directions from
   (Z, G'Z), which are a few thousand rows. The RANK leading ones are the latent space, each divided by its singular value
   (the fold-in of latent semantic indexing): directions that many passages share, be it a language, common words or a
   passage that is copied often, weigh less, and none is left out.
3. Every document's sliding windows, of each benchmark item's own length and every STRIDE words, are candidates if they hold
   at least OVERLAP of the item's term weight, whatever their cosine. Such a window holds one of the item's prefix terms, the
   heaviest ones without which OVERLAP can't be reached, so the weights are summed, exactly, about those words only.
   The windows are also folded into the latent space as differences of running sums, and those whose cosine with an
   item reaches COSINE are candidates too if they hold enough words of the item for LCS_LOW of it: the cosine adds
   paraphrases in which the item's weighty words are changed, and never drops a window.
4. A candidate is a leak if the longest common subsequence of words covers LCS of the item; or if it covers LCS_LOW
   (a paraphrase) and the window also holds the item's answer in order: the words of its last sentence, at least ANSWER and
   at most the last ANSWER_MOST and half of the item's words, so that a paraphrase is not asked for most of the item.

The benchmark is a stated query set. Frequencies and latent space are those of all its terms, from one pass each, whatever
the number of items; the windows are searched for blocks of at most BLOCK items and WORDS words, each a pass, and how items
fall into blocks has no say in what is found. What is broadcast is bounded: 12 bytes for each of at most TERMS terms (a
benchmark with more distinct words is taken in parts), FEATURES latent features, and a block's items.

Null and blank texts have no words and no leak; items without words are ignored; equal items all report; items with
null ids report as -1. Long texts are searched whole, in pieces that overlap by
more than the longest item. Repeated documents report alike; an empty
benchmark marks nothing; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words as words
from .common import joined_ascii_words, map_batches, need, table

RANK, EXTRA = 48, 8
PASSAGE, STRIDE = 40, 4
COSINE, OVERLAP = 0.6, 0.5
LCS, LCS_LOW, ANSWER, ANSWER_MOST = 0.75, 0.5, 4, 8
#: Items and words of a block, blocks that one pass over the texts looks for, terms of a vocabulary, and latent features.
BLOCK, WORDS, PASS = 2000, 100_000, 16
TERMS, FEATURES = 1 << 21, 1 << 16
PIECE = 1 << 15
#: Fixed point of the term weights, and the most numbers (windows by items) that are held at once.
UNIT, SUMS = 256, 1 << 22

def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    return lcs_at(bits(a), len(a), b)


def bits(a: list) -> dict:
    """Each word's places in ``a`` as a bit set."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    return at


def lcs_at(at: dict, n: int, b: list) -> int:
    full = (1 << n) - 1
    s = full
    for m in map(at.get, b):
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence, with the sentences before it until there are ANSWER words; of a long one, its end."""
    got: list[bytes] = []
    for part in reversed(re.split(r"[.!?\n]+", text)):
        got = words(part) + got
        if len(got) >= ANSWER:
            break
    return got[-max(ANSWER, min(ANSWER_MOST, len(words(text)) // 2)) :]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class WordHashes:
    """Polynomial hashes modulo 2**64 of the words of a byte string, all at once from one running sum."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word (run of bytes that aren't spaces) starts, and its hash."""
        if len(self.up) <= len(raw):
            n = max(PIECE * 8, 2 * len(raw))
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        c = np.frombuffer(raw, np.uint8)
        edge = np.diff((c != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(c * self.up[: len(c)], out=total[1:])
        return start, (total[end] - total[start]) * self.down[start] * _MIX


class Vocabulary:
    """Terms by the hashes of their words, numbered in the hashes' order; 12 bytes a term and a table of fixed size."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        # slot of the top bits -> first term there; slots with more terms are looked up in the sorted hashes
        self.bits = min(22, max(16, (64 * len(self.hashes)).bit_length()))
        slot = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(self.hashes), dtype=np.int32)[::-1]
        self.crowded = np.bincount(slot, minlength=1 << self.bits) > 1

    def __len__(self) -> int:
        return len(self.hashes)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; other words get len(self)."""
        none = np.int32(len(self.hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[slot]
        out[self.hashes[np.maximum(out, 0)] != hashes] = none
        if len(rest := np.flatnonzero(self.crowded[slot] & (out == none))):
            k = np.minimum(np.searchsorted(self.hashes, hashes[rest]), len(self.hashes) - 1)
            out[rest] = np.where(self.hashes[k] == hashes[rest], k, none)
        return out

    def of_texts(self, texts: list[str | None], hasher: WordHashes):
        """Yields (index of the first text, term numbers of joined texts, number of words of each text)."""
        for first, raw, starts in joined_ascii_words(texts, 8 * PIECE):
            at, hashes = hasher(raw)
            bounds = np.searchsorted(at, np.append(starts, len(raw) + 1))
            yield first, self.look_up(hashes), np.diff(bounds)


class Items(Vocabulary):
    """A block of benchmark items with their terms."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows  # plain, so that a block can be sent where this package isn't installed
        rows = [(i, t, w) for i, t in rows if (w := words(t))]
        self.ids = [i for i, _, _ in rows]
        self.words = [w for _, _, w in rows]
        self.answers = [answer_of(t) for _, t, _ in rows]
        terms = sorted({w for ws in self.words for w in ws})
        hashes = WordHashes()(b" ".join(terms))[1]
        super().__init__(hashes)
        self.terms = dict(zip(terms, np.searchsorted(self.hashes, hashes).tolist()))

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        return np.array([self.terms.get(w, len(self)) for w in ws], np.int32)


def inverse_frequencies(docs: DataFrame, terms: Vocabulary) -> np.ndarray:
    """ln(1 + documents / documents with the term), per term and a 0 for other words. One pass, pre-aggregated by task."""
    shared = docs.sparkSession.sparkContext.broadcast(terms.hashes)

    def run(batches):
        terms, n, hasher = Vocabulary(shared.value), 0, WordHashes()
        v = len(terms)
        seen, many = np.zeros(v + 1, np.int64), max(1, min(500, (1 << 22) // (v + 1)))
        for b in batches:
            n += len(b["text"])
            for _, ids, size in terms.of_texts(b["text"], hasher):
                ends = np.concatenate([[0], np.cumsum(size)])
                for at in range(0, len(size), many):
                    part = size[at : at + many]
                    own = ids[ends[at] : ends[at + len(part)]]
                    here = np.zeros((len(part), v + 1), bool)
                    here[np.repeat(np.arange(len(part)), part), own] = True
                    if len(part) > 1:
                        seen += here.sum(axis=0)
                    else:
                        seen[np.flatnonzero(here[0])] += 1
        hit = np.flatnonzero(seen[:-1])
        yield {"term": [-1, *hit.tolist()], "n": [n, *seen[hit].tolist()]}

    got = dict(map_batches(need(docs, "text"), run, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    n = np.array([got.get(k, 0) for k in range(len(terms))], float)
    return np.append(np.log1p(got.get(-1, 0) / np.maximum(n, 1)), 0.0)


def latent_rows(docs: DataFrame, terms: Vocabulary, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Features (a term's number modulo FEATURES; so each term its own, up to FEATURES terms) by RANK: the leading right
    singular vectors of all TF-IDF passages, each over its singular value."""
    v = min(len(terms), FEATURES)
    width = min(RANK + EXTRA, v)
    g = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))[0]
    shared = docs.sparkSession.sparkContext.broadcast((terms.hashes, idf.astype(np.float32), g.astype(np.float32)))

    def run(batches):
        hashes, idf, g = shared.value
        terms = Vocabulary(hashes)
        own = len(terms) <= len(g)  # then a feature's weight is one term's, and can be applied to the sums
        weighed = idf[:-1, None] * g if own else None
        z = np.zeros(g.shape)

        def add(ids: np.ndarray, row: np.ndarray):
            keep = ids < len(terms)
            ids, row = ids[keep], row[keep]
            if not len(ids):
                return
            first = np.flatnonzero(np.diff(row, prepend=-1))
            which = np.cumsum(np.diff(row, prepend=row[0]) > 0)
            norm = np.sqrt(np.maximum(np.add.reduceat(idf[ids] ** 2, first), 1e-12))
            ids_ = ids if own else ids % len(g)
            y = np.add.reduceat(weighed[ids] if own else idf[ids, None] * g[ids_], first, axis=0) / (norm**2)[:, None]
            order = np.argsort(ids_.astype(np.int16) if len(g) < 32000 else ids_, kind="stable")
            begin = np.flatnonzero(np.diff(ids_[order], prepend=-1))
            each = y[which[order]] if own else y[which[order]] * idf[ids[order], None]
            z[ids_[order][begin]] += np.add.reduceat(each, begin, axis=0)

        hasher = WordHashes()
        for b in batches:
            for _, ids, size in terms.of_texts(b["text"], hasher):
                passages = -(-size // PASSAGE)
                before = np.cumsum(passages) - passages
                within = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                add(ids, np.repeat(before, size) + within // PASSAGE)
        if own:
            z *= idf[:-1, None]
        hit = np.flatnonzero(np.abs(z).sum(axis=1))
        yield {"term": hit, "z": z[hit].tolist()}

    each = map_batches(need(docs, "text"), run, "term int, z array<double>")
    got = each.groupBy("term").agg(*[F.sum(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(width)]).toArrow()
    z = np.zeros((v, width))
    if got.num_rows:
        z[got["term"].to_numpy()] = np.stack([got[f"z{i}"].to_numpy() for i in range(width)], 1)
    # A'A is near Z (G'Z)^-1 Z'; its leading eigenvectors are the right singular vectors
    c = g.T @ z
    val, vec = np.linalg.eigh((c + c.T) / 2)
    good = val > 1e-9 * max(val.max(initial=0), 1e-12)
    root = z @ (vec[:, good] / np.sqrt(val[good])) if good.any() else np.zeros((v, 1))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    order = np.argsort(-s)[:RANK]
    return (u[:, order] * (s.max() / np.maximum(s[order], 1e-6 * max(s.max(), 1e-12)))).astype(np.float32)


def of_block(items: Items, terms: Vocabulary, idf: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's part of the statistics: its terms' idf and latent rows, and a 0 for other words."""
    k = terms.look_up(items.hashes)
    rows = idf[k, None] * lead[k % len(lead)]
    return np.append(idf[k], 0.0), np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)


class Search:
    """Finds the leaks of one block of items in texts."""

    def __init__(self, items: Items, idf: np.ndarray, rows: np.ndarray):
        self.items, self.rows, self.hasher = items, rows, WordHashes()
        numbers = [items.numbers(w) for w in items.words]
        folded = np.stack([rows[n].sum(axis=0) for n in numbers])
        long = np.linalg.norm(folded, axis=1)
        folded /= np.maximum(long, 1e-12)[:, None]
        size = np.array([max(1, round(len(n) / STRIDE)) for n in numbers])
        self.order = np.argsort(size, kind="stable")  # items by size; columns of ``weight`` and ``folded``
        self.size, self.folded = size[self.order], np.ascontiguousarray(folded[self.order].T)
        # whole numbers, so that differences of running sums are exact
        widest = (int(size.max()) + 2) * STRIDE
        unit = np.round(idf * min(UNIT, (1 << 30) / (widest * max(float(idf.max()), 1.0)))).astype(np.int32)
        # a bit for each term and item that holds it; and by term the items whose prefix it is in: those of an item's terms,
        # heaviest first, without which a window can't hold ``least`` of the item, each term as often as the item has it
        self.unit, self.has = unit, np.zeros((len(idf), (len(numbers) + 7) // 8), np.uint8)
        first = [[] for _ in range(len(idf))]
        for k, j in enumerate(self.order):
            own, often = np.unique(numbers[j], return_counts=True)
            self.has[own, k >> 3] |= np.uint8(1 << (k & 7))
            heavy = np.argsort(-unit[own], kind="stable")
            rest = (unit[own] * often).sum(dtype=np.int64) - np.cumsum((unit[own] * often)[heavy], dtype=np.int64)
            least = max(1, int(np.ceil(OVERLAP * unit[numbers[j]].sum(dtype=np.int64))))
            for t in own[heavy[: int(np.argmax(rest < least)) + 1]].tolist():
                first[t].append(k)
        self.hits = np.array([len(f) for f in first], np.int32)  # none for other words
        self.starts = np.cumsum(self.hits) - self.hits
        self.holders = np.array([k for f in first for k in f], np.int64)
        self.least = np.array([max(1, int(np.ceil(OVERLAP * unit[numbers[j]].sum(dtype=np.int64)))) for j in self.order], np.int32)
        # running sums are off by rounding: a window of next to no latent weight, measured by the item's own, has no direction
        self.floor = np.where(long > 1e-12, 1e-3 * long, np.inf)[self.order].astype(np.float32)
        self.common = np.array([LCS_LOW * len(numbers[j]) for j in self.order])
        self.places = [bits(w) for w in items.words]
        self.longest = int(size.max())

    def holds(self, ids: np.ndarray, items: np.ndarray) -> np.ndarray:
        """1 where the item beside a word (a column of ``folded``) holds it, else 0."""
        return self.has[ids, items >> 3] >> (items & 7).astype(np.uint8) & 1

    def heavy(self, ids: np.ndarray, n: int) -> np.ndarray:
        """window * items + item of all windows that hold ``least`` of an item: those about a word of its prefix are summed."""
        at = np.flatnonzero(self.hits[ids])
        many = self.hits[ids[at]]
        item = self.holders[np.repeat(self.starts[ids[at]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        stride = np.repeat(at, many) // STRIDE
        pairs = np.unique(stride * len(self.order) + item)
        stride, item = np.divmod(pairs, len(self.order))
        out = [np.zeros(0, np.int64)]
        pad = np.full((self.longest + 2) * STRIDE, len(self.items.terms), np.int32)
        padded = np.concatenate([pad, ids, pad])
        for m in np.unique(self.size[item]).tolist():
            own = np.flatnonzero(self.size[item] == m)
            span = (2 * m + 3) * STRIDE  # windows of m strides, and one more on each side, that reach the word's stride
            most = max(1, SUMS // span)
            for begin in range(0, len(own), most):
                r, k = stride[own[begin : begin + most]], item[own[begin : begin + most]]
                near = padded[((r - m - 1) * STRIDE + len(pad))[:, None] + np.arange(span)]
                sums = np.zeros((len(r), 2 * m + 4), np.int64)
                np.cumsum((self.holds(near, k[:, None]) * self.unit[near]).reshape(len(r), -1, STRIDE).sum(axis=2), axis=1, out=sums[:, 1:])
                i, t = np.nonzero(sums[:, m + 2 :] - sums[:, : m + 2] >= self.least[k, None])
                start = r[i] - m + t
                good = (start >= 0) & (start < n)
                out.append(start[good] * len(self.order) + k[i[good]])
        return np.unique(np.concatenate(out))

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window start (in strides), item, cosine. ``ids``: a multiple of STRIDE long."""
        n, count = len(ids) // STRIDE, len(self.order)
        run = np.zeros((n + self.longest + 1, self.rows.shape[1]), np.float32)
        words = ids.reshape(n, STRIDE)
        each = self.rows.take(words[:, 0], axis=0)
        for k in range(1, STRIDE):
            each += self.rows.take(words[:, k], axis=0)
        np.cumsum(each, axis=0, out=run[1 : n + 1])
        run[n + 1 :] = run[n]
        pad = np.full((self.longest + 2) * STRIDE, len(self.items.terms), np.int32)
        padded = np.concatenate([pad[:STRIDE], ids, pad])
        exact, out = self.heavy(ids, n), []
        window, item = np.divmod(exact, count)
        wide = max(1, SUMS // n)
        for m in np.unique(self.size).tolist():
            first, last = np.searchsorted(self.size, [m, m + 1]).tolist()
            u = run[m : n + m] - run[:n]
            norm = np.sqrt(np.einsum("ij,ij->i", u, u))
            own = self.size[item] == m
            x, y = window[own], item[own]
            out.append((x, self.order[y], np.einsum("ij,ij->i", u[x], self.folded.T[y]) / np.maximum(norm[x], 1e-12)))
            for a in range(first, last, wide):
                b = min(last, a + wide)
                score = u @ self.folded[:, a:b]
                floor = self.floor[a:b]
                i, j = np.divmod(np.flatnonzero(score >= np.maximum(COSINE * norm, floor.min())[:, None]), b - a)
                most = max(1, SUMS // ((m + 2) * STRIDE))
                for at in range(0, len(i), most):
                    x, y = i[at : at + most], j[at : at + most]
                    new = np.flatnonzero((score[x, y] >= floor[y]) & ~np.isin(x * count + a + y, exact))
                    x, y = x[new], y[new]
                    span = padded[(x * STRIDE)[:, None] + np.arange((m + 2) * STRIDE)]
                    ok = self.holds(span, a + y[:, None]).sum(axis=1, dtype=np.int32) >= self.common[a + y]
                    x, y = x[ok], y[ok]
                    out.append((x, self.order[a + y], score[x, y] / np.maximum(norm[x], 1e-12)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def verify(self, ws: list[bytes], start: int, item: int) -> float:
        """Share of the item that its longest common subsequence with the window covers; 0 if the checks fail."""
        want = self.items.words[item]
        window = ws[max(0, start - 2 * STRIDE) : start + len(want) + 3 * STRIDE]
        share = lcs_at(self.places[item], len(want), window) / len(want)
        if share >= LCS:
            return share
        answer = self.items.answers[item]
        return share if share >= LCS_LOW and lcs(answer, window) == len(answer) else 0.0

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float]]]:
        """For each text its leaked items: (item id, LCS share, cosine), best window of each."""
        out: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
        none, parts, held = len(self.items.terms), [], 0

        def flush():
            joined = np.concatenate([p[2] for p in parts])
            ends = np.cumsum([len(p[2]) for p in parts]) // STRIDE
            starts, items, cosines = self.candidates(joined)
            split: dict[int, list[bytes]] = {}
            for k, s, j, c in zip(np.searchsorted(ends, starts, "right").tolist(), starts.tolist(), items.tolist(), cosines.tolist()):
                n, offset, ids = parts[k]
                if n not in split:
                    split = {n: words(texts[n])}
                if share := self.verify(split[n], offset + (s - int(ends[k])) * STRIDE + len(ids), j):
                    out[n][j] = max(out[n].get(j, (0.0, 0.0)), (share, c))

        overlap = 2 * (self.longest + 6) * STRIDE
        piece = max(PIECE, 2 * overlap)  # grows with the longest item, so that pieces always overlap by it
        step = piece - overlap
        for first, every, size in self.items.of_texts(texts, self.hasher):
            begin = 0
            for n, count in enumerate(size.tolist(), first):
                for at in range(0, count, step):
                    ids = every[begin + at : begin + min(count, at + piece)]
                    ids = np.concatenate([ids, np.full(-len(ids) % STRIDE, none, np.int32)])
                    if held and held + len(ids) > piece:
                        flush()
                        parts, held = [], 0
                    parts.append((n, at, ids))
                    held += len(ids)
                    if at + piece >= count:
                        break
                begin += count
        if parts:
            flush()
        return [sorted((self.items.ids[j], s, c) for j, (s, c) in found.items()) for found in out]


def item_blocks(benchmark: DataFrame, size: int = BLOCK):
    """Blocks of at most ``size`` items and, but for a longer single item, WORDS words; only one is held at a time."""
    rows: list[tuple[int, str]] = []
    held = 0
    for i, t in benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)), "text").orderBy("item_id", "text").toLocalIterator():
        n = len(words(t))
        if rows and (len(rows) == size or held + n > WORDS):
            yield Items(rows)
            rows, held = [], 0
        rows.append((i, t or ""))
        held += n
    if rows:
        yield Items(rows)


def vocabularies(benchmark: DataFrame, size: int = BLOCK) -> list[tuple[int, Vocabulary]]:
    """(blocks, their vocabulary): the whole benchmark's in one, unless it has more than TERMS terms."""
    out, hashes, blocks = [], np.zeros(0, np.uint64), 0
    for items in item_blocks(benchmark, size):
        both = np.union1d(hashes, items.hashes)
        if blocks and len(both) > TERMS:
            out.append((blocks, Vocabulary(hashes)))
            both, blocks = np.unique(items.hashes), 0
        hashes, blocks = both, blocks + 1
    return [*out, (blocks, Vocabulary(hashes))] if blocks else out


def leaks(df: DataFrame, benchmark: DataFrame, carry: list[str], block: int = BLOCK) -> DataFrame:
    """``carry`` columns, text and found array<struct<item, lcs, cosine>> for every row of ``df``."""
    out = df.select(*[F.col(f"`{c}`") for c in carry], "text", F.array().cast("array<struct<item:long,lcs:double,cosine:double>>").alias("found"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    sc, blocks = df.sparkSession.sparkContext, item_blocks(benchmark, block)
    for count, terms in vocabularies(benchmark, block):
        if not len(terms):
            continue
        idf = inverse_frequencies(df, terms)
        lead = latent_rows(df, terms, idf)
        own = (items for items in itertools.islice(blocks, count) if items.words)
        while group := [(items.rows, *of_block(items, terms, idf, lead)) for items in itertools.islice(own, PASS)]:
            shared = sc.broadcast(group)

            def run(batches, shared=shared):
                searches = [Search(Items(rows), idf, lead) for rows, idf, lead in shared.value]
                for b in batches:
                    found = b["found"]
                    for search in searches:
                        now = [[dict(zip(("item", "lcs", "cosine"), x)) for x in f] for f in search.leaks(b["text"])]
                        found = [a + n for a, n in zip(found, now)]
                    yield b | {"found": found}

            out = map_batches(out, run, spec)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ids, ascending, comma-joined), lcs and cosine of the best."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    item = F.array_sort(F.transform("found", lambda x: x["item"]))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.array_join(item.cast("array<string>"), ",").alias("items"), F.array_max(F.transform("found", lambda x: x["lcs"])).alias("lcs"), F.array_max(F.transform("found", lambda x: F.round(x["cosine"], 3))).alias("cosine"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a leak, with the columns of ``docs``."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    clean = leaks(packed, benchmark, ["row"]).where(F.size("found") == 0)
    return clean.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
