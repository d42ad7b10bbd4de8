"""Toxicity by cumulative-link ordinal regression on sparse text features (operator 7).

Grades: 0 clean, 1 toxic, 2 severely toxic. P(grade >= k) = sigmoid(w.x - theta_k), one w for both ordered thresholds
theta_1 < theta_2; the output is the expected severity P(>=1) + P(>=2), in 0..2, and a document is rejected if
P(>=1) >= REJECT. x is a set: a document's distinct words and their PREFIXES, hashed. w's features are
chosen by an L1 penalty (accelerated proximal gradient), so only telling ones weigh anything and long clean texts don't add
up to a toxic one; their weights are then fitted with a slight ridge (L-BFGS).

Labels give toxic 0/1; a toxic training document is graded 2 if it holds SEVERE or more distinct words that the training
rows themselves show to be toxic (log-odds over ODDS, in at least SEEN toxic rows). Prefixes are features, but are not
counted for the grade. Training reads at most TRAIN_ROWS labelled rows, chosen by a hash of their doc_id. Their features
are counted by a pre-aggregated shuffle; only the telling ones, at most DIMS, and what rows hold of them come to the
driver. Scoring reads every row and whole texts.

Null and empty texts score as the bare thresholds say (clean). Labelled rows without text, labels with null ids and nulls
in toxic are ignored; a doc_id labelled twice is toxic if either label says so. Without labelled rows of both kinds all
severities are 0. Repeated rows score alike; an empty table gives none; extra columns are kept out of the model.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, need, table

TRAIN_ROWS = 16_000
#: Distinct toxic words of a severely toxic text; a word is toxic from these log-odds and toxic rows on.
SEVERE, ODDS, SEEN = 5, 3.0, 5
DIMS = 1 << 20
PENALTY = 1e-3
STEPS = 250
#: A document is rejected from this probability of any toxicity on.
REJECT = 0.3
RIDGE = 1e-5
PREFIXES = (2, 3, 4, 5, 6)
CACHE = 1 << 18
#: Features enter the model if their chi-square against the labels reaches this.
TELLING = 15.0

_words = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[int]:
    """Hashed ids of a word and its prefixes."""
    raw = word.encode("utf-8", "surrogatepass")
    return [crc32(raw) % DIMS] + [crc32(word[:k].encode("utf-8", "surrogatepass"), k) % DIMS for k in PREFIXES if len(word) > k]


def features(text: str | None) -> list[int]:
    return sorted({f for w in set(_words((text or "").lower())) for f in word_features(w)})


def word_ids(text: str | None) -> list[int]:
    """Hashed ids of the distinct words alone."""
    return sorted({crc32(w.encode("utf-8", "surrogatepass")) % DIMS for w in set(_words((text or "").lower()))})


def log_odds(hit, seen, toxic: int, clean: int):
    """Of toxic against clean rows that hold a feature; hit: toxic rows with it, seen: all rows with it."""
    return np.log((hit + 0.5) / (toxic - hit + 0.5)) - np.log((seen - hit + 0.5) / (clean - seen + hit + 0.5))


def grades(toxic: np.ndarray, toxic_words: np.ndarray) -> np.ndarray:
    """0, 1, 2 from the label and the number of distinct toxic words."""
    return np.where(toxic > 0, 1 + (toxic_words >= SEVERE), 0)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ordinal_loss(w: np.ndarray, t, row: np.ndarray, col: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of -log P(grade), and its slopes by the weights and by the two thresholds. Row ``row[i]`` holds feature ``col[i]``."""
    n = len(grade)
    s = np.bincount(row, w[col], n)
    p1, p2 = sigmoid(s - t[0]), sigmoid(s - t[1])
    q1, q2 = p1 * (1 - p1), p2 * (1 - p2)
    mid = np.maximum(p1 - p2, 1e-12)
    case = [grade == 0, grade == 2]
    cost = -np.log(np.maximum(np.select(case, [1 - p1, p2], mid), 1e-12)).mean()
    by_s = np.select(case, [p1, p2 - 1], -(q1 - q2) / mid)
    by_1, by_2 = np.select(case, [-p1, 0], q1 / mid), np.select(case, [0, 1 - p2], -q2 / mid)
    return cost, np.bincount(col, by_s[row], len(w)) / n, np.array([by_1.mean(), by_2.mean()])


def fit(rows: list[np.ndarray], grade: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[dict[int, float], tuple[float, float]]:
    """Non-zero weights by feature, and the two thresholds. rows: the telling features of each training text."""
    if not len(rows) or grade.min() == grade.max():
        return {}, (50.0, 60.0)
    n, size = len(rows), np.array([len(r) for r in rows])
    names, col = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    row, d = np.repeat(np.arange(n), size), len(names)
    slope = lambda w, t: ordinal_loss(w, t, row, col, grade)[1:]
    v = np.ones(d)  # the largest eigenvalue of X'X/n bounds the curvature
    for _ in range(20):
        v = np.bincount(col, np.bincount(row, v[col], n)[row], d) / n
        v, most = v / max(np.linalg.norm(v), 1e-12), np.linalg.norm(v)
    rate = 1 / (0.5 * most + 0.01)
    w, t = np.zeros(d), np.array([2.0, 3.0])
    z, tz, mom = w, t, 1.0
    for _ in range(steps):
        g, gt = slope(z, tz)
        new_w = z - rate * g
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_t = tz - rate * gt
        new_t[1] = max(new_t[1], new_t[0] + 0.05)
        if ((z - new_w) * (new_w - w)).sum() > 0:  # restart when the momentum points uphill
            mom = 1.0
        nxt = (1 + np.sqrt(1 + 4 * mom * mom)) / 2
        z, tz = new_w + (mom - 1) / nxt * (new_w - w), new_t + (mom - 1) / nxt * (new_t - t)
        tz[1] = max(tz[1], tz[0] + 0.05)
        w, t, mom = new_w, new_t, nxt
    # the penalty has chosen the features; it also shrinks their weights, so these are fitted anew with a slight ridge
    stay = np.flatnonzero(w)
    held = np.full(d, -1)
    held[stay] = np.arange(len(stay))
    row, col, d = row[held[col] >= 0], held[col[held[col] >= 0]], len(stay)

    def loss(x):
        v, t = x[:d], np.array([x[d], x[d] + np.exp(np.clip(x[d + 1], -5, 5))])
        cost, g, gt = ordinal_loss(v, t, row, col, grade)
        return cost + RIDGE * (v @ v) / 2, np.concatenate([g + RIDGE * v, [gt.sum(), gt[1] * (t[1] - t[0])]])

    x = _minimise(loss, np.concatenate([w[stay], [t[0], np.log(t[1] - t[0])]]))
    return {int(k): float(v) for k, v in zip(names[stay], x[:d])}, (float(x[d]), float(x[d] + np.exp(np.clip(x[d + 1], -5, 5))))


def _minimise(loss, x: np.ndarray, rounds: int = 200, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, shares = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            shares.append(a)
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(shares)):
            q += s * (a - (y @ q) / (s @ y))
        step, down = 1.0, g @ q
        while step > 1e-8:
            f2, g2 = loss(x - step * q)
            if f2 <= f - 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g2 - g
        x, g, done, f = x + s, g2, f - f2 < 1e-10, f2
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if done:
            break
    return x


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[int, float], tuple[float, float]]:
    """Fits on at most ``rows`` labelled documents; the bounded label sample is broadcast."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = cut(need(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))

    def count(batches):
        seen, hit = Counter(), Counter()
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                seen.update(f := features(t))
                if y:
                    hit.update(f)
        yield {"f": list(seen), "seen": list(seen.values()), "hit": [hit[f] for f in seen]}

    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return fit([], np.zeros(0))
    even = F.col("seen") * toxic / n
    square = (F.col("hit") - even) ** 2 * n / F.greatest(even * (n - toxic), F.lit(1e-9))
    counted = map_batches(sample, count, "f int, seen long, hit long").groupBy("f").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))
    got = counted.where((F.col("seen") >= 3) & (square >= TELLING)).toArrow()
    names, seen, hit = (got[c].to_numpy() for c in ("f", "seen", "hit"))
    bad = names[(log_odds(hit, seen, toxic, n - toxic) > ODDS) & (hit >= SEEN)]
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(names.tolist()), frozenset(bad.tolist())))

    def run(batches):
        telling, bad = shared.value
        for b in batches:
            yield {"toxic": b["toxic"], "words": [len(bad.intersection(word_ids(t))) for t in b["text"]], "ids": [sorted(telling.intersection(features(t))) for t in b["text"]]}

    got = map_batches(sample, run, "toxic int, words int, ids array<int>").toArrow()
    ids, toxic, words = got["ids"].combine_chunks(), got["toxic"].to_numpy(), got["words"].to_numpy()
    flat, ends = ids.flatten().to_numpy(), np.array(ids.offsets)
    each = [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
    order = sorted(range(len(each)), key=lambda i: (crc32(each[i].tobytes()), toxic[i], words[i]))  # so that a rerun sums alike
    return fit([each[i] for i in order], grades(toxic, words)[order])


def toxicity(df: DataFrame, model: tuple[dict[int, float], tuple[float, float]], text: str = "text") -> DataFrame:
    """``df`` with severity (0..2), p_toxic and toxic appended; one narrow pass. Appended names replace equal ones."""
    weights, (t1, t2) = model
    shared = df.sparkSession.sparkContext.broadcast(weights)  # at most the training features that L1 left

    def run(batches):
        get, cache = shared.value.get, {}
        for b in batches:
            score = []
            for t in b[text]:
                found = {}
                for w in set(_words((t or "").lower())):
                    pair = cache.get(w)
                    if pair is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        pair = cache[w] = tuple((f, x) for f in word_features(w) if (x := get(f)))
                    if pair:
                        found.update(pair)
                score.append(sum(found[f] for f in sorted(found)))
            s = np.array(score, float)
            p1, p2 = sigmoid(s - t1), sigmoid(s - t2)
            yield {c: b[c] for c in names} | {"severity": (p1 + p2).tolist(), "p_toxic": p1.tolist(), "toxic": (p1 >= REJECT).tolist()}

    names = [c for c in df.columns if c not in ("severity", "p_toxic", "toxic")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    return map_batches(df.select(*[F.col(f"`{c}`") for c in names]), run, f"{fields}, severity double, p_toxic double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "severity", "p_toxic", "toxic")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text isn't rejected, with the columns of ``docs``."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    scored = toxicity(packed, train(docs, labels))
    return scored.where("NOT toxic").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
