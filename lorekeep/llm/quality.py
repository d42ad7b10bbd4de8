"""Quality by nearest-neighbour voting in a latent semantic space (operator 9).

A text's terms are the trigrams of its bytes' classes (letter case, digits, white space, kinds of signs, non-ASCII) and a few
counts of word repetition. TF-IDF rows of at most SAMPLE labelled documents give, by singular value decomposition, RANK latent
directions. The sample's unit latent vectors and labels, whose size that parameter bounds, are broadcast; every document
takes exact cosine products with all of them, in blocks, and its NEIGHBOURS nearest vote with their similarity as weight.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Neither labels, lang, source nor doc_id enters
a score. Null and empty texts have no terms and get the sample's mean label; so does everything if nothing is labelled (0.5).
Equal texts score alike; ties of similarity go to the earlier sample row; a doc_id labelled twice counts as its least label;
null labels are ignored. Very long texts are read whole, PIECE bytes at a time. An empty table gives none.
"""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, need, table

SAMPLE, RANK, NEIGHBOURS = 4000, 32, 15
PIECE = 1 << 20

_CLASSES = np.full(256, 9, np.uint16)
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[ord(" ")] = 3
_CLASSES[ord("\n")] = 4
_CLASSES[128:] = 10
for _k, _signs in ((5, "."), (6, ",;:"), (7, "!?"), (8, "|"), (11, "()[]{}<>\"'`")):
    for _s in _signs:
        _CLASSES[ord(_s)] = _k
_KINDS = 12
TERMS = _KINDS**3 + 3


def terms(text: str | None) -> np.ndarray:
    """Relative frequencies of the terms (float32); all 0 for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float64)
    for at in range(0, len(raw), PIECE):
        c = _CLASSES[np.frombuffer(raw[at : at + PIECE + 2], np.uint8)]
        if len(c) > 2:
            out[: _KINDS**3] += np.bincount(c[:-2] * (_KINDS * _KINDS) + c[1:-1] * _KINDS + c[2:], minlength=_KINDS**3)
    if n := out.sum():
        out /= n
    if words := raw.split():
        out[-3] = sum(map(eq, words, words[1:])) / len(words)
        out[-2] = 1 - len(set(words)) / len(words)
        out[-1] = raw.count(b"\n") / len(words)
    return np.sqrt(out).astype(np.float32)


def held_out(key) -> bool:
    """crc32 of the id as text (null: empty) leaves 1 when divided by 3."""
    return crc32(b"" if key is None else str(key).encode()) % 3 == 1


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK) -> dict:
    """Projection (terms x rank, idf included) and the sample's unit vectors with their labels."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1 if len(x) else np.ones(TERMS)
    if not len(x):
        return {"project": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": y, "mean": 0.5}
    a = (x * idf).astype(np.float32)
    used = np.flatnonzero(a.any(axis=0))
    val, vec = np.linalg.eigh(a[:, used].T @ a[:, used])
    lead = vec[:, np.argsort(-val)[:rank]]
    project = np.zeros((TERMS, lead.shape[1]), np.float32)
    project[used] = idf[used, None] * lead
    v = x @ project
    return {"project": project, "vectors": (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32), "labels": y.astype(np.float32), "mean": float(y.mean())}


def vote(model: dict, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of term rows ``x``."""
    v = x @ model["project"]
    norm = np.linalg.norm(v, axis=1)
    out = np.full(len(x), model["mean"])
    k = min(k, len(model["labels"]))
    for at in range(0, len(x), 256):
        rows = at + np.flatnonzero(norm[at : at + 256] > 0)
        if not len(rows) or not k:
            continue
        near = (v[rows] / norm[rows, None]) @ model["vectors"].T
        # whole numbers, so that the order of sums does not decide between equal neighbours; then the earlier row is nearer
        near = np.rint(near * 1e5).astype(np.int64)
        best = np.argpartition(np.arange(near.shape[1]) - near * near.shape[1], k - 1, axis=1)[:, :k]
        weight = (np.maximum(np.take_along_axis(near, best, 1), 0) / 1e5) ** 8
        out[rows] = (weight * model["labels"][best]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)
    return np.clip(np.round(out, 6), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits on at most ``sample`` rows (by a hash of doc_id) whose id isn't held out. Their term rows, whose number and width are
    fixed, come to the driver."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(crc % 3 != 1)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    each = need(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "quality": b["quality"], "x": [terms(t).tobytes() for t in b["text"]]}

    got = map_batches(each.select("doc_id", "quality", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["doc_id"][i].as_py(), got["x"][i].as_py()))
    x = np.stack([np.frombuffer(got["x"][i].as_py(), np.float32) for i in order]) if order else np.zeros((0, TERMS), np.float32)
    return fit(x, np.array([float(got["quality"][i].as_py() > 0) for i in order]))


def quality(df: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted for every row; one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            score = []
            for at in range(0, len(b[text]), 500):
                score += vote(shared.value, np.stack([terms(t) for t in b[text][at : at + 500]])).tolist()
            yield {key: b[key], "held_out": [held_out(k) for k in b[key]], "score": score, "predicted": [int(s >= 0.5) for s in score]}

    return map_batches(need(df, key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
