"""Centroid clustering, vector codes and language-model scores against plain loops."""

import math
import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm import clustering, codes, language_model, vectors

VECTORS = "vec_id long, embedding array<float>, label int, id string, n long, cluster int"


def rows_of(n, dims, seed, spread=0.05):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, dims))
    return [[float(np.float32(v)) for v in middles[r.integers(6)] + spread * r.normal(size=dims)] for _ in range(n)]


def plain_lloyd(x, cents, rounds):
    """x, cents: lists of lists of int."""
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for v in x]
        cents = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for v, k in zip(x, at, strict=True) if k == n]) else c for n, c in enumerate(cents)]
    return [near(v) for v in x], cents


def whole(v, scale):
    return [math.floor(c * scale) for c in v]


@pytest.mark.parametrize("n, leaf, few, spread", [(1, 4, 2, 0.1), (700, 8, 3, 0.05), (700, 64, 16, 1.0), (300, 4, 2, 0.0)])
def test_cover_trees_hold_all_and_walks_are_exact(n, leaf, few, spread):
    x = np.array([whole(v, 256) for v in rows_of(n, 8, n, spread)])
    t = clustering.CoverTree(x, leaf, few)
    assert sorted(t.order) == list(range(n)) and len(t.lo) <= 2 * n
    sums = t.sums(x)
    for i in range(len(t.lo)):
        own = t.order[t.lo[i] : t.hi[i]]
        assert t.center[i] in own and t.radius[i] == np.sqrt(((x[own] - x[t.center[i]]) ** 2).sum(axis=1)).max()
        assert (sums[i] == x[own].sum(axis=0)).all()
        kids = range(t.first[i], t.last[i])
        assert not kids or sorted(np.concatenate([t.order[t.lo[k] : t.hi[k]] for k in kids])) == sorted(own)
    r = np.random.default_rng(1)
    cents = np.concatenate([x[r.integers(n, size=9)], x[:1], x[:1] + 1])  # equal ones among them
    tree = {k: np.asarray(getattr(t, k), np.int64) for k in ("lo", "hi", "first", "last")} | {"radius": t.radius}
    place = np.empty(n, np.int64)
    place[t.order] = np.arange(n)
    nodes, leaves, compared = clustering.walk({"x": x[t.order], "tree": tree | {"center": place[t.center]}}, clustering.Centroids(cents))
    got = np.full(n, -1)
    for node, c in nodes:
        got[t.lo[node] : t.hi[node]] = c
    for lo, hi, label in leaves:
        got[lo:hi] = label
    assert (got == ((x[t.order][:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert compared < n * len(cents) or spread == 1.0 or n == 1


@pytest.mark.parametrize("n, spread", [(1, 0.1), (900, 0.05), (900, 1.0), (300, 0.0)])
def test_filtering_is_exact(n, spread):
    x = np.array([whole(v, 64) for v in rows_of(n, 4, n, spread)])
    t = codes.Tree(x, leaf=8)
    book = np.concatenate([x[:7], x[:1], x[-1:] + 1])
    tree = codes.unpacked(t.packed(x), 4)
    assert (tree["x"] == x[t.order]).all()
    nodes, entries, rows, labels, compared = codes.walk(tree, book)
    got = np.full(n, -1)
    for node, e in zip(nodes, entries, strict=True):
        assert (tree["sums"][node] == x[t.order[tree["lo"][node] : tree["hi"][node]]].sum(axis=0)).all()
        got[tree["lo"][node] : tree["hi"][node]] = e
    got[rows] = labels
    assert (got == ((x[t.order][:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert compared < n * len(book) / 2 or n == 1


def odd_vectors():
    """Nulls, repeats, ties, a hot vector, wrong lengths, ids that are null, columns that the operators don't read."""
    out = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(rows_of(240, 8, 3))]
    out += [(500 + i, [0.25] * 8, None) for i in range(120)] + [out[0], (0, out[1][1], 7), (None, [0.5] * 8, 1), (None, [-0.5] * 8, None)]
    return out + [(900, None, 1), (901, [], 1), (902, [0.1] * 7, 1), (903, [0.1] * 7 + [None], 1), (904, [0.1] * 7 + [math.nan], 1), (905, [math.inf] + [0.1] * 7, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 9) for r in rows], VECTORS).repartition(5)


def fine(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("k, block", [(12, 64), (12, 4096), (1000, 4096)])
def test_clusters_by_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(clustering.grown, "__defaults__", (block,))
    rows = odd_vectors()
    kept = [r for r in rows if fine(r[1], 8)]
    sha = lambda i: (i is None, sha256(f"2:{i}".encode()).hexdigest())
    order = sorted(kept, key=lambda r: (sha(r[0]), r[1]))
    x = [whole(r[1], 256) for r in kept]
    near, cents = plain_lloyd(x, [whole(r[1], 256) for r in order[:k]], 3)
    per = Counter()
    for d, c in near:
        per[c] += d
    want = [(r[0], c, d, per[c], sum(per.values()), sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for r, (d, c) in zip(kept, near, strict=True)]
    drawn = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    got = clustering.cluster(frame(spark, rows), [drawn], k=k, rounds=3, dims=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("entries, block", [(6, 50), (16, 4096), (256, 4096)])
def test_codes_by_brute_force(spark, monkeypatch, entries, block):
    monkeypatch.setattr(codes.grown, "__defaults__", (block,))
    rows = odd_vectors()
    kept = [r for r in rows if fine(r[1], 8)]
    x = [whole(r[1], 4096) for r in kept]
    start = [whole(r[1], 4096) for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        near, book = plain_lloyd([v[2 * p : 2 * p + 2] for v in x], [v[2 * p : 2 * p + 2] for v in start], 3)
        books += [c for e in book for c in e]
        for i, (d, e) in enumerate(near):
            code[i] += f"{e:02x}"
            error[i] += d
    per = Counter()
    for r, e in zip(kept, error, strict=True):
        per[r[2]] += e
    sha = sha256(",".join(map(str, books)).encode()).hexdigest()
    want = [(r[0], c, e, per[r[2]], sha) for r, c, e in zip(kept, code, error, strict=True)]
    got = codes.compress(frame(spark, rows), entries=entries, parts=4, rounds=3, dims=8)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_vectors_without_rows_and_beyond_the_limit(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id string, embedding array<double>, label string")
    assert clustering.cluster(empty, [F.col("vec_id")]).collect() == [] and codes.compress(empty).collect() == []
    assert clustering.cluster(empty.limit(0), [F.col("vec_id")]).schema["vec_id"].dataType == T.StringType()
    with pytest.raises(ValueError):
        vectors.whole_numbers(np.array([1e9]), 256)


# --- language model -------------------------------------------------------------------------------------------------------


def plain_scores(docs, order, em_rounds=30):
    """Dictionaries and loops; estimates aren't rounded where weights are learned."""
    fold = lambda i: crc32(b"" if i is None else str(i).encode()) % 5
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low(t)).split(" ") if w]
    texts = [(i, fold(i), split(t)) for i, t in docs]

    def counts(folds):
        c = Counter()
        for _, f, ws in texts:
            if f in folds:
                seq = ["<s>"] * (order - 1) + ws + ["</s>"]
                for at in range(order - 1, len(seq)):
                    for k in range(order):
                        c[tuple(seq[at - k : at + 1])] += 1
                    for k in range(1, order):
                        c["context", *seq[at - k : at]] += 1
                    c["all"] += 1
        return c

    full, held = counts({0, 2, 3, 4}), counts({2, 3, 4})
    v = sum(1 for g in full if isinstance(g, tuple) and len(g) == 1)

    def estimates(c, seq, at):
        ps = [c[tuple(seq[at - k : at + 1])] / max(1, c["context", *seq[at - k : at]]) for k in range(order - 1, 0, -1)]
        longest = c["context", *seq[at - order + 1 : at]] if order > 1 else 0
        return longest.bit_length(), ps + [c[(seq[at],)] / max(1, c["all"]), 1 / (v + 1)]

    events = []
    for _, f, ws in texts:
        if f == 0:
            seq = ["<s>"] * (order - 1) + ws + ["</s>"]
            events += [estimates(held, seq, at) for at in range(order - 1, len(seq))]
    prior = {b: [0 if b == 0 and order > 1 and k == 0 else 1 for k in range(order + 1)] for b in range(40)}
    lam = {b: [p / sum(prior[b]) for p in prior[b]] for b in prior}
    before = None
    for _ in range(em_rounds):
        sums, n, ll = {}, Counter(), 0
        for b, ps in events:
            mix = sum(w * p for w, p in zip(lam[b], ps, strict=True))
            ll += math.log(mix)
            n[b] += 1
            sums[b] = [s + w * p / mix for s, w, p in zip(sums.get(b, [0] * (order + 1)), lam[b], ps, strict=True)]
        for b, s in sums.items():
            lam[b] = [(x + p) / (n[b] + sum(prior[b])) for x, p in zip(s, prior[b], strict=True)]
        if not events or before is not None and ll / len(events) - before < 1e-6:
            break
        before = ll / len(events)
    seen = sorted(b for b in n if b) if events else []
    for b in range(1, 40):
        if seen and b not in seen:
            lam[b] = lam[max((s for s in seen if s < b), default=seen[0])]
    out = []
    for i, f, ws in texts:
        seq = ["<s>"] * (order - 1) + ws + ["</s>"]
        score = base = known = 0
        for at in range(order - 1, len(seq)):
            b, ps = estimates(full, seq, at)
            mix = sum(w * p for w, p in zip(lam[b], ps, strict=True)) if full["all"] else 1
            score += math.log10(mix)
            c = full[(seq[at],)]
            known += c > 0
            base += math.log10((c + 0.5) / (full["all"] + 0.5 * (v + 1)))
        out.append((i, f == 1, len(ws) + 1, known, full["all"], base, score))
    return out


def some_texts(n=220):
    r = random.Random(7)
    vocab = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)]
    line = " ".join(r.choices(vocab, k=30))
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(0, 60))) + ("\n" + line if i % 3 == 0 else "")) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, "Null Id x ÄÖ 中文"), (None, "w1 w2"), (5, "again w1"), docs[0], (n + 3, "W1\x0bW2\x0cw3\x1cw4 " * 3000)]


@pytest.mark.parametrize("order, chunk, cell", [(2, 1 << 20, 4 << 20), (2, 500, 16), (3, 700, 4 << 20), (1, 1 << 20, 4 << 20)])
def test_scores_by_brute_force(spark, monkeypatch, order, chunk, cell):
    monkeypatch.setattr(language_model.chunks, "__defaults__", (chunk,))
    monkeypatch.setattr(language_model, "CELL", cell)
    monkeypatch.setattr(language_model, "STEPS", 1 << 16)
    docs = some_texts()
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], "doc_id long, text string, chunk string, n long, cell string").repartition(3)
    got = language_model.language_model_scores(df, order=order)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(plain_scores(docs, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=2e-3)


def test_weights_are_shares_and_held_out_rows_add_no_words(spark):
    docs = [(i, t) for i, t in some_texts(60) if i is not None]
    both, sums = language_model.counted(spark.createDataFrame(docs, "doc_id long, text string"))
    lam = language_model.weights(both, sums)
    assert lam.shape == (language_model.BUCKETS, 3) and np.allclose(lam.sum(axis=1), 1) and (lam[1:] > 0).all()
    known = sorted({w.decode() for i, t in docs if language_model.fold(i) != 1 for w in language_model.words(t)})
    own = next(i for i in range(10**6, 10**7) if language_model.fold(i) == 1)
    asked = spark.createDataFrame([(own, f"w1 {w} ") for w in [*known, "unknown"]] + [(own, "w1")], "doc_id long, text string")
    both2, sums2 = language_model.counted(spark.createDataFrame(docs, "doc_id long, text string").union(asked))
    assert sums2["distinct"] == sums["distinct"] == len(known) + 1
    scored = language_model.score(both2, sums2, lam).where(f"doc_id = {own}").collect()
    assert len(scored) == len(known) + 2


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_model.language_model_scores(df).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.count("*")).first()
    assert r[2] > 100 and r[1] > r[0]


def test_language_model_without_training_rows(spark):
    out = [i for i in range(50) if language_model.fold(i) == 1][:3]
    got = language_model.language_model_scores(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert language_model.language_model_scores(spark.createDataFrame([], "doc_id string, text string")).collect() == []
