"""License scans, token counts, SimHash, suffix-array deduplication and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, licenses, simhash, suffix_dedup, token_counts
from lorekeep.llm.common import ascii_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "a", "é", "All  Rights\nreserved", "x " * 30_000, "\U0001f600 end", "​"]


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts)], DOCS)


# --- licenses ---------------------------------------------------------------------------------------------------------


def plain_scan(text):
    words = ascii_words(text)
    starts, base = [], set()
    for p, label in licenses.PHRASES.items():
        ws = p.encode().split()
        hits = [i for i in range(len(words)) if words[i : i + len(ws)] == ws]
        starts += hits
        base |= {label} if hits else set()
    labels, score = set(base), 1.0 if base else 0.0
    for t, label in licenses.NOTICES.items():
        want, n = set(ascii_words(t)), len(ascii_words(t))
        blocks = [ascii_words(line) for line in (text or "").split("\n")] + [words[i : i + n] for i in range(max(1, len(words) - n + 1))]
        c = max(len(want.intersection(x)) for x in blocks) / len(want)
        if c >= licenses.CONTAINMENT:
            labels.add(label)
            score = max(score, c)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_license_scan(spark):
    rng = random.Random(2)
    pool = [w for t in [*licenses.PHRASES, *licenses.NOTICES] for w in t.split()] + ["x", "Y,", "\n", "CC-BY", "é"]
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in [*licenses.PHRASES, *licenses.NOTICES] * 6:
        ws = t.upper().split() if rng.random() < 0.5 else t.split()
        if rng.random() < 0.6:
            ws.pop(rng.randrange(len(ws)))
        texts.append("intro\n" + ", ".join(ws) + "\nend")
        at = rng.randrange(len(ws))
        texts.append("intro\n" + " ".join(ws[:at]) + "\n * " + " ".join(ws[at:]) + rng.choice(["\nend", " and more\n\n" + " ".join(ws)]))
    got = {r.doc_id: tuple(r)[1:8] for r in licenses.license_scan(docs(spark, texts)).collect()}
    assert got == {i: plain_scan(t) for i, t in enumerate(texts)}
    assert licenses.license_scan(docs(spark, [])).count() == 0


# --- token counts -----------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("  \n\tabthe<s>/▁é漢😀\u0000ﬁ​.,!0x") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts = [None if t is None else t.replace("\u0000", "") for t in texts] + ["<s> </s> <unk> <0x41>", "the " * 5000]
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(docs(spark, texts), path).collect()}
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in enumerate(texts)}
    assert got == want


# --- SimHash ----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if (x ^ y).bit_count() <= 3 and find(a) != find(b):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprint():
    rng = random.Random(4)
    for t in ODD + [" ".join(rng.choice("ab Ünï co de".split()) for _ in range(n)) for n in (1, 2, 3, 4, 50, 500)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_planes():
    from itertools import combinations

    assert len(simhash.PLANES) == 14
    for shared in combinations(range(8), simhash.SHARED):
        assert any(set(p) <= set(shared) for p in simhash.PLANES)


@pytest.mark.parametrize("long", [2, 7, 1 << 30])
def test_posting_lists_lose_no_link(spark, monkeypatch, long):
    """Random centres with neighbours at 0 to 5 bits; short limits force every way through a list, over several tasks."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        c = rng.getrandbits(64)
        fps += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(6)]
        fps += [c ^ sum(1 << b for b in rng.sample(range(8), rng.randrange(6))) for _ in range(6)]
    c = rng.getrandbits(64)
    fps += [c ^ sum(1 << b for b in rng.sample(range(20, 44), rng.randrange(7))) for _ in range(60)]  # one crowded list
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    label = {f: f for f in fps}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in simhash.links_of(nodes).collect():
        u, v = r.u % (1 << 64), r.v % (1 << 64)
        p, q = find(u), find(v)
        label[max(p, q)] = min(p, q)
    assert {f: find(f) for f in fps} == plain_components(fps, fps)


def test_star_members_are_linked():
    """A star joins only what a chain of links joins."""
    rng = random.Random(8)
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(4))) for c in [rng.getrandbits(64) for _ in range(4)] for _ in range(40)})
    arr = np.array(fps, np.uint64)
    want = plain_components(list(range(len(fps))), fps)
    for fifth in (None, (3, 4, 5, 6, 7)):
        for group in {f >> 24 for f in fps}:
            own = np.array([i for i, f in enumerate(fps) if f >> 24 == group])
            assert {int(own[i]): int(own[j]) for i, j in enumerate(simhash.stars(arr[own], fifth))} == {i: want[i] for i in own.tolist()}


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    texts = ODD + base + [b.upper() for b in base[:10]] + base[:5] + [b + " tail" for b in base]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: (r.fp, r.component) for r in simhash.near_duplicates(docs(spark, texts, ids)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    assert {i: v[0] & (2**64 - 1) for i, v in got.items()} == fps
    assert {i: v[1] for i, v in got.items()} == plain_components(ids, [fps[i] for i in ids])
    kept = {r.doc_id for r in simhash.one_of_each(docs(spark, texts, ids)).collect()}
    assert kept == {v[1] for v in got.values()}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.one_of_each(docs(spark, ["a", "a", "b"], [None, 1, 2])).count() == 3


# --- suffix-array deduplication ---------------------------------------------------------------------------------------


def plain_dedup(texts, length):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                m[s : s + length] = True
        edges = np.diff(m.astype(int), prepend=0)
        out.append((len(b), int(m.sum()), int((edges > 0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("kw", [{"length": 20, "gram": 8}, {"length": 20, "gram": 8, "hot": 1, "piece": 128}, {"length": 20, "gram": 8, "hot": 1 << 40}, {"length": 50, "gram": 16, "piece": 100}])
def test_suffix_dedup(spark, kw):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(10, 400))) for _ in range(12)]
    piece = lambda: (x := rng.choice(base))[(a := rng.randint(0, 200)) : a + rng.randint(5, 90)]
    texts = ["".join(rng.choice(["", "ab" * 40, piece(), piece()]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    texts += [None, "", texts[3], "x" * 700, "abcdefgh" * 100, "b" * 19, "c" * 20]
    ids = [None, 1, 1, *range(2, len(texts) - 1)]  # null and repeated ids
    got = sorted(tuple(r)[1:] for r in suffix_dedup.dedup_report(docs(spark, texts, ids), **kw).collect())
    assert got == sorted(plain_dedup(texts, kw["length"]))


def test_cut_repeats(spark):
    passage = "zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich " * 5
    df = docs(spark, ["only here " * 3 + "ä" + passage, passage + "the end", None, ""])
    out = {r.doc_id: r for r in suffix_dedup.cut_repeats(df).collect()}
    assert "Boxkämpfer jagen" not in out[0].text and "Boxkämpfer jagen" not in out[1].text
    assert out[1].text.endswith("the end") and out[1].n_chars == len(out[1].text) and out[2].text == ""
    assert suffix_dedup.cut_repeats(df).columns == df.columns
    assert suffix_dedup.dedup_report(docs(spark, [])).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def test_lcs_and_words():
    rng = random.Random(8)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(70))] for _ in range(2))
        assert decontaminate.lcs(a, b) == plain(a, b)
    items = decontaminate.Items([(1, "One two, THREE"), (2, ""), (3, "two é")])
    texts = ["zero two", None, "", "É é three three", "one" + "x" * 10]
    for size in (8, 1 << 20):
        pieces = list(decontaminate.joined_ascii_words(texts, size))
        assert sum(len(p[2]) for p in pieces) == len(texts)
    ids = np.concatenate([i for _, i, _ in items.of_texts(texts, decontaminate.WordHashes())])
    assert ids.tolist() == np.concatenate([items.numbers(ascii_words(t)) for t in texts]).tolist()


@pytest.fixture(scope="module")
def world():
    rng = random.Random(9)
    vocabulary = ["w" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(1500)]
    common = vocabulary[:40]
    say = lambda n: " ".join(rng.choice(common if rng.random() < 0.4 else vocabulary) for _ in range(n))
    items = [say(rng.randint(15, 50)) + ". " + say(5) + "." for _ in range(30)]
    clean = [say(rng.randint(1, 600)) for _ in range(150)]
    return rng, say, items, clean


def test_decontamination(spark, world):
    rng, say, items, clean = world
    leaked = [say(rng.randint(0, 200)) + "\n" + i.upper() + " " + say(rng.randint(0, 200)) for i in items]
    light = []
    for i in items:  # one word in ten replaced
        ws = i.split()
        for k in rng.sample(range(len(ws)), len(ws) // 10):
            ws[k] = "changed"
        light.append(say(60) + " " + " ".join(ws) + " " + say(40))
    texts = clean + leaked + light + [None, "", "w"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (100, " ")], "item_id long, text string")
    got = {r.doc_id: [x.item for x in r.found] for r in decontaminate.leaks(docs(spark, texts), bench, ["doc_id"]).collect()}
    n = len(clean)
    assert all(not got[i] for i in range(n)), "clean documents stay"
    assert all(k in got[n + k] for k in range(len(items))), "verbatim leaks"
    assert sum(k in got[n + len(items) + k] for k in range(len(items))) >= 28, "light paraphrases"
    assert not any(got[i] for i in range(len(texts) - 3, len(texts)))
    blocks = {r.doc_id: [x.item for x in r.found] for r in decontaminate.leaks(docs(spark, texts), bench, ["doc_id"], block=16).collect()}
    assert blocks == got, "blocks have no say"
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.select("doc_id").collect()} >= set(range(n))


def test_decontamination_empty(spark, world):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs(spark, ["a"]), none, ["doc_id"]).where(F.size("found") > 0).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.leaks(docs(spark, []), some, ["doc_id"]).count() == 0


def zipf(seed, size, slope):
    """n -> n words of a skewed vocabulary."""
    rng = random.Random(seed)
    words, weights = [f"w{k}" for k in range(size)], np.cumsum([1 / (k + 1) ** slope for k in range(size)]).tolist()
    return rng, lambda n: " ".join(rng.choices(words, cum_weights=weights, k=n))


def found_items(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: {x.item: x.lcs for x in r.found} for r in decontaminate.leaks(docs(spark, texts), bench, ["doc_id"]).collect()}


def test_decontamination_hot_passage(spark):
    """An item that a third of the documents hold is itself a leading direction; its copies elsewhere are found all the same."""
    rng, say = zipf(1, 3000, 1.05)
    items = [say(rng.randint(15, 50)) for _ in range(60)]
    texts = [say(rng.randint(20, 300)) for _ in range(1500)]
    texts = [items[0] + " " + t if k % 3 == 0 else t for k, t in enumerate(texts)]
    probes = [say(rng.randint(4, 200)) + " " + items[j] + " " + say(rng.randint(4, 200)) for j in [0] * 100 + list(range(1, 60))]
    got = found_items(spark, texts + probes, items)
    assert [j for k, j in enumerate([0] * 100 + list(range(1, 60))) if j not in got[len(texts) + k]] == []
    assert all(0 in got[k] for k in range(0, 1500, 3)) and not any(got[k] for k in range(1500) if k % 3)


def test_decontamination_rare_words(spark):
    """Words found nowhere else have next to no latent weight in a large corpus; a copy is found at every offset of the grid."""
    rng, say = zipf(2, 4000, 1.1)
    items = [say(rng.randint(15, 50)) for _ in range(200)] + [" ".join(f"rare{n}x{k}" for k in range(30)) for n in range(24)]
    texts = [say(150) for _ in range(8000)]
    texts += [say(40 + n % 4) + " " + items[200 + n] + " " + say(30) for n in range(24)]
    got = found_items(spark, texts, items)
    assert [n for n in range(24) if got[8000 + n].get(200 + n) != 1.0] == []


def test_search_is_free_of_scale():
    """The latent rows' common factor has no say in what is found, be it by weight or by the cosine alone."""
    items = decontaminate.Items([(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, "one two three four five six seven eight nine ten")])
    idf = np.append(np.ones(len(items.terms)), 0.0)
    idf[items.numbers([b"alpha", b"beta", b"gamma", b"delta"])] = 9.0  # the rest holds less than OVERLAP of the weight
    rows = np.vstack([np.zeros((len(items.terms), 2)), np.zeros((1, 2))]).astype(np.float32)
    for k, w in enumerate(items.words):
        rows[items.numbers(w), k] = 1
    texts = ["x y z one two three four five six seven eight nine ten x", "x x p q r s epsilon zeta eta theta iota kappa y"]
    for scale in (1.0, 1e-5):
        (a,), (b,) = decontaminate.Search(items, idf, rows * np.float32(scale)).leaks(texts)
        assert a[:2] == (1, 1.0) and b[:2] == (0, 0.6) and min(a[2], b[2]) > 0.9


def test_decontamination_paraphrases(spark):
    """Half to three quarters of an item with the end of its answer: of one sentence or with a long last one."""
    rng, say = zipf(3, 2000, 0.7)
    one = [say(n) + "." for n in range(12, 52, 4)]
    long = ["Short start. " + say(n) + "!" for n in range(14, 54, 4)]
    brief = [say(n) + ". " + say(5) for n in range(15, 55, 4)]
    items, texts, want = one + long + brief, [say(100) for _ in range(200)], []
    for j, t in enumerate(items):
        ws = ascii_words(t)
        for share in (0.55, 0.65, 0.72):
            keep = max(int(np.ceil(0.5 * len(ws))), int(share * len(ws)))
            tail = min(8, len(ws) // 2)
            left = set(rng.sample(range(len(ws) - tail), keep - tail)) | set(range(len(ws) - tail, len(ws)))
            changed = [w.decode() if k in left else f"new{k}" for k, w in enumerate(ws)]
            want.append((len(texts), j, keep / len(ws)))
            texts.append(say(30) + " " + " ".join(changed) + " " + say(20))
            if j < 10:  # without the answer: clean
                texts.append(say(30) + " " + " ".join(changed[:-tail]) + " " + say(20))
    got = found_items(spark, texts, items)
    assert [(j, share) for at, j, share in want if got[at].get(j, 0) < share - 1e-9] == []
    assert not any(got[k] for k in range(len(texts)) if k not in {at for at, _, _ in want})
    assert decontaminate.answer_of("one two three. Four five six seven") == b"four five six seven".split()
    assert decontaminate.answer_of("a b c d e f g h i j k l m n o p q r s t") == b"m n o p q r s t".split()


def test_decontamination_by_brute_force(spark, world):
    """Every window of every text against every item by a plain LCS; no candidate search."""
    rng, say, items, clean = world
    texts = clean[:25]
    for j, t in enumerate(items):
        ws = ascii_words(t)
        for share in (0.1, 0.2, 0.3):
            gone = set(rng.sample(range(len(ws)), int(share * len(ws))))
            texts.append(say(rng.randint(0, 60)) + " " + " ".join(f"new{k}" if k in gone else w.decode() for k, w in enumerate(ws)) + " " + say(rng.randint(0, 60)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: {x.item: x.lcs for x in r.found} for r in decontaminate.leaks(docs(spark, texts), bench, ["doc_id"]).collect()}
    plain = {}
    for i, t in enumerate(texts):
        ws = ascii_words(t)
        for j, item in enumerate(items):
            want = ascii_words(item)
            if len(set(ws) & set(want)) >= 0.5 * len(set(want)) - 2:
                best = max(decontaminate.lcs(want, ws[at : at + len(want) + 12]) for at in range(0, max(1, len(ws)), 1)) / len(want)
                if best >= decontaminate.LCS:
                    plain[i, j] = best
    missed = [(i, j) for (i, j), share in plain.items() if share >= decontaminate.LCS + 0.03 and j not in got[i]]
    assert not missed and len(plain) > 60
    recall = [sum(j in got[25 + 3 * j + k] for j in range(len(items))) / len(items) for k in range(3)]
    assert recall[0] == 1 and recall[1] >= 0.95, recall  # 10, 20 and 30 % of the words replaced
    print("recall by share replaced", recall)


@pytest.mark.parametrize("features", [8, 1 << 16])
def test_decontamination_bounds(spark, world, monkeypatch, features):
    """Few features, small vocabularies and narrow parts bound memory; verbatim leaks are found all the same."""
    rng, say, items, clean = world
    texts = clean[:20] + [say(30) + " " + t + " " + say(20) for t in items]
    monkeypatch.setattr(decontaminate, "FEATURES", features)
    monkeypatch.setattr(decontaminate, "TERMS", 300)
    monkeypatch.setattr(decontaminate, "WORDS", 120)
    monkeypatch.setattr(decontaminate, "SUMS", 500)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(decontaminate.vocabularies(bench)) > 1
    got = {r.doc_id: {x.item for x in r.found} for r in decontaminate.leaks(docs(spark, texts), bench, ["doc_id"], block=7).collect()}
    assert all(j in got[20 + j] for j in range(len(items))) and not any(got[i] for i in range(20))


def test_decontamination_borders_with_a_long_item(monkeypatch):
    """A block with an item of more words than a piece holds: leaks of short ones are found across every border."""
    monkeypatch.setattr(decontaminate, "PIECE", 256)
    rng, say = zipf(4, 3000, 0.7)
    short, long = [" ".join(f"s{j}x{k}" for k in range(40)) for j in range(12)], " ".join(f"l{k}" for k in range(200))
    for rows in ([*enumerate(short)], [*enumerate(short), (99, long)]):
        items = decontaminate.Items(rows)
        idf = np.append(np.ones(len(items.terms)), 0.0)
        latent = np.vstack([np.random.default_rng(5).standard_normal((len(items.terms), 8)), np.zeros((1, 8))]).astype(np.float32)
        search = decontaminate.Search(items, idf, latent)
        for before in range(0, 44, 3):  # words of the item before the border at 256
            text = say(256 - before) + " " + short[before % 12] + " " + say(400)
            assert [x[:2] for x in search.leaks([text])[0]] == [(before % 12, 1.0)]
    text = say(1000) + " " + long + " " + short[3] + " " + say(900)
    assert {x[:2] for x in search.leaks(["a b", text])[1]} == {(3, 1.0), (99, 1.0)}


def test_wrapped_notices(spark):
    mit = "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense as published by"
    narrow = "\n".join("redistribution and use in source and binary forms with or without modification are permitted".split())
    far = "Permission is hereby granted, free of charge, to any person obtaining a copy\n" + "x " * 30 + "\nof this software and associated documentation files"
    texts = ["intro\n\n" + mit, bsd + "\nend", gpl, narrow, far, "intro\nreleased under the MIT license\nend"]
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, texts)).collect()}
    assert [got[i].labels for i in range(6)] == ["notice-mit", "notice-bsd", "gpl,notice-gpl", "notice-bsd", "", "notice-mit"]
    assert [got[i].score for i in range(6)] == [1.0, 1.0, 1.0, 1.0, 0.0, 1.0]
    assert [[b.line for b in got[i].blocks] for i in (0, 1, 5)] == [[2], [0], [1]]


def test_near_duplicates_without_ids(spark, monkeypatch):
    """A row without an id links and passes links on; a component takes its least id, or none."""
    codes = {"a": 0, "b": 0b111, "c": 0b111111, "far": 0x0F0F0F0F0F0F0F0F, "near far": 0x0F0F0F0F0F0F0F0E, "alone": 0x70F0F0F0F0F0F0F0}
    fps = lambda df, text, key: df.select(key, F.create_map(*[F.lit(x) for p in codes.items() for x in p])[F.col(text)].cast("long").alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", fps)
    df = docs(spark, ["c", "b", "a", "far", "near far", "alone"], [5, None, 9, None, None, 3])
    got = {r.fp: r.component for r in simhash.near_duplicates(df).collect()}
    assert got == {codes["a"]: 5, codes["b"]: 5, codes["c"]: 5, codes["far"]: None, codes["near far"]: None, codes["alone"]: 3}
