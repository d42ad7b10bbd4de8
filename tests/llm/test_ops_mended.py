"""Unseen page layouts, deep markup, long texts without spaces, what op8 sends to executors."""

import pickle
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark import SparkContext

from lorekeep.llm import decontaminate, html_extract, token_counts
from lorekeep.llm.labelled_pages import page

from .test_ops_text import docs


def unseen(r: random.Random) -> tuple[str, str]:
    """Pages whose layout says nothing by name: unnamed sections, lines parted by br, generated class names, spans in divs."""
    word = lambda: "".join(r.choice("bcdfghjklmnprstvz") + r.choice(["a", "e", "i", "o", "u", "ou", "ai"]) for _ in range(r.randint(1, 4)))
    said = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    paras = [" ".join(said(7, 22) + "." for _ in range(r.randint(1, 6))) for _ in range(r.randint(3, 9))]
    code = lambda: "css-" + "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    links = lambda n: "".join(f"<a href='/{word()}'>{said(1, 3)}</a>\n" for _ in range(n))
    items = lambda n: "<ul>" + "".join(f"<li><a href='#'>{said(2, 5)}</a></li>" for _ in range(n)) + "</ul>"
    wrap = lambda x: f"<div class='{code()}'>{x}</div>"
    title, kind = said(3, 9), r.randrange(5)
    if kind == 0:
        body = f"<header>{links(6)}</header><section><h1>{title}</h1>" + "".join(f"<section><p>{p}</p></section>" for p in paras) + f"</section><section>{items(5)}</section><footer>{links(4)}</footer>"
    elif kind == 1:
        body = f"<center>{links(5)}</center><font size=5>{title}</font><br><br>" + "<br><br>".join(paras) + f"<hr>{links(3)}"
    elif kind == 2:
        body = wrap(wrap(links(6))) + wrap(wrap(wrap(f"<h1 class={code()}>{title}</h1>") + "".join(wrap(wrap(p)) for p in paras))) + wrap(items(6)) + wrap(f"© 2021 {said(1, 3)}")
    elif kind == 3:
        body = f"<div>{items(8)}</div><div><div><h2>{title}</h2>" + "".join(f"<div><span>{p}</span></div>" for p in paras) + f"</div></div><div>{links(3)}</div>"
    else:
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}" for p in paras) + f"<hr><p>{links(4)}<address>{said(2, 4)}</address>"
    return f"<html><body>{body}</body></html>", " ".join([title, *paras])


def test_unseen_layouts_lose_no_page():
    r, model, plain = random.Random(99), html_extract.default_model(), html_extract.plain_model()
    hit = want = extra = 0
    for _ in range(200):
        html, main = unseen(r)
        a, b = Counter(main.split()), Counter(html_extract.main_text(html, model, None, plain).split())
        assert b
        hit, want, extra = hit + (a & b).total(), want + a.total(), extra + (b - a).total()
    assert hit / want >= 0.9 and extra / want < 0.05, (hit / want, extra / want)
    assert html_extract.main_text("<nav><a>one</a></nav><footer>two</footer>", model, None, plain) == ""


@pytest.mark.parametrize("part", ["<div>x</span></i>", "<div class=a{0}>y", "<a><div>", "<b><p>"])
def test_deep_markup_takes_time_in_proportion(part):
    model = html_extract.default_model()
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    html = "".join(part.replace("{0}", name(k)) for k in range(100_000)) + "</a></i></b>" * 1000
    began = time.time()
    html_extract.main_text(html, model)
    assert time.time() - began < 20


def test_gradient_of_the_field():
    """One step of training against differences of the log-likelihood by enumeration: the fitted field is near a maximum."""
    pages = [page(k) for k in range(12)]
    weights, tr = html_extract.train(pages, epochs=1500, decay=1e-2)

    def loss(w, t):
        total = n = 0
        for p in pages:
            found = html_extract.blocks(p)
            s = [sum(w[x] for x in f) for f in html_extract.block_features(found)]
            y = [max(0, b.main) for b in found]
            a = np.array([0.0, s[0]])
            gold = y[0] * s[0]
            for k in range(1, len(s)):
                a = np.array([np.logaddexp(a[0] + t[0][0], a[1] + t[1][0]), np.logaddexp(a[0] + t[0][1], a[1] + t[1][1]) + s[k]])
                gold += y[k] * s[k] + t[y[k - 1]][y[k]]
            total += np.logaddexp(*a) - gold
            n += len(s)
        return total / n + 1e-2 / 20 * (sum(v * v for v in w.values()) + float((np.array(t) ** 2).sum()))

    best = loss(weights, tr)
    r = random.Random(2)
    for name in r.sample(sorted(weights), 12):
        for step in (0.05, -0.05):
            assert loss(weights | {name: weights[name] + step}, tr) > best - 2e-5
    for a in (0, 1):
        for b in (0, 1):
            for step in (0.05, -0.05):
                moved = tr.copy()
                moved[a, b] += step
                assert loss(weights, moved) > best - 2e-5


def test_long_chunks_are_not_kept(spark):
    import public_tokenizers

    rank, _ = token_counts.load_ranks(public_tokenizers.path("piece_bpe_32k.model"))
    counts = token_counts._Counts(rank)
    long = "字" * 1000
    assert counts[long] == token_counts.merge_count(long, rank) and counts[" word"] and list(counts) == [" word"]
    texts = ["x" * 300_000, "语言模型" * 20_000, "ab " * 50_000]
    import sentencepiece

    want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(docs(spark, texts), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(want.encode(t)) for t in texts]


def test_executors_need_no_package(spark, monkeypatch):
    """What is broadcast holds no class of this package, and one pass over the texts looks for many blocks of items."""
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or broadcast(self, value))
    items = [f"item {j} " + " ".join(f"w{j}x{k}" for k in range(12)) + "." for j in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["some words before " + t for t in items] + ["nothing of it"]
    out = decontaminate.leaks(docs(spark, texts), bench, ["doc_id"], block=4)
    assert sent and not any(b"lorekeep" in s for s in sent)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: [x.item for x in r.found] for r in out.collect()}
    assert got == {j: [j] for j in range(40)} | {40: []}
    monkeypatch.setattr(decontaminate, "PASS", 3)
    again = decontaminate.leaks(docs(spark, texts), bench, ["doc_id"], block=4)
    assert again._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4
    assert {r.doc_id: [x.item for x in r.found] for r in again.collect()} == got
