"""Labelled web pages for training: layouts drawn from a seeded grammar, main-text blocks marked by construction.

An element with data-main="1" (or "0") labels the blocks below it; the extractor's features never see that attribute.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co de er fi go ha in jo ka le mi no or pa qu re sa ti un ve wo xy zu é ñ ü ción tion ing eau sch".split()
_CONTENT = ["content", "post", "entry-content", "article-body", "main-text", "story", "body-copy", "page-content", "post-body"]
_ADS = ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement banner"]
_NOTICE = ["cookie-notice", "notice", "consent banner", "alert", "gdpr", "newsletter", "subscribe-box", "popup modal"]
_SIDE = ["sidebar", "related", "widget", "share social", "breadcrumbs", "tags", "author-box", "recommended", "popular"]
_MENU = ["menu", "nav", "navbar", "top-menu", "site-nav", "links"]
_FOOT = ["footer", "site-footer", "bottom", "copyright"]
_HEAD = ["header", "site-header", "masthead", "top", "branding"]
_COMMENTS = ["comments", "comment-list", "responses", "discussion", "replies"]


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 1, high: int = 25) -> str:
    ws = [_word(r) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
    return " ".join(ws).rstrip(",").capitalize() + "."


def _prose(r: random.Random) -> str:
    text = " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    style = r.random()
    if style < 0.06:
        text = " ".join(w + "!!" for w in text.upper().split())
    elif style < 0.12:
        text = " ".join(w + r.choice(["%%%", "***", "&amp;&amp;", "$$$"]) for w in text.split())
    elif style < 0.16:
        text = " | ".join(text.split())
    elif style < 0.2:
        text = " ".join([_word(r)] * r.randint(3, 30))
    elif style < 0.25:
        text = _word(r).capitalize() + "."
    ws = text.split(" ")
    for k in range(len(ws)):
        if r.random() < 0.03:
            tag = r.choice(["b", "i", "em", "strong", "a href='#'", "span", "code"])
            ws[k] = f"<{tag}>{ws[k]}</{tag.split()[0]}>"
    return " ".join(ws)


def _links(r: random.Random, n: int, label: str = "") -> str:
    return "<ul>" + "".join(f'<li{label}><a href="/{_word(r)}">{" ".join(_word(r) for _ in range(r.randint(1, 4)))}</a></li>' for _ in range(n)) + "</ul>"


def _box(r: random.Random, names: list[str], tags: list[str], inner: str) -> str:
    tag = r.choice(tags)
    name = r.choice(names) if r.random() < 0.9 or tags == ["div"] else _word(r)
    attr = r.choice([f' class="{name}"', f' id="{name.split()[0]}"', f' class="box {name}"'])
    return f'<{tag}{attr if tag in ("div", "section", "p") or r.random() < 0.5 else ""} data-main="0">{inner}</{tag}>'


def _main_block(r: random.Random) -> str:
    k = r.random()
    if k < 0.68:
        return f"<p>{_prose(r)}" + ("</p>" if r.random() < 0.85 else "")
    if k < 0.76:
        return f"<h{r.randint(2, 4)}>{_sentence(r, 1, 8)}</h{2}>"
    if k < 0.84:
        return "<ul>" + "".join(f"<li>{_sentence(r, 1, 15)}" for _ in range(r.randint(2, 5))) + "</ul>"
    if k < 0.88:
        return f"<blockquote><p>{_prose(r)}</p></blockquote>"
    if k < 0.92:
        return f"<table><tr><td>{_sentence(r, 1, 4)}</td><td>{_sentence(r, 1, 4)}</td></tr></table>"
    if k < 0.95:
        return f"<pre>{_prose(r)}</pre>"
    if k < 0.97:
        return f"<figure><img src='x.png'><figcaption>{_sentence(r, 3, 12)}</figcaption></figure>"
    return f"<p><b>{_sentence(r, 1, 6)}<br><p>{_prose(r)}</p>"


def page(seed: int) -> str:
    """One labelled page."""
    r = random.Random(seed)
    parts = []
    ad = lambda: _box(r, _ADS, ["div", "aside", "section", "p"], r.choice([_sentence(r, 3, 15), f"<a href='#'>{_sentence(r, 2, 8)}</a>", f"<p>{_prose(r)}</p>"]))
    notice = lambda: _box(r, _NOTICE, ["div", "section", "dialog"], f"<p>{_sentence(r, 5, 25)}</p><button>{_word(r)}</button>")
    side = lambda: _box(r, _SIDE, ["aside", "div", "section"], r.choice([_links(r, r.randint(2, 6)), f"<h3>{_sentence(r, 1, 3)}</h3>{_links(r, 3)}", f"<p>{_prose(r)}</p>"]))
    menu = lambda: _box(r, _MENU, ["nav", "nav", "div"], _links(r, r.randint(3, 9)))
    form = lambda: f'<form data-main="0"><label>{_sentence(r, 1, 4)}</label><input name="q"><select><option>{_word(r)}</select><textarea>{_word(r)}</textarea><button>{_word(r)}</button></form>'
    if r.random() < 0.5:
        parts.append(notice())
    if r.random() < 0.7:
        parts.append(_box(r, _HEAD, ["header", "div"], f"<{r.choice(['h1', 'p', 'div'])}>{_sentence(r, 1, 4)}</{'div'}>" + (menu() if r.random() < 0.4 else "")))
    if r.random() < 0.85:
        parts.append(menu())
    for make, chance in ((ad, 0.6), (side, 0.3), (form, 0.3)):
        if r.random() < chance:
            parts.append(make())
    body = [f"<h1>{_sentence(r, 1, 10)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
        body.append(_main_block(r))
        if r.random() < 0.07:
            body.append("</p>" + r.choice([ad, side, form])())
    inner = "".join(body)
    style = r.random()
    if style < 0.45:
        main = f'<article data-main="1">{inner}</article>'
    elif style < 0.58:
        main = f'<main data-main="1">{inner}</main>'
    elif style < 0.74:
        main = f'<div {r.choice(["class", "id"])}="{r.choice(_CONTENT)}" data-main="1">{inner}</div>'
    elif style < 0.82:  # sections, with and without a name or role
        main = f'<{r.choice(["div", "section"])}{r.choice(["", " role=main"])}><section data-main="1">{inner}</section></{"div"}>'
    elif style < 0.88:
        main = f'<table><tr><td class="{_word(r)}" data-main="0">{_links(r, 4)}</td><td data-main="1">{inner}</td></tr></table>'
    else:  # a name that says nothing, or none
        main = f'<div{r.choice(["", f" class={_word(r)}", f" id={_word(r)}"])} data-main="1">{inner}</div>'
    if r.random() < 0.3:
        main = f"<main>{main}</main>" if r.random() < 0.5 else f'<div class="wrapper">{main}</div>'
    parts.append(main)
    if r.random() < 0.4:
        said = "".join(r.choice([f"<p>{_prose(r)}</p>", f"<div class='comment'><b>{_word(r)}</b><p>{_prose(r)}</p></div>", f"<li>{_prose(r)}</li>"]) for _ in range(r.randint(1, 5)))
        parts.append(_box(r, _COMMENTS, ["section", "div", "ol"], f"<h3>{_sentence(r, 1, 3)}</h3>{said}"))
    for make, chance in ((side, 0.5), (ad, 0.3), (form, 0.2), (notice, 0.1)):
        if r.random() < chance:
            parts.append(make())
    if r.random() < 0.9:
        parts.append(_box(r, _FOOT, ["footer", "footer", "div"], r.choice([f"&copy; {_word(r)}.example &middot; {_sentence(r, 2, 10)}", _links(r, 4), f"<p>{_sentence(r, 2, 12)}</p>{_links(r, 2)}"])))
    return f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(parts)}</body></html>"
