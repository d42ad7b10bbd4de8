"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks (operator 3).

A page is walked once into leaf blocks: runs of text between block-level tags, each with its open ancestors. A block's
features are its ancestors' tags and the words of their class, id and role, its own tag, and its text's length, share of
linked text, punctuation and place. The field has two labels (main text or not) with a weight per feature and label pair
of neighbours; it is trained by maximum likelihood (forward-backward, Adam, L2) on labelled pages, drawn by a seeded
grammar of layouts, and decoded by Viterbi. A page on which it finds nothing, as its layout's names say nothing, is decoded
by a second field, of the text's own features, trained on the same pages. Page titles, scripts, styles, comments of markup, frames, buttons, choices, text
fields and inert templates hold no text. Formulas, words in drawings and the fallback of embedded media are text of their line.

Text: character references decoded (a reference cut off by the end of the page stays as it is), white space inside a
block one space, blocks trimmed and joined by one space in page order. Nothing else is dropped or capped.

Null and empty html give an empty text. Unclosed and misnested tags are closed by the tag that ends their parent; a tag that
the end of the page cuts off is no text. Repeated rows are extracted each; very long pages take time and memory
in proportion; extra columns are ignored. Pages are independent: one narrow pass, no shuffle.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, need, table

TRAIN_PAGES = 600
PROSE = 20
EPOCHS = 150

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
# formulas stand in their line
_INLINE |= frozenset("math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr mstyle mpadded mphantom mspace menclose merror maction mfenced semantics annotation annotation-xml".split())
# fallback text of embedded media, and words in drawings, stand where they are
_INLINE |= frozenset("svg g path circle ellipse rect line polyline polygon text tspan textpath defs use symbol desc marker lineargradient radialgradient stop clippath mask pattern filter foreignobject object canvas audio video picture noscript button option optgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts that pages of any layout call by these tags.
_PARTS = frozenset(("nav", "header", "footer", "aside", "form", "dialog"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tags that an opening tag closes first, as far up as the given limit tags.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _CLOSES.items()}

#: Buttons, choices and inert templates hold no text. One that isn't closed before the next of its kind or before a part of
#: the page begins or ends is just a stray tag: it swallows nothing.
_STOP = r"<(?:(?P=part)|/?(?:p|h[1-6]|article|section|main|form|table|ul|ol|nav|header|footer|aside|body|html))(?=[\s/>])"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    # text up to the closing tag or the end of the page, whatever it looks like
    r"|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]|\Z)[^>]*(?:>.*?(?:</(?P=raw)(?=[\s/>]|\Z)[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<part>button|select|datalist)(?=[\s/>])[^>]*>(?:(?!" + _STOP + r").)*?</(?P=part)\s*>"
    r"|<template(?=[\s/>])[^>]*>(?:(?!<template[\s/>]).)*?</template\s*>|<option(?=[\s/>])[^>]*>[^<]*"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|</\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MAIN = re.compile(r"""\bdata-main\s*=\s*["']?([01])""", re.I)
_NAMES = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "linked", "tags", "names", "own", "main")

    def __init__(self, text: str, linked: int, tags: frozenset, names: frozenset, own: str, main: int):
        self.text, self.linked, self.tags, self.names, self.own, self.main = text, linked, tags, names, own, main


class Open:
    """The open elements (tag, ancestors' tags, ancestors' names, label, inside a link), and for every tag and for blocks the
    places where they are open, so that no end tag is searched for."""

    def __init__(self):
        self.stack = [("", frozenset(), frozenset(), -1, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, element: tuple) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        if element[0] not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.places[self.stack.pop()[0]].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, tags) -> int:
        """Place of the innermost open one of ``tags``; 0 if none is."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def blocks(page: str | None, tags: frozenset | None = None, names: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order. Of their ancestors' tags and names only those in ``tags`` and ``names`` are carried along (all
    without them), so that what a block carries is bounded by what a model knows."""
    out: list[Block] = []
    now, parts, linked = Open(), [], 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                own = now.stack[now.blocks[-1]]
                out.append(Block(text, min(linked, len(text)), own[1], own[2], own[0], own[3]))
            parts, linked = [], 0

    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            if "&" in text:
                text = _html.unescape(text)
            parts.append(text)
            if now.stack[-1][4]:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["part"] or m["raw"] and m["raw"].lower() == "textarea":
                parts.append(" ")
            continue
        tag = tag.lower()
        block = tag not in _INLINE and tag != "br" and tag != "img" and tag != "input"
        if block:
            close()
        if m["end"]:
            kept = now.last(_HEADINGS if tag in _HEADINGS else (tag,))
            # an inline end tag never closes a block
            if kept and (block or now.blocks[-1] < kept):
                now.cut(kept)
            continue
        if tag in _VOID:
            if not block and tag != "wbr":
                parts.append(" ")
            continue
        if block:
            now.cut(now.blocks[-1] + 1)  # a block ends unclosed inline elements
            if now.stack[-1][0] == "p":
                now.cut(len(now.stack) - 1)
            if tag in _CLOSES:
                ends, limit = _CLOSES[tag]
                if (k := now.last(ends)) > now.last(limit):
                    now.cut(k)
        attr, top = m["attr"], now.stack[-1]
        own_names, main = top[2], top[3]
        if attr and block:
            got = {w for a in _ATTR.finditer(attr) for w in _NAMES.findall(a[2].lower()) if names is None or w in names}
            if not got <= own_names:
                own_names = own_names | got
            if lab := _MAIN.search(attr):
                main = int(lab[1])
        if attr.endswith("/") and not block:
            continue
        new = block and tag not in top[1] and (tags is None or tag in tags)
        now.push((tag, top[1] | {tag} if new else top[1], own_names, main, top[4] or tag == "a"))
    close()
    return out


def block_features(found: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    out, n = [], len(found)
    for k, b in enumerate(found):
        t = b.text
        size, words = len(t), t.count(" ") + 1
        share = b.linked / size
        f = ["bias", "own:" + b.own, "chars:%d" % min(9, size.bit_length()), "words:%d" % min(7, words.bit_length()), "link:%d" % int(share * 4 + 0.5)]
        f += ["in:" + x for x in b.tags]
        f += ["name:" + x for x in b.names]
        f.append("end:" + (t[-1] if t[-1] in ".!?:;,|" else "other"))
        f.append("commas:%d" % min(3, t.count(",")))
        f.append("place:%d" % (4 * k // n))
        if "©" in t:
            f.append("copyright")
        if t.isupper():
            f.append("upper")
        out.append(f)
    return out


def text_features(found: list[Block]) -> list[list[str]]:
    """Of those features the ones that need no known layout: of the text itself and of parts that are named alike everywhere;
    and the block's share of the page's text."""
    total = sum(len(b.text) for b in found)
    kept = lambda x: not x.startswith(("name:", "own:", "place:", "commas:")) and (not x.startswith("in:") or x[3:] in _PARTS)
    return [[*filter(kept, f), "share:%d" % (5 * len(b.text) // total)] for f, b in zip(block_features(found), found, strict=True)]


def train(pages: list[str], epochs: int = EPOCHS, decay: float = 1e-3, features=block_features) -> tuple[dict[str, float], np.ndarray]:
    """Weights of the features (for main against not) and the 2 x 2 transition weights."""
    chains = [(features(b), [max(0, x.main) for x in b]) for p in pages if (b := blocks(p))]
    names: dict[str, int] = {}
    for fs, _ in chains:
        for f in fs:
            for x in f:
                names.setdefault(x, len(names))
    longest, n = max(len(y) for _, y in chains), len(chains)
    row, col, gold, live = [], [], np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for c, (fs, y) in enumerate(chains):
        gold[c, : len(y)], live[c, : len(y)] = y, True
        for k, f in enumerate(fs):
            row += [c * longest + k] * len(f)
            col += [names[x] for x in f]
    row, col = np.array(row), np.array(col)
    w, tr = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    total = live.sum()
    pairs = live[:, 1:] & live[:, :-1]
    seen_pairs = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, epochs + 1):
        s = np.bincount(row, w[col], n * longest).reshape(n, longest)
        emit = np.stack([np.zeros_like(s), s], 2)
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = emit[:, 0]
        for k in range(1, longest):
            now = emit[:, k] + np.logaddexp(fwd[:, k - 1, :1] + tr[0], fwd[:, k - 1, 1:] + tr[1])
            fwd[:, k] = np.where(live[:, k, None], now, fwd[:, k - 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            nxt = emit[:, k + 1] + bwd[:, k + 1]
            now = np.logaddexp(tr[:, 0] + nxt[:, :1], tr[:, 1] + nxt[:, 1:])
            bwd[:, k] = np.where(live[:, k + 1, None], now, 0)
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * live
        g = np.bincount(col, (p1 - gold * live).ravel()[row], len(names)) / total + decay * w / 10
        joint = np.exp(fwd[:, :-1, :, None] + tr + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        gt = (joint.sum(axis=(0, 1)) - seen_pairs) / total + decay * tr / 10
        for x, d, a, b in ((w, g, 0, 1), (tr, gt, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * d
            moments[b] = 0.99 * moments[b] + 0.01 * d * d
            x -= 0.15 * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    return {x: float(w[k]) for x, k in names.items()}, tr


def decode(found: list[Block], weights: dict[str, float], tr: np.ndarray, features=block_features) -> list[int]:
    """Labels by Viterbi; ties go to not main."""
    if not found:
        return []
    (t00, t01), (t10, t11) = tr.tolist()
    get = weights.get
    a = b = 0.0
    back = []
    for k, f in enumerate(features(found)):
        s = 0.0
        for x in f:
            s += get(x, 0.0)
        if k:
            from0, from1 = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10), (0, a + t01) if a + t01 >= b + t11 else (1, b + t11)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1] + s
        else:
            a, b = 0.0, s
    label = int(b > a)
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def known(weights: dict[str, float]) -> tuple[frozenset, frozenset]:
    """Tags and names that the weights tell apart."""
    return tuple(frozenset(x[len(kind) :] for x in weights if x.startswith(kind)) for kind in ("in:", "name:"))


def main_text(page: str | None, model: tuple[dict[str, float], np.ndarray], names: tuple[frozenset, frozenset] | None = None, plain: tuple[dict[str, float], np.ndarray] | None = None) -> str:
    """Where the field finds nothing, one of the text's own features (``plain``) is asked, and then the block that holds most of
    the page's unlinked text is taken, if it has PROSE words."""
    found = blocks(page, *(names or known(model[0])))
    labels = decode(found, *model)
    if plain and not any(labels):
        labels = decode(found, *plain, text_features)
        if not any(labels) and found:
            most = max(range(len(found)), key=lambda k: len(found[k].text) - found[k].linked)
            if found[most].text.count(" ") + 1 >= PROSE and 2 * found[most].linked < len(found[most].text):
                labels[most] = 1
    return " ".join(b.text for b, y in zip(found, labels) if y)


@lru_cache(maxsize=2)
def default_model(pages: int = TRAIN_PAGES) -> tuple[dict[str, float], np.ndarray]:
    """Fitted once in a driver; the same pages give the same weights."""
    from .labelled_pages import page

    return train([page(k) for k in range(pages)])


@lru_cache(maxsize=2)
def plain_model(pages: int = TRAIN_PAGES) -> tuple[dict[str, float], np.ndarray]:
    """The field for pages on which the other finds nothing."""
    from .labelled_pages import page

    return train([page(k) for k in range(pages)], features=text_features)


def extract(df: DataFrame, model: tuple[dict[str, float], np.ndarray] | None = None, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row."""
    shared = df.sparkSession.sparkContext.broadcast((model or default_model(), plain_model()))  # a few hundred weights

    def run(batches):
        model, plain = shared.value
        names = known(model[0])
        for b in batches:
            texts = [main_text(h, model, names, plain) for h in b[html]]
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    kind = df.schema["page_id"].dataType.simpleString()
    return map_batches(need(df, "page_id", "url", html), run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
