"""License scans as an exact set-similarity join of templates with text blocks (operator 1).

Tokens are ordered by how many lines of the whole corpus hold them, rare ones first. A template t with containment
threshold c must share need = ceil(c |t|) tokens with a block, so one of its first |t| - need + 1 tokens in that order is in
the block (prefix filter), the block has at least ``need`` of the templates' tokens (length filter), and after a shared
token at places i and j at most min(|t| - i, |block| - j) more can follow (positional filter). Survivors are counted
exactly. Two kinds of template share this join:

* phrases: the block is a whole text and the threshold 1; a check of the word order then finds all places of the phrase;
* notices: blocks are the text's lines and, as a notice may be wrapped, all runs of as many words as the template has,
  whatever lines they lie in; the threshold is CONTAINMENT.

Templates are few and fixed, so their tokens' frequencies are small to broadcast; texts are read twice and never shuffled.
Null texts are empty and have no words. Ties of frequency go by token. Repeated rows report alike; very long texts are
scanned whole; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, deque
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_word_lines, ascii_words, map_batches, need, table

CONTAINMENT = 0.8

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The method's own labels: opening words of public licenses and usual notices.
NOTICES = {
    "this work is licensed under the gnu general public license": "notice-gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "notice-gpl",
    "licensed under the apache license version 2 0": "notice-apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "notice-mit",
    "released under the mit license": "notice-mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "notice-bsd",
    "this work is licensed under a creative commons attribution 4 0 international license": "notice-cc",
    "licensed under cc by 4 0": "notice-cc",
    "this document is in the public domain": "notice-public-domain",
}


class Templates:
    """Templates with their tokens in global order and their filters."""

    def __init__(self, texts: dict[str, str], threshold: float, counts: dict[bytes, int]):
        self.order = {w: k for k, w in enumerate(sorted({w for t in texts for w in ascii_words(t)}, key=lambda w: (counts.get(w, 0), w)))}
        self.rows, self.index = [], {}
        for t, label in texts.items():
            ids = sorted({self.order[w] for w in ascii_words(t)})
            least = ceil(threshold * len(ids) - 1e-9)
            for place in range(len(ids) - least + 1):
                self.index.setdefault(ids[place], []).append((len(self.rows), place))
            self.rows.append((ids, least, label, ascii_words(t)))
        self.prefix = frozenset(w for w, k in self.order.items() if k in self.index)

    def match(self, block: list[bytes] | set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        if not self.prefix.intersection(block):
            return []
        get = self.order.get
        ids = sorted({k for w in block if (k := get(w)) is not None})
        size, shared = len(ids), Counter()
        for j, k in enumerate(ids):
            for r, i in self.index.get(k, ()):
                tokens, least = self.rows[r][0], self.rows[r][1]
                if size >= least and shared[r] + min(len(tokens) - i, size - j) >= least:
                    shared[r] += 1
        have, out = set(ids), []
        for r in sorted(shared):
            tokens, least = self.rows[r][0], self.rows[r][1]
            n = sum(k in have for k in tokens)
            if n >= least:
                out.append((r, n / len(tokens)))
        return out


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every start of the phrase's words in a row."""
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def spans(words: list[bytes], tokens: frozenset[bytes], width: int, least: int) -> list[tuple[int, int, int]]:
    """Runs of at most ``width`` words, from a token to a token, with at least ``least`` of them: first word, last word, how many."""
    have, open_, out = Counter(), deque(), []
    for k, w in enumerate(words):
        if w not in tokens:
            continue
        open_.append(k)
        have[w] += 1
        while open_[0] <= k - width:
            first = words[open_.popleft()]
            have[first] -= 1
            if not have[first]:
                del have[first]
        if len(have) >= least:
            out.append((open_[0], k, len(have)))
    return out


def line_counts(df: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many lines of all texts each token of the templates stands. Counted per task, then summed."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b[text]:
                for words in ascii_word_lines(t):
                    seen.update(vocabulary.intersection(words))
        yield {"token": list(seen), "n": list(seen.values())}

    got = map_batches(need(df, text), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in got}


def license_scan(df: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = CONTAINMENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks: the lines that met a notice, or in which a wrapped one starts.

    score: the best containment met (1 for a phrase), else 0. blocks: array<struct<line, label, containment>>.
    """
    counts = line_counts(df, frozenset(w for t in [*phrases, *notices] for w in ascii_words(t)), text)

    def run(batches):
        whole, lines = Templates(phrases, 1.0, counts), Templates(notices, threshold, counts)
        out_names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
        for b in batches:
            rows = []
            for t in b[text]:
                parts = ascii_word_lines(t)
                words = [w for p in parts for w in p]
                starts, base, blocks, single = [], set(), [], []
                for r, _ in whole.match(words):
                    if got := places(words, whole.rows[r][3]):
                        starts += got
                        base.add(whole.rows[r][2])
                for n, p in enumerate(parts):
                    for r, c in lines.match(p):
                        blocks.append({"line": n, "label": lines.rows[r][2], "containment": c})
                        single.append((n, r))
                best = max((x["containment"] for x in blocks), default=0.0)
                if len(parts) > 1 and (wide := lines.match(words)):
                    line = [n for n, p in enumerate(parts) for _ in p]
                    for r, _ in wide:
                        ids, least, label, ws = lines.rows[r]
                        met, runs = {n for n, k in single if k == r}, {}
                        for i, j, c in spans(words, frozenset(ws), len(ws), least):
                            best = max(best, c / len(ids))
                            if met.isdisjoint(range(line[i], line[j] + 1)):  # not what a line has reported by itself
                                runs[line[i]] = max(runs.get(line[i], 0), c)
                        blocks += [{"line": n, "label": label, "containment": c / len(ids)} for n, c in runs.items()]
                labels = base | {x["label"] for x in blocks}
                score = 1.0 if base else best
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks))
            yield {key: b[key]} | dict(zip(out_names, zip(*rows)))

    kind = df.schema[key].dataType.simpleString()
    return map_batches(need(df, key, text), run, f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:int,label:string,containment:double>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    phrase = " UNION ALL ".join(f"SELECT '{label}' AS label, {quoted(ascii_words(p))} AS ws" for p, label in PHRASES.items())
    notice = " UNION ALL ".join(f"SELECT '{label}' AS label, {quoted(sorted(set(ascii_words(t))))} AS ws, {len(ascii_words(t))} AS width" for t, label in NOTICES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {fold} AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS words FROM d),
phrase AS ({phrase}), notice AS ({notice}),
hit AS (
  SELECT rid, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(ws)] = ws)) AS pos FROM w, phrase WHERE list_has_all(words, ws)
),
line AS (SELECT rid, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{word}')) AS lw FROM w),
met AS (
  SELECT rid, label, len(list_intersect(ws, lw))::DOUBLE / len(ws) AS c FROM line, notice
  WHERE len(list_intersect(ws, lw)) >= ceil({CONTAINMENT} * len(ws) - 1e-9)
),
near AS (SELECT rid, label, ws, width, words FROM w, notice WHERE len(list_intersect(ws, words)) >= ceil({CONTAINMENT} * len(ws) - 1e-9)),
run AS (SELECT rid, label, len(list_intersect(ws, words[i + 1 : i + width]))::DOUBLE / len(ws) AS c, len(ws) AS n FROM (SELECT *, unnest(range(greatest(1, len(words) - width + 1))) AS i FROM near)),
spanned AS (SELECT rid, label, c FROM run WHERE c * n >= ceil({CONTAINMENT} * n - 1e-9) - 1e-6),
base AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM (SELECT rid, label, 1.0::DOUBLE AS c FROM hit UNION ALL SELECT * FROM met UNION ALL SELECT * FROM spanned) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(every.score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""


ORACLE_SQL = _sql()
