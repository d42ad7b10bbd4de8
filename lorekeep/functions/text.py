"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{FAFF}]"
_WORD = "[A-Za-z0-9_]+"
#: At every ideograph with a neighbour behind it the pair, at one without neighbours itself, at a word the word.
_TOKEN = f"(?=({CJK}{{2}}|(?<!{CJK}){CJK}(?!{CJK})|{_WORD}))(?:{_WORD}|{CJK})"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trims all Unicode white space, not spaces only."""
    return F.regexp_replace(col(x), r"(?U)^[\s\x1C-\x1F\x85]+|[\s\x1C-\x1F\x85]+$", "")


def blank(x: Column | str) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def tokens(x: Column | str) -> Column:
    """Overlapping pairs of each ideographic run (a single one as itself) and lower-cased word runs, in order, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(_TOKEN), F.lit(1))
    return F.transform(found, lambda t: F.translate(t, _UPPER, _UPPER.lower()))


def token_set(x: Column | str) -> Column:
    return F.array_distinct(tokens(x))


def match_expression(x: Column | str) -> Column:
    """Distinct tokens in order, quoted, joined by OR."""
    return F.array_join(F.transform(token_set(x), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def share_found(query: Column, text: Column) -> Column:
    """Share of the query's token set in the text's; 0 if either is empty."""
    return F.when((F.size(query) == 0) | (F.size(text) == 0), 0.0).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def coverage(draft: Column, corpus: Column) -> Column:
    """Share of the draft's token set in the corpus': 1 for an empty draft, else 0 for an empty corpus."""
    return F.when(F.size(draft) == 0, 1.0).when(F.size(corpus) == 0, 0.0).otherwise(F.size(F.array_intersect(draft, corpus)) / F.size(draft))


def entropy(x: Column | str) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    text = F.coalesce(col(x), F.lit(""))
    n = F.length(text)

    def term(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(F.transform(chars, term), F.lit(0.0), lambda a, b: a + b)


def content_hash(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def unit_id(source_type: Column, ref: Column, symbol: Column, hash_: Column) -> Column:
    """Deterministic id of a knowledge unit from what identifies its source."""
    seed = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source_type, ref, symbol, hash_)])
    return F.concat(F.lit("KU-"), F.substring(F.sha1(seed), 1, 16))


def question_fingerprint(title: Column | str) -> Column:
    """Sorted distinct title tokens joined by a bar."""
    return F.array_join(F.array_sort(token_set(title)), "|")


def answer_hash(body: Column | str) -> Column:
    """Hash of a body with outer white space cut and inner collapsed: equal answers, equal hashes."""
    return F.sha2(F.regexp_replace(strip(F.coalesce(col(body), F.lit(""))), r"(?U)\s+", " "), 256)


def first_heading(x: Column | str, fallback: Column) -> Column:
    """The first level-1 Markdown heading."""
    found = F.regexp_extract(col(x), r"(?m)^\s*#\s+(.+?)\s*$", 1)
    return F.when(found == "", fallback).otherwise(found)


def compatible(x: Column) -> Column:
    """Unicode compatibility composition; the JVM has no function for it."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return run(x)


def slug(x: Column | str, separator: str = "-") -> Column:
    """Anchor of a heading: letters, digits, underscores, hyphens and ideographs stay, white space becomes the separator."""
    kept = F.regexp_replace(F.lower(strip(compatible(col(x)))), r"(?U)[^\w\-\s]", "")
    sep = re.escape(separator)
    one = F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", separator), f"(?:{sep}){{2,}}", separator)
    bare = F.regexp_replace(one, f"^(?:{sep})+|(?:{sep})+$", "")
    return F.when(bare == "", "section").otherwise(bare)


def timestamp_text(x: Column, millis: bool = False) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def has_marker(x: Column | str, markers: tuple[str, ...]) -> Column:
    """Whether any marker is a substring, case ignored."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, F.lower(m)))


def citation_line(source_type: Column, authority: Column, freshness: Column, kind: Column, ref: Column, score: Column) -> Column:
    return F.format_string("[%s/%s/%s] %s:%s score=%.3f", source_type, authority, freshness, kind, ref, score)
