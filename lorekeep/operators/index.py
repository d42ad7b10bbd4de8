"""Lexical index: postings, statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set, tokens

#: A table of query terms is broadcast up to this many bytes; beyond, joins shuffle.
BROADCAST_BYTES = 16 << 20

K1, B = 1.2, 0.75
FIELDS = ("title", "body", "symbol")


def unit_text() -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "symbol", "body")])


def postings(units: DataFrame) -> DataFrame:
    """term, ku_id, field, tf. A term is a token of ``functions.text.tokens`` (an underscore joins, it doesn't split)."""
    each = units.select("ku_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("x"))
    terms = each.select("ku_id", "x.field", F.explode_outer(tokens("x.text")).alias("term")).where("term IS NOT NULL")
    return terms.groupBy("term", "ku_id", "field").agg(F.count("*").alias("tf"))


def inverted(units: DataFrame) -> DataFrame:
    """term, ku_id, field as a set: the fallback index."""
    each = units.select("ku_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("x"))
    return each.select("ku_id", "x.field", F.explode_outer(token_set("x.text")).alias("term")).where("term IS NOT NULL")


def lexical_index(units: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, ku_id, tf, dl: the stored index that rankings read. dl is the unit's length in tokens.

    Each unit also has a row without a term, so that the corpus' statistics come from the index. With ``terms`` (term,
    distinct and few enough to broadcast) other terms are left out before the shuffle; the statistics are whole all the same.
    """
    # the length is taken before the explode: after it, every exploded row would carry the array along
    sized = units.select("ku_id", tokens(unit_text()).alias("t")).select("ku_id", F.size("t").alias("dl"), "t")
    none = F.array(F.lit(None).cast("string"))
    each = sized.select("ku_id", "dl", F.explode(F.concat("t", none)).alias("term"))
    if terms is not None:
        asked = terms.select("term", F.lit(True).alias("__asked"))
        each = each.join(F.broadcast(asked), "term", "left").where("__asked OR term IS NULL")
    return each.groupBy("term", "ku_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def refreshed(existing: DataFrame, changed: DataFrame, make=postings) -> DataFrame:
    """An index (``make``: postings or lexical_index) with the rows of the changed units made anew."""
    return existing.join(changed.select("ku_id").distinct(), "ku_id", "left_anti").select(*existing.columns).unionByName(make(changed))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len; from a lexical index."""
    return index.where("term IS NULL").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term (distinct) of queries (query_id, query)."""
    return queries.select("query_id", F.explode(token_set("query")).alias("term"))


def small(terms: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all of query_id and term fit into ``limit`` bytes; one aggregation over the queries."""
    return terms.agg(F.coalesce(F.sum(F.octet_length("term") + F.octet_length(F.col("query_id").cast("string")) + 32), F.lit(0))).first()[0] <= limit


def sent(df: DataFrame, yes: bool) -> DataFrame:
    return F.broadcast(df) if yes else df


def bm25(index: DataFrame, queries: DataFrame, few: bool | None = None) -> DataFrame:
    """query_id, ku_id, score (lower is better) from a lexical index: idf ln((N-df+.5)/(df+.5)), floored at 1e-6 if not
    positive. Only the postings of terms that are asked for are read further than the statistics."""
    terms = query_terms(queries)
    few = small(terms) if few is None else few
    found = index.join(sent(terms.select("term").distinct(), few), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.crossJoin(F.broadcast(corpus_stats(index))).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "avg_len")  # one row of statistics
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    scored = found.join(sent(weight, few), "term").select("term", "ku_id", part.alias("part"))
    both = scored.join(sent(terms, few), "term")
    return both.groupBy("query_id", "ku_id").agg(F.round(-F.sum("part"), 9).alias("score"))  # rounded: the order of a sum decides no tie


def jaccard_hits(units: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, ku_id, relevance (Jaccard of the token sets) for every pair with a shared term.

    Shared terms are counted in a join of terms; the sets themselves aren't shuffled.
    """
    terms = query_terms(queries)
    few = small(terms)
    asked = queries.select("query_id", F.size(token_set("query")).alias("qn"))
    sized = units.select("ku_id", token_set(unit_text()).alias("t")).select("ku_id", F.size("t").alias("un"), "t")
    each = sized.select("ku_id", "un", F.explode_outer("t").alias("term"))
    both = each.join(sent(terms, few), "term").groupBy("query_id", "ku_id").agg(F.count("*").alias("n"), F.first("un").alias("un"))
    return both.join(sent(asked, few), "query_id").select("query_id", "ku_id", (F.col("n") / (F.col("qn") + F.col("un") - F.col("n"))).alias("relevance"))


def distinct_term_hits(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, ku_id, hits: how many distinct query terms a unit holds."""
    return query_terms(queries).join(index.select("term", "ku_id").distinct(), "term").groupBy("query_id", "ku_id").agg(F.count("*").alias("hits"))
