"""A stored lexical index in immutable segments, and exact top-k rankings that skip most of it.

A segment numbers its units by length (a range-partitioned sort), so that 2^SLOT_BITS neighbours, a slot, are alike in length.
Its postings are blocks of one term and slot: the largest tf, the least lengths, the number of postings, and the postings as
arrays. ``terms`` holds the same for a term's whole list, ``units`` the ids, lengths and terms of units. ``doc`` is
segment << SEGMENT_BITS | number; slots are docs without their last SLOT_BITS bits.

A refresh writes a segment of the changed units and tombstones for their former rows, with what those take from the terms'
counts; a merge rewrites the live units of all segments as one. All become visible with the manifest (``sources.versions``).

BM25 in three steps, for all queries at once, each exact:
 1. Blocks with the highest bounds of the strongest terms give partial scores; a query's k-th best of these is its threshold.
 2. The weakest terms that together stay far under the threshold can't make a hit by themselves: their lists aren't opened.
    Blocks of the other terms whose slot can't reach the threshold (sum of the terms' bounds there, plus the weak terms' bounds) are
    left, the rest is scored.
 3. The threshold has grown by what has been scored; the few units that can still reach it get their weak terms from their own
    list of terms.

Jaccard is a prefix-filter join with a threshold that grows: first in the rarest terms' blocks, those of the shortest units first, then,
with exact values of the best of these, in all of the prefix that the threshold leaves; a term at place p of the frequency
order is read only in units short enough to reach the threshold with what follows p.

An index can be written without blocks, in one pass without a shuffle of its units. Its rankings read all units' own terms
(``scan``): for one ranking of many queries, as the blocks cost more to make than such a pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import cut
from ..sources.versions import Folder
from . import scan
from .index import K1, B, query_terms, sent, small, unit_text

SLOT_BITS, SEGMENT_BITS = 6, 56
#: Numbers of live segments; a merge frees them.
SEGMENTS = 1 << (63 - SEGMENT_BITS)
#: Blocks and postings that a query opens at first, if these give enough units.
SEED_BLOCKS, SEED_POSTINGS = 512, 1024
#: Terms are weak up to this share of the threshold together: the smaller, the more postings are opened and the fewer units are
#: left to be looked into.
WEAK_SHARE = 0.2
#: Added to thresholds, so that scores rounded to 9 digits stay comparable.
SLACK = 1e-8

# --- writing --------------------------------------------------------------------------------------------------------------


def _sized(units: DataFrame) -> DataFrame:
    """ku_id, dl (tokens), un (distinct tokens), terms, tfs."""
    return scan.counted(units.select("ku_id", tokens(unit_text()).alias("t")))


def _lists(units: DataFrame) -> DataFrame:
    """term, df, max_tf, min_dl from the units' own terms; summed per task before anything moves."""
    each = units.select("dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "dl")
    return each.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def _numbered(sized: DataFrame, segment: int) -> DataFrame:
    """With ``doc``, ascending in length. To be stored before it is read twice."""
    return sized.repartitionByRange("dl", "ku_id").sortWithinPartitions("dl", "ku_id").withColumn("doc", F.monotonically_increasing_id() + F.lit(segment << SEGMENT_BITS))


def slot(doc: Column) -> Column:
    return F.shiftright(doc, SLOT_BITS)


def _blocks(units: DataFrame) -> DataFrame:
    """term, slot, n, max_tf, min_dl, min_un, docs, tfs, dls, uns."""
    each = units.select("doc", "dl", "un", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "doc", "dl", "un")
    g = each.groupBy("term", slot(F.col("doc")).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("doc", "tf", "dl", "un"))).alias("p"))
    return g.select("term", "slot", F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.dl").alias("min_dl"), F.array_min("p.un").alias("min_un"), F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), F.col("p.un").alias("uns"))


def _write_segment(folder: Folder, sized: DataFrame, segments: list[dict], blocks: bool) -> dict:
    number = min(set(range(SEGMENTS)) - {x["number"] for x in segments}, default=None)
    if number is None:
        raise ValueError(f"{SEGMENTS} segments are in use: merge them first")
    spark, name = sized.sparkSession, folder.fresh("segment")
    at = f"{folder.path}/{name}"
    if blocks:
        _numbered(sized, number).write.parquet(f"{at}/units")
    else:
        sized.withColumn("doc", F.monotonically_increasing_id() + F.lit(number << SEGMENT_BITS)).write.parquet(f"{at}/units")
    stored = spark.read.parquet(f"{at}/units")
    if blocks:
        # within a file the terms are in order, so a filter on terms skips pages and row groups
        _blocks(stored).sortWithinPartitions("term", "slot").write.parquet(f"{at}/blocks")
        per = spark.read.parquet(f"{at}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    else:
        per = _lists(stored)
    per.sortWithinPartitions("term").write.parquet(f"{at}/terms")
    n = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len")).first()
    return {"name": name, "number": number, "units": n["n"], "tokens": n["len"]}


def write_index(units: DataFrame, path: str, blocks: bool = True) -> dict:
    """A new index over ``units`` (ku_id unique, title, symbol, body) in place of whatever the folder held; refreshes and merges
    keep to its choice of ``blocks``."""
    folder = Folder(units.sparkSession, path)
    before = folder.state()
    made = _write_segment(folder, _sized(units), before.get("segments", []), blocks)
    return folder.publish({"segments": [made], "dead": [], "blocks": blocks}, before["version"])


def passing_index(units: DataFrame) -> Index:
    """An index without blocks for one ranking: the units' terms are kept in the shared folder while a plan reads them."""
    sized = cut(_sized(units).withColumn("doc", F.monotonically_increasing_id()))
    n = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len")).first()
    return Index(sized, None, _lists(sized), None, n["n"], n["len"])


def refresh_index(changed: DataFrame, path: str, removed: DataFrame | None = None) -> dict:
    """The units of ``changed`` replace those of their ids, those of ``removed`` (ku_id) go. Writes the changed units' segment and
    tombstones; of the old segments only ids are read, and the terms of units that go."""
    spark = changed.sparkSession
    folder = Folder(spark, path)
    before = folder.state()
    ids = changed.select("ku_id") if removed is None else changed.select("ku_id").union(removed.select("ku_id"))
    ids = ids.select(F.col("ku_id").cast("string").alias("ku_id")).distinct()
    old = open_index(spark, path, before).units.join(ids, "ku_id", "left_semi").select("ku_id", "doc", "dl", "terms")
    name = folder.fresh("dead")
    old.write.parquet(f"{folder.path}/{name}/units")
    gone = spark.read.parquet(f"{folder.path}/{name}/units")
    gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder.path}/{name}/terms")
    n = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len")).first()
    dead = [*before["dead"], {"name": name, "units": n["n"], "tokens": n["len"]}]
    made = _write_segment(folder, _sized(changed), before["segments"], before.get("blocks", True))
    return folder.publish(before | {"segments": [*before["segments"], made], "dead": dead}, before["version"])


def merge_index(spark: SparkSession, path: str) -> dict:
    """All live units as one segment, numbered by length again; no text is read or tokenised."""
    folder = Folder(spark, path)
    before = folder.state()
    made = _write_segment(folder, open_index(spark, path, before).units.drop("doc"), before["segments"], before.get("blocks", True))
    return folder.publish(before | {"segments": [made], "dead": []}, before["version"])


# --- reading --------------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """units: ku_id, doc, dl, un, terms, tfs of live units. blocks: all, or None where there are none. terms: term, df, max_tf, min_dl of live units (max_tf
    and min_dl may still be those of dead ones: bounds). dead: doc."""

    units: DataFrame
    blocks: DataFrame | None
    terms: DataFrame
    dead: DataFrame | None
    n_docs: int
    n_tokens: int

    def live(self, df: DataFrame) -> DataFrame:
        return df if self.dead is None else df.join(self.dead, "doc", "left_anti")


def open_index(spark: SparkSession, path: str, state: dict | None = None) -> Index:
    folder = Folder(spark, path)
    s = state or folder.state()
    if not s.get("segments"):
        raise FileNotFoundError(f"no index in {path}")
    read = lambda kind, part: spark.read.parquet(*[f"{folder.path}/{x['name']}/{part}" for x in s[kind]])
    units, terms = read("segments", "units"), read("segments", "terms")
    dead = None
    if s["dead"]:
        dead = read("dead", "units").select("doc")
        units = units.join(dead, "doc", "left_anti")
        less = read("dead", "terms").select("term", (-F.col("df")).alias("df"), F.lit(0).alias("max_tf"), F.lit(None).cast("int").alias("min_dl"))
        terms = terms.unionByName(less)
    total = lambda k: sum(x[k] for x in s["segments"]) - sum(x[k] for x in s["dead"])
    return Index(units, read("segments", "blocks") if s.get("blocks", True) else None, terms, dead, total("units"), total("tokens"))


# --- rankings -------------------------------------------------------------------------------------------------------------


def _asked(ix: Index, queries: DataFrame) -> tuple[DataFrame, bool]:
    """query_id, term, df, max_tf, min_dl of all query terms (null where no live unit has the term), kept for the steps."""
    terms = query_terms(queries)
    few = small(terms)
    per = ix.terms.join(sent(terms.select("term").distinct(), few), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).where("df > 0")
    return cut(terms.join(sent(per, few), "term", "left")), few


def _opened(blocks: DataFrame) -> DataFrame:
    """A row for every posting of the blocks, behind their other columns."""
    rest = [c for c in blocks.columns if c not in ("docs", "tfs", "dls", "uns")]
    return blocks.select(*rest, F.explode(F.arrays_zip("docs", "tfs", "dls", "uns")).alias("p")).select(*rest, F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), F.col("p.uns").alias("un"))


def _with_terms(ix: Index, found: DataFrame) -> DataFrame:
    """``found`` (query_id, doc, ...) with the units' terms, tfs and lengths. Few units are found, so their rows are what moves: they
    are broadcast, or a filter of their docs is applied before the units are dealt."""
    return ix.units.select("doc", "dl", "un", "terms", "tfs").join(found, "doc")


def _seed(before: Column, k: int) -> Column:
    """Whether a term, behind terms of ``before`` postings, is opened at first: while the postings are too few to hold some k
    units, whatever its own list's length, else if its list is short."""
    return (before < 4 * k) | (before + F.col("df") <= SEED_POSTINGS)


def _above(scored: DataFrame, k: int, least: str, most: str) -> DataFrame:
    """Rows of (query_id, ...) whose ``most`` reaches the query's k-th greatest ``least``: others can't be among the best k."""
    w = W.partitionBy("query_id")
    floors = _kth(scored.select("query_id", least), k, least).withColumnRenamed("floor", "__floor")
    return scored.join(F.broadcast(floors), "query_id", "left").where(F.col("__floor").isNull() | (F.col(most) >= F.col("__floor") - SLACK)).drop("__floor")


def _kth(scored: DataFrame, k: int, by: str) -> DataFrame:
    """query_id, floor: the k-th best value of queries that have so many."""
    w = W.partitionBy("query_id").orderBy(F.col(by).desc())
    return scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min(by)).alias("floor"))


def _best(ix: Index, scored: DataFrame, k: int, value: Column) -> DataFrame:
    """query_id, ku_id, value, rank of the k best (greatest ``value``; ties by ku_id). Ids are read for those only that tie or win."""
    w = W.partitionBy("query_id")
    top = scored.select("query_id", "doc", value.alias("value")).withColumn("__r", F.rank().over(w.orderBy(F.col("value").desc()))).where(F.col("__r") <= k).drop("__r")
    named = ix.units.select("doc", "ku_id").join(top, "doc")
    return named.withColumn("rank", F.row_number().over(w.orderBy(F.col("value").desc(), "ku_id"))).where(F.col("rank") <= k).select("query_id", "ku_id", "value", "rank")


def bm25_part(tf: Column, dl: Column, avg: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))


def bm25_best(ix: Index, queries: DataFrame, k: int, seen: list | None = None) -> DataFrame:
    """query_id, ku_id, score (lower is better, rounded to 9 digits), lex_rank: the best k of ``index.bm25``, by the three steps
    above. ``seen`` gets (step, blocks) frames of what is opened, for measurements."""
    asked, few = _asked(ix, queries)
    n, avg = float(ix.n_docs), F.lit(ix.n_tokens / max(1, ix.n_docs))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if ix.blocks is None:
        terms = asked.where("df IS NOT NULL").select("query_id", "term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), F.lit(0.0).alias("qn"))
        best = scan.best(ix.units, terms, k, ix.n_tokens / max(1, ix.n_docs))
        return best.select("query_id", "ku_id", (-F.col("value")).alias("score"), F.col("rank").alias("lex_rank"))
    part = lambda tf, dl: F.col("idf") * bm25_part(tf, dl, avg)
    weighed = asked.where("df IS NOT NULL").withColumn("idf", F.when(idf > 0, idf).otherwise(1e-6)).withColumn("most", part(F.col("max_tf"), F.col("min_dl"))).drop("max_tf", "min_dl")
    w = W.partitionBy("query_id")

    # 1: the strongest terms; of their blocks those with the highest bounds
    strong = weighed.withColumn("__before", F.sum("df").over(w.orderBy(F.col("most").desc(), "term")) - F.col("df")).where(_seed(F.col("__before"), k))
    bound = part(F.col("max_tf"), F.col("min_dl"))
    seeds = ix.blocks.join(sent(strong.select("query_id", "term", "idf"), few), "term").withColumn("__r", F.row_number().over(w.orderBy(bound.desc(), "term", "slot"))).where(F.col("__r") <= SEED_BLOCKS)
    first = ix.live(_opened(seeds).select("query_id", "doc", part(F.col("tf"), F.col("dl")).alias("part"))).groupBy("query_id", "doc").agg(F.sum("part").alias("s"))
    floors = _kth(first, k, "s")

    # 2: weak terms are the ones whose bounds add up to a small share of the threshold
    ranked = weighed.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    ranked = cut(ranked.withColumn("__upto", F.sum("most").over(w.orderBy("most", "term"))).withColumn("weak", F.col("__upto") < WEAK_SHARE * F.col("floor")).withColumn("rest", F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))).over(w), F.lit(0.0))))
    open_ = ix.blocks.join(sent(ranked.where("NOT weak").select("query_id", "term", "idf", "floor", "rest"), few), "term")
    reach = open_.repartition("query_id", "slot").withColumn("__reach", F.sum(bound).over(W.partitionBy("query_id", "slot")) + F.col("rest")).where("__reach >= floor")
    scored = _opened(reach.drop("__reach")).groupBy("query_id", "slot", "doc").agg(F.sum(part(F.col("tf"), F.col("dl"))).alias("s"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    scored = cut(ix.live(scored.where("s + rest >= floor")).select("query_id", "doc", "s", (F.col("s") + F.col("rest")).alias("most")))
    left = _above(scored, k, "s", "most")  # the threshold has grown: s holds all of the strong terms

    # 3: only what can still win gets its weak terms, from the unit's own list
    weak = ranked.where("weak").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("weak"))
    whole = _with_terms(ix, left.join(sent(weak, few), "query_id", "left"))
    at = lambda x: F.array_position("terms", x["term"])
    more = lambda x: F.when(at(x) > 0, x["idf"] * bm25_part(F.try_element_at("tfs", at(x).cast("int")), F.col("dl"), avg)).otherwise(0.0)
    total = whole.select("query_id", "doc", (F.col("s") + F.aggregate(F.coalesce("weak", F.array().cast(weak.schema["weak"].dataType)), F.lit(0.0), lambda a, x: a + more(x))).alias("s"))
    if seen is not None:
        seen += [("seeds", seeds.select("query_id", "term", "n")), ("open", reach.select("query_id", "term", "n")), ("candidates", left.select("query_id", "doc"))]
    best = _best(ix, total, k, F.round("s", 9))
    return best.select("query_id", "ku_id", (-F.col("value")).alias("score"), F.col("rank").alias("lex_rank"))


def jaccard_best(ix: Index, queries: DataFrame, k: int, seen: list | None = None) -> DataFrame:
    """query_id, ku_id, relevance (Jaccard of the token sets), rank: the best k of the units that share a term."""
    asked, few = _asked(ix, queries)
    w = W.partitionBy("query_id")
    if ix.blocks is None:
        terms = asked.withColumn("qn", F.count("*").over(w)).where("df IS NOT NULL").select("query_id", "term", F.lit(1.0).alias("idf"), "qn")
        return scan.best(ix.units, cut(terms), k, None).select("query_id", "ku_id", F.col("value").alias("relevance"), "rank")
    asked = asked.select("query_id", "term", F.coalesce("df", F.lit(0)).alias("df")).withColumn("qn", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("df", "term")) - 1)
    asked = cut(asked.withColumn("before", F.sum("df").over(w.orderBy("place")) - F.col("df")))
    alike = lambda n: n / (F.col("qn") + F.col("un") - n)

    lists = asked.groupBy("query_id").agg(F.collect_list("term").alias("asked"))

    def exact(found: DataFrame) -> DataFrame:
        """query_id, doc, j of rows (query_id, doc, qn), from the unit's own terms."""
        whole = _with_terms(ix, found.select("query_id", "doc", "qn").join(sent(lists, few), "query_id"))
        return whole.select("query_id", "doc", alike(F.size(F.array_intersect("terms", "asked"))).alias("j"))

    # the rarest terms' blocks, of one term those of the shortest units first; the most promising of these units get exact values
    rare = asked.where(_seed(F.col("before"), k)).select("query_id", "term", "qn", "place")
    seeds = ix.blocks.join(sent(rare, few), "term").withColumn("__r", F.row_number().over(w.orderBy("place", "min_un", "slot"))).where(F.col("__r") <= SEED_BLOCKS)
    first = ix.live(_opened(seeds)).groupBy("query_id", "slot", "doc").agg(F.count("*").alias("n"), F.first("un").alias("un"), F.first("qn").alias("qn"))
    first = first.withColumn("j", alike(F.col("n"))).withColumn("__r", F.row_number().over(w.orderBy(F.col("j").desc(), "doc"))).where(F.col("__r") <= 16 * k)
    floors = _kth(exact(first), k, "j")

    # n shared terms give j >= floor only if n >= floor / (1 + floor) * (qn + un); from place p on at most qn - p are shared
    grown = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    grown = grown.withColumn("longest", F.when(F.col("floor") <= 0, F.lit(float("inf"))).otherwise((F.col("qn") - F.col("place")) * (1 + F.col("floor")) / F.col("floor") - F.col("qn")))
    prefix = cut(grown.where("longest >= 1 AND df > 0").select("query_id", "term", "qn", "floor", "longest"))
    found = ix.blocks.join(sent(prefix, few), "term").where("min_un <= longest")
    each = _opened(found).where("un <= longest").groupBy("query_id", "slot", "doc").agg(F.count("*").alias("n"), F.first("un").alias("un"), F.first("qn").alias("qn"), F.first("floor").alias("floor"))
    # the places that weren't read for a unit of this length may all hold shared terms
    share = F.when(F.col("floor") > 0, F.col("floor") / (1 + F.col("floor"))).otherwise(0.0)
    unread = F.greatest(F.lit(0), F.col("qn") - 1 - F.floor(F.col("qn") - (F.col("un") + F.col("qn")) * share - 1e-9))
    each = ix.live(each).withColumn("least", alike(F.col("n"))).withColumn("most", alike(F.least(F.col("n") + unread, F.col("un"), F.col("qn"))))
    left = cut(_above(cut(each.where("most >= floor")), k, "least", "most"))
    if seen is not None:
        seen += [("seeds", seeds.select("query_id", "term", "n")), ("open", found.select("query_id", "term", "n")), ("candidates", left.select("query_id", "doc"))]
    best = _best(ix, exact(left), k, F.round("j", 12))
    return best.select("query_id", "ku_id", F.col("value").alias("relevance"), "rank")
