"""Mixing sources to target token weights by entropy balancing (operator 6). DataFrame functions only.

Among all rates r_d >= 0, entropy balancing takes those nearest to 1 in Kullback-Leibler divergence, weighted by a
document's words, that meet the token constraints: for each family of constraints (here one, the sources) the words of each
category equal a target. The optimum is an exponential tilt, r_d = exp(sum of the lambdas of d's categories), and lambda
solves the convex dual sum_d size_d r_d - sum_c lambda_c target_c. Documents with the same categories have the same rate,
so they are first summed into cells by one distributed aggregation; every Newton iteration then is a job over the cells: it
sums their tilted words by category, which gives gradient and Hessian (diagonal within a family), and steps family by family
until the gradient's largest part, relative to its target, is below TOLERANCE. Steps are no longer than 1 in lambda.

Targets of sources: in code-point order, null last, they weigh 5, 2, 1, repeating, and share all words; a target stops at 3
times its source's words and the excess is shared again by weight until none is above (a few sums over the sources).

Rates become copies by systematic rounding: a cell's documents, largest first, get floor(rate) copies each, and the k-th
gets one more where round(k * rest) goes up. As sizes only fall, what a cell takes differs from its words times its rate by
half of its largest document at most (summation by parts). Places k come from a range-partitioned sort, so neither a
hot source nor any other group meets in one task; the only window without a key is over one row per partition.

Null or blank texts have size 0 and are taken 0 times; null sources are one source; ties of size go by doc_id, null first,
and equal rows are interchangeable; repeated rows count each; an empty table gives none. Reruns agree: sizes and places are
whole numbers and the order is fixed. doc_id may have any type that can be ordered; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, need, table

WEIGHTS = (5, 2, 1)
CEILING = 3
TOLERANCE, ROUNDS = 1e-12, 500
#: What is added before rounding down, so that the last bits of a rate decide nothing.
EDGE = 1e-6


def sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (words)."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return need(df, "doc_id", "source", text).select("doc_id", "source", F.size(words).cast("long").alias("size"))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in the order, from 0. A range-partitioned sort; places are per partition, then shifted."""
    low = (1 << 33) - 1  # monotonically_increasing_id: partition above, row of the partition below
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftrightunsigned("__at", 33))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row per partition
    place = (F.col("__before") + F.col("__at").bitwiseAND(F.lit(low))).alias(name)
    return dealt.join(F.broadcast(before), "__part").select(*df.columns, place)


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ranked(per, F.col("source").asc_nulls_last())
    per = cut(per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")))
    total, left = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    spent, large = 0, "decimal(19,0)"
    while True:
        # a source is full if its weight's share of what the full ones leave is above CEILING times its words
        full = (F.col("source_size") * CEILING).cast(large) * F.lit(left).cast(large) < F.lit(total - spent).cast(large) * F.col("weight").cast(large)
        now = per.agg(F.coalesce(F.sum(F.when(full, F.col("source_size") * CEILING)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if tuple(now) == (spent, left):
            break
        spent, left = now
    level = F.lit(float(total - spent)) * F.col("weight") / F.lit(left)
    return per.select("source", "source_size", F.when(full, F.col("source_size") * float(CEILING)).otherwise(level).alias("target"))


def balance(cells: DataFrame, targets: dict[str, DataFrame], size: str = "size") -> DataFrame:
    """``cells`` with rate: the tilt that meets every target. targets: by column of ``cells`` a family of constraints, a
    DataFrame of that column's values (null is one) and their target. Values without a target or words have rate 0.

    Families must agree in their total. If no rates meet all targets, an error is raised after ROUNDS iterations.
    """
    tilted = cells.withColumn("__log", F.lit(0.0)).withColumn("__live", F.col(size) > 0)
    for c, t in targets.items():
        goal = t.select(F.col(c).alias("__of"), F.col("target").cast("double").alias(f"__t_{c}"))
        tilted = tilted.join(goal, F.col(c).eqNullSafe(F.col("__of")), "left").drop("__of")
        tilted = tilted.withColumn("__live", F.col("__live") & (F.coalesce(F.col(f"__t_{c}"), F.lit(0.0)) > 0))
    tilted = cut(tilted)
    words = F.when(F.col("__live"), F.col(size) * F.exp("__log")).otherwise(0.0)
    worst = 0.0
    for _ in range(ROUNDS):
        tilted = tilted.withColumn("__off", F.lit(0.0))
        for c in targets:
            sums = tilted.groupBy(F.col(c).alias("__of")).agg(F.sum(words).alias("__s"))
            tilted = tilted.join(sums, F.col(c).eqNullSafe(F.col("__of"))).drop("__of")
            # Newton: gradient over Hessian, both from the category's tilted words
            gradient = F.when(F.col("__live"), F.col(f"__t_{c}") - F.col("__s")).otherwise(0.0)
            step = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.when(F.col("__live"), gradient / F.col("__s")).otherwise(0.0)))
            off = F.when(F.col("__live"), F.abs(gradient) / F.col(f"__t_{c}")).otherwise(0.0)
            tilted = tilted.withColumn("__off", F.greatest("__off", off)).withColumn("__log", F.col("__log") + step).drop("__s")
        tilted = cut(tilted)
        worst = tilted.agg(F.coalesce(F.max("__off"), F.lit(0.0))).first()[0]
        if worst <= TOLERANCE:
            return tilted.select(*cells.columns, F.when(F.col("__live"), F.exp("__log")).otherwise(0.0).alias("rate"))
    raise ValueError(f"the targets can't be met together: off by {worst:.3g}")


def mix(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of ``df``."""
    sized = cut(sizes(df, text))
    per = cut(source_targets(sized))
    rates = balance(per.withColumnRenamed("source_size", "size"), {"source": per.select("source", "target")})
    rates = rates.select(F.col("source").alias("__of"), F.col("size").alias("source_size"), "target", F.least(F.lit(float(CEILING)), "rate").alias("rate"))
    each = sized.join(rates, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    placed = ranked(each.where("size > 0"), F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_first(), name="place")
    first = placed.groupBy(F.col("source").alias("__of")).agg(F.min("place").alias("first"))
    placed = placed.join(first, F.col("source").eqNullSafe(F.col("__of"))).withColumn("k", F.col("place") - F.col("first") + 1)
    base = F.floor(F.col("rate") + 1e-9)
    rest = F.greatest(F.lit(0.0), F.col("rate") - base)
    upto = lambda k: F.floor(rest * k + 0.5 + EDGE)
    out = placed.withColumn("copies", (base + upto(F.col("k")) - upto(F.col("k") - 1)).cast("int"))
    names = ("doc_id", "source", "size", "source_size", "target", "rate", "copies")
    out = out.select(*names).unionByName(each.where("size = 0").withColumn("copies", F.lit(0)).select(*names))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: One family of constraints has a closed form, rate = target / words; the method above is held against it.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, (sum(s) OVER ())::BIGINT AS total FROM per
), prefix AS (
  SELECT *, coalesce(3 * sum(s) OVER (ORDER BY 3 * s / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
         (sum(w) OVER (ORDER BY 3 * s / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lft FROM weighed
), level AS (
  SELECT spent AS c, lft AS l FROM prefix WHERE 3 * s * lft >= (total - spent) * w ORDER BY 3 * s / w, rank LIMIT 1
), targets AS (
  SELECT source, s, CASE WHEN 3 * s * l < (total - c) * w THEN 3.0::DOUBLE * s ELSE (total - c)::DOUBLE * w / l END AS target FROM prefix, level
), rates AS (
  SELECT *, CASE WHEN s > 0 THEN least(3.0, target / s) ELSE 0.0 END AS rate FROM targets
), each AS (
  SELECT d.doc_id, d.size, r.s, r.target, floor(r.rate + 1e-9) AS base, greatest(0.0, r.rate - floor(r.rate + 1e-9)) AS rest,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST, d.rid) AS k
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, s AS source_size, target,
       (size * (base + floor(rest * k + 0.5 + 1e-6) - floor(rest * (k - 1) + 0.5 + 1e-6)))::BIGINT AS taken FROM each
"""
