"""Sensitivity labels: a total order, in which an unknown label is the strictest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..enums import TAINTS


def rank(label: Column) -> Column:
    """0 CLEAN, 1 INTERNAL, 2 SENSITIVE or anything else."""
    return F.when(label == "CLEAN", 0).when(label == "INTERNAL", 1).otherwise(2)


def of_rank(r: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TAINTS)), r + 1)


def strictest(*labels: Column) -> Column:
    """The maximum of single labels; CLEAN without any."""
    if not labels:
        return F.lit("CLEAN")
    return of_rank(F.greatest(F.lit(0), *map(rank, labels)))


def strictest_of(array: Column) -> Column:
    """The maximum of an array of labels; CLEAN if it is empty or null."""
    ranks = F.transform(F.coalesce(array, F.array().cast("array<string>")), rank)
    return of_rank(F.coalesce(F.array_max(ranks), F.lit(0)))


def coerce(label: Column, default: str = "CLEAN") -> Column:
    """Upper-cased label, or the default if it is none of the three (unlike ``rank``, which takes it for SENSITIVE)."""
    up = F.upper(label)
    return F.when(up.isin(*TAINTS), up).otherwise(F.lit(default))


def external_safe(label: Column) -> Column:
    return F.coalesce(label, F.lit("SENSITIVE")) == "CLEAN"
