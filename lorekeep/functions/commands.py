"""Command lines: canonical form, hashes and tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIRM_FLAGS = ("--yes", "-y")


def normalize(argv: Column, names: tuple[str, ...]) -> Column:
    """Drops the head if it, or its base name, is one of the binary's names, and exact confirm flags anywhere."""
    head = F.get(argv, F.lit(0))
    base = F.element_at(F.split(head, "/"), -1)
    tail = F.when(head.isin(*names) | base.isin(*names), F.slice(argv, F.lit(2), F.greatest(F.size(argv), F.lit(1)))).otherwise(argv)
    return F.filter(F.coalesce(tail, F.array().cast("array<string>")), lambda t: ~t.isin(*CONFIRM_FLAGS))


def argv_hash(normalized: Column) -> Column:
    return F.sha2(F.array_join(normalized, "\n"), 256)


def confirm_token(key: bytes, action_id: Column, hash_: Column, issued_at: Column, ttl: Column) -> Column:
    """Unpadded URL-safe HMAC-SHA256 of what the token binds."""

    @F.pandas_udf("string")
    def run(payload: pd.Series) -> pd.Series:
        mac = lambda p: base64.urlsafe_b64encode(hmac.new(key, p.encode(), hashlib.sha256).digest()).decode().rstrip("=")
        return payload.map(lambda p: None if p is None else mac(p))

    return run(F.concat_ws("|", action_id, hash_, issued_at.cast("string"), ttl.cast("string")))


def gate_token(key: bytes, payload: Column) -> Column:
    """Hex HMAC-SHA256."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest())

    return run(payload)
