"""Joining many rows to a lookup when one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the ``lookup`` row of their key; the lookup has one row per key.

    Adaptive execution splits a hot partition only where both sides of a join are shuffled for it.
    A lookup that has just been aggregated by the key already has its partitioning and would not
    be, and then a hot key would go to one task. The hash as a further key, equal whenever the
    keys are, has the lookup shuffled again: one short row per key.
    """
    left = rows.withColumn("_hash", F.xxhash64(*keys))
    right = lookup.withColumn("_hash", F.xxhash64(*keys))
    return left.join(right, [*keys, "_hash"], how).drop("_hash")
