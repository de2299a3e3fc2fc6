"""Joins of a large table with a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on `key`, one lookup row per key.

    Adaptive execution chooses from measured shuffle sizes: it broadcasts a small lookup, and splits the partition of a key
    that holds many rows of the big side. Null keys match nothing.
    """
    return big.join(lookup, key, how)
