"""Deterministic pseudo-random columns: the same row gets the same value in every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(key: Column, salt: str) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of md5(key || salt)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def wide_hash(key: Column, salt: str) -> Column:
    """Integer in [0, 2^52) as a double, for orderings that should have next to no ties."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
