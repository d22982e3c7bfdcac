"""Bounded, repeatable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 1) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; all rows if there are fewer."""
    count = df.count()
    if count <= bound:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 32)) / float(1 << 32)
    return df.filter(share < bound / count)
