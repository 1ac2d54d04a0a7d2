"""Bounded samples by hash, to fit routes and centroids on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, column: str, n: int, most: int) -> DataFrame:
    """About ``most`` of the ``n`` distinct values of a column, those with the lowest hashes, and never twice as many.

    A filter on the hash's range: every task gives its own part only, unlike a sorted limit of which each gives all.
    """
    if n <= most:
        return df.limit(2 * most)
    top = int(-(2**63) + most / n * 2**64)
    return df.filter(hashed(column) < F.lit(top)).limit(2 * most)


def hashed(column: str) -> Column:
    return F.xxhash64(F.lit(20240229), column)
