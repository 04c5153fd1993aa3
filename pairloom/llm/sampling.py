"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str | Column, max_rows: int) -> DataFrame:
    """All rows if there are at most max_rows, else those of one bucket of hashes of key, of max_rows rows or somewhat fewer
    on average. Never more than max_rows: a bucket that holds more by chance loses those of the highest hashes; rows of one
    key are told apart by their other columns, so the sample is the same every time.

    What is gathered depends on max_rows alone, not on the number of rows or tasks.
    """
    buckets = max(1, -(-df.count() // max_rows))
    hashed = df.withColumn("hash_", F.xxhash64(key)).where(F.pmod("hash_", F.lit(buckets)) == 0)
    return hashed.orderBy("hash_", F.xxhash64(*df.columns)).limit(max_rows).drop("hash_")
