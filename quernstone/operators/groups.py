"""Group operators that SQL has no single word for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dense_groups(grouped: DataFrame, key: str, groups: int, zero: list[str]) -> DataFrame:
    """One row for each key 0..groups-1; absent groups have 0 in the columns named in zero and NULL in the others."""
    every = grouped.sparkSession.range(groups).select(F.col("id").alias(key))
    whole = every.join(grouped, key, "left")
    return whole.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in zero else F.col(f"`{c}`") for c in grouped.columns if c != key])


def top_groups(grouped: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The n groups with the largest values, ties by key; NULL never ranks."""
    return grouped.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), key).limit(n)


def latency_buckets(frame: DataFrame, column: str) -> DataFrame:
    """Counts by floor(log2(x + 1)) with running totals, as a histogram of latencies keeps them."""
    from pyspark.sql import Window

    counts = frame.groupBy(F.floor(F.log2(F.col(column) + 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bucket", "n", F.sum("n").over(Window.orderBy("bucket")).alias("so_far"))
