"""Key-value state as a fold over an append-only log of (seq, op, txn, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PAGES, SLOTS = 1024, 64


def latest(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """The last value written to each key: one partial aggregate, no sort."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def get(state: DataFrame, keys: DataFrame, missing: int = 0) -> DataFrame:
    """Each asked key with its value, or the value for a miss."""
    return keys.join(state, "key", "left").select(*keys.columns, F.coalesce("value", F.lit(missing)).alias("value"))


def key_range(state: DataFrame, low: int, high: int, ordered: bool = False) -> DataFrame:
    found = state.where(F.col("key").between(low, high))
    return found.orderBy("key") if ordered else found


def page_of(key) -> F.Column:
    return F.floor((key % (PAGES * SLOTS)) / SLOTS).cast("long")


def by_page(frame: DataFrame, partitions: int, key: str = "key", seq: str = "seq") -> DataFrame:
    """Rows of one page together, in order of arrival within each page."""
    return frame.withColumn("page", page_of(F.col(key))).repartition(partitions, "page").sortWithinPartitions("page", seq)


def replay(log: DataFrame) -> DataFrame:
    """State after a log without transaction ids: WRITE counts at once; TXN counts when the next COMMIT comes, at its
    place; what no COMMIT follows is dropped.

    The commit after each row comes from a bucketed running minimum: within buckets of the sequence by a window, across
    buckets by the buckets' own first commits, so that no task sees the whole log.
    """
    size = 1 << 16
    rows = log.withColumn("_bucket", F.floor(F.col("seq") / size))
    commit = F.when(F.col("op") == "COMMIT", F.col("seq"))
    inside = F.min(commit).over(Window.partitionBy("_bucket").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    firsts = rows.groupBy("_bucket").agg(F.min(commit).alias("_first"))
    after = F.min("_first").over(Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
    later = firsts.select("_bucket", after.alias("_later"))
    placed = rows.withColumn("_inside", inside).join(F.broadcast(later), "_bucket")
    effect = F.when(F.col("op") == "WRITE", F.col("seq")).when(F.col("op") == "TXN", F.coalesce("_inside", "_later"))
    counted = placed.withColumn("_effect", effect).where("_effect IS NOT NULL")
    return counted.groupBy("key").agg(F.max_by("value", F.struct("_effect", "seq")).alias("value"))


def replay_by_transaction(log: DataFrame) -> DataFrame:
    """State after a log whose rows name their transaction: a TXN row counts if its own transaction committed."""
    commits = log.where("op = 'COMMIT'").groupBy("txn").agg(F.max("seq").alias("_effect"))
    written = log.where("op = 'WRITE'").select("key", "value", "seq", F.col("seq").alias("_effect"))
    staged = log.where("op = 'TXN'").join(commits, "txn").select("key", "value", "seq", "_effect")
    return written.union(staged).groupBy("key").agg(F.max_by("value", F.struct("_effect", "seq")).alias("value"))


def checksum(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("checksum"))


def fingerprint(frame: DataFrame, column: str) -> DataFrame:
    """A column's checksum, the same in any order and on any level of storage: the sum of 60 bits of each value's hash.
    NULL adds nothing; repeated values count each time."""
    bits = F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 15), 16, 10)
    return frame.agg(F.coalesce(F.sum(bits.cast("decimal(28,0)")), F.lit(0)).cast("string").alias("checksum"))
