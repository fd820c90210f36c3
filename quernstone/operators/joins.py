"""Equi-joins by row numbers, and the count of a join without its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..catalog import RID


def join_pairs(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """left_row, right_row of every match; repeated keys give every combination."""
    a = left.select(F.col(left_key).alias("_a"), F.col(RID).alias("left_row"))
    b = right.select(F.col(right_key).alias("_b"), F.col(RID).alias("right_row"))
    return a.join(b, F.col("_a") == F.col("_b")).select("left_row", "right_row")


def join_rows(left: DataFrame, left_key: str, right: DataFrame, right_key: str, left_column: str, right_column: str) -> DataFrame:
    """The two columns of every match, by right row, then left row."""
    a = left.select(F.col(left_key).alias("_a"), F.col(RID).alias("_l"), F.col(left_column).alias("_x"))
    b = right.select(F.col(right_key).alias("_b"), F.col(RID).alias("_r"), F.col(right_column).alias("_y"))
    found = a.join(b, F.col("_a") == F.col("_b")).orderBy("_r", "_l")
    return found.select(F.col("_x").alias(left_column), F.col("_y").alias(right_column if right_column != left_column else f"{right_column}_right"))


def join_count(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """How many rows the join has: both sides are counted by key first, so no repeated key meets another as rows."""
    a = left.groupBy(F.col(left_key).alias("_a")).agg(F.count(F.lit(1)).alias("_m"))
    b = right.groupBy(F.col(right_key).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    return a.join(b, F.col("_a") == F.col("_b")).agg(F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0)).alias("n"))


def gather(frame: DataFrame, column: str, rows: DataFrame) -> DataFrame:
    """place, value of the rows with the numbers in rows(place, row), in that order; numbers may repeat."""
    found = rows.join(frame.select(RID, F.col(column).alias("value")), F.col("row") == F.col(RID), "left")
    return found.select("place", F.when(F.col(RID).isNull(), F.raise_error(F.lit("no such row"))).otherwise(F.col("value")).alias("value")).orderBy("place")


def matching_rows(frame: DataFrame, condition, limit: int | None = None) -> DataFrame:
    """Numbers of the first rows that match, in row order."""
    found = frame.where(condition).select(RID).orderBy(RID)
    return found if limit is None else found.limit(limit)


def encode_dictionary(frame: DataFrame, column: str) -> DataFrame:
    """value, code of every distinct string; a code is the value's rank in byte order. Ranks come from a range sort and
    partition sizes, so no single task sees all values."""
    from ..catalog import numbered

    values = frame.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")
    return numbered(values).select("value", F.col(RID).alias("code"))


def encode_values(frame: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Adds code by a dictionary of encode_dictionary(); a string that it lacks has the dictionary's size as code."""
    known = codes.select(F.col("value").alias("_value"), "code")
    return frame.join(known, F.col(column) == F.col("_value"), "left").withColumn("code", F.coalesce("code", F.lit(codes.count()))).drop("_value")


def decode_values(frame: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds value by the column code; a code that the dictionary lacks is the empty string."""
    return frame.join(codes.select("code", "value"), "code", "left").withColumn("value", F.coalesce("value", F.lit("")))
